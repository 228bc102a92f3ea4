"""JSON lines with a checked schema: bad rows come back with a reason; and their writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "__bad"


def _fits(line: Column, schema: StructType) -> Column:
    """Whether a line that is an object gives every field of ``schema`` its type, or leaves it out."""
    wide = StructType([*schema.fields, StructField(_BAD, StringType())])
    return F.from_json(line, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})[_BAD].isNull()


def reason(line: Column, schema: StructType, required: Sequence[str] = ()) -> Column:
    """Why a line is no row of ``schema``, null where it is one: ``not_json``, ``not_an_object``, or the ``type:`` and ``missing:`` of its fields in order.

    Fields that the schema lacks are ignored. A required field must be there
    and not null; the others may be absent or null.
    """
    # As the one element of a list: what stands behind the first value of a line would be read over otherwise.
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("\n]")))
    element = lambda k: F.try_variant_get(listed, f"$[{k}]", "variant")
    kind = F.schema_of_variant(element(0))
    # Fields are looked at one by one only where the whole line does not fit.
    wrong = F.when(_fits(line, schema), F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(*[F.when(~_fits(line, StructType([f])), f"type:{f.name}") for f in schema.fields]))
    )
    absent = F.array_compact(F.array(*[F.when(F.get_json_object(line, f"$['{name}']").isNull(), f"missing:{name}") for name in required])) if required else F.array().cast("array<string>")
    found = F.concat(wrong, absent)
    return F.when(element(0).isNull() | element(1).isNotNull(), "not_json").when(~kind.startswith("OBJECT"), "not_an_object").when(F.size(found) > 0, F.array_join(found, ","))


def checked(rows: DataFrame, line: str, schema: StructType, required: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``parsed``, a struct of ``schema``, and ``reason``; one of the two is null. A null line is ``not_json``."""
    why = F.coalesce(reason(F.col(line), schema, required), F.when(F.col(line).isNull(), "not_json"))
    out = rows.withColumn("reason", why)
    return out.withColumn("parsed", F.when(F.col("reason").isNull(), F.from_json(line, schema)))


def read(spark: SparkSession, path: str, schema: StructType, required: Sequence[str] = ()) -> DataFrame:
    """(fields of ``schema``, reason, line): every line under ``path`` that is not blank; files are split like any text.

    A good line has its fields and no reason, a bad one its text and a reason.
    """
    lines = spark.read.text(path).where("trim(value) != ''")
    out = checked(lines, "value", schema, required)
    return out.select("parsed.*", "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("line"))


def write(rows: DataFrame, path: str, version: str, place: str, split: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Writes ``rows`` as JSON lines under ``path``/rows and their summary under ``path``/meta; returns the summary, one row.

    The summary has the version, the row count, the distinct places in order,
    and a count for each of ``splits``. Null fields are left out of a line.
    """
    rows.write.mode("overwrite").json(f"{path}/rows")
    meta = rows.agg(
        F.lit(version).alias("dataset_version"), F.count("*").alias("n"), F.lit("jsonl").alias("format"), F.array_sort(F.collect_set(place)).alias("places"),
        F.struct(*[F.count_if(F.col(split) == s).alias(s) for s in splits]).alias("splits"),
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return rows.sparkSession.read.schema(meta.schema).json(f"{path}/meta")

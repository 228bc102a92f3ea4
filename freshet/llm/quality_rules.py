"""Quality rules with thresholds that adapt to each language and source, in DataFrames throughout.

Whole texts give counts (words, symbols, repeated lines and windows) and from
them whole-number rates. A rate's distribution is kept as a mergeable quantile
sketch: counts in bins that are exact below 64 and keep six significant bits
above, so a quantile is off by 1/32 at most, at any size of value. Sketches
merge by adding counts; a group of fewer than ``min_group`` documents uses its
language's, and a small language the corpus's. Texts that fail the base rule
take no part.

A threshold lies beyond a group's tenth or last tenth by ``spread`` times the
distance from its median to there, and by a small guard for rates that are
constant. A text is kept if no rate lies beyond its group's thresholds, which
are joined back.

KLL sketches are not used since their quantiles differ from run to run, and a
lost executor would change verdicts.

Defined results: a null or blank text has no words and fails the base rule; a
text of any length is counted whole; a null language or source is a group of
its own; repeated rows each count; a rate at a threshold is kept; an empty
table gives no rows. Windows of three words are told apart by their 64-bit
XXH64, so two different ones of one text are taken as equal with a chance of
about the square of their number in 2^65.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import BLANKS, blanked, scratch

#: Rates (see ``rates``) and their guards.
GUARDS = {"symbol_rate": 50, "dup_line_rate": 1000, "repeat_rate": 100, "word_length": 100}
#: The rates that have a lower threshold too.
BOTH_TAILS = ("word_length",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPREAD, MIN_GROUP, BROADCAST_ROWS = 4, 100, 50_000


def windows(w: Column) -> Column:
    """The 3-word windows of ``w`` as (hash, place), sorted by hash, so that equal ones are neighbours."""
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))
    return F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))


def repeat_words(w: Column, ranked: Column) -> Column:
    """Words in windows that occur twice or more; ``ranked``: the column of ``windows(w)``."""
    near = lambda k: F.get(ranked, k)["h"]  # noqa: E731  null beyond the ends
    again = F.filter(ranked, lambda x, k: F.coalesce(x["h"] == near(k - 1), F.lit(False)) | F.coalesce(x["h"] == near(k + 1), F.lit(False)))
    places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(F.size(w) >= 4, F.size(F.array_distinct(places))).otherwise(0)


def with_counts(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the base counts of the whole text, and n_lines, each a long."""
    whole = F.coalesce(text, F.lit(""))
    out = rows.withColumn("spaced", blanked(text, BLANKS.replace("\n", "")))
    out = out.withColumn("w", F.array_remove(F.split(F.replace(F.col("spaced"), F.lit("\n"), F.lit(" ")), " "), ""))
    full = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("full", full).withColumn("ranked", windows(F.col("w")))
    bare = F.replace(F.replace(F.col("spaced"), F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
    counts = {
        "n_words": F.size("w"), "word_chars": F.length(bare), "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("full") - F.size(F.array_distinct("full")), "n_lines": F.size("full"), "n_repeat_words": repeat_words(F.col("w"), F.col("ranked")),
    }
    return out.withColumns({k: c.cast("long") for k, c in counts.items()}).drop("spaced", "w", "full", "ranked")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Whole numbers: per ten thousand characters, lines and words; thousandths of a character a word."""
    per = lambda a, n, unit: F.floor(unit * a / F.greatest(n, F.lit(1)))
    return {
        "symbol_rate": per(F.col("n_symbols"), F.col("word_chars"), 10_000), "dup_line_rate": per(F.col("n_dup_lines"), F.col("n_lines"), 10_000),
        "repeat_rate": per(F.col("n_repeat_words"), F.col("n_words"), 10_000), "word_length": per(F.col("word_chars"), F.col("n_words"), 1000),
    }


def bin_of(value: Column) -> Column:
    """The least value of the bin of a whole number from 0: itself below 64, else its six leading bits."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, rate, bin, n): mergeable by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bin_of(F.col(k)).alias("bin")) for k in GUARDS]))
    rows = counted.where(~base_failed()).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), each.alias("e"))
    return rows.groupBy("lang", "source", "e.rate", "e.bin").agg(F.count("*").alias("n"))


def quantiles(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, docs, q10, q50, q90) of the sketches merged to ``keys``."""
    merged = sketched.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    cum = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("cum", cum).withColumn("docs", F.sum("n").over(group))
    at = lambda q: F.min(F.when(100 * F.col("cum") >= q * F.col("docs"), F.col("bin")))
    return ranked.groupBy(*keys, "rate").agg(F.max("docs").alias("docs"), *[at(q).alias(f"q{q}") for q in (10, 50, 90)])


def thresholds(sketched: DataFrame, spread: int = SPREAD, guards: Mapping[str, int] = GUARDS, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <rate>_least, <rate>_most): each group's thresholds, from the nearest merged sketch that is large enough."""
    guard = F.create_map(*[F.lit(x) for kv in guards.items() for x in kv])[F.col("rate")]
    ends = F.struct((F.col("q10") - spread * (F.col("q50") - F.col("q10")) - guard).alias("least"), (F.col("q90") + spread * (F.col("q90") - F.col("q50")) + guard).alias("most"))
    own = quantiles(sketched, ["lang", "source"]).select("lang", "source", "rate", "docs", ends.alias("own"))
    lang = quantiles(sketched, ["lang"]).select(F.col("lang").alias("l2"), F.col("rate").alias("r2"), F.col("docs").alias("lang_docs"), ends.alias("of_lang"))
    whole = quantiles(sketched, []).select(F.col("rate").alias("r3"), ends.alias("of_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rate") == F.col("r2"))).join(whole, F.col("rate") == F.col("r3"))
    chosen = F.when(F.col("docs") >= min_group, F.col("own")).when(F.col("lang_docs") >= min_group, F.col("of_lang")).otherwise(F.col("of_all"))
    picked = lambda k, end: F.max(F.when(F.col("rate") == k, F.col(f"chosen.{end}"))).alias(f"{k}_{end}")
    return joined.withColumn("chosen", chosen).groupBy("lang", "source").agg(*[picked(k, end) for k in guards for end in ("least", "most")])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ("*",), **options) -> DataFrame:
    """(row, counts, base_failed, kept) for each row of ``docs``; ``row`` holds the columns in ``carry``."""
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = scratch(with_counts(rows, F.col("text")).withColumns(rates()).drop("text"), "counts")
    limits = scratch(thresholds(sketch(counted), **options).withColumnsRenamed({"lang": "l", "source": "s"}), "thresholds")
    if limits.count() <= BROADCAST_ROWS:  # else an ordinary join
        limits = F.broadcast(limits)
    joined = counted.join(limits, counted["lang"].eqNullSafe(F.col("l")) & counted["source"].eqNullSafe(F.col("s")), "left")
    beyond = F.lit(False)
    for k in GUARDS:
        beyond = beyond | F.coalesce(F.col(k) > F.col(f"{k}_most"), F.lit(False))
    for k in BOTH_TAILS:
        beyond = beyond | F.coalesce(F.col(k) < F.col(f"{k}_least"), F.lit(False))
    return joined.select("row", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~beyond).alias("kept"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judge(docs, **options).where("kept").select("row.*")

"""Line dedup by a deletion-neighbourhood join, in DataFrames throughout.

A line is its sequence of words. A line of ``exact_words`` or more goes if an
equal line stands earlier in the order (id, line number), and one of
``min_words`` or more also if such a line within one word edit (a word
replaced, added or removed) does. Without ``exact_words`` it is ``min_words``;
the registered query and the pipeline take 1, so short lines go by equality
alone. Lines without words stay.

Equal lines are grouped by MD5. For near ones every line would emit itself and
each variant with one word deleted as hashed keys; lines within one edit share
such a key. First, an exact filter: of two lines within one edit, either the
first or the last words are equal (pigeonhole), so only lines that share such
a half with another emit variants. Keys are position-wise XOR hashes, so all
variants of a line come from two running XORs and long lines stay linear.
Per key only the earliest line is kept and joined back, never all pairs of a
group; equal variants at one position are one replacement apart, a variant
equal to a whole line one deletion apart, and the words themselves verify it.

Defined results: a null text stays null and an empty one empty; a text whose
lines all go becomes empty, its row stays; texts and lines of any length are
taken whole. Rows with one id and equal text are
judged alike, so that repeated rows don't remove each other's lines. Ties
cannot occur otherwise. An empty table gives no rows. Variants meet by 64-bit
keys and are verified word by word; were two different ones to share a key, an
earlier line could hide behind another, so that one too many would stay, never
one too few.

Lines, halves, variants and earliest lines that hold more than a thousandth of
their rows are joined by broadcast of those keys, so that no task meets all
rows of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import discard, hot_keys, hottest, join_few, join_hot, only_near, scratch


def lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, id, at, line, n): every line of ``min_words`` words, its words joined by single spaces, by row signature, id and line number from 0.

    With ``wanted``, a written table, rows whose ``doc`` it lacks may be left out.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Texts are signed and spaced once, ahead of the explode.
    rows = rows.select(signature(F.col("id"), F.col("text")).alias("doc"), "id", "text")
    if wanted is not None:
        rows = only_near(rows, F.xxhash64("doc"), wanted, F.xxhash64("doc"))
    spaced = rows.select("doc", "id", single_spaced(F.col("text")).alias("text"))
    each = spaced.select("doc", "id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    each = each.where("line != ''")
    return each.withColumn("n", F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= min_words)


def single_spaced(text: Column) -> Column:
    """The text with one space between the words of a line and none at its ends; most texts are so already."""
    inner = F.regexp_replace(text, r"[\x20\t\x0b\f\r]+", " ")
    odd = text.startswith(" ") | text.endswith(" ")
    for c in ("  ", " \n", "\n ", "\t", "\x0b", "\f", "\r"):
        odd = odd | text.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(inner, r" ?\n ?", "\n"))).otherwise(text)


def signature(doc_id: Column, text: Column) -> Column:
    """Sixteen bytes for a row: its id and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text)))


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and last words such that lines within one edit share at least one.

    Lines of n and n or n + 1 words share the size n//2, rounded down to a
    multiple of four from four on; one edit cannot touch both the first and
    the last so many. A line takes its own size and that of n - 1 words.
    """
    round_down = lambda k: F.when(k < 4, k).otherwise(k - k % 4)
    half, less = round_down(F.floor(n / 2).cast("int")), round_down(F.floor((n - 1) / 2).cast("int"))
    head = lambda size: F.xxhash64(F.lit("head"), size, F.call_function("substring_index", line, F.lit(" "), size))
    tail = lambda size: F.xxhash64(F.lit("tail"), size, F.call_function("substring_index", line, F.lit(" "), -size))
    return F.when(half == less, F.array(head(half), tail(half))).otherwise(F.array(head(half), tail(half), head(less), tail(less)))


def variants(lined: DataFrame) -> DataFrame:
    """(lid, first, key, at): of each line (lid, first, line) the whole (at 0) and each variant without one word."""
    lined = lined.repartition("lid")  # lines move, not their words
    each = lined.withColumn("w", F.split("line", " ")).select("lid", "first", F.size("w").alias("n"), F.posexplode("w").alias("i", "word")).withColumn("i", F.col("i") + 1)
    each = each.withColumn("here", F.xxhash64("word", "i")).withColumn("moved", F.xxhash64("word", F.col("i") - 1)).drop("word")
    line, upto = Window.partitionBy("lid"), Window.partitionBy("lid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("whole", F.bit_xor("here").over(line)).withColumn("moved_all", F.bit_xor("moved").over(line))
    each = each.withColumn("here_to", F.bit_xor("here").over(upto)).withColumn("moved_to", F.bit_xor("moved").over(upto))
    before = F.col("here_to").bitwiseXOR(F.col("here"))
    after = F.col("moved_all").bitwiseXOR(F.col("moved_to"))
    own = F.struct(F.xxhash64(before.bitwiseXOR(after), F.col("n") - 1).alias("key"), F.col("i").alias("at"))
    all_ = F.struct(F.xxhash64("whole", "n").alias("key"), F.lit(0).alias("at"))
    keys = F.when(F.col("i") == 1, F.array(own, all_)).otherwise(F.array(own))
    return each.select("lid", "first", F.explode(keys).alias("k")).select("lid", "first", "k.key", "k.at")


def without(w: Column, at: Column) -> Column:
    """The words without the one at ``at`` (from 1); all of them for 0."""
    return F.when(at == 0, F.array_join(w, " ")).otherwise(F.array_join(F.concat(F.slice(w, 1, at - 1), F.slice(w, at + 1, F.size(w))), " "))


#: Most characters of a line that is broadcast to its many near lines (a thousand such lines at most); longer ones are joined like any other.
SHORT = 10_000


def near_lines(source: DataFrame) -> DataFrame:
    """(lid, kept): lines of ``source`` (lid, first, line) with an earlier line within one edit, and the earliest such."""
    v_all = v = scratch(variants(source), "variants")
    keys = scratch(v.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    v = only_near(v, F.col("key"), keys, F.col("key"))
    mine = F.struct("first", "lid", "at")
    at_place = v.groupBy("key", "at").agg(F.min(mine).alias("least"), F.count("*").alias("c"))
    by_key = at_place.groupBy("key").agg(F.min(F.when(F.col("at") == 0, F.col("least"))).alias("wholes"), F.min(F.when(F.col("at") > 0, F.col("least"))).alias("parts"), F.sum("c").alias("c"))
    shared = at_place.drop("c").join(by_key.where("c > 1").drop("c"), "key")
    best = F.when(F.col("at") == 0, F.col("parts")).otherwise(F.least("least", "wholes"))
    shared = scratch(shared.select("key", "at", best.alias("best")), "shared")
    # Lines of one template share a variant; those are spread, and so are the many near lines of one earliest line below.
    found = join_hot(v, shared, "key", hottest(keys, "key"), ["at"]).where("best.first < first")
    pairs = found.select("lid", F.col("best.lid").alias("other"), F.struct("at", F.col("best.at").alias("other_at")).alias("p"), F.col("best.first").alias("kept"))
    # One place is enough to verify two lines, however many give the same variant: each pair's words move once.
    pairs = scratch(pairs.groupBy("lid", "other", "kept").agg(F.min("p").alias("p")).select("lid", "other", "kept", "p.at", "p.other_at"), "line-pairs")
    w = source.select("lid", F.split("line", " ").alias("w"))
    short = source.where(F.length("line") <= SHORT).select(F.col("lid").alias("other"))
    hot = hot_keys(pairs, "other")
    hot = hot if hot is None else F.broadcast(short.join(hot, "other"))
    checked = join_hot(pairs.join(w, "lid"), w.select(F.col("lid").alias("other"), F.col("w").alias("other_w")), "other", hot)
    checked = checked.where(without(F.col("w"), F.col("at")) == without(F.col("other_w"), F.col("other_at")))
    near = scratch(checked.groupBy("lid").agg(F.min("kept").alias("kept")), "near")
    discard(v_all, keys, shared, pairs)
    return near


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """(doc, at, near): every line to remove; near: for an earlier line within one edit, else an equal one."""
    least = min_words if exact_words is None else min(exact_words, min_words)
    lid, place = F.unhex(F.md5("line")).alias("lid"), F.struct("id", "doc", "at").alias("place")
    halves_of = F.when(F.col("n") >= min_words, half_keys(F.col("line"), F.col("n"))).otherwise(F.array().cast("array<bigint>"))  # none: equal lines only
    seen = scratch(lines(docs, id_col, text_col, least).select(lid, place, halves_of.alias("halves")), "line-places")
    classes = scratch(seen.groupBy("lid").agg(F.min("place").alias("first"), F.count("*").alias("c"), F.first("halves").alias("halves")), "lines")
    # A short stand-in for the line id: two lines with the same one only pass the filter together.
    halves = classes.select(F.xxhash64("lid").alias("short"), F.explode("halves").alias("half"))
    common = scratch(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1"), "halves")
    close = scratch(join_hot(only_near(halves, F.col("half"), common, F.col("half")), common.select("half"), "half", hottest(common, "half")).select("short").distinct(), "close")
    near_classes = only_near(classes, F.xxhash64("lid"), close, F.col("short")).withColumn("short", F.xxhash64("lid")).join(close, "short")
    wanted = scratch(near_classes.select("lid", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "first"), "wanted")
    words_of = lines(docs, id_col, text_col, min_words, wanted).select("doc", "at", "line").join(wanted, ["doc", "at"])
    source = scratch(words_of.groupBy("lid").agg(F.first("first").alias("first"), F.first("line").alias("line")), "near-lines")  # repeated rows: once
    near = near_lines(source)
    judged = scratch(classes.join(near, "lid", "left").where("c > 1 OR kept IS NOT NULL").select("lid", "first", F.col("kept").isNotNull().alias("near")), "judged")
    hot = hottest(classes, "lid")
    discard(classes, common, close, wanted, source, near)
    all_places = join_hot(only_near(seen.select("lid", "place"), F.xxhash64("lid"), judged, F.xxhash64("lid")), judged, "lid", hot)
    return all_places.where(F.col("near") | (F.col("place") != F.col("first"))).select("place.doc", "place.at", "near").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """(row, n_lines, n_exact, n_near): ``row`` holds the columns of ``docs``, its text without the lines that go."""
    gone = duplicates(docs, id_col, text_col, min_words, exact_words).groupBy("doc").agg(F.collect_list("at").alias("gone"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"))
    rows = join_few(docs.select(F.struct("*").alias("row"), signature(F.col(id_col), F.col(text_col)).alias("doc")), scratch(gone, "gone"), "doc")
    text = F.col(f"row.{text_col}")
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    rest = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.col("parts")[i]), "\n"))
    out = rows.withColumn("parts", F.split(text, "\n"))
    return out.select(
        F.col("row").withField(text_col, rest).alias("row"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """``docs`` with the lines removed; ``chars_col``, if there, is set to the new length."""
    out = dedup(docs, id_col, text_col, min_words, exact_words).select("row.*")
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out

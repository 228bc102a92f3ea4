"""Mixing sources to target weights by hierarchical budgeting, in DataFrames throughout.

A token budget goes down a tree, by default domain, language, source. Among
siblings it is shared by weight; one whose subtree cannot take its share
(``max_epochs`` times its tokens) is filled, and the shortage is shared among
its siblings by weight. Since a node's capacity is that of its whole subtree,
a shortage passes to an ancestor's siblings only when its own siblings are
full. A leaf's budget is spent on whole epochs and then on the token prefix of
one more, in an order seeded by (seed, epoch, id): the documents that begin
before the budget is spent.

Tokens are counted once, into a slim table of leaf, order keys and count. A
leaf's prefix comes down to one key: its buckets' sums (4096 at most) say in
which bucket the prefix ends, and only that bucket's rows are put in order.
Rows are then taken by comparing with their leaf's last key, so neither texts
nor a whole leaf go through a shuffle or a window.

Defined results: a null level value is a node of its own, named ``(null)``; a
node that its level's weight table does not list has the least weight listed
there, and 1 where there is no table; a null or blank text has no tokens, and
is taken with the epochs that its place falls in; a text of any length is
counted whole; rows without an id are ordered by their text; rows with equal
id and text are separate documents that follow each other, so of these, too,
only as many are taken as begin before the budget is spent; a weight of zero excludes its subtree; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import scratch, words

#: Production: domain is the source's number modulo 4, as the corpus has no such column.
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.2, "d2": 0.2, "d3": 0.2}
LANG_WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


#: Most leaves whose budgets are broadcast.
BROADCAST_LEAVES = 50_000


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("d"), F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int") % 4)


def n_tokens(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fill(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``nodes`` (cap, weight, budget of the parent) with ``share``: budget by weight, none above cap.

    With nodes in rising order of cap / weight, the water level is the
    greatest of (budget - caps before) / (weights from here on).
    """
    group = Window.partitionBy(*parent)
    rising = group.orderBy(F.col("cap") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, 0)
    level = (F.col("budget") - (F.sum("cap").over(rising) - F.col("cap"))) / (F.sum("weight").over(group) - F.sum("weight").over(rising) + F.col("weight"))
    levels = nodes.where("weight > 0").withColumn("level", level)
    return levels.withColumn("share", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("weight") * F.max("level").over(group)))).drop("level")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget`` in whole tokens."""
    known = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    above = None
    for depth in range(1, len(levels) + 1):
        own, up = list(levels[:depth]), list(levels[: depth - 1])
        table = weights.get(levels[depth - 1], {})
        weight = F.lit(1.0) if not table else F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(levels[depth - 1])], F.lit(min(table.values())))
        nodes = known.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight.cast("double")).withColumn("name", F.col(levels[depth - 1]))
        if above is None:
            nodes = nodes.withColumn("top", F.lit(0)).withColumn("budget", budget)
            up = ["top"]
        else:
            nodes = nodes.join(above, up)
        above = fill(nodes, up).select(*own, F.col("share").alias("budget"), "tokens")
        if depth < len(levels):
            above = above.drop("tokens")
    return above.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


class Mixture(NamedTuple):
    """What to take, and in which seeded order."""

    levels: Mapping[str, Column]
    weights: Mapping[str, Mapping[str, float]]
    share: float = 0.75  #: of the corpus's tokens
    max_epochs: int = 4
    seed: int = 1
    buckets: int = 3  #: hash digits that split a leaf, 16 each

    @property
    def keys(self) -> list[str]:
        return [f"__level_{name}" for name in self.levels]


def mixture(levels: Mapping[str, Column] | None = None, weights: Mapping[str, Mapping[str, float]] | None = None, **options) -> Mixture:
    """A mixture; by default of production."""
    levels = levels or {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return Mixture(levels, {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights, **options)


def keyed(docs: DataFrame, m: Mixture, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(leaf, __id, __t, more): the leaf's level values and what orders a row in it."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    named = [F.coalesce(c.cast("string"), F.lit("(null)")).alias(k) for k, c in zip(m.keys, m.levels.values(), strict=True)]
    return docs.select(*named, F.coalesce(F.col(id_col).cast("string"), text).alias("__id"), text.alias("__t"), *more)


def place(m: Mixture) -> Column:
    """The seeded order of a row in its leaf, over ``__full``, ``__id`` and ``__t``."""
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(m.seed)), F.col("__full").cast("string"), F.col("__id"))), F.col("__t"))


def few_leaves(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_LEAVES else table  # else an ordinary join


def cuts(slim: DataFrame, m: Mixture) -> DataFrame:
    """(leaf, __tokens, __budget, __full, __cut, __last, __copies): whole epochs, the last place of the prefix of one more (null: none), and how many of the rows there it takes."""
    keys = m.keys
    leaves = scratch(slim.groupBy(*keys).agg(F.sum("__n").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    named = {k: m.weights.get(name, {}) for k, name in zip(keys, m.levels, strict=True)}
    spent = budgets(leaves, keys, named, F.lit(total * m.share), m.max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    spent = spent.select(*keys, F.col("tokens").alias("__tokens"), F.col("budget").alias("__budget"), full.alias("__full"))
    spent = scratch(spent.withColumn("__rest", F.col("__budget") - F.col("__full") * F.col("__tokens")), "budgets")
    placed = slim.join(few_leaves(spent.where("__rest > 0").select(*keys, "__full", "__rest")), keys).withColumn("__h", place(m)).withColumn("__bucket", F.substring("__h", 1, m.buckets))
    sums = placed.groupBy(*keys, "__rest", "__bucket").agg(F.sum("__n").alias("__sum"))
    up = Window.partitionBy(*keys)
    begun = sums.withColumn("__before", F.sum("__sum").over(up.orderBy("__bucket")) - F.col("__sum")).where("__before < __rest")
    ends = scratch(begun.groupBy(*keys).agg(F.max(F.struct("__bucket", "__before")).alias("e")).select(*keys, "e.*"), "ends")
    inside = placed.join(few_leaves(ends), [*keys, "__bucket"]).groupBy(*keys, "__rest", "__before", "__h").agg(F.sum("__n").alias("__sum"), F.max("__n").alias("__each"), F.count("*").alias("__copies"))
    within = F.col("__before") + F.sum("__sum").over(up.orderBy("__h")) - F.col("__sum")
    begin = F.when(F.col("__each") > 0, F.least("__copies", F.ceil((F.col("__rest") - F.col("__at")) / F.col("__each")))).otherwise(F.col("__copies"))
    ended = F.max(F.struct(F.col("__h").alias("__cut"), begin.alias("__last"), "__copies")).alias("e")
    last = inside.withColumn("__at", within).where("__at < __rest").groupBy(*keys).agg(ended).select(*keys, "e.*")
    return scratch(spent.join(last, keys, "left").drop("__rest"), "cuts")


def taken(rows: DataFrame, cut: DataFrame, m: Mixture) -> DataFrame:
    """``rows`` (of ``keyed``) that the mixture takes, with ``epochs``."""
    placed = rows.join(few_leaves(cut), m.keys).withColumn("__h", place(m))
    more = F.coalesce((F.col("__h") <= F.col("__cut")).cast("int"), F.lit(0))
    if cut.where("__last < __copies").isEmpty():
        return placed.withColumn("epochs", F.col("__full") + more).where("epochs > 0")
    # The prefix ends among rows of one place: these alone are numbered, in any order, as they are equal.
    ends = F.coalesce((F.col("__h") == F.col("__cut")) & (F.col("__last") < F.col("__copies")), F.lit(False))
    rest = placed.where(~ends).withColumn("epochs", F.col("__full") + more)
    among = numbered(scratch(placed.where(ends), "copies"), m.keys).withColumn("epochs", F.col("__full") + (F.col("__nth") < F.col("__last")).cast("int"))
    return rest.unionByName(among.drop("__nth")).where("epochs > 0")


def numbered(rows: DataFrame, keys: Sequence[str], parts: int = 1024) -> DataFrame:
    """``rows`` (a written table) with ``__nth`` from 0 within ``keys``: counted in ``parts`` and their offsets, so no task takes in a whole group."""
    dealt = scratch(rows.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), "dealt")
    sizes = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__size"))
    ahead = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__size")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(F.lit(0))) - 1
    out = dealt.withColumn("__own", own).join(sizes.select(*keys, "__part", ahead.alias("__ahead")), [*keys, "__part"])
    return out.withColumn("__nth", F.col("__ahead") + F.col("__own")).drop("__part", "__own", "__ahead")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """What the mixture takes: (row, level columns, n_tokens, leaf_tokens, leaf_budget, epochs); ``row`` holds the columns in ``carry``.

    ``epochs`` says how often the row is taken; ``options`` are those of ``mixture``.
    """
    m = mixture(**options)
    slim = scratch(keyed(docs, m, id_col, text_col, n_tokens(F.col(text_col)).alias("__n"), F.struct(*carry).alias("row")), "slim")
    found = taken(slim, cuts(slim.drop("row"), m), m)
    return found.select("row", *(F.col(k).alias(name) for k, name in zip(m.keys, m.levels, strict=True)), F.col("__n").alias("n_tokens"), F.col("__tokens").alias("leaf_tokens"), F.col("__budget").alias("leaf_budget"), "epochs")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` in the mixture's proportions: each row as often as it is taken."""
    m = mixture(**options)
    cut = cuts(scratch(keyed(docs, m, id_col, text_col, n_tokens(F.col(text_col)).alias("__n")), "slim"), m)
    found = taken(keyed(docs, m, id_col, text_col, F.struct("*").alias("__row")), cut, m)
    return found.select("__row", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("__row.*")

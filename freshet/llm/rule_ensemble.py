"""A quality classifier as a sparse rule ensemble.

Text statistics come from built-in column functions. A forest of shallow trees
is fitted on labelled rows; every path from a root to a node is a conjunctive
rule over the statistics. A lasso-penalised logistic regression weighs the
rules and drops most, and what is left is compiled into one Spark column
expression, which scores whole texts without Python.

The forest and the weights are fitted on at most ``sample_rows`` labelled rows
(the least by a hash of id and label).

Defined results: null and blank texts have no words, count as one word of one
character where a share is taken, and are scored like any other; a text of any length is counted whole; equal labels of one id
count once, different ones are learnt from both, and so are all documents of a
repeated id; other columns are not looked at; labels that are null or whose document is missing are not
learnt from; with no labelled row every score is 0.5, with labels of one class
only it is 0.99 or 0.01. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import blanked, bounded_sample, scratch, words


def statistics(rows: DataFrame, text: Column) -> tuple[DataFrame, list[str]]:
    """``rows`` with a double for each statistic of the whole text, and their names."""
    whole = F.coalesce(text, F.lit(""))
    # The rare characters, once; classes without lower-case letters and blanks are counted in them.
    out = rows.withColumn("__text", whole).withColumn("__w", words(whole)).withColumn("__rare", F.regexp_replace(whole, r"[a-z\x20\x09-\x0D]+", ""))
    w, t = F.col("__w"), F.col("__text")
    out = out.withColumn("__n", F.greatest(F.size(w), F.lit(1)).cast("double")).withColumn("__c", F.greatest(F.length(F.replace(blanked(t), F.lit(" "), F.lit(""))), F.lit(1)).cast("double"))
    n, c = F.col("__n"), F.col("__c")
    held = lambda chars: F.regexp_count(F.col("__rare"), F.lit(f"[{chars}]"))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    stats = {
        "log_words": F.log1p(F.size(w)),
        "word_length": c / n,
        "distinct_words": F.size(F.array_distinct(w)) / n,
        "doubled_words": F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))) / n,
        "symbols": held("#*$%&|<>") / c,
        "pipes": held("|") / c,
        "digits": held("0-9") / c,
        "stops": held(".,;:!?") / c,
        "capitals": held("A-Z") / c,
        "line_words": n / (breaks + 1),
        "short_words": F.size(F.filter(w, lambda x: F.length(x) <= 3)) / n,
        "long_words": F.size(F.filter(w, lambda x: F.length(x) >= 15)) / n,
        "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))) / (breaks + 1),
    }
    out = out.withColumns({f"s_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in stats.items()}).drop("__text", "__w", "__n", "__c", "__rare")
    return out, [f"s_{k}" for k in stats]


class Rule(NamedTuple):
    """A conjunction of (statistic, whether at most the threshold, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, below, at in self.terms:
            held = held & (F.col(name) <= at if below else F.col(name) > at)
        return held


def paths(node, names: list[str], above: tuple = ()) -> list[Rule]:
    """The rules of all nodes below a tree's JVM ``node``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return []
    split, found = node.split(), []
    for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
        terms = (*above, (names[split.featureIndex()], below, float(split.threshold())))
        found += [Rule(terms), *paths(child, names, terms)]
    return found


class RuleEnsemble(NamedTuple):
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, names: list[str], label: str = "label", trees: int = 20, depth: int = 3, penalty: float = 0.003, seed: int = 3) -> RuleEnsemble:
    """An ensemble of a written table of statistics and a 0/1 label."""
    counts: Mapping[int, int] = {int(r[0]): r[1] for r in labelled.groupBy(label).count().collect()}
    if len(counts) < 2:
        return RuleEnsemble({0: -4.6, 1: 4.6}.get(next(iter(counts), -1), 0.0), {})
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(labelled.withColumn(label, F.col(label).cast("double")))
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, subsamplingRate=0.8, seed=seed).fit(rows)
    rules = sorted(dict.fromkeys(r for t in forest.trees for r in paths(t._java_obj.rootNode(), names)))
    if not rules:
        return RuleEnsemble(0.0, {})
    held = labelled.select(F.col(label).cast("double").alias(label), *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select(label, "features")
    held = scratch(held.coalesce(4), "rule-features")  # at most sample_rows sparse vectors: each step reads them, none weighs the rules anew
    lasso = LogisticRegression(labelCol=label, featuresCol="features", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(held)
    return RuleEnsemble(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w})


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **options) -> tuple[RuleEnsemble, list[str]]:
    """An ensemble of at most ``sample_rows`` labels where ``learn`` (over the labels' ``id_col``) holds."""
    usable = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = bounded_sample(usable.withColumn("h", F.xxhash64("id", "label")), "h", sample_rows).drop("h")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most sample_rows rows
    stats, names = statistics(texts.repartition(12), F.col("text"))
    return fit(scratch(stats.select("label", *names), "labelled"), names, **options), names


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``; only the text is looked at."""
    stats, names = statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"))
    return stats.select("id", model.score().alias("score"))

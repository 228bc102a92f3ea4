"""Source mixing and line dedup against plain versions."""

import hashlib
import random
from collections import defaultdict

import pytest
from helpers import empty_docs, odd_docs, words
from pyspark.sql import functions as F

from freshet.llm import line_dedup, mixing, queries


def plain_fill(caps, weights, budget):
    """Water filling by repeated rounds: who cannot take the share is filled, the rest share what is left."""
    share, open_ = {k: 0.0 for k in caps}, {k for k in caps if weights[k] > 0}
    left = budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] <= left * weights[k] / total}
        if not full:
            for k in open_:
                share[k] = left * weights[k] / total
            break
        for k in full:
            share[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return share


def plain_mix(rows, weights, share, epochs, seed):
    """rows: (id, path, n). {id: how often}; ids are unique."""
    leaves = defaultdict(int)
    for _, path, n in rows:
        leaves[path] += n
    budget = {(): share * sum(leaves.values())}
    depth = len(next(iter(leaves)))
    for d in range(1, depth + 1):
        children = defaultdict(lambda: defaultdict(float))
        for path, n in leaves.items():
            children[path[: d - 1]][path[:d]] += n * epochs
        for parent, caps in children.items():
            budget |= plain_fill(caps, {k: weights[d - 1].get(k[-1], 1.0) for k in caps}, budget[parent])
    taken = {}
    for path, tokens in leaves.items():
        whole = int(budget[path] + 1e-6)
        full = whole // tokens if tokens else 0
        rest, at = whole - full * tokens, 0
        own = [(hashlib.md5(f"{seed}:{full}:{i}".encode()).hexdigest(), i, n) for i, p, n in rows if p == path]
        for _, i, n in sorted(own):
            if (k := full + (at < rest)) > 0:
                taken[i] = k
            at += n
    return taken


def test_mixture_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(d.doc_id, (f"d{int(d.source[3:]) % 4}", d.lang, d.source), len(words(d.text))) for d in docs]
    mine = plain_mix(rows, [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}], 0.75, 4, 1)
    assert {r.doc_id: r.epochs for r in queries.op4_source_mixing(spark, sf_dir).collect()} == mine


def test_shortages_go_to_siblings_first(spark):
    docs = spark.createDataFrame([(i, "w " * n, g, s) for i, (n, g, s) in enumerate([(10, "a", "x"), (400, "a", "y"), (500, "b", "x")])], "doc_id long, text string, g string, s string")
    options = {"levels": {"g": F.col("g"), "s": F.col("s")}, "weights": {"g": {"a": 1.0, "b": 1.0}, "s": {}}, "max_epochs": 1, "share": 0.5}
    got = {(r.g, r.s): r.leaf_budget for r in mixing.mix(docs, **options).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 217, ("b", "x"): 227}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_budget_holds_with_repeated_rows(spark, seed):
    """Half of a leaf are copies of one row: as many of them are taken as begin before the budget is spent."""
    docs = spark.createDataFrame([(7, "w " * 10, "s")] * 500 + [(100 + i, "w " * (1 + i % 19), "s") for i in range(500)] + [(None, "v " * 30, "t")] * 40 + [(8, "", "t")] * 9, "doc_id long, text string, source string")
    total = 500 * 10 + sum(1 + i % 19 for i in range(500)) + 40 * 30
    options = {"levels": {"source": F.col("source")}, "weights": {}, "share": 3100 / total, "max_epochs": 4, "seed": seed}
    got = mixing.mix(docs, **options).collect()
    spent = defaultdict(int)
    for r in got:
        spent[r.source] += r.n_tokens * r.epochs
    budget = {r.source: r.leaf_budget for r in got}
    assert all(budget[k] <= spent[k] < budget[k] + 30 for k in budget) and abs(sum(budget.values()) - 3100) <= 2
    rows = mixing.mixed_rows(docs, **options)
    assert rows.count() == sum(r.epochs for r in got) and rows.select(F.sum(mixing.n_tokens(F.col("text")))).first()[0] == sum(spent.values())


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark, clash=True)
    out = mixing.mixed_rows(docs, share=2.0)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert {r.source for r in mixing.mix(docs).select("source").collect()} <= {"(null)", "src1"}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_dedup(docs, least=5):
    """docs: (id, text), unique ids in any order. {id: text without the lines that go}."""
    seen, out = [], {}
    for i, text in sorted(docs):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = words(line)
            if len(w) >= least:
                if not any(one_edit(w, s) for s in seen):
                    kept.append(line)
                seen.append(w)
            else:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)]
    lines = [[rng.choice(vocab) for _ in range(rng.randint(4, 9))] for _ in range(160)]
    for _ in range(200):
        w = list(rng.choice(lines))
        at = rng.randrange(len(w))
        rng.choice([lambda: w.pop(at), lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "other"), lambda: None])()
        lines.append(w)
    rng.shuffle(lines)
    space = [" ", "  ", "\t"]
    docs = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(space).join(w) for w in lines[6 * i : 6 * i + 6])) for i in range(60)]
    got = line_dedup.cleaned(spark.createDataFrame(docs, "doc_id long, text string"), chars_col=None)
    assert {r.doc_id: r.text for r in got.collect()} == plain_dedup(docs)


def test_lines_odd_rows(spark):
    docs = odd_docs(spark, clash=True)
    rows = line_dedup.cleaned(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in rows}
    assert texts[0] is None and texts[1] == "" and texts[2] == " \n\t\r\x0b\x0c "
    assert texts[4].startswith("one two") and texts[5] == ""  # row 4 comes twice: the copies are judged alike
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert line_dedup.dedup(empty_docs(spark)).count() == 0


def plain_short_dedup(docs, least=5):
    """As plain_dedup, but equal lines of one word or more go as well."""
    equal, near, out = set(), [], {}
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            w = words(line)
            if not w or not (tuple(w) in equal or (len(w) >= least and any(one_edit(w, s) for s in near))):
                kept.append(line)
            equal.add(tuple(w))
            if len(w) >= least:
                near.append(w)
        out[i] = "\n".join(kept)
    return out


def test_short_equal_lines_go(spark, small):
    import corpus_pipeline

    docs = [(0, "Les.\na b\n\na  b\none two three four five"), (1, "Les.\n\n \na c\nb\nOne\none two three four"), (2, "b\nb\n Les. \none two three four six"), (3, "Les.")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    mine = plain_short_dedup(docs)
    assert mine[0] == "Les.\na b\n\none two three four five" and mine[2] == "" and mine[3] == ""
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, table, "").collect()} == mine
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert {r.doc_id: r.text for r in queries.op5_line_dedup(spark, small).collect()} == plain_short_dedup(given)


def test_lines_beyond_the_filters(spark, small, monkeypatch):
    """Beyond FILTER_ROWS the joins alone decide, with the same result."""
    from freshet.llm import common

    given = {r.doc_id: r.text for r in queries.op5_line_dedup(spark, small).collect()}
    monkeypatch.setattr(common, "FILTER_ROWS", 0)
    assert {r.doc_id: r.text for r in queries.op5_line_dedup(spark, small).collect()} == given


def test_very_long_lines(spark):
    """Lines of twenty thousand equal words, one more, and one with another word: linear work, one line stays."""
    n = 20_000
    docs = spark.createDataFrame([(1, "w " * n), (2, "w " * (n + 1)), (3, "w " * 7 + "x " + "w " * (n - 8)), (4, "v " * n)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup(docs).select("row.*").where("text != ''").collect()} == {1, 4}


def test_mixing_of_unlisted_nodes_and_ties(spark):
    rows = [(i, "w " * 10, lang, "src1") for i, lang in enumerate(["en", "xx", None] * 40)] + [(None, "w " * 10, "en", "src1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    options = {"levels": {"lang": F.col("lang")}, "weights": {"lang": {"en": 0.5, "de": 0.1}}, "share": 0.5, "max_epochs": 1}
    got = {r.lang: r.leaf_budget for r in mixing.mix(docs, **options).collect()}
    assert set(got) == {"en", "xx", "(null)"} and got["xx"] == got["(null)"] and got["en"] == 430  # xx and null weigh 0.1 each; en takes all it has
    once = sorted(str(r) for r in mixing.mix(docs, **options).collect())
    assert once == sorted(str(r) for r in mixing.mix(docs.repartition(7), **options).collect())
    assert mixing.mixed_rows(docs.withColumn("row", F.lit(1)), **options).columns == [*docs.columns, "row"]


def plain_counts(docs, least=5):
    """{id: (lines, equal ones that go, near ones that go)}: a line is judged by its words' first place."""
    first = {}
    for i, text in sorted(docs):
        for at, line in enumerate(text.split("\n")):
            if words(line):
                first.setdefault(tuple(words(line)), (i, at))
    near = {w for w, p in first.items() if len(w) >= least and any(q < p and len(v) >= least and one_edit(list(v), list(w)) for v, q in first.items() if v != w and abs(len(v) - len(w)) < 2)}
    out = {}
    for i, text in docs:
        each = [(tuple(words(x)), (i, at)) for at, x in enumerate(text.split("\n")) if words(x)]
        out[i] = (text.count("\n") + 1, sum(w not in near and p != first[w] for w, p in each), sum(w in near for w, _ in each))
    return out


def test_hot_lines_templates_and_counts(spark):
    """A line in most documents, hundreds of lines of one template, near ones of one earliest line: spread, with the same result."""
    docs = [(i, f"the same line stands in all\npage {i} of the long report\nshort\n" + ("a line of its own words %d %d\n" % (i, 7 * i)) + f"the same line stands in {i} all" + ("\npage of the long report" if i % 50 == 3 else "")) for i in range(1200)]
    docs.append((5000, "the same line stands in none\n" + "w " * 4000 + "end\n" + "w " * 4000 + "other"))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = line_dedup.dedup(table, exact_words=1).collect()
    assert {r.row.doc_id: r.row.text for r in got} == plain_short_dedup_fast(docs)
    assert {r.row.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in got} == plain_counts(docs)


def plain_short_dedup_fast(docs, least=5):
    """As plain_short_dedup, over distinct lines."""
    equal, near, verdict, out = set(), [], {}, {}
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            w = tuple(words(line))
            if w and w not in equal:
                verdict[w] = len(w) >= least and any(abs(len(w) - len(s)) < 2 and one_edit(list(w), list(s)) for s in near)
                if len(w) >= least:
                    near.append(w)
            if not w or (w not in equal and not verdict[w]):
                kept.append(line)
            equal.add(w)
        out[i] = "\n".join(kept)
    return out

"""Language ID, quality classifier, multi-index: held-out accuracy, recall against brute force, odd rows."""

import math
import random

import numpy as np
from helpers import DOCS, ODD, empty_docs, fold, odd_docs, words
from pyspark.sql import functions as F

from freshet.llm import langid, multi_index, queries, rule_ensemble


def test_language_held_out(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    right = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out and truth[r.doc_id].lang is not None and any(c.isalpha() for c in truth[r.doc_id].text or "")]
    assert len(right) > 100 and np.mean(right) > 0.97
    for r in rows:
        assert r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id].text or ""))


def test_a_language_of_one_repeated_text_is_learnt(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("the", "and", "cat", "house", "river")) + rng.choice("aeiou") for _ in range(30)), "en", "s1", 0) for i in range(3000)]
    rows += [(9000 + i, "der schnelle braune fuchs springt ueber den faulen hund", "de", "s1", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    for sample in (100, 1000):
        model = langid.fit(docs, F.lit(True), sample_rows=sample)
        assert {r.id < 9000: r.lang_pred for r in langid.identify(docs, model).collect()} == {True: "en", False: "de"}


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 20):
        code = langid.codewords(n)
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert code.shape[0] == n and near >= max(1, code.shape[1] // 4)


def test_many_languages_and_none(spark):
    many = spark.createDataFrame([(i, f"{chr(97 + i % 9)}{chr(98 + i % 9)} " * 30, f"l{i % 9}") for i in range(90)], "doc_id long, text string, lang string")
    model = langid.fit(many, F.lit(True))
    rows = langid.identify(many, model).collect()
    assert np.mean([r.lang_pred == f"l{r.id % 9}" for r in rows]) > 0.9
    none = langid.fit(empty_docs(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd_docs(spark, clash=True), none).collect()} == {"und"}
    one = langid.fit(many.where("lang = 'l1'"), F.lit(True))
    assert langid.identify(many, one).where("lang_pred != 'l1' OR score != 1").count() == 0


def test_every_language_is_learnt(spark):
    """More languages than sampled rows, each of its own letters."""
    rng = random.Random(6)
    rows = [(40 * k + i, " ".join("".join(rng.choice((chr(0x400 + 6 * k), chr(0x401 + 6 * k), chr(0x402 + 6 * k))) for _ in range(4)) for _ in range(20)), f"l{k:02}") for k in range(30) for i in range(40 if k % 3 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (20, 300):
        model = langid.fit(docs, F.lit(True), sample_rows=sample)
        assert model.langs == [f"l{k:02}" for k in range(30)]
        assert np.mean([r.lang_pred == f"l{r.id // 40:02}" for r in langid.identify(docs, model).collect()]) > 0.95


def plain_decode(model, text):
    """Counts gram by gram, margins bit by bit, and the nearest codeword."""
    data, mask = b" " + text.lower().encode() + b" ", 0xFFFFFFFF
    counts = [0] * langid.BINS
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & mask for a, b in zip(data, data[1:], strict=False)]
    for h in [(b * 0x165667B1) & mask for b in data] + two + [(t * 0xC2B2AE3D + c * 0x27D4EB2F) & mask for t, c in zip(two, data[2:], strict=False)]:
        counts[h >> 20] += 1
    n = sum(counts)
    z = [max(-20, min(20, sum(c * float(model.weights[k, bit]) for k, c in enumerate(counts)) / n + float(model.bias[bit]))) for bit in range(model.code.shape[1])]
    loss = [sum(float(model.trust[c, b]) * np.log1p(np.exp(-float(model.code[c, b]) * z[b])) for b in range(len(z))) for c in range(len(model.langs))]
    order = sorted(range(len(loss)), key=lambda c: (loss[c], model.langs[c]))
    weights = [np.exp(-2 * (v - loss[order[0]])) for v in loss]
    return model.langs[order[0]], weights[order[0]] / sum(weights), loss[order[1]] - loss[order[0]] < model.margin


def test_decoding_against_plain_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    texts = [r.text for r in docs.select("text").limit(25).collect() if r.text and len(r.text) < 4000] + ["a", "é", "日本 語", "Ab c" * 50]
    for t in texts:
        lang, score, ambiguous = model.predict(t)
        want = plain_decode(model, t)
        assert (lang, ambiguous) == (want[0], want[2]) and abs(score - want[1]) < 1e-3
    code = langid.LanguageModel(["a", "b"], np.array([[1], [-1]]), np.zeros((langid.BINS, 1), np.float32), np.zeros(1), np.ones((2, 1)), 0.2)
    assert code.predict("tie") == ("a", 0.5, True)  # equally near codewords: the first by name


def test_quality_held_out(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op9_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (fold(r.doc_id) == 2) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    base = max(np.mean([y for _, y in test]), 1 - np.mean([y for _, y in test]))
    assert np.mean([p == y for p, y in test]) > min(0.97, base + 0.1)


def plain_statistics(text):
    text = text or ""
    w = words(text)
    n, c = max(1, len(w)), max(1, sum(x not in " \t\n\x0b\x0c\r" for x in text))
    lines = text.split("\n")
    share = lambda chars: sum(x in chars for x in text) / c
    return {
        "s_log_words": math.log1p(len(w)), "s_word_length": c / n, "s_distinct_words": len(set(w)) / n, "s_doubled_words": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        "s_symbols": share("#*$%&|<>"), "s_pipes": share("|"), "s_digits": share("0123456789"), "s_stops": share(".,;:!?"), "s_capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "s_line_words": n / len(lines),
        "s_short_words": sum(len(x) <= 3 for x in w) / n, "s_long_words": sum(len(x) >= 15 for x in w) / n, "s_distinct_lines": len(set(lines)) / len(lines),
    }


def test_a_fitted_ensemble_against_plain_rules(spark, sf_dir):
    """Statistics and scores of odd, long and ordinary texts, rule by rule."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, names = rule_ensemble.train(docs, labels, F.lit(True))
    assert model.weights
    texts = [*ODD, "word " * 200_000, *[r.text for r in docs.orderBy("doc_id").limit(60).collect()], "# | 5 A." * 30 + "\n" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit(7)).withColumn("score", F.lit("x"))
    stats, _ = rule_ensemble.statistics(rows.select("doc_id", "text"), F.col("text"))
    for r in stats.collect():
        plain = plain_statistics(texts[r.doc_id])
        assert set(plain) == set(names) and all(abs(r[k] - v) < 1e-9 for k, v in plain.items()), (texts[r.doc_id] or "")[:40]
    for r in rule_ensemble.score(rows, model).collect():
        plain = plain_statistics(texts[r.id])
        total = model.intercept + sum(v for rule, v in model.weights.items() if all((plain[k] <= at) == below for k, below, at in rule.terms))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_rules_are_compiled_conjunctions(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 7), int(i % 10 > 6 and i % 7 < 3)) for i in range(700)], "s_a double, s_b double, label int")
    model = rule_ensemble.fit(rows, ["s_a", "s_b"], trees=5)
    assert 0 < len(model.weights) and max(len(r.terms) for r in model.weights) >= 2
    wrong = rows.withColumn("score", model.score()).where((F.col("score") > 0.5).cast("int") != F.col("label")).count()
    assert wrong == 0


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    docs = odd_docs(spark, clash=True)
    model, _ = rule_ensemble.train(docs, labels, F.lit(True))
    assert {round(r.score, 2) for r in rule_ensemble.score(docs, model).collect()} == {0.99}
    model, _ = rule_ensemble.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in rule_ensemble.score(docs, model).collect()} == {0.5}
    assert rule_ensemble.score(empty_docs(spark), model).count() == 0


def brute(ids, x, asked, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {}
    for q in asked:
        s = x @ x[q]
        s[q] = -2
        best[ids[q]] = [ids[j] for j in np.lexsort((ids, -s))[:k]]
    return best


def test_recall_and_exact_scores(spark, sf_dir):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    truth = brute(ids, x, [i for i, v in enumerate(ids) if v % 50 == 0], 5)
    got = queries.op1_multi_index(spark, sf_dir).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        a, b = x[np.searchsorted(ids, r.query_id)], x[np.searchsorted(ids, r.vec_id)]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert found.keys() == truth.keys() and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(truth[q])) / 5 for q in truth]) >= 0.9


def test_clustered_recall_and_split_cells(spark):
    """Structured data, cells beyond a shard, several query blocks."""
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = multi_index.nearest(vectors, F.col("vec_id") % 50 == 0, centroids=8, shard_rows=100, query_block=20).collect()
    truth = brute(np.arange(3000), x.astype(np.float64), range(0, 3000, 50), 5)
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in truth}
    assert np.mean([len(found[q] & set(truth[q])) / 5 for q in truth]) >= 0.9


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.0, 1.0]), (10, []), (11, [1e30, 1e30])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(1)).withColumn("cell", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in multi_index.nearest(vectors, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50), (0, 2, 50), (0, 3, 11), (0, 4, 9), (50, 1, 0), (50, 2, 11), (50, 3, 9)]
    assert multi_index.nearest(vectors.limit(0), F.lit(True)).count() == 0
    assert multi_index.nearest(vectors.limit(1), F.lit(True)).count() == 0

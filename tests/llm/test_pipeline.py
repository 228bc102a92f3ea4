"""The pipeline against its stages' plain versions, chained; odd rows in every stage."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import DOCS, empty_docs, odd_docs, words
from test_mixing_and_lines import plain_mix, plain_short_dedup
from test_packing import hold_places, whole_ids
from test_text_scans import plain_counts

from freshet.llm import mixing, quality_rules, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def plain_quality(docs):
    """The documents of (id, text, lang, source) that base rule and thresholds keep."""

    def rates(text):
        n_words, chars, symbols, dup, rep = plain_counts(text)
        n_lines = sum(bool(words(x)) for x in (text or "").split("\n"))
        per = lambda a, n, unit: unit * a // max(n, 1)
        return n_words < 50 or 100 * rep > 50 * n_words, (per(symbols, chars, 10_000), per(dup, n_lines, 10_000), per(rep, n_words, 10_000), per(chars, n_words, 1000))

    found = [(d, *rates(d[1])) for d in docs]
    good = [(d, r) for d, bad, r in found if not bad]

    def ends(rows, k):
        low = [r[k] >> max(0, r[k].bit_length() - 6) << max(0, r[k].bit_length() - 6) for r in rows]
        q10, q50, q90 = (sorted(low)[-(-q * len(low) // 100) - 1] for q in (10, 50, 90))
        guard = list(quality_rules.GUARDS.values())[k]
        return q10 - 4 * (q50 - q10) - guard, q90 + 4 * (q90 - q50) + guard

    kept = []
    for d, r in good:
        groups = ([x for e, x in good if e[2:] == d[2:]], [x for e, x in good if e[2] == d[2]], [x for _, x in good])
        rows = next((g for g in groups[:2] if len(g) >= 100), groups[2])
        if all(r[k] <= ends(rows, k)[1] for k in range(4)) and r[3] >= ends(rows, 3)[0]:
            kept.append(d)
    return kept


def plain_near(docs):
    """One document, the least id, of each group linked by five-word shingles."""
    sets = []
    for d in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in d[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and 5 * both >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [d for i, d in enumerate(docs) if root(i) == i]


def test_chained_plain_versions(spark, small, tokenizer):
    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    docs = plain_quality(docs)
    cleaned = plain_short_dedup([(d[0], d[1]) for d in docs])
    docs = plain_near([(d[0], cleaned[d[0]], d[2], d[3]) for d in docs])
    rows = [(d[0], (f"d{int(d[3][3:]) % 4}", d[2], d[3]), len(words(d[1]))) for d in docs]
    epochs = plain_mix(rows, [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}], 0.75, 4, 1)
    want = Counter()
    for d in docs:
        ids = whole_ids(tokenizer, d[1])
        first = len(ids) % 2048 or 2048
        for piece, at in enumerate([0, *range(first, len(ids), 2048)]):
            size = first if piece == 0 else 2048
            want[d[0], piece, at, size, zlib.crc32(np.array(ids[at : at + size], dtype="<u4").tobytes())] += epochs.get(d[0], 0)
    got = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    hold_places(got, 2048)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows_in_every_stage(spark, stage):
    name, run = stage
    docs = odd_docs(spark)
    long = spark.createDataFrame([(900, "word " * 300_000 + "end", "en", "src2", 1)], DOCS)
    out = run(spark, docs.unionByName(long), "")
    assert out.count() > 0 or name == "quality_rules"  # where every odd text fails the base rule
    if name != "pattern_packing":
        assert out.columns == docs.columns
        clash = odd_docs(spark, clash=True)
        assert run(spark, clash, "").columns == clash.columns
    assert run(spark, empty_docs(spark), "").count() == 0

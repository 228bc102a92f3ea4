"""SimHash near-dedup against a plain fingerprint and all pairs of a small table."""

import random

import xxhash
from helpers import empty_docs, odd_docs, words
from pyspark.sql import functions as F

from freshet.llm import queries, shingles, simhash


def plain_fingerprint(text, width):
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    """{index: least index reachable}, by all pairs."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in queries.op7_simhash(spark, sf_dir).collect()}
    fps = [plain_fingerprint(t, 4) for _, t in docs]
    heads = plain_components(fps, 4)
    assert len(found) == len(docs)
    for (doc_id, _), fp, head in zip(docs, fps, heads, strict=True):
        assert found[doc_id].fingerprint == f"{fp:016x}"
        assert found[doc_id].component_id == docs[head][0]


def test_chunks_and_chains(spark):
    """Many values close together, far more than one tree holds, and chains at exactly the radius."""
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(60)}
    chain = rng.getrandbits(64)
    for _ in range(15):
        values.add(chain)
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.links(fps, 4, tree_rows=32)).collect()}
    mine = {}
    for v, head in zip(signed, plain_components(values, 4), strict=True):
        mine.setdefault(head, []).append(v)
    for group in mine.values():
        labels = {got.get(v, v) for v in group}
        assert len(labels) == 1
    assert len({got.get(v, v) for v in signed}) == len(mine)


def test_keep_one_with_repeated_ids(spark):
    """Rows (1, A), (1, B), (2, A): one of each text stays."""
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "AB"}
    docs = spark.createDataFrame([(1, texts["A"]), (1, texts["B"]), (2, texts["A"]), (1, texts["B"])], "doc_id long, text string").withColumn("__key", F.lit(3))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(1, "A"), (1, "B")]


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by_id = {r.id: r for r in found}
    assert {by_id[0].component_id, by_id[1].component_id, by_id[2].component_id} == {0}
    assert by_id[5].component_id == 4
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.keep_one(odd_docs(spark, clash=True))
    assert kept.columns == odd_docs(spark, clash=True).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 3, 4, 6, 7, 8, 9, 10, 11]


def plain_kept(docs, width=5):
    """The least id of each component of equal texts and of shingle similarity 4/5 or more, by all pairs."""
    sets = {}
    for i, text in sorted(docs):
        w = tuple(words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        sets.setdefault(w, (i, {w[k : k + width] for k in range(max(1, len(w) - width + 1))} if w else set()))
    firsts = list(sets.values())
    up = list(range(len(firsts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(firsts):
        for j, (_, b) in enumerate(firsts[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) > 0 and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {firsts[root(i)][0] for i in range(len(firsts))}


def test_edited_copies_against_all_pairs(spark, sf_dir):
    """Edited copies far apart in bits go, unlike texts stay; long lists in small chunks, and the given table."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(20)]  # in every text: a list of all of them
    docs = []
    for _ in range(25):
        seed = [rng.choice(vocab) for _ in range(rng.randint(20, 150))]
        for _ in range(6):
            w = list(seed)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(passage + w)
    rng.shuffle(docs)
    docs = [(i, rng.choice([" ", "\n ", "\t"]).join(w).replace("w1", rng.choice(["w1", "W1"]))) for i, w in enumerate(docs)]
    mine = plain_kept(docs)
    assert 25 < len(mine) < 120
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(table).collect()} == mine
    keyed = table.select(shingles.text_key(F.col("text")).alias("key"), "text")
    cut = simhash.components(shingles.edges(keyed, simhash.components, chunk=16)).groupBy("label").count().collect()
    assert sum(r["count"] - 1 for r in cut) == keyed.select("key").distinct().count() - len(mine)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id for r in simhash.keep_one(given).collect()} == plain_kept([(r.doc_id, r.text) for r in given.collect()])


def test_simhash_links_come_first(spark, monkeypatch):
    """keep_one's candidates begin with the fingerprints' own links: equal ones by their least key, others by the BK-trees."""
    fps = {b"a": 0, b"b": 0, b"c": 15, b"d": 31 << 20, b"e": -1, b"f": -2, b"g": 0}
    marked = spark.createDataFrame([(bytearray(k), v) for k, v in fps.items()], "key binary, fp long")
    got = {(bytes(r.a), bytes(r.b)) for r in simhash.near_pairs(marked).collect()}
    assert got == {(b"a", b"b"), (b"a", b"g"), (b"a", b"c"), (b"e", b"f")}
    asked = []
    monkeypatch.setattr(simhash, "near_pairs", lambda m: asked.append(m.count()) or m.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
    simhash.keep_one(spark.createDataFrame([(1, "one two three"), (2, "four five six")], "doc_id long, text string"))
    assert asked == [2]


def test_bitmaps_lose_no_pair():
    """Every pair of a similarity of 4/5 passes the bitmaps, few others do."""
    import numpy as np

    rng = random.Random(3)
    draw = lambda: rng.getrandbits(64) - (1 << 63)
    sets = []
    for size in [1, 3, 8, 15, 16, 17, 40, 130, 500, 2000] * 3:
        base = [draw() for _ in range(size)]
        for _ in range(6):
            s = set(base)
            for _ in range(rng.randint(0, max(1, size // 6))):
                s.add(draw()) if rng.random() < 0.5 or len(s) < 2 else s.remove(rng.choice(sorted(s)))
            sets.append(np.array(sorted(s), dtype="<i8"))
    keys, n, labels = [bytes([i]) for i in range(len(sets))], [len(s) for s in sets], [bytes([i % 50]) for i in range(len(sets))]
    for sides in ([0] * len(sets), [1 + i % 2 for i in range(len(sets))]):
        got = shingles.open_pairs(keys, n, labels, sides, [shingles.parity_bits(s) for s in sets])
        ok = lambda i, j: labels[i] != labels[j] and (not sides[i] or sides[i] != sides[j]) and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])  # noqa: B023, E731
        want = {(keys[j], keys[i]) for i in range(len(sets)) for j in range(i) if ok(i, j)}
        assert want <= got and len(got) < 1.1 * len(want)


def test_filters_hold_bits_not_rows(spark, monkeypatch):
    """What a filter broadcasts and what marks the common shingles is a few bits a key: nothing is lost, little else passes."""
    import numpy as np

    from freshet.llm import common

    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda t: sent.append(t.count()) or real(t))
    n = 200_000
    wanted = common.scratch(spark.range(n).select(F.xxhash64("id").alias("w")), "wanted")
    rows = spark.range(2 * n).select("id", F.xxhash64("id").alias("k")).union(spark.sql("SELECT -1L, CAST(NULL AS LONG)"))
    near = {r.id for r in common.only_near(rows, F.col("k"), wanted, F.col("w")).select("id").collect()}
    assert set(range(n)) <= near and -1 not in near and len(near) < 1.03 * n
    few = common.scratch(spark.range(n).select("id", F.lit(7).alias("v")), "few")
    joined = common.join_few(spark.range(2 * n), few, "id").groupBy("v").agg(F.count("*").alias("c"), F.min("id").alias("least")).collect()
    assert sorted((r.v or 0, r.c, r.least) for r in joined) == [(0, n, n), (7, n, 0)]
    assert sent and max(sent) <= 32 * n // common.ROW_BITS
    bits, size = common.bit_filter(wanted, F.col("w"), n)
    words = common.bits_of(bits)
    assert len(words) == size * common.ROW_BITS // 64 and words.nbytes <= 4 * n
    keys = rows.where("k IS NOT NULL").orderBy("id").toArrow()
    assert set(keys["id"].to_numpy()[common.held_in(words, keys["k"].to_numpy())].tolist()) == near
    none = common.scratch(wanted.limit(0), "none")
    assert common.only_near(rows, F.col("k"), none, F.col("w")).isEmpty()
    listed = spark.createDataFrame([([1, 2, 3],), ([2, 3, 4],), ([3, 2, 5],)], "hashes array<long>")
    assert common.held_in(shingles.common_hashes(listed), np.array([1, 2, 3, 4, 5])).tolist() == [False, True, True, False, False]

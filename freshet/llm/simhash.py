"""SimHash near-duplicates: fingerprints, and components by BK-tree search in shards.

A fingerprint links to every other at ``radius`` or fewer differing bits. The
64 bits are cut into bands; two linked fingerprints agree on all but
``radius`` of them, so some choice of the other bands is equal in both
(pigeonhole), and a shard for each choice and value finds every link. Each
shard's fingerprints go into BK-trees, whose children are keyed by their
integer Hamming distance to the parent; a search follows only the edges within
the radius. Trees are not broadcast: all shards together are as large as the
corpus's fingerprints, so each is built in the task that its queries go to. A shard beyond ``tree_rows`` is split into chunks, and every pair
of chunks is a cell of its own: a bounded tree is sent to each chunk of
queries. Cells return one row per linked fingerprint (its root in the cell),
never all pairs; components come from repeated minimum labels with pointer
jumping, all in DataFrames.

Defined results: a null or blank text has the fingerprint zero and links like
any other; a text of any length is read whole; equal fingerprints are one
value, however many rows hold it; a null id is ignored in ``component_id`` unless its component has
no other. Repeated rows are returned as often as they come. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import shingles
from freshet.llm.common import discard, hot_keys, hottest, join_hot, only_near, scratch


def fingerprint(text: str | None, width: int = 4) -> int:
    """The signed 64-bit fingerprint of a whole text: majority bits over its word shingles' XXH64."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    joined, ends = b" ".join(found), list(accumulate(len(w) + 1 for w in found))
    starts, last = [0, *ends], min(width, len(found))
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[a : z - 1], 42) for a, z in zip(starts, ends[last - 1 :], strict=False)], dtype="<u8")
    return shingles.majority(h)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row (id, fp) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class BKTree:
    """Distinct 64-bit values; each node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            kept, children = todo.pop()
            d = (kept ^ value).bit_count()
            if d <= radius:
                found.append(kept)
            if len(children) > 2 * radius + 1:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
            else:
                todo += [c for e, c in children.items() if -radius <= e - d <= radius]
        return found


def cell_links(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root) of every linked one; ``query_side`` None: links within ``tree_side``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def link(x: int, others: list[int]) -> None:
        for y in others:
            if (a := root(x)) != (b := root(y)):
                parent[max(a, b)] = min(a, b)

    tree = BKTree()
    if query_side is None:
        for x in tree_side:
            link(x, tree.within(x, radius))
            tree.add(x)
    else:
        for x in tree_side:
            tree.add(x)
        for x in query_side:
            link(x, tree.within(x, radius))
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def shard_masks(n: int, radius: int, per_shard: int = 64) -> list[int]:
    """Masks of the band choices: the fewest bands whose shards would hold ``per_shard`` of ``n`` random values."""
    for bands in range(radius + 1, radius + 5):
        edges = [64 * i // bands for i in range(bands + 1)]
        chosen = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in c) for c in combinations(range(bands), bands - radius)]
        if n <= per_shard << min(m.bit_count() for m in chosen):
            break
    return chosen


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 4, tree_rows: int = 1024, n: int | None = None) -> DataFrame:
    """Rows (a, b), a != b, that join up exactly the distinct values of ``fp`` within ``radius``."""
    masks = shard_masks(fps.count() if n is None else n, radius)
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)]))
    entries = fps.select("fp", entry.alias("e")).select("fp", "e.band", "e.part")
    sizes = scratch(entries.groupBy("band", "part").agg(F.count("*").alias("size")).where("size > 1"), "shards")
    chunks = F.ceil(F.col("size") / tree_rows)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") > j).alias("asks")))
    dealt = (
        join_hot(entries, sizes, ["band", "part"], hottest(sizes, ["band", "part"], "size")).withColumn("chunks", chunks).withColumn("own", own)
        .select("fp", "band", "part", F.explode(cells).alias("c")).select("fp", "band", "part", "c.i", "c.j", "c.asks")
        .repartition("band", "part", "i", "j").sortWithinPartitions("band", "part", "i", "j", "asks", "fp")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, asks = None, [], []

        def done() -> list[tuple[int, int]]:
            if key is None or len(tree) + len(asks) < 2:
                return []
            return [(_signed(x), _signed(r)) for x, r in cell_links(tree, asks if key[2] != key[3] else None, radius)]

        def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

        for b in batches:
            found = []
            for fp, *now, ask in zip(*(b.column(c).to_pylist() for c in ("fp", "band", "part", "i", "j", "asks")), strict=True):
                if now != key:
                    found += done()
                    key, tree, asks = now, [], []
                (asks if ask else tree).append(fp % (1 << 64))
            yield out(found)
        yield out(done())

    return dealt.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for every node that has an edge.

    Each round takes the least label among neighbours, then the label's own
    label; tables are written each round, so a lost executor costs one round.
    """
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    written, hot = labels, hot_keys(both, "b")
    while True:
        heard = join_hot(both, labels.withColumnRenamed("node", "b"), "b", hot).groupBy("a").agg(F.min("label").alias("heard"))
        lower = scratch(labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "lower")
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))  # every label is a node
        new = scratch(join_hot(lower, up, "label", hot_keys(lower, "label")).select("node", "old", F.least("label", "jump").alias("label")), "labels")
        changed = new.where("label != old").limit(1).count()
        discard(lower, written)
        written, labels = new, new.select("node", "label")
        if not changed:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tree_rows: int = 1024) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``; component_id: the least id that links reach."""
    marked = scratch(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = scratch(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    labels = components(links(least.select("fp"), radius, tree_rows, least.count()))
    groups = least.join(labels, least["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    heads = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = groups.join(heads, "label").select("fp", "component_id")
    return join_hot(marked, scratch(by_fp, "by-fingerprint"), "fp", hot_keys(marked, "fp")).select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_pairs(marked: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b), a < b, of the keys of ``marked`` (key, fp): each fingerprint's keys with its least one, and the least ones of the fingerprints that ``links`` joins."""
    heads = scratch(marked.groupBy("fp").agg(F.min("key").alias("head")), "fingerprints")
    same = join_hot(marked, heads, "fp", hot_keys(marked, "fp")).where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = scratch(links(heads.select("fp"), radius, n=heads.count()), "near")
    roots = near.groupBy("b").agg(F.count("*").alias("c"))
    far = join_hot(near.join(side("a"), "a"), side("b"), "b", hottest(scratch(roots, "roots"), "b"))
    return same.union(far.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of each group: the first by id, then key, of its component (rows without an id each stay; of rows with one id and key, the first by a hash).

    Links of the SimHash fingerprints come first, through the BK-trees in shards, and each is verified: texts equal but
    for case and spacing, or with a similarity of 4/5 or more, are one (see shingles). The radius alone would lose most
    of the edited copies, so the exact prefix filter finds what it leaves.
    """
    packed = docs.select(F.col(id_col).alias("__id"), shingles.text_key(F.col(text_col)).alias("__key"), F.col(text_col).alias("__text"), F.struct("*").alias("__row"))
    texts = packed.where(F.col("__id").isNotNull()).select(F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("__text").alias("text"))
    firsts = scratch(texts.groupBy("key").agg(F.min("id").alias("first")), "distinct")
    # One row a key is enough; more do no harm.
    some = only_near(texts, F.xxhash64("id", "key"), firsts, F.xxhash64("first", "key"))
    labels = components(scratch(shingles.edges(some, components, width, first=near_pairs), "links"))
    groups = firsts.join(labels, firsts["key"] == labels["node"], "left").select("first", "key", F.coalesce("label", "key").alias("label"))
    heads = scratch(groups.groupBy("label").agg(F.min(F.struct("first", "key")).alias("head")).select(F.col("head.first").alias("__id"), F.col("head.key").alias("__key")), "heads")
    kept = packed.select("__id", "__key", "__row").join(heads, ["__id", "__key"]).groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
    return kept.unionByName(packed.where(F.col("__id").isNull()).select("__row.*"))

"""A trie of conversation prefixes, rolled up by pointer jumping.

Conversations that begin alike share the nodes of their common turns. A node
is keyed by a digest of its turns and has an edge to its parent's digest. What
a node's whole subtree holds (its leaves, the words that sharing saves) goes up
by doubling: before round k each node holds the sums of its subtree down to
less than 2^k levels and the key of its ancestor 2^k levels up; the round adds
its sums there and takes over the ancestor's own pointer. A tree of depth d
needs log2(d) + 1 rounds, not d. Nodes that neither send nor receive any more
leave the rounds, so these shrink.

Nothing is held whole in a task. Turns get their places from ranges of the
order (conversation, turn) and each range's offset. Digests chain within blocks
of 64 turns; the blocks before are summed up by doubling too (the digest of the
last 2^k blocks and of those before them), so one conversation may hold any
share of all turns. Keys are the first 16 bytes of SHA-256. Pointers to a node
that many share are joined by broadcast of such keys. The ids that end at a
node are joined up in pieces of at most 4096 and hashed as a stream.

Defined results: turns are in order of turn (null first), ties in order of the
SHA-256 of role and text; a null role or text is empty; equal rows are turns of their own;
rows with a null conversation id belong to none and are left out; other
columns are not looked at. Without any conversation there is no node, not even
a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import discard, hot_keys, join_hot, scratch, words

BLOCK = 64
ROOT = b""

#: In what way a conversation is rebuilt: the first ``head`` turns come from conversation ``base``.
Rebuild = Callable[[Column], tuple[Column, Column]]


class Names(NamedTuple):
    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


def shared_heads(conv: Column) -> tuple[Column, Column]:
    """Production: conversation c takes its first crc32(c) % 4 turns from c - c % 20."""
    return conv - conv % 20, (F.crc32(conv.cast("string").cast("binary")) % 4).cast("long")


#: Most turns that a conversation may take from another.
MOST_HEAD = 3


def digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)), 1, 16)


def turns(rows: DataFrame, names: Names) -> DataFrame:
    """(conv, turn, d, words, salt): each turn's digest and word count; ``salt`` only spreads equal rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (names.role, names.text))
    d = digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    kept = rows.where(F.col(names.conv).isNotNull())
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)).cast("int")
    return kept.select(F.col(names.conv).cast("long").alias("conv"), F.col(names.turn).alias("turn"), d.alias("d"), F.size(words(text)).cast("long").alias("words"), salt.alias("salt"))


def placed(slim: DataFrame) -> DataFrame:
    """(conv, pos, d, words): each turn's place in its conversation, from 1.

    The order is dealt out in ranges; only the first conversation of a range
    can have begun before it, so there are no more offsets than ranges.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "d", "salt"]
    ranged = scratch(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("ahead", F.sum("c").over(ahead)).where("ahead IS NOT NULL").select("conv", "part", "ahead")
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:]))
    out = ranged.withColumn("own", own).join(F.broadcast(offsets), ["conv", "part"], "left")
    return out.select("conv", (F.col("own") + F.coalesce("ahead", F.lit(0))).alias("pos"), "d", "words")


def rebuilt(seq: DataFrame, rebuild: Rebuild) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, d, words), (conv, n)) of the rebuilt conversations, those without turns among the latter."""
    lengths = seq.groupBy("conv").agg(F.max("pos").alias("own"))
    base, head = rebuild(F.col("conv"))
    convs = lengths.select("conv", "own", base.alias("base"), head.alias("head"))
    bases = lengths.select(F.col("conv").alias("base"), F.least("own", F.lit(MOST_HEAD)).alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("has", F.lit(0))))
    convs = scratch(convs.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n")), "convs")
    first = seq.where(F.col("pos") <= MOST_HEAD).withColumnRenamed("conv", "base")
    given = convs.where("taken > 0").select("conv", "base", "taken").join(first, "base").where("pos <= taken").select("conv", "pos", "d", "words")
    # A conversation's own turns after its head; they move up where the base is short of turns.
    own = seq.where(F.col("pos") > rebuild(F.col("conv"))[1])
    moved = join_hot(own, convs.select("conv", (F.col("head") - F.col("taken")).alias("less")), "conv", hot_keys(own, "conv"))
    return given.unionByName(moved.select("conv", (F.col("pos") - F.col("less")).alias("pos"), "d", "words")), convs.select("conv", "n")


def chained(seq: DataFrame) -> DataFrame:
    """(conv, block, total, items): each block's turns in order, with the digest of the block up to each."""
    at = F.struct("pos", "d", "words")
    blocks = seq.groupBy("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(at)).alias("t"))  # BLOCK at most
    start = F.struct(F.lit(ROOT).alias("last"), F.array().cast("array<struct<pos: bigint, words: bigint, c: binary>>").alias("items"))

    def step(state: Column, turn: Column) -> Column:
        c = digest(state["last"], turn["d"])
        return F.struct(c.alias("last"), F.concat(state["items"], F.array(F.struct(turn["pos"].alias("pos"), turn["words"].alias("words"), c.alias("c")))).alias("items"))

    return blocks.select("conv", "block", F.aggregate("t", start, step).alias("s")).select("conv", "block", F.col("s.last").alias("total"), "s.items")


def before_blocks(blocks: DataFrame) -> DataFrame:
    """(conv, block, before, last): for every block but a conversation's first, the digest of all blocks before it and the node key of the turn just before it."""
    ends = scratch(blocks.where((F.col("block") > 0) | (F.size("items") == BLOCK)).select("conv", "block", "total"), "block-ends")  # others have none after them
    most = ends.agg(F.max("block")).first()[0]
    upto, step = ends.select("conv", "block", F.col("total").alias("upto")), 1
    while most and step <= most:  # upto: the digest of the last ``step`` blocks up to this one, fewer at the begin
        left = upto.select("conv", (F.col("block") + step).alias("block"), F.col("upto").alias("earlier"))
        upto = scratch(upto.join(left, ["conv", "block"], "left").select("conv", "block", F.when(F.col("earlier").isNull(), F.col("upto")).otherwise(digest(F.lit("&"), F.col("earlier"), F.col("upto"))).alias("upto")), "block-prefixes")
        step *= 2
    shift = (F.col("block") + 1).alias("block")
    before = upto.select("conv", shift, F.col("upto").alias("before"))
    last = ends.join(before, ["conv", "block"], "left").select("conv", shift, node_key(F.col("before"), F.col("total")).alias("last"))
    return before.join(last, ["conv", "block"])


def node_key(before: Column, inside: Column) -> Column:
    """The key of the turns whose full blocks before have the digest ``before`` (null: none) and the rest ``inside``."""
    return F.when(before.isNull(), inside).otherwise(digest(F.lit("|"), before, inside))


def visits(blocks: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, words): the nodes below the root that each conversation passes."""
    later = blocks.where("block > 0").join(before_blocks(blocks), ["conv", "block"])
    flat = blocks.where("block = 0").unionByName(later, allowMissingColumns=True)
    keys = F.transform("items", lambda t: node_key(F.col("before"), t["c"]))
    items = flat.select("conv", "items", keys.alias("keys"), F.coalesce("last", F.lit(ROOT)).alias("last"))
    each = items.select("conv", "keys", "last", F.posexplode("items").alias("i", "t"))
    parent = F.when(F.col("i") == 0, F.col("last")).otherwise(F.get("keys", F.col("i") - 1))
    return each.select("conv", F.col("t.pos").alias("depth"), F.get("keys", F.col("i")).alias("key"), parent.alias("parent"), F.col("t.words").alias("words"))


def ends_hash(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): SHA-256 of the ids in order, comma-joined.

    Ids are joined up by 4096s, so a task reads few rows even for a node where
    very many end; a hash is one chain, so these go through one state in order,
    a piece at a time.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("key", F.shiftright("conv", 12).alias("nth")).agg(piece.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for b in batches:
            done = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "nth").mapInArrow(run, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, parent, depth, sums...) with each of the sums over the node's whole subtree, by pointer jumping.

    ``up`` is the ancestor ``reach`` levels up, null above the root.
    """
    sums = [c for c in nodes.columns if c not in ("key", "parent", "depth")]
    active = scratch(nodes.withColumnRenamed("parent", "up"), "rollup")
    done, reach = [], 1
    while True:
        sent = active.where(F.col("depth") >= reach).groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(f"add_{c}") for c in sums])
        # The ancestors of nodes deeper than the next reach are still below the root and have pointers of their own.
        far = active.where(F.col("depth") > 2 * reach).select("key", "up")
        pointers = active.where(F.col("depth") > reach).select(F.col("key").alias("up"), F.col("up").alias("next"))
        jumped = join_hot(far, pointers, "up", hot_keys(far, "up")).select("key", "next")
        at = F.when(F.col("depth") == 2 * reach, F.lit(ROOT)).otherwise(F.col("next"))
        got = F.col(f"add_{sums[0]}").isNotNull()
        out = active.join(sent, "key", "left").join(jumped, "key", "left")
        out = out.select("key", "depth", at.alias("up"), *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in sums], (got | (F.col("depth") >= 2 * reach)).alias("on"))
        out = scratch(out, "rollup")
        done.append(out.where("NOT on").select("key", *sums))
        active, reach = out.where("on").drop("on"), 2 * reach
        if active.where(F.col("depth") >= reach).isEmpty():
            return reduce(DataFrame.unionByName, done, active.select("key", *sums))


def trie(rows: DataFrame, rebuild: Rebuild = shared_heads, names: Names = Names()) -> DataFrame:
    """One row a node: (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``key`` is the digest of its turns, empty for the root; ``rebuild`` says
    which conversation gives each one's first turns, and how many.
    """
    slim = scratch(turns(rows, names), "turns")
    seq = scratch(placed(slim), "places")
    again, convs = rebuilt(seq, rebuild)
    blocks = scratch(chained(again), "blocks")
    seen = scratch(visits(blocks), "visits")
    below = seen.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = scratch(below.unionByName(top), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    full = scratch(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "full")
    own = full.select("key", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = rolled_up(own)
    last = seen.join(convs.withColumnRenamed("n", "depth"), ["conv", "depth"], "left_semi").select("key", "conv")
    none = convs.where("n = 0").select(F.lit(ROOT).alias("key"), "conv")
    ends = ends_hash(last.unionByName(none))
    lower = full.where("depth > 0").select("key", "parent")
    parents = full.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = join_hot(lower, parents, "parent", hot_keys(lower, "parent")).select("key", "parent_conv_id")
    out = full.join(parents, "key", "left").join(sums, "key").join(ends, "key", "left")
    out = out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    out = scratch(out, "trie")
    discard(slim, seq, blocks, seen, nodes, full)
    return out

"""Near-duplicates by the exact Jaccard similarity of word shingles.

Texts that are equal but for A-Z case and white space share a key. Two others
link if their sets of word shingles (as 64-bit hashes) have a similarity of
4/5 or more. Candidates come from an exact prefix filter: in any one order of
all shingles, linked texts of n shingles share one of their first n//5 + 1.
The order puts common shingles last, so lists stay short; which shingles count
as common changes the work, never the result. Every candidate is verified.

SimHash links, if they are given, are verified first, and each list's members
are compared with its least one; only members that are then still in different
components meet, in cells of two chunks of a list. There a parity bitmap rules
pairs out: each shingle flips one bit, so two bitmaps differ in no more bits
than the sets in shingles, and no link is lost. No list is cut short.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import BLANKS, FILTER_ROWS, bit_filter, bits_of, held_in, hottest, join_hot, only_near, scratch


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (of all words if fewer), in order; empty without words."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    one = xxhash.xxh64_intdigest
    return np.array([one(b" ".join(found[i : i + width]), 42) for i in range(max(1, len(found) - width + 1))] if found else [], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The signed 64-bit SimHash fingerprint of shingle hashes, repeats included: bits set in over half of them."""
    on = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        on += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > len(h), bitorder="little").view("<i8")[0])


def parity_bits(s: np.ndarray) -> bytes:
    """Of distinct hashes: how often each place is hit, odd or even; four to eight places a hash, 64 to 4096 in all."""
    places = min(4096, max(64, 1 << (4 * len(s) - 1).bit_length())) if len(s) else 64
    return np.packbits(np.bincount(s & (places - 1), minlength=places) & 1).tobytes()


def open_pairs(keys: list[bytes], n: list[int], labels: list[bytes], sides: list[int], bits: list[bytes]) -> set[tuple[bytes, bytes]]:
    """Pairs of a cell, the lesser key first, that may have a similarity of 4/5: of two labels and two ``sides`` (0: any), alike in size, their bitmaps near enough."""
    known: dict[bytes, int] = {}
    size, side, label = np.array(n), np.array(sides), np.array([known.setdefault(v, len(known)) for v in labels])
    if len(known) < 2:
        return set()
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(bits):
        by_width.setdefault(len(b), []).append(i)
    found = set()
    for width, mine in by_width.items():
        near = [(np.array(mine), np.frombuffer(b"".join(bits[i] for i in mine), "<u8").reshape(len(mine), -1))]
        if twice := by_width.get(2 * width):  # sizes that are alike have the same width or the next one
            folded = np.frombuffer(b"".join(bits[i] for i in twice), "<u8").reshape(len(twice), 2, -1)
            near.append((np.array(twice), folded[:, 0] ^ folded[:, 1]))
        for at, i in enumerate(mine):
            for k, (those, rows) in enumerate(near):
                those, rows = (those[at + 1 :], rows[at + 1 :]) if k == 0 else (those, rows)
                both = size[those] + size[i]
                may = (label[those] != label[i]) & ((side[those] == 0) | (side[those] != side[i])) & (5 * np.minimum(size[those], size[i]) >= 4 * np.maximum(size[those], size[i]))
                those, rows, both = those[may], rows[may], both[may]
                apart = np.bitwise_count(rows ^ near[0][1][at]).sum(axis=1, dtype=np.int64)
                found.update((min(keys[i], keys[j]), max(keys[i], keys[j])) for j in those[9 * apart <= both])
    return found


def text_key(text: Column) -> Column:
    """Sixteen bytes for a text but for A-Z case and white space; null is as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.md5(F.trim(F.regexp_replace(plain, f"[ {BLANKS}]+", " "))))


def shingled(texts: DataFrame, width: int, choose: Callable[[np.ndarray], np.ndarray], marked: bool = False) -> DataFrame:
    """(key, n, hashes): once a key of ``texts`` (key, text), its number of distinct shingles and those that ``choose`` takes of them, sorted; ``marked``: also fp and bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [shingle_hashes(t.as_py(), width) for t in b.column("text")]
            sets = [np.unique(h.view("<i8")) for h in every]
            columns = {"key": b.column("key"), "n": pa.array([len(s) for s in sets], pa.int64()), "hashes": pa.array([choose(s) for s in sets], pa.list_(pa.int64()))}
            if marked:
                columns |= {"fp": pa.array([majority(h) for h in every], pa.int64()), "bits": pa.array([parity_bits(s) for s in sets], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    found = texts.select("key", "text").mapInArrow(make, "key binary, n long, hashes array<long>" + (", fp long, bits binary" if marked else ""))
    return found.groupBy("key").agg(*[F.first(c).alias(c) for c in found.columns[1:]])


def common_hashes(prefixes: DataFrame, least: int = 3, most: int = FILTER_ROWS) -> np.ndarray:
    """The bits (see ``held_in``) of the hashes that stand in ``least`` prefixes or more; the least is doubled until at most ``most`` are left."""
    counts = scratch(prefixes.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= least), "common")
    while (n := counts.where(F.col("c") >= least).count()) > most:
        least *= 2
    return bits_of(bit_filter(counts.where(F.col("c") >= least), F.col("h"), n)[0])


def prefixes(texts: DataFrame, width: int) -> DataFrame:
    """(key, n, hashes, fp, bits): the first n//5 + 1 shingles of each key, common ones last."""
    common = common_hashes(shingled(texts, width, lambda s: s[: len(s) // 5 + 1]))

    def rarest(s: np.ndarray) -> np.ndarray:
        often = held_in(common, s)
        return np.concatenate([s[~often], s[often]])[: len(s) // 5 + 1]

    return shingled(texts, width, rarest, marked=True)


def similar(pairs: DataFrame, texts: DataFrame, width: int, chunk: int = 1024) -> DataFrame:
    """The rows of ``pairs`` (a, b), a written table, whose texts have a similarity of 4/5 or more.

    The partners of one ``a`` are dealt out by ``chunk``s, and its set is sent once to each.
    """
    asked = scratch(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "asked")
    near = only_near(texts, F.xxhash64("key"), asked, F.xxhash64("key"))
    sets = scratch(shingled(near, width, lambda s: s).join(asked, "key", "left_semi"), "shingles")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"hashes_{c}"))
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    chunks = scratch(pairs.groupBy("a").agg(F.count("*").alias("c")).withColumn("chunks", F.ceil(F.col("c") / chunk)), "chunks")
    dealt = join_hot(pairs, chunks.select("a", "chunks"), "a", hottest(chunks, "a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    heads = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).join(side("a"), "a")
    return dealt.join(side("b"), "b").join(heads, ["a", "chunk"]).where(9 * shared >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def edges(texts: DataFrame, components: Callable[[DataFrame], DataFrame], width: int = 5, chunk: int = 1024, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (a, b) that join up exactly the keys of ``texts`` (key, text) whose similarity is 4/5 or more.

    ``components`` gives (node, label) of such rows; ``first`` gives pairs (a, b), a < b, of the keys of (key, fp) that are verified first.
    """
    sets = scratch(prefixes(texts, width), "prefixes")
    entries = sets.select("key", "n", F.explode("hashes").alias("h"))
    lists = scratch(entries.groupBy("h").agg(F.count("*").alias("size"), F.min("key").alias("head"), F.min_by("n", "key").alias("head_n")).where("size > 1"), "lists")
    hot = hottest(lists, "h", "size")
    entries = scratch(join_hot(only_near(entries, F.col("h"), lists, F.col("h")), lists, "h", hot), "listed")
    alike = lambda x, y: (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))
    stars = entries.where((F.col("key") != F.col("head")) & alike("n", "head_n")).select(F.col("head").alias("a"), F.col("key").alias("b"))
    stars = scratch((stars.union(first(sets.select("key", "fp"))) if first else stars).distinct(), "stars")
    found = scratch(similar(stars, texts, width), "links")
    labels = components(found)
    # What these do not join: pairs of different components, in cells of two chunks each.
    open_ = entries.drop("head", "head_n").join(labels, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key")).drop("node")
    mixed = scratch(open_.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("h"), "mixed")
    own = F.pmod(F.xxhash64("key"), F.col("chunks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.when(F.col("own") == j, 0).when(F.col("own") < j, 1).otherwise(2).alias("side")))
    dealt = join_hot(open_, mixed, "h", hot).withColumn("chunks", F.ceil(F.col("size") / chunk)).withColumn("own", own)
    dealt = dealt.join(sets.select("key", "bits"), "key").select("h", "key", "n", "label", "bits", F.explode(cells).alias("c"))
    dealt = dealt.select("h", "c.i", "c.j", "key", "n", "label", "c.side", "bits").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out(pairs: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            pairs = set()
            for h, i, j, *member in zip(*(b.column(c).to_pylist() for c in ("h", "i", "j", "key", "n", "label", "side", "bits")), strict=True):
                if (h, i, j) != cell:
                    pairs |= open_pairs(*([m[k] for m in held] for k in range(5)))
                    cell, held = (h, i, j), []
                held.append(member)
            yield out(pairs)
        yield out(open_pairs(*([m[k] for m in held] for k in range(5))))

    met = dealt.mapInArrow(search, "a binary, b binary").distinct()
    rest = scratch(met.join(stars, ["a", "b"], "left_anti"), "pairs")
    return found.union(similar(rest, texts, width))

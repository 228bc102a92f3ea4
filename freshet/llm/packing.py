"""Sequence packing by patterns of few documents, fitted with non-negative least squares.

Documents are tokenised and cut into pieces of at most ``capacity`` ids (only
longer documents are cut; the first piece takes the odd rest). The histogram of
piece lengths, at most ``capacity`` numbers, goes to the driver. There the
patterns of up to three lengths that fill a sequence exactly are enumerated,
their repeat counts fitted to the histogram by non-negative least squares and
rounded, and the residual packed best-fit, again on the histogram. The plan
says which ranks of each length go to which sequences; ranking the pieces of a
length is spread over salted groups, so one length may hold any share of the
rows.

Defined results: a null text is an empty one and packs as its end token alone;
a text of any length is encoded whole and cut into pieces; repeated rows are
packed as often as they come, and pieces with equal length and key take their
places in any order; further columns of the input are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import scratch

#: The byte-level pre-tokeniser's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The one pre-tokeniser with that pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Texts beyond this many characters are left to the tokenizer itself.
LONG = 100_000


def astral(text: str) -> bool:
    """Whether a code point lies beyond 16 bits."""
    return not text.isascii() and len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_pairs(tokenizer: dict) -> tiktoken.Encoding | None:
    """A tokenizer file's byte pairs as ranks; None unless it is byte-level throughout and its ids rise with its merges."""
    model, vocab = tokenizer["model"], tokenizer["model"]["vocab"]
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model.get("merges", [])]
    odd = tokenizer.get("normalizer") or tokenizer.get("post_processor") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model["type"] != "BPE" or odd or not BYTE_LEVEL.items() <= (tokenizer.get("pre_tokenizer") or {}).items():
        return None
    known = byte_of()
    own = [t for t in vocab if t not in {x["content"] for x in tokenizer.get("added_tokens", [])}]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(own) or any(vocab.get(c, len(vocab)) > merged[0] for c in known):
        return None
    return tiktoken.Encoding("byte-pairs", pat_str=PATTERN, mergeable_ranks={bytes(known[c] for c in t): vocab[t] for t in own}, special_tokens={})


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer's pairs are merged by their ranks; texts that hold
    one of its added tokens, very long texts or code points beyond 16 bits, and all texts of
    any other tokenizer are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pairs = byte_pairs(json.loads(self.tokenizer.to_str()))

    def encode(self, text: str) -> bytes:
        if self.pairs is None or len(text) > LONG or any(a in text for a in self.added) or astral(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.pairs.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder: the tokenizer is parsed once, whatever the number of tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every document; ids: the piece's token ids, unless ``with_ids`` is False."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stop = np.array([end], dtype="<u4").tobytes()
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encode = encoder(tokenizer).encode
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, out = b.slice(lo, 256), []
                for n, t in enumerate(part.column("text").to_pylist()):
                    ids = encode(t or "") + stop
                    total = len(ids) // 4
                    size = total % capacity or capacity
                    at = piece = 0
                    while at < total:
                        chunk = ids[4 * at : 4 * (at + size)]
                        out.append((n, piece, at, size, zlib.crc32(chunk), chunk))
                        at, piece, size = at + size, piece + 1, capacity
                found = (pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values(), 1))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array([r[0] for r in out], pa.int64())), *found], ["id", *kinds])

    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of the given lengths that sum to ``capacity``; c may be 0, or b and c."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    b, c = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    b, c = b.ravel(), c.ravel()
    a = capacity - b - c
    keep = (b >= c) & (a >= b) & (a > 0)
    a, b, c = a[keep], b[keep], c[keep]
    keep = have[a]
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def nnls(p: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A's columns counting each pattern's lengths.

    Accelerated projected gradient; A is never built. Length 0 does not count.
    """
    size = len(histogram)
    weight = 1 / np.sqrt(np.maximum(np.bincount(p.ravel(), minlength=size), 1.0))  # rows scaled by how many patterns use them
    weight[0] = 0
    target = histogram * weight
    forward = lambda x: weight * sum(np.bincount(p[:, i], weights=x, minlength=size) for i in range(p.shape[1]))
    back = lambda r: sum((weight * r)[p[:, i]] for i in range(p.shape[1]))
    x = back(target) / 9
    y, t = x.copy(), 1.0
    v = np.ones(len(p)) / np.sqrt(max(1, len(p)))
    for _ in range(20):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / max(top * 1.05, 1e-9)
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(counts: dict[int, int], capacity: int = 2048) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, ranks, first sequence, offset) that place every piece, and the number of sequences.

    The pieces of a run go to consecutive sequences at the same offset.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    at = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(ranks[length]), n, sequence, offset))
        ranks[length] += n
        left[length] -= n

    if left[capacity]:
        at = int(left[capacity])
        place(capacity, at, 0, 0)
    todo = np.flatnonzero(left[1:capacity]) + 1
    if len(todo) and len(p := patterns(todo, capacity)):
        x = nnls(p, left.astype(float))
        # Whole repeats first, then one more by falling remainder, as far as the pieces last.
        for amount, order in ((np.floor(x), np.argsort(-x, kind="stable")), (np.ones(len(x)), np.argsort(np.floor(x) - x, kind="stable"))):
            for i in order:
                want = int(amount[i])
                if want < 1:
                    continue
                used: dict[int, int] = {}
                for length in p[i].tolist():
                    if length:
                        used[length] = used.get(length, 0) + 1
                n = min(want, *(int(left[length]) // k for length, k in used.items()))
                if n < 1:
                    continue
                offset = 0
                for length in p[i].tolist():
                    if length:
                        place(length, n, at, offset)
                        offset += length
                at += n
    # Best fit of the residual, longest first: open[space] holds runs of sequences with that much space.
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity - 1, 0, -1):
        space = length
        while left[length]:
            while space <= capacity and not open_[space]:
                space += 1
            if space > capacity:
                n = int(left[length])
                each = capacity // length
                whole = -(-n // each)
                for k in range(each):
                    m = min(whole, n - k * whole)
                    if m > 0:
                        place(length, m, at, k * length)
                        after = min(whole, max(0, n - (k + 1) * whole)) if k + 1 < each else 0
                        if m > after:
                            open_[capacity - (k + 1) * length].append((at + after, m - after))
                at += whole
                break
            first, n = open_[space].pop()
            m = min(n, int(left[length]))
            place(length, m, first, capacity - space)
            if space > length:
                open_[space - length].append((first, m))
            if n > m:
                open_[space].append((first + m, n - m))
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), at


def pack(found: DataFrame, capacity: int = 2048, salt_rows: int = 200_000) -> DataFrame:
    """``found`` (as of ``pieces``) with sequence_id and offset.

    ``found`` should be a written table: it is read for the histogram, the ranks and the result.
    """
    spark = found.sparkSession
    counts = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    deal = spark.sparkContext.broadcast(runs)  # as many runs as patterns and residual steps, whatever the number of rows
    salts = max(16, -(-sum(counts.values()) // salt_rows))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "start"), F.lit(salts)))
    by_length = Window.partitionBy("length").orderBy("salt")
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(by_length) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).drop("salt", "nth", "before")
    out = [c for c in found.columns if c != "ids"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = deal.value
        first = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, these = length == n, runs[first[n] : first[n + 1]]
                i = np.searchsorted(these[:, 1], rank[own], side="right") - 1
                sequence[own] = these[i, 3] + rank[own] - these[i, 1]
                offset[own] = these[i, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(sequence), pa.array(offset)], [*out, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in out)
    return ranked.select(*out, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(scratch(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids=False), "pieces"), capacity)


def sequences(found: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed token ids: one row per sequence (sequence_id, ids), from pieces with their ids."""
    keys = ["id", "piece", "start", "ids_crc32"]
    part = F.struct(F.coalesce(F.col("id").cast("string"), F.lit("(null)")), *keys[1:]).alias("part")  # rows without an id join too
    placed = packed.select(part, "sequence_id", "offset").distinct()
    joined = found.select(part, "ids").dropDuplicates(["part"]).join(placed, "part")
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return joined.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.unhex(F.array_join("parts.ids", "")).alias("ids"))

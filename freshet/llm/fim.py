"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one class: white space, or word
characters of one UTF-8 width (1 to 4 bytes). Each run has its first byte and,
cumulatively, how many characters and tokens end in the runs up to it. A cut
after k units is found by binary search for the run that contains it; its byte
is then arithmetic: the run's first byte plus width times the characters left
in it. A token is white space and the word after it, or the white space at the
end, so tokens end only where runs end; characters end anywhere in them.

Where the cuts fall, whether a text is transformed, and which form it takes
come from the hash of seed and id alone, so any task gives the same result.

Defined results: a null text is an empty one and stays plain, as does a text
with one of the marks; a null id is hashed as the empty one; a text of any
length is cut whole, and so are bytes that are no UTF-8; repeated rows are cut
alike; other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: The class of a character by its first byte: 0 white space, else the bytes it takes; 9 for the bytes inside one.
CLASS = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b < 0x80 else 9 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], dtype=np.uint8)


class Runs(NamedTuple):
    """Maximal class runs: first byte and class of each, and the units that end up to its end."""

    begin: np.ndarray
    kind: np.ndarray
    chars: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Runs:
        kinds = CLASS[np.frombuffer(data, dtype=np.uint8)]
        if not (kinds != 9).any():
            return cls(*(np.zeros(0, dtype=np.int64) for _ in range(4)))
        first = np.flatnonzero(kinds != 9) if (kinds == 9).any() else None  # where characters begin
        kinds = kinds if first is None else kinds[first]
        edge = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
        kind = kinds[edge]
        # A token ends with a word's last run, and with the white space at the end.
        ends = (kind != 0) & (np.append(kind[1:], 0) == 0)
        ends[-1] = True
        return cls(edge if first is None else first[edge], kind, np.append(edge[1:], len(kinds)), np.cumsum(ends))

    def count(self, unit: str) -> int:
        upto = self.chars if unit == "char" else self.tokens
        return int(upto[-1]) if len(upto) else 0

    def cut(self, k: int, unit: str) -> tuple[int, int]:
        """(byte, characters before it) of the cut after k units."""
        if k <= 0:
            return 0, 0
        run = int(np.searchsorted(self.chars if unit == "char" else self.tokens, k))
        before = int(self.chars[run - 1]) if run else 0
        inside = (k if unit == "char" else int(self.chars[run])) - before
        return int(self.begin[run]) + inside * max(1, int(self.kind[run])), before + inside


class Example(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


class Plan(NamedTuple):
    """What decides a transformation: the seed, the unit of the cuts (token or char), and per cent of texts transformed, and of these in the form spm."""

    seed: int = 42
    unit: str = "token"
    rate: int = 50
    spm: int = 80

    def example(self, doc_id: object, data: bytes) -> Example:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        runs = Runs.of(data)
        n = runs.count(self.unit)
        if not data or h3 % 100 >= self.rate or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
            return Example(n, "plain", None, None, data)
        (a, a_chars), (z, z_chars) = (runs.cut(k, self.unit) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = data[:a], data[a:z], data[z:]
        if h4 % 100 < self.spm:
            return Example(n, "spm", a_chars, z_chars - a_chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
        return Example(n, "psm", a_chars, z_chars - a_chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of that form was made of; marks cannot overlap, so the first of each is the true one."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    one, rest = output[len(second) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _map(docs: DataFrame, plan: Plan, id_col: str, text_col: str, made: str, make) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [make(plan.example(i.as_py(), t.as_py() or b"")) for i, t in zip(b.column("id"), b.column("text"), strict=True)]
            table = pa.Table.from_pylist(found, schema) if found else schema.empty_table()
            for out in table.to_batches():
                yield pa.RecordBatch.from_arrays([b.column("id"), *out.columns], ["id", *schema.names])

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in made.split(", "))])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {made}")


def transform(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``."""
    made = _map(docs, plan, id_col, text_col, "n long, form string, prefix_chars long, middle_chars long, output binary", lambda e: e._asdict())
    return made.withColumn("output", F.col("output").cast("string"))


def digests(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``transform``, with the SHA-256 of the output, and of the text that ``restore`` rebuilds from it, in its place: no text leaves a task."""

    def made(e: Example) -> dict:
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return e._asdict() | {"output_sha256": digest(e.output), "restored_sha256": digest(restore(e.output, e.form))}

    return _map(docs, plan, id_col, text_col, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", made)

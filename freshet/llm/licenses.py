"""Licence scans with a positional index of rare tokens.

A notice stands at word ``o`` of a file if at least its share of words stand
at their places ``o + i``, and each of its mandatory phrases stands whole
within ``slack`` words of it. The index files a notice of m words, t of which
must stand, under its m - t + 2 words of highest IDF (fewest documents,
counted over all documents): two of these at least stand in place wherever the
notice does, so a file looks up its own words of highest IDF alone, and only
starts ``o`` that two postings agree on are verified. Nothing that stands is
lost, whatever the counts; they only decide how few starts are looked at.

Words are runs of 0-9, a-z and all code points past ASCII, after A-Z has been
lower-cased. A text is cut into words piece by piece and kept as one number a
word, so memory stays at a few bytes for each of its characters.

Defined results: a null or empty text has no words and no places; a text of
any length is read whole; places may overlap, and a notice counts at every
start where it stands, also where its first words are cut off by the text's
begin; repeated rows are judged alike; ids are carried as they are, and other
columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.license_templates import BASE, NOTICES, Template

#: Fixed value: the words of the contract, after A-Z has been lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD, _GAP = re.compile(WORD), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")  # between words, before A-Z is lower-cased
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

PLACES = "array<struct<label: string, base: boolean, start: long, share: double>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())]))


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class _Numbers(dict):
    """Numbers of the notices' words; any other word is -1."""

    def __missing__(self, word: str) -> int:
        return -1


class LicenseIndex:
    """The notices, filed under their rarest words."""

    def __init__(self, templates: Sequence[Template], seen: Mapping[str, int], slack: int = 20, block: int = 1 << 18):
        self.templates, self.slack, self.block = list(templates), slack, block
        self.words = _Numbers()
        number = lambda text: np.array([self.words.setdefault(w, len(self.words)) for w in words(text)], dtype=np.int32)
        self.ids = [number(t.text) for t in self.templates]
        self.phrases = [[number(p) for p in t.phrases] for t in self.templates]
        self.need = [max(1, math.ceil(t.share * len(n))) for t, n in zip(self.templates, self.ids, strict=True)]
        self.votes = np.array([min(2, n) for n in self.need])
        named = list(self.words)
        postings: list[list[tuple[int, int]]] = [[] for _ in named]
        for t, ids in enumerate(self.ids):
            rarest = sorted(range(len(ids)), key=lambda i: (seen.get(named[ids[i]], 0), named[ids[i]], i))  # noqa: B023
            for i in rarest[: len(ids) - self.need[t] + int(self.votes[t])]:
                postings[ids[i]].append((t, i))
        # Postings as flat arrays; the last entry, for -1, is empty.
        self.n = np.array([len(p) for p in postings] + [0])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.post = np.array([x for p in postings for x in p], dtype=np.int64).reshape(-1, 2)
        self.longest = max((len(n) for n in self.ids), default=1)

    def numbers(self, text: str, piece: int = 1 << 20) -> np.ndarray:
        """The text's words as numbers; pieces end between words."""
        parts, a = [], 0
        while a < len(text):
            gap = _GAP.search(text, a + piece)
            z = gap.start() if gap else len(text)
            parts.append(np.fromiter(map(self.words.__getitem__, words(text[a:z])), dtype=np.int32))
            a = z
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def starts(self, ids: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """(notice, start) with a start in [a, z) that enough postings agree on."""
        lo, hi = max(0, a), min(len(ids), z + self.longest)
        pos = lo + np.flatnonzero(self.n[ids[lo:hi]])
        n = self.n[ids[pos]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = self.post[np.repeat(self.at[ids[pos]], n) + nth]
        notice, start = found[:, 0], np.repeat(pos, n) - found[:, 1]
        inside = (start >= a) & (start < z)
        keys, votes = np.unique(notice[inside] * (1 << 40) + (start[inside] + self.longest), return_counts=True)
        notice, start = keys >> 40, (keys & ((1 << 40) - 1)) - self.longest
        enough = votes >= self.votes[notice] if len(notice) else np.zeros(0, dtype=bool)
        return notice[enough], start[enough]

    def stands(self, ids: np.ndarray, phrase: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Whether the phrase stands whole within each of the spans [a, z)."""
        lo, hi = int(max(0, a.min())), int(min(len(ids), z.max()))
        n = hi - lo - len(phrase) + 1
        if n <= 0:
            return np.zeros(len(a), dtype=bool)
        here = np.ones(n, dtype=bool)
        for i, w in enumerate(phrase):
            here &= ids[lo + i : lo + i + n] == w
        upto = np.concatenate([[0], np.cumsum(here)])
        return upto[np.clip(z - len(phrase) + 1 - lo, 0, n)] > upto[np.clip(a - lo, 0, n)]

    def places(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of words, and the places (label, base, start, share) in order."""
        ids = self.numbers(text or "")
        out = []
        for a in range(-self.longest, len(ids), self.block):
            notices, starts = self.starts(ids, a, a + self.block)
            for t in np.unique(notices):
                start, own = starts[notices == t], self.ids[t]
                at = start[:, None] + np.arange(len(own))
                same = (ids[np.clip(at, 0, len(ids) - 1)] == own) & (at >= 0) & (at < len(ids))
                match = same.sum(axis=1)
                start, match = start[match >= self.need[t]], match[match >= self.need[t]]
                for p in self.phrases[t]:
                    if len(start):
                        ok = self.stands(ids, p, start - self.slack, start + len(own) + self.slack)
                        start, match = start[ok], match[ok]
                label, base = self.templates[t].label, self.templates[t].base
                out += [{"label": label, "base": base, "start": int(max(0, s)), "share": float(m) / len(own)} for s, m in zip(start, match, strict=True)]
        return len(ids), sorted(out, key=lambda p: (p["start"], p["label"], not p["base"], -p["share"]))


def document_counts(docs: DataFrame, text_col: str, listed: Sequence[str]) -> dict[str, int]:
    """In how many documents each of the listed words stands: one number a word of the notices."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = F.array_intersect(F.regexp_extract_all(low, F.lit(WORD), 0), F.array(*[F.lit(w) for w in listed]))
    return {r.word: r["n"] for r in docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = BASE + NOTICES, slack: int = 20) -> DataFrame:
    """(id, n_words, places) for each row of ``docs``: where each notice stands, with the share of its words in place."""
    listed = sorted({w for t in templates for x in (t.text, *t.phrases) for w in words(x)})
    index = LicenseIndex(templates, document_counts(docs, text_col, listed) if listed else {}, slack)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [index.places(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], _PLACES)], ["id", "n_words", "places"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, places {PLACES}")


def label_list(places: Column) -> Column:
    """The places' labels: distinct, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

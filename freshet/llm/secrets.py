"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models are trained: one of random strings, one of
ordinary identifiers and words. Their labelled samples are fixed seed lists
plus the strings that the fixed patterns find (random) and all other tokens
(ordinary) in a bounded sample of documents (``sample_docs``); only pair counts
leave the executors. A token of ``min_length`` or more characters outside the
fixed patterns' spans becomes a ``markov`` span when its log-likelihood ratio
reaches ``min_ratio`` nats per character.

Defined results: a null text is an empty one and has no spans; a text of any
length is scanned whole, in one row; spans that begin at one place stand in the
order of the kinds; ids are carried as they are, null or repeated, and other
columns are not looked at. An empty table gives no rows and the models of
the seed lists.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import bounded_sample

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
INDEX = {c: i for i, c in enumerate(ALPHABET)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")

#: Labelled seeds of the ordinary model; the corpus's own tokens join them.
ORDINARY = (
    "user_name first_name last_name created_at updated_at is_active get_value set_value to_string from_json "
    "parse_arguments main_window file_path base_directory max_length min_value default_timeout connection_pool "
    "request_handler response_body content_type accept_language cache_control documentation implementation "
    "configuration internationalization getElementById addEventListener toUpperCase hasOwnProperty backgroundColor "
    "java/util/concurrent org/example/project src/main/resources usr/local/share site-packages read-only "
    "state-of-the-art well-known twenty-first abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "2023-01-15 2024-12-31 1000000 ================ ---------------- ________________"
).split()


def random_strings(n: int = 400, seed: int = 11) -> list[str]:
    """Labelled seeds of the random model: strings of the usual key alphabets."""
    rng = random.Random(seed)
    kinds = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.hexdigits[:16], string.ascii_uppercase + string.digits)
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(20, 44))) for i in range(n)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def free_tokens(text: str, spans: list[tuple[int, int, int]], min_length: int) -> Iterator[tuple[int, int]]:
    """Tokens of the alphabet that touch none of ``spans``."""
    at, reach = 0, 0
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % min_length, text):
        while at < len(spans) and spans[at][0] < m.end():
            reach, at = max(reach, spans[at][2]), at + 1
        if reach <= m.start():
            yield m.span()


def pair_counts(tokens: Iterator[str]) -> Counter:
    return Counter(p for t in tokens for p in zip(t, t[1:], strict=False) if p[0] in INDEX and p[1] in INDEX)


def log_model(pairs: Counter, smooth: float = 0.5) -> np.ndarray:
    """Log-probabilities of the next character, smoothed over the alphabet."""
    counts = np.full((len(ALPHABET), len(ALPHABET)), smooth)
    for (a, b), n in pairs.items():
        counts[INDEX[a], INDEX[b]] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class SecretModel:
    """The table of log-likelihood ratios, random over ordinary, of each pair of characters."""

    def __init__(self, ratio: np.ndarray, min_length: int, min_ratio: float):
        self.ratio, self.min_length, self.min_ratio = ratio, min_length, min_ratio

    def score(self, token: str) -> float:
        at = [INDEX[c] for c in token]
        return float(self.ratio[at[:-1], at[1:]].sum()) / max(1, len(token) - 1)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        added = [(a, 3, z) for a, z in free_tokens(text, base, self.min_length) if self.score(text[a:z]) >= self.min_ratio]
        return base, sorted(base + added)


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = 4000, min_length: int = 20, min_ratio: float = 1.0) -> SecretModel:
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where("text IS NOT NULL")
    sample = bounded_sample(rows, "h", sample_docs).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in batches:
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                found[0].update(pair_counts(ASSIGN.match(t, a)[2] if k == 0 else t[a:z] for a, k, z in base))
                found[1].update(pair_counts(t[a:z] for a, z in free_tokens(t, base, 2)))
        rows = [(k, a, b, n) for k in (0, 1) for (a, b), n in found[k].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], ["kind", "a", "b", "n"])

    pairs = (pair_counts(iter(random_strings())), pair_counts(iter(ORDINARY)))
    # At most two counts for each pair of characters.
    for kind, a, b, n in sample.mapInArrow(count, "kind int, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n")).collect():
        pairs[kind][(a, b)] += n
    # A pattern that fills the sample must not stand for all random strings: half the weight stays with the seeds.
    seeds = pair_counts(iter(random_strings()))
    scale = max(1.0, sum(pairs[0].values()) / max(1, sum(seeds.values())))
    for p, n in seeds.items():
        pairs[0][p] += int(n * scale)
    return SecretModel(log_model(pairs[0]) - log_model(pairs[1]), min_length, min_ratio)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the spans as asterisks."""
    clear, at = [], 0
    for a, _, z in spans:
        clear += [text[at:a], "*" * max(0, z - max(a, at))]
        at = max(at, z)
    return "".join([*clear, text[at:]])


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for each row; with ``redact`` also redacted: a text that has spans with them masked."""
    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "n_markov": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()} | ({"redacted": pa.string()} if redact else {})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t in b.column("text"):
                text = t.as_py() or ""
                base, spans = model.spans(text)
                n = Counter(k for _, k, _ in spans)
                row = (*(n[k] for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
                out.append((*row, masked(text, spans) if spans else None) if redact else row)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values()))], ["id", *kinds])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string" + ", redacted string" * redact)

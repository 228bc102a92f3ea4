"""Licence scans, fill-in-middle cuts and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import fim, licenses, prefix_trie, queries
from freshet.llm.license_templates import BASE, NOTICES, Template

from helpers import ODD, empty_docs, odd_docs

ALL = BASE + NOTICES
NOTICE = NOTICES[0].text


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def plain_places(text, templates=ALL, slack=20):
    """Every start of every notice, tried one by one."""
    ws, out = license_words(text), []
    for t in templates:
        own = license_words(t.text)
        for o in range(-len(own), len(ws)):
            match = sum(0 <= o + i < len(ws) and ws[o + i] == w for i, w in enumerate(own))
            near = ws[max(0, o - slack) : max(0, o + len(own) + slack)]
            whole = lambda p: any(near[k : k + len(p)] == p for k in range(len(near)))  # noqa: B023, E731
            if match >= math.ceil(t.share * len(own)) and all(whole(license_words(p)) for p in t.phrases):
                out.append((max(0, o), t.label, t.base, match / len(own)))
    return len(ws), sorted(out, key=lambda p: (p[0], p[1], not p[2], -p[3]))


def license_texts():
    rng = random.Random(3)
    pool = NOTICE.split() + "the license of this file is under mit version 2 0 and gnu general public apache cc by nc".split() + ["lorem", "ipsum", "ünder"]
    texts = [t.text for t in ALL] + [ascii_lower(t.text).upper() for t in ALL]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += ["Released under the MIT\n# License.", "under the MIT-License; under-the-mit-license", "CC BY-NC 4.0, cc by nc", "apache license version 2.0", NOTICE.split(" ", 6)[6], "under the mit licenses", "ſunder the mıt license"]
    for _ in range(40):  # notices with words changed, cut at either end
        ws = rng.choice(NOTICES).text.split()
        ws = [w if rng.random() > 0.2 else "changed" for w in ws]
        texts.append(" ".join(["before"] * rng.randint(0, 3) + ws[rng.randint(0, 5) :] + ["after"]))
    return texts


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_places_against_every_start(block):
    index = licenses.LicenseIndex(ALL, {"the": 90, "of": 80, "license": 5, "gnu": 1}, block=block)
    for text in [*ODD, *license_texts()]:
        n, places = index.places(text)
        assert (n, [(p["start"], p["label"], p["base"], p["share"]) for p in places]) == plain_places(text)


def test_pieces_end_between_words():
    index = licenses.LicenseIndex(BASE, {})
    text = " ".join(["Under the MIT License, ünï"] * 400)
    whole = index.numbers(text)
    for piece in (1, 2, 3, 17, 1000):
        assert (index.numbers(text, piece) == whole).all()


def test_a_phrase_is_mandatory():
    with_it = Template("x", "alpha beta gamma delta epsilon zeta eta theta iota kappa", ("gamma delta",), 0.5)
    index = licenses.LicenseIndex([with_it], {})
    assert [p["share"] for p in index.places("alpha beta gamma delta epsilon zeta")[1]] == [0.6]
    assert index.places("alpha beta gamma changed epsilon zeta eta theta iota kappa")[1] == []


def test_license_scan_of_odd_and_long_rows(spark):
    long = ("filler words of no license " * 30000) + "Licensed under CC BY-NC 4.0. " + NOTICE
    docs = odd_docs(spark, clash=True).unionByName(spark.createDataFrame([(99, long)], "doc_id long, text string"), allowMissingColumns=True)
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    for r in got:
        want = [plain_places(t) for t in texts[r.id] if len(t or "") < 5000]
        if want:
            assert (r.n_words, [tuple(p[k] for k in ("start", "label", "base", "share")) for p in r.places]) in want
    (far,) = [r for r in got if r.id == 99]
    assert [(p.label, p.base) for p in far.places] == [("cc-by-nc", True), ("mit", False)] and far.places[0].start == 5 * 30000 + 2
    assert licenses.scan(empty_docs(spark)).count() == 0


UNITS = {"token": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), "char": re.compile(r"(?s:.)")}


def plain_fim(doc_id, text, plan=fim.Plan()):
    text = text or ""
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNITS[plan.unit].findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < plan.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_cuts_against_plain_units(unit):
    rng = random.Random(5)
    texts = [*ODD, "a", " ", "  a", "a  ", "é", "日本 語🙂a\tb", "<", "<S", "x<P", "<P>", "a<M>b", "\x00\x1f\x85\xa0  x"]
    texts += ["".join(rng.choice(" \n\tabé日🙂<SPM>") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    plan = fim.Plan(unit=unit, rate=100, spm=50)
    for i, t in enumerate(texts):
        got, want = plan.example(i, (t or "").encode()), plain_fim(i, t, plan)
        assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output.decode()) == want
        assert fim.restore(got.output, got.form).decode() == (t or "")


def test_bytes_that_are_no_utf8_come_back():
    for data in (b"\xff\xfe", b"\x80", b"a \xe6\x97 b\xff", b"\xc3"):
        for i in range(20):
            e = fim.Plan(rate=100).example(i, data)
            assert fim.restore(e.output, e.form) == data


def test_fim_of_odd_rows(spark):
    docs = odd_docs(spark, clash=True)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *plain_fim(r.doc_id, r.text)) for r in rows), key=str)
    assert sorted((tuple(r) for r in fim.transform(docs).collect()), key=str) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.digests(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *(w := plain_fim(r.doc_id, r.text))[:4], sha(w[4]), sha(r.text or "")) for r in rows), key=str)
    assert fim.transform(empty_docs(spark)).count() == 0 == fim.digests(empty_docs(spark)).count()


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [t for _, _, t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[n] for n in below[node]) if below[node] else 1
        saved[node] = (len(members[node]) - 1) * (words(node[-1][1]) if node else 0) + sum(saved[n] for n in below[node])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()),
        key=str,
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVS = "conv_id long, turn long, role string, text string"


def check_trie(spark, rows, **more):
    docs = spark.createDataFrame(rows, CONVS).repartition(5)
    for name, value in more.items():
        docs = docs.withColumn(name, F.lit(value))
    got = prefix_trie.trie(docs).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_with_odd_rows(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "ü x\ty"])) for c in (*range(0, 66), -3, -20, -41, 2**40 + 7) for t in range(rng.randint(0, 6))]
    rows += [(c, None, "user", "no turn") for c in (3, 4, 20)] + [(25, 1, "user", "tie"), (25, 1, "user", "tie"), (25, 1, None, None)]
    rows += [(None, 0, "user", "no conversation"), (500, None, None, None), (7, 2, "user", "a|b"), (8, 2, "use", "ra|b")]
    check_trie(spark, rows, conv=1, key=2, depth=3, d=4, up=5)


def test_trie_of_deep_hot_conversations(spark, many_ranges):
    """One conversation holds a third of all turns, many share a long head, many end at one node."""
    deep = [("user" if t % 2 else "assistant", f"turn {t % 7} of it") for t in range(300)]
    rows = [(c, t, *deep[t]) for c, n in ((0, 300), (40, 300), (60, 131), (80, 64), (100, 65), (120, 63), (140, 128)) for t in range(n)]
    rows += [(160, t, *deep[t]) for t in range(200)] + [(160, 200, "user", "another way")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(3)]
    check_trie(spark, rows)


def test_trie_of_nothing_and_of_one_root(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVS)).count() == 0
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent, its only turn in the head
    check_trie(spark, [(one, 0, "user", "x")])


def test_new_queries_are_registered(spark, small):
    for name in ("op11_license_scan", "op12_fim_runs", "op13_prefix_trie"):
        assert queries.queries()[name](spark, small).limit(1).count() == 1

"""Secrets, URL filters, quality counts against plain versions."""

import hashlib
import random
import re
import string

from helpers import DOCS, empty_docs, odd_docs, words
from pyspark.sql import functions as F

from freshet.llm import queries, quality_rules, secrets, url_filter

PLAIN = {
    "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def plain_base(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]]
    return sorted(found)


def test_secrets_of_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        named = [f"{kind}:{a}:{z}" for a, _, z, kind in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("markov")] == named
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in PLAIN)
        assert len(spans) == len(named) + r.n_markov


def test_markov_finds_random_strings_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = secrets.fit(docs)
    rng = random.Random(99)
    kinds = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits)
    hits = sum(model.score("".join(rng.choices(kinds[i % 3], k=rng.randint(24, 40)))) >= model.min_ratio for i in range(600))
    assert hits >= 0.95 * 600
    plain = "getElementByIdentifier internationalization_settings maximum_connection_lifetime src/main/java/com/acme/app counterrevolutionaries ---------------------------- http_response_status_code 2024-01-01T00-00-00-000".split()
    assert [t for t in plain if model.score(t) >= model.min_ratio] == []
    base, spans = model.spans("see https example " + "kJ8xQ2vZ9rT4wLm7Yb3NcPqF" + " end")
    assert base == [] and len(spans) == 1


def test_secrets_odd_rows(spark):
    docs = odd_docs(spark, clash=True)
    model = secrets.fit(docs)
    rows = secrets.scan(docs, model).collect()
    assert len(rows) == docs.count()
    assert next(r for r in rows if r.id == 0).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(empty_docs(spark), secrets.fit(empty_docs(spark))).count() == 0


def plain_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else None
    if twice is None:
        seen, twice = set(), set()
        for x in windows:
            (twice if x in seen else seen).add(x)
    inside = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op10_quality_rules(spark, sf_dir).collect():
        counts = plain_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality_rules.COUNTS) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)


def test_quality_odd_rows(spark):
    docs = odd_docs(spark, clash=True)
    rows = quality_rules.judge(docs, carry=("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[c] for c in quality_rules.COUNTS) == plain_counts(r.row.text)
    assert quality_rules.judge(empty_docs(spark)).count() == 0
    assert quality_rules.kept_rows(docs).columns == docs.columns


def test_quality_sketches_merge(spark, sf_dir):
    """Sketches of two halves, added, give the thresholds of the whole; a group's quantiles are those of a sorted list."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = quality_rules.with_counts(docs.select("text", "lang", "source", "doc_id"), F.col("text")).withColumns(quality_rules.rates()).drop("text").cache()
    halves = [quality_rules.sketch(counted.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "rate", "bin").agg(F.sum("n").alias("n"))
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(quality_rules.thresholds(merged)) == order(quality_rules.thresholds(quality_rules.sketch(counted)))
    en = sorted(r.word_length for r in counted.where(~quality_rules.base_failed()).where("lang = 'en'").collect())
    got = quality_rules.quantiles(quality_rules.sketch(counted), ["lang"]).where("lang = 'en' AND rate = 'word_length'").first()
    assert got.docs == len(en)
    for q in (10, 50, 90):
        exact = en[-(-q * len(en) // 100) - 1]
        assert got[f"q{q}"] <= exact < got[f"q{q}"] * 33 / 32 + 1


def test_thresholds_differ_by_group(spark):
    """Two groups of other habits: what is usual in one is beyond the other's threshold."""
    rng = random.Random(8)
    line = lambda longer: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2 + longer, 6 + longer))) for _ in range(60))
    rows = [(i, line(0 if i % 2 else 6), "en", "short" if i % 2 else "long", 0) for i in range(400)]
    rows += [(1001, line(6), "en", "short", 0), (1002, line(0), "en", "long", 0)]
    kept = {r.row.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, DOCS), carry=("doc_id",)).collect()}
    assert not kept[1001] and not kept[1002]
    assert sum(kept.values()) >= 390


def test_quality_bins(spark):
    values = [*range(200), 4095, 4096, 10**6 + 7, 10**15]
    for r in spark.createDataFrame([(v,) for v in values], "v long").withColumn("bin", quality_rules.bin_of(F.col("v"))).collect():
        low = max(0, r.v.bit_length() - 6)
        assert r.bin == r.v >> low << low
        assert r.bin <= r.v and (r.v - r.bin) * 32 <= r.v and (r.v >= 64 or r.bin == r.v)


def plain_verdict(url, rules, patterns):
    after = (url or "").partition("://")[2]
    host, path = re.split("[/?#]", after, maxsplit=1)[0], re.split("[?#]", after, maxsplit=1)[0]
    path = path[len(host) :]
    host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return best.host + best.path, best.verdict
    hits = [p for p in map(url_filter.compiled, patterns) if re.search(p.regex, (url or "").lower(), re.DOTALL)]
    return None, "block" if hits and all(p.block for p in hits) else "allow"


def test_urls(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op8_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.rule, r.verdict) == plain_verdict(urls[r.page_id], url_filter.HOST_RULES, url_filter.PATTERNS)


def test_url_index_loses_no_pattern(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/EN/x?y#z", "http://a.net/es/", "http://net/fr/1", "http://x.org?/es/", "http://user@www.example.com/en/", "http://cheap-pills.biz/a", "http://www.cheap-pills.biz", "http://adult-education.org/porn/", "http://b.org/x/online-casino/y", "http://b.org/porn", "http://b.org/pornography", "http://docs.b.org/adult-chat", "http://b.org/adult-chat?q", "ftp://adserver.foo.org/x", "http://b.org/?affid=3&utm_campaign=spam", "http://b.org/?affid=3&utm_campaign=spammer"]
    patterns = [*url_filter.PATTERNS, "|http://b.org/|", "*casino*", "pills", "^x^"]
    pages = spark.createDataFrame(list(enumerate(odd)) + [(4, odd[4]), (None, odd[5])], "page_id long, url string").withColumn("id", F.lit(1)).withColumn("host", F.lit(2))
    for r in url_filter.judge(pages, patterns=patterns).collect():
        url = odd[r.id] if r.id is not None else odd[5]
        assert (r.rule, r.verdict) == plain_verdict(url, url_filter.HOST_RULES, patterns), url
    assert url_filter.judge(pages.limit(0)).count() == 0


#: Each pattern with a regular expression written by hand.
BY_HAND = {
    "||ads.": r"^[a-z][a-z0-9+.-]*://([^/?#]*[.@])?ads\.", "|http://a.b/c|": r"^http://a\.b/c$", "/rss.xml|": r"/rss\.xml$", "/login^": r"/login([^a-z0-9_.%-]|$)", "^q=*^r=": r"([^a-z0-9_.%-]|$)q=.*([^a-z0-9_.%-]|$)r=",
    "pills": "pills", "/x?y+(z)": r"/x\?y\+\(z\)", "@@||docs.*/Chat^": r"^[a-z][a-z0-9+.-]*://([^/?#]*[.@])?docs\..*/chat([^a-z0-9_.%-]|$)", "*": "", "^": r"([^a-z0-9_.%-]|$)",
}


def test_patterns_mean_what_is_written_by_hand():
    rng = random.Random(12)
    parts = ["http://", "a.b", "ads.", "x.ads.", "bads.", "/c", "/login", "?q=", "&r=", "docs.", "/chat", "/chats", "/rss.xml", "pills", "/x?y+(z)", "#", "@", "_", "%20", "\n"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(3000)] + ["http://a.b/c", "http://ads.x", "http://a.b/login", "http://u@ads.x/", "http://docs.a/b/chat", "http://a/?q=1&r=2"]
    for pattern, regex in BY_HAND.items():
        mine = url_filter.compiled(pattern)
        for u in urls:
            hit = bool(re.search(regex, u, re.DOTALL))
            assert bool(re.search(mine.regex, u, re.DOTALL)) == hit, (pattern, u)
            assert not hit or set(mine.tokens) <= url_filter.url_tokens(u), (pattern, u)  # the index can rely on the tokens


def test_the_list_in_use_blocks_hosts_not_parameters(spark, sf_dir):
    index = url_filter.UrlFilter((), url_filter.PATTERNS, {})
    blocked = ["https://blog.adult-x.example.net/en/1", "http://m.casino-win.example.com/en/4033.html", "https://free-bets.example.com/en/5#top", "https://www.cheap-pills.example.com/de/6", "http://www.spam-farm.example.com/a", "https://m.ads-track.example.com/en/9", "http://shop.org/cart/7", "http://a.org/search?q=x"]
    kept = ["http://a.example.net/en/7817?utm_source=feed", "https://a.example.com/en/7944?page=2&ref=x", "http://a.org/article?utm_medium=mail&fbclid=1&sort=new", "http://readspam.org/adults", "http://heads.org/pads.html", "http://adult-education.org/course", "http://a.org/logins", "http://a.org/casino-history"]
    assert [bool((p := index.pattern(u)) and p.block) for u in blocked + kept] == [True] * len(blocked) + [False] * len(kept)
    rows = queries.op8_url_filter(spark, sf_dir).where("rule IS NULL").collect()
    assert {r.host.split(".example")[0].split(".")[-1] for r in rows if r.verdict == "block"} <= {"adult-x", "casino-win", "free-bets", "cheap-pills", "spam-farm", "ads-track"}


def test_a_hundred_thousand_rules(spark):
    patterns = [f"||host{i}." if i % 2 else f"/path{i}/*^item^" for i in range(100_000)]
    urls = ["http://www.host77777.org/", "http://a.org/path4/x?item", "http://a.org/path5/x?item", "http://host4.org/"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), patterns=patterns).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.id)] == ["block", "block", "allow", "allow"]


def test_only_fetched_patterns_run(spark, monkeypatch):
    """Thousands of patterns: each url runs few of them, and verdicts depend on them."""
    patterns = [f"/topic{i}/*^item{i % 7}^" for i in range(3000)] + ["||ads7."]
    urls = [f"http://site{i}.org/topic{i}/x?item{i % 7}" for i in range(0, 3000, 50)] + ["http://ads7.org/a", "http://site.org/topic/item"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = [r.verdict for r in sorted(url_filter.judge(pages, patterns=patterns).collect(), key=lambda r: r.id)]
    assert verdicts == ["block"] * 61 + ["allow"]
    index = url_filter.UrlFilter((), patterns, url_filter.token_counts(pages, "url", sorted({t for p in patterns for t in url_filter.compiled(p).tokens})))
    run = [sum(len(index.by_token.get(t, ())) for t in ("", *url_filter.url_tokens(u))) for u in urls]
    assert max(run) < 30 and sum(run) < 10 * len(urls)


def test_pattern_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("! a comment\n\n||ads.\n  @@||ads.example.\n")
    assert url_filter.load_patterns(spark, f"file://{tmp_path}/list.txt") == ["||ads.", "@@||ads.example."]


def test_markov_precision_and_recall(spark, sf_dir):
    """On labelled tokens that the models have not seen; the table itself holds no token of letters and digits outside the fixed patterns."""
    model = secrets.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng = random.Random(4711)
    parts = "user account total price customer order invoice session handler factory builder controller repository message queue worker thread buffer index cluster region payload header".split()
    joined = [rng.choice(("_", "-", "/", "")).join(rng.choice((str.lower, str.title))(rng.choice(parts)) for _ in range(rng.randint(3, 5))) for _ in range(800)]
    ordinary = [t for t in joined if len(t) >= 20]
    secret = ["".join(rng.choices(string.ascii_letters + string.digits + "+/"[: 2 * (i % 2)], k=rng.randint(20, 44))) for i in range(800)]
    hits, false = sum(model.score(t) >= model.min_ratio for t in secret), sum(model.score(t) >= model.min_ratio for t in ordinary)
    print(f"recall {hits / len(secret):.3f}, precision {hits / (hits + false):.3f}, of {len(ordinary)} ordinary")
    assert hits >= 0.95 * len(secret) and hits >= 0.98 * (hits + false)

"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from freshet.llm import fim, licenses, mixing, url_filter
from freshet.llm.license_templates import BASE, NOTICES
from freshet.llm.quality_rules import BOTH_TAILS, GUARDS, MIN_GROUP, SPREAD

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RATES = {
    "symbol_rate": "10000 * n_symbols // greatest(word_chars, 1)", "dup_line_rate": "10000 * n_dup_lines // greatest(n_lines, 1)",
    "repeat_rate": "10000 * n_repeat_words // greatest(n_words, 1)", "word_length": "1000 * word_chars // greatest(n_words, 1)",
}


def _quantiles(name: str, keys: str) -> str:
    """A quantile table of the merged sketches."""
    by = f"{keys}, " if keys else ""
    at = ", ".join(f"min(CASE WHEN 100 * cum >= {q} * docs THEN bin END) AS q{q}" for q in (10, 50, 90))
    return f"""{name} AS (SELECT {by}rate, max(docs) AS docs, {at}
        FROM (SELECT {by}rate, bin, sum(sum(n)) OVER (PARTITION BY {by}rate ORDER BY bin) AS cum, sum(sum(n)) OVER (PARTITION BY {by}rate) AS docs FROM sketch GROUP BY {by}rate, bin) GROUP BY {by}rate)"""


def _quality() -> str:
    guard = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in GUARDS.items()) + " END"
    least, most = f"q10 - {SPREAD} * (q50 - q10) - {guard}", f"q90 + {SPREAD} * (q90 - q50) + {guard}"
    chosen = lambda end: f"CASE WHEN own.docs >= {MIN_GROUP} THEN own.{end} WHEN ofl.docs >= {MIN_GROUP} THEN ofl.{end} ELSE ofa.{end} END AS {end}"
    beyond = " OR ".join([f"coalesce({k} > max({k}_most), false)" for k in GUARDS] + [f"coalesce({k} < max({k}_least), false)" for k in BOTH_TAILS]).replace("max(", "(")
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
    seq AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
    tri AS (SELECT rid, i, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM seq WINDOW s AS (PARTITION BY rid ORDER BY i)),
    again AS (SELECT rid, i FROM tri WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, x, y, z) > 1),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
    l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    c AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN rep USING (rid)),
    r AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _RATES.items())}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
    each AS (SELECT lang, source, unnest([{", ".join(f"{{'rate': '{k}', 'v': {k}}}" for k in GUARDS)}]) AS e FROM r WHERE NOT base_failed),
    sketch AS (SELECT lang, source, e.rate AS rate, (e.v >> greatest(length(bin(e.v)) - 6, 0)) << greatest(length(bin(e.v)) - 6, 0) AS bin, count(*) AS n FROM each GROUP BY ALL),
    {_quantiles("q_own", "lang, source")}, {_quantiles("q_lang", "lang")}, {_quantiles("q_all", "")},
    own AS (SELECT *, {least} AS least, {most} AS most FROM q_own), ofl AS (SELECT *, {least} AS least, {most} AS most FROM q_lang), ofa AS (SELECT *, {least} AS least, {most} AS most FROM q_all),
    ch AS (SELECT own.lang AS lang, own.source AS source, own.rate AS rate, {chosen("least")}, {chosen("most")}
        FROM own JOIN ofl ON own.lang IS NOT DISTINCT FROM ofl.lang AND own.rate = ofl.rate JOIN ofa ON own.rate = ofa.rate),
    lim AS (SELECT lang, source, {", ".join(f"max(CASE WHEN rate = '{k}' THEN {e} END) AS {k}_{e}" for k in GUARDS for e in ("least", "most"))} FROM ch GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
    FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source"""


def _mixing() -> str:
    m = mixing.Mixture(dict.fromkeys(("domain", "lang", "source")), {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS})
    keys, parts = list(m.levels), []
    for depth in range(1, len(keys) + 1):
        own, up, table = keys[:depth], keys[: depth - 1], m.weights.get(keys[depth - 1], {})
        weight = "CASE " + keys[depth - 1] + " " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in table.items()) + f" ELSE {min(table.values())}::DOUBLE END" if table else "1::DOUBLE"
        above = f"JOIN b{depth - 1} AS up USING ({', '.join(up)})" if up else f"CROSS JOIN (SELECT sum(tokens) * {m.share}::DOUBLE AS budget FROM leaves) AS up"
        parts.append(f"""n{depth} AS (SELECT t.*, up.budget FROM (SELECT {', '.join(own)}, sum(tokens)::DOUBLE * {m.max_epochs} AS cap, {weight} AS weight FROM leaves GROUP BY {', '.join(own)}) AS t {above}),
    v{depth} AS (SELECT *, (budget - (sum(cap) OVER r - cap)) / (sum(weight) OVER g - sum(weight) OVER r + weight) AS level FROM n{depth} WHERE weight > 0
        WINDOW g AS ({'PARTITION BY ' + ', '.join(up) if up else ''}), r AS ({'PARTITION BY ' + ', '.join(up) if up else ''} ORDER BY cap / weight, {keys[depth - 1]} ROWS UNBOUNDED PRECEDING)),
    b{depth} AS (SELECT {', '.join(own)}, greatest(0, least(cap, weight * max(level) OVER ({'PARTITION BY ' + ', '.join(up) if up else ''}))) AS budget FROM v{depth})""")
    leaf = ", ".join(keys)
    return rf"""WITH r AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4), '(null)') AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
        len({WORDS})::BIGINT AS n, md5(coalesce(text, '')) AS t FROM documents),
    leaves AS (SELECT {leaf}, sum(n)::BIGINT AS tokens FROM r GROUP BY ALL), {", ".join(parts)},
    s AS (SELECT {leaf}, tokens, floor(budget + 1e-6)::BIGINT AS budget FROM leaves JOIN b{len(keys)} USING ({leaf})),
    f AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM s),
    p AS (SELECT r.*, tokens, budget, whole, budget - whole * tokens AS rest, md5(concat_ws(':', '{m.seed}', whole, coalesce(doc_id::VARCHAR, t))) || t AS h FROM r JOIN f USING ({leaf})),
    k AS (SELECT {leaf}, h, sum(sum(n)) OVER (PARTITION BY {leaf} ORDER BY h) - sum(n) AS before FROM p GROUP BY {leaf}, h),
    e AS (SELECT p.*, (whole + (before + n * (row_number() OVER (PARTITION BY {leaf}, h ORDER BY doc_id) - 1) < rest)::INT)::INT AS epochs FROM p JOIN k USING ({leaf}, h))
    SELECT doc_id, {leaf}, n AS n_tokens, tokens AS leaf_tokens, budget AS leaf_budget, epochs FROM e WHERE epochs > 0"""


def _urls() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rules = sorted(url_filter.HOST_RULES, key=lambda r: -len(r.name))
    listed = sorted(map(url_filter.compiled, url_filter.PATTERNS), key=lambda p: (p.block, p.text))
    quoted = [(p, p.regex.replace("'", "''")) for p in listed]
    hit = "CASE WHEN rule IS NULL THEN CASE " + " ".join(f"WHEN regexp_matches(low, '(?s){regex}') THEN '{p.text}'" for p, regex in quoted) + " END END"
    after = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return rf"""WITH a AS (SELECT page_id, coalesce(lower(url), '') AS low, coalesce({after}, '') AS rest FROM pages),
    h AS (SELECT page_id, low, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    r AS (SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in rules)} END AS rule FROM h),
    p AS (SELECT *, {hit} AS pattern FROM r)
    SELECT page_id, host, path, rule, pattern, CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in rules)} WHEN pattern IS NOT NULL AND NOT starts_with(pattern, '@@') THEN 'block' ELSE 'allow' END AS verdict FROM p"""


def _licenses(slack: int = 20) -> str:
    listed = [(t, licenses.words(t.text)) for t in BASE + NOTICES]
    phrases = [(k, licenses.words(p)) for k, (t, _) in enumerate(listed) for p in t.phrases]
    rows = lambda found: ", ".join(f"({', '.join(repr(x) for x in r)})" for r in found)
    in_text = rows((k, i, w) for k, (_, ws) in enumerate(listed) for i, w in enumerate(ws))
    about = rows((k, t.label, t.base, len(ws), -(-round(t.share * len(ws), 6) // 1)) for k, (t, ws) in enumerate(listed))
    in_phrase = rows((k, p, i, w) for p, (k, ws) in enumerate(phrases) for i, w in enumerate(ws))
    lengths = rows((k, p, len(ws)) for p, (k, ws) in enumerate(phrases))
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listing = lambda which: f"coalesce(array_to_string(list_sort(list(DISTINCT label){which}), ','), '')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    s AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
    tw(t, i, word) AS (VALUES {in_text}), tm(t, label, base, m, need) AS (VALUES {about}), pw(t, p, i, word) AS (VALUES {in_phrase}), pm(t, p, len) AS (VALUES {lengths}),
    c AS (SELECT rid, t, pos - i AS o, count(*) AS k FROM s JOIN tw USING (word) GROUP BY ALL),
    f AS (SELECT rid, t, p, pos - i AS o FROM s JOIN pw USING (word) JOIN pm USING (t, p) GROUP BY rid, t, p, o, len HAVING count(*) = len),
    g AS (SELECT rid, t, label, base, o, m, k / m AS share FROM c JOIN tm USING (t) WHERE k >= need),
    h AS (SELECT * FROM g WHERE (SELECT count(*) FROM pm WHERE pm.t = g.t) = (SELECT count(DISTINCT f.p) FROM f JOIN pm USING (p) WHERE f.rid = g.rid AND f.t = g.t AND f.o >= g.o - {slack} AND f.o + len <= g.o + m + {slack})),
    r AS (SELECT rid, count(*) FILTER (base) AS n_base, min(greatest(o, 0)) FILTER (base) AS first_word, max(greatest(o, 0)) FILTER (base) AS last_word, {listing(" FILTER (base)")} AS base_labels, {listing("")} AS labels, max(share) AS score FROM h GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (rid)"""


def _fim(plan: fim.Plan = fim.Plan()) -> str:
    group = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
    part = lambda a, z: f"array_to_string(w[{a}:{z}], '')"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{plan.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
    k AS (SELECT *, len(w)::BIGINT AS n, {group(0)} % (len(w) + 1) AS a, {group(1)} % (len(w) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {group(2)} % 100 >= {plan.rate} THEN 'plain' WHEN {group(3)} % 100 < {plan.spm} THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, {part(1, "least(a, b)")} AS prefix, {part("least(a, b) + 1", "greatest(a, b)")} AS middle, {part("greatest(a, b) + 1", "n")} AS suffix FROM k)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(t) AS restored_sha256,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256 FROM p"""


def _trie() -> str:
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    return rf"""WITH RECURSIVE s AS (SELECT conv_id AS conv, turn, sha256(strlen({role}) || ':' || {role} || {text}) AS d, len({WORDS})::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, d) AS pos, d, words FROM s),
    c AS (SELECT conv, max(pos) AS own FROM t GROUP BY conv),
    crc AS (SELECT conv, conv::VARCHAR AS digits, 0 AS bit, 4294967295::BIGINT AS x FROM c UNION ALL
        SELECT conv, digits, bit + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END FROM (SELECT *, CASE WHEN bit % 8 = 0 THEN xor(x, ascii(substr(digits, bit // 8 + 1, 1))) ELSE x END AS y FROM crc WHERE bit < 8 * length(digits))),
    k AS (SELECT c.conv, c.own, c.conv - c.conv % 20 AS base, xor(x, 4294967295) % 4 AS head FROM c JOIN crc ON crc.conv = c.conv AND bit = 8 * length(digits)),
    m AS (SELECT k.*, least(head, coalesce(b.own, 0)) AS taken FROM k LEFT JOIN c b ON b.conv = k.base),
    r AS (SELECT m.conv, pos, d, words FROM m JOIN t ON t.conv = m.base AND pos <= taken UNION ALL SELECT m.conv, pos - head + taken, d, words FROM m JOIN t ON t.conv = m.conv AND pos > head),
    p AS (SELECT conv, pos, words, md5(string_agg(d, '') OVER (PARTITION BY conv ORDER BY pos)) AS key FROM r UNION ALL SELECT conv, 0, 0, '' FROM m),
    q AS (SELECT *, lag(key) OVER o AS up, lead(pos) OVER o IS NULL AS ends FROM p WINDOW o AS (PARTITION BY conv ORDER BY pos)),
    n AS (SELECT key, min(conv) AS conv_id, any_value(pos) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '') AS ended FROM q GROUP BY key),
    ch AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (key)),
    a AS (SELECT p.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens FROM f JOIN p ON p.conv = f.conv_id AND p.pos <= f.depth GROUP BY p.key)
    SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ended) AS ends_sha256 FROM f JOIN a USING (key) LEFT JOIN n g ON g.key = f.up"""


def oracle_sql() -> dict[str, str]:
    return {"op11_license_scan": _licenses(), "op12_fim_runs": _fim(), "op13_prefix_trie": _trie(), "op4_source_mixing": _mixing(), "op8_url_filter": _urls(), "op10_quality_rules": _quality()}

"""SQL twins of the queries that SQL can express, for DuckDB.

Mixing, packing and page structure are beyond it; those queries are tested
against brute force.
"""

from mealgrid.llm import licenses, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _urn(*parts: str) -> str:
    text = " || chr(31) || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    h = f"md5({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts) + " || '>'"


def _plain(html: str) -> str:
    block = "p|div|h[1-6]|li|ul|ol|tr|table|br|article|section|nav|header|footer|aside|blockquote|pre|form"
    hidden = r"<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
    out = rf"regexp_replace({html}, '(?is){hidden}', '', 'g')"
    out = rf"regexp_replace({out}, '(?is)<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:{block})\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    named = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
    for name, char in named:
        out = f"replace({out}, '{name}', '{char}')"
    out = rf"regexp_replace({out}, '[ \t\r]+', ' ', 'g')"
    return rf"trim(regexp_replace({out}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


OP2 = rf"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body, {_urn("'response'", 'page_id', 'url')} AS id FROM pages
), made AS (
  SELECT *, {_urn("'metadata'", 'id')} AS meta, {_urn("'conversion'", 'id')} AS conv, 'sha256:' || sha256(body) AS digest,
    {_plain('body')} AS plain,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(body)) AS http
  FROM source
), records AS (
  SELECT page_id, uri, id, digest, 'metadata' AS t, meta AS rid, 'application/warc-fields' AS kind,
    'source-digest: ' || digest || chr(13) || chr(10) || 'derived: ' || conv || chr(13) || chr(10) || http || chr(13) || chr(10) AS b FROM made
  UNION ALL
  SELECT page_id, uri, id, digest, 'conversion', conv, 'text/plain; charset=utf-8', plain FROM made
)
SELECT page_id, t AS record_type, rid AS record_id, id AS refers_to, uri AS target_uri, digest AS payload_digest,
  'sha256:' || sha256(b) AS block_digest, cast(octet_length(encode(b)) AS bigint) AS n_bytes,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || t || chr(13) || chr(10) || 'WARC-Record-ID: ' || rid || chr(13) || chr(10)
    || 'WARC-Refers-To: ' || id || chr(13) || chr(10) || 'WARC-Target-URI: ' || uri || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(b) || chr(13) || chr(10)
    || 'Content-Type: ' || kind || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(b)) || chr(13) || chr(10) AS header,
  b AS block
FROM records
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
    cast(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: abs(z[1] - z[2]))) AS integer) AS distance
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), placed AS (
  SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS integer) AS rank FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM placed WHERE rank <= 10
"""

OP8 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
hit AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS r, w, ps FROM docs LEFT JOIN lost USING (doc_id)
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM kept WHERE ps IS NOT NULL),
rest AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
  GROUP BY words.doc_id
)
SELECT kept.doc_id, cast(n AS bigint) AS n_words, cast(r AS bigint) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM kept LEFT JOIN rest ON kept.doc_id = rest.doc_id
"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs
),
grams AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
),
reach AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
root AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(root.y, doc_id)) AS class_id, coalesce(links.n, 0) AS n_links
FROM docs LEFT JOIN root ON doc_id = root.x LEFT JOIN links ON doc_id = links.x
"""


OP11 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), terms AS (SELECT lang, source, r, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t FROM terms GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, t, count(*) AS n FROM terms GROUP BY lang, source, t),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n FROM groups AS g JOIN kept AS k ON g.lang = k.lang
  LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
), whole AS (SELECT lang, t, sum(n) AS n FROM dense GROUP BY lang, t),
p AS (
  SELECT dense.*, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM dense JOIN sizes USING (lang)
), q AS (
  SELECT whole.lang, t, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole JOIN sizes USING (lang)
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS f FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), above AS (SELECT lang, source, t AS item, p - q AS f FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
every AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM above),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS k FROM every)
SELECT lang, source, part, item, cast(f AS bigint) AS value, cast(k AS integer) AS rank FROM placed WHERE part = 'pair' OR k <= 50
"""

OP13 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS a, a.label AS own, b.id AS b, b.label AS other, cast(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS bigint) AS s
  FROM v AS a JOIN v AS b ON a.id <> b.id WHERE a.id % 50 = 0
), positives AS (
  SELECT a, b, s FROM scores WHERE own = other QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), ranked AS (
  SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS k
  FROM positives AS p JOIN scores AS n ON p.a = n.a AND n.own <> n.other AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
)
SELECT a AS anchor_id, p AS positive_id, cast(k AS integer) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM ranked WHERE k <= 3
"""

OP12 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
sized AS (SELECT *, length(x) // 2 AS n FROM docs),
places AS (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM sized WHERE n >= 50),
windows AS (SELECT doc_id, i, md5(substr(x, cast(2 * i + 1 AS bigint), 100)) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN firsts USING (h) WHERE doc_id > d),
begun AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM begun GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS last FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), rest AS (
  SELECT sized.doc_id, sum(b - a) AS r, count(*) AS s,
    string_agg(substr(x, cast(2 * c + 1 AS bigint), cast(2 * (a - c) AS bigint)), '' ORDER BY a) || any_value(CASE WHEN last = 1 THEN substr(x, cast(2 * b + 1 AS bigint)) END) AS t
  FROM sized JOIN gaps ON sized.doc_id = gaps.doc_id GROUP BY sized.doc_id
)
SELECT sized.doc_id, cast(n AS bigint) AS n_bytes, cast(coalesce(r, 0) AS bigint) AS n_removed, cast(coalesce(s, 0) AS bigint) AS n_spans,
  sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM sized LEFT JOIN rest ON sized.doc_id = rest.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(source: str, columns: str, text: str, pattern: str) -> str:
    """Rows ``m`` (a match) and ``pos`` (code points before it), leftmost and without overlap."""
    return f"""SELECT {columns}, ms[i] AS m,
  coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS pos
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT {columns}, regexp_extract_all({text}, {pattern}) AS ms, string_split_regex({text}, {pattern}) AS gs FROM {source}))"""


def _op1() -> str:
    found = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = _quoted(rule.pattern)
        least = f"length(regexp_extract(m, {pattern}, 1)) >= {rule.least}" if rule.least else "true"
        found.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, pos AS s, pos + length(m) AS e FROM ({_matches('docs', 'doc_id', 't', pattern)}) WHERE {least}"
        )
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    line = "kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(found)})
SELECT docs.doc_id, {counts},
  sha256(coalesce(string_agg({line}, ',' ORDER BY s, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({line}, ',' ORDER BY s, rank), '') AS spans, sha256(any_value(t)) AS blob
FROM docs LEFT JOIN found ON docs.doc_id = found.doc_id GROUP BY docs.doc_id"""


def _op5() -> str:
    ratios = {
        "symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"),
        "dup_lines": ("n_dup_lines", "len(lines)"), "marks": ("n_marks", "n_words"),
    }
    at = ", ".join(f"least(4000, (1000 * {a} + greatest({b}, 1) - 1) // greatest({b}, 1)) AS at_{r}" for r, (a, b) in ratios.items())
    names, steps = ", ".join(f"'{r}'" for r in ratios), ", ".join(f"at_{r}" for r in ratios)
    wide = ", ".join(f"max(cut) FILTER (rule = '{r}') AS {r}_cut" for r in ratios)
    over = " OR ".join(f"coalesce(at_{r} > {r}_cut, false)" for r in ratios)
    cuts = ", ".join(f"any_value({r}_cut) AS {r}_cut" for r in ratios)
    tail = "list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.04) + (n - j) * ln(0.96))))"
    return rf"""WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)
), twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
plain AS (
  SELECT docs.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(covered.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals,
    length(t) - length(replace(t, '!', '')) AS n_marks,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM docs LEFT JOIN covered ON docs.doc_id = covered.doc_id
), measured AS (
  SELECT *, {at}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols / greatest(word_chars, 1) AS symbols, n_capitals / greatest(word_chars, 1) AS capitals,
    n_dup_lines / greatest(len(lines), 1) AS dup_lines, n_marks / greatest(n_words, 1) AS marks
  FROM plain
), good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
sampled AS (SELECT * FROM measured SEMI JOIN good ON measured.doc_id = good.doc_id),
spread AS (SELECT lang, unnest([{names}]) AS rule, unnest([{steps}]) AS step FROM measured),
held AS (SELECT lang, rule, step, count(*) AS n FROM spread GROUP BY ALL),
ranked AS (
  SELECT lang, rule, step, sum(n) OVER (PARTITION BY lang, rule) AS whole,
    coalesce(sum(n) OVER (PARTITION BY lang, rule ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM held
), shares AS (SELECT cast(floor(100 * 1.25 ** i) AS bigint) AS share FROM range(31) AS x(i)),
ladder AS (SELECT lang, rule, share, min(step) FILTER (above * 100000 <= whole * share) AS cut FROM ranked, shares GROUP BY ALL),
wide AS (SELECT lang, share, {wide} FROM ladder GROUP BY ALL),
tested AS (
  SELECT wide.lang, share, count(*) AS n, count(*) FILTER ({over}) AS k, {cuts}
  FROM wide JOIN sampled ON wide.lang IS NOT DISTINCT FROM sampled.lang GROUP BY wide.lang, share
), passed AS (
  SELECT *, k < n * 0.04 AND {tail} <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM tested)) AS ok FROM tested
), cuts AS (
  SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY share) AS so_far FROM passed)
  WHERE so_far QUALIFY row_number() OVER (PARTITION BY lang ORDER BY share DESC) = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept,
  symbols, capitals, dup_lines, marks
FROM measured LEFT JOIN cuts ON measured.lang IS NOT DISTINCT FROM cuts.lang"""


def _template(text: str) -> str:
    """A template as an expression over words that each have a blank on either side."""
    out, at = "", 0
    wrapped = lambda part: "".join(f" {w.decode()} " for w in licenses.words(part))
    for m in licenses.MARK.finditer(text):
        out += wrapped(text[at : m.start()])
        at = m.end()
        out += f"(?: [^ ]+ ){{0,{m[3]}}}" if m[2] == "any" else (")?" if m[1] else "(?:")
    return out + wrapped(text[at:])


def _op9() -> str:
    labelled = [(label, _template(t), False) for label, t in licenses.TEMPLATES.items()]
    labelled += [(label, "".join(f" {w} " for w in p.split()), True) for p, label in licenses.PHRASES.items()]
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    found = []
    for label, pattern, base in labelled:
        hits = _matches("docs", "doc_id, line", "line", _quoted(pattern))
        found.append(
            f"SELECT doc_id, '{label}' AS label, {base} AS base, {blanks('substr(line, 1, cast(pos AS bigint))')} AS s, {blanks('m')} AS k FROM ({hits})"
        )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH worded AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT doc_id, len(w) AS n, coalesce(' ' || array_to_string(w, '  ') || ' ', '') AS line FROM worded),
found AS ({" UNION ALL ".join(found)}),
inside AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM found GROUP BY doc_id
)
SELECT docs.doc_id, n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(c / n, 0) AS score
FROM docs LEFT JOIN told ON docs.doc_id = told.doc_id LEFT JOIN inside ON docs.doc_id = inside.doc_id"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": _op1(),
    "op5_quality_rules": _op5(),
    "op9_license_scan": _op9(),
    "op2_warc_derivatives": OP2,
    "op4_hamming_top_k": OP4,
    "op8_substring_dedup": OP8,
    "op10_jaccard_join": OP10,
    "op11_source_divergence": OP11,
    "op12_suffix_dedup": OP12,
    "op13_hard_negatives": OP13,
}

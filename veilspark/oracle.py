"""DuckDB SQL with the same rows as the queries. Views of the supplied tables are there by their names."""

from __future__ import annotations

from veilspark.functions import fixed
from veilspark.operators.context import SENTENCE
from veilspark.operators.detect import LABEL_PATTERN
from veilspark.queries import AROUND, AUDIT_FIELDS, COLUMN_NAMES, FILE_FIELDS, MASKED, NUMBERS, RECORD, SCRIPT, USER_FIELDS, VALUES, WORDS


def _fields(fields: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in fields.items())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CTES: dict[str, str] = {
    "v": f"SELECT k, c_name, {_fields(VALUES)} FROM (SELECT cast(c_custkey AS BIGINT) AS k, c_name FROM customer)",
    "records": f"SELECT k AS doc_id, {RECORD} AS text FROM v",
    "docs": "SELECT doc_id, text FROM documents",
    "files": f"SELECT {_fields(FILE_FIELDS)} FROM documents",
    "users": f"SELECT {_fields(USER_FIELDS)} FROM customer",
    "audit": f"SELECT {_fields(AUDIT_FIELDS)} FROM events",
}


def _placed(source: str, pattern: str, extra: str) -> str:
    """Matches of a pattern with their offsets, from the lengths of gaps and matches."""
    p = _q(pattern)
    return (
        f"SELECT doc_id, {extra}, i AS m, ms[i] AS value, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS INTEGER) AS start "
        f"FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs FROM {source} WHERE regexp_matches(text, {p})))"
    )


def _raw(source: str) -> str:
    parts = [_placed(source, regex, f"{i} AS p, {_q(entity)} AS entity_type, CAST({score} AS DOUBLE) AS score") for i, (entity, _, score, regex) in enumerate(fixed.PATTERNS)]
    return "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, m) - 1 AS INTEGER) AS ord, entity_type, start, CAST(start + length(value) AS INTEGER) AS stop, value, score FROM (" + " UNION ALL ".join(parts) + ")"


def _segments() -> str:
    """Lines cut sign by sign: each sign's entity, the last in the list that holds it, and runs of signs of one entity."""
    docs = f"SELECT doc_id, text, regexp_replace(text, '{NUMBERS}', chr(1), 'g') AS masked FROM documents WHERE text IS NOT NULL"
    listed = "SELECT doc_id, kind, m - 1 AS m, kind || (m - 1) AS id, start, start + length(value) AS stop FROM (" + " UNION ALL ".join(_placed("docs", x, f"'{k}' AS kind") for k, x in (("N", NUMBERS), ("W", AROUND))) + ")"
    signs = lambda side, text: f"SELECT doc_id, '{side}' AS side, i, substring({text}, i + 1, 1) AS c FROM (SELECT doc_id, {text}, unnest(range(0, length({text}))) AS i FROM docs)"
    left = "SELECT doc_id, 'original' AS side, start AS i, arg_max(id, (kind, m)) AS id FROM (SELECT doc_id, kind, m, id, unnest(range(start, stop)) AS start FROM ents) GROUP BY doc_id, start"
    right = "SELECT doc_id, 'sanitized' AS side, i, 'N' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS id FROM signs WHERE side = 'sanitized' AND c = chr(1)"
    numbered = "SELECT s.*, o.id, count(*) FILTER (c = chr(10)) OVER (PARTITION BY s.doc_id, s.side ORDER BY s.i) AS line FROM signs s LEFT JOIN owners o ON o.doc_id = s.doc_id AND o.side = s.side AND o.i = s.i"
    parted = "SELECT *, lag(id) OVER w IS DISTINCT FROM id OR lag(i) OVER w IS NULL AS fresh FROM numbered WHERE c <> chr(10) WINDOW w AS (PARTITION BY doc_id, side, line ORDER BY i)"
    runs = "SELECT doc_id, side, line, run, min(i) AS i, string_agg(c, '' ORDER BY i) AS text, any_value(id) AS id FROM (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, side, line ORDER BY i) AS run FROM parted) GROUP BY doc_id, side, line, run"
    ctes = {"docs": docs, "ents": listed, "signs": signs("original", "text") + " UNION ALL " + signs("sanitized", "masked"), "owners": f"{left} UNION ALL {right}", "numbered": numbered, "parted": parted, "runs": runs}
    return (
        "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in ctes.items()) + " SELECT doc_id, CAST(line + 1 AS INTEGER) AS line_no, bool_or(id IS NOT NULL) OVER (PARTITION BY doc_id, line) AS has_changes, side, "
        "CAST(row_number() OVER (PARTITION BY doc_id, side, line ORDER BY run) - 1 AS INTEGER) AS seg_no, text, id IS NOT NULL AS is_pii, id AS entity_id, left(id, 1) AS entity_type FROM runs"
    )


PARAGRAPHS = "SELECT doc_id, text, list_filter(string_split(text, chr(10) || chr(10)), lambda p: NOT regexp_full_match(p, '\\s*')) AS ps FROM documents WHERE text IS NOT NULL"
#: Groups of paragraphs: a new one is opened where a paragraph no longer fits.
GROUPED = (
    "SELECT doc_id, list_append(r.done, r.cur) AS gs FROM (SELECT doc_id, list_reduce(list_transform(ps, lambda p: {'done': CAST([] AS VARCHAR[]), 'cur': p, 'size': length(p)}), "
    "lambda a, b: CASE WHEN a.size + b.size > 2000 THEN {'done': list_append(a.done, a.cur), 'cur': b.cur, 'size': b.size} ELSE {'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur, 'size': a.size + b.size} END) AS r FROM ps WHERE len(ps) > 0)"
)


def _chunked(body: str) -> str:
    """Spans of windows of 30,000 signs with 500 on either side, counted from the start of the whole text."""
    n, o = fixed.CHUNKS_SMALL["txt"], fixed.TEXT_OVERLAP
    dossiers = "SELECT doc_id // 100 AS big, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM records GROUP BY 1"
    windows = f"SELECT big * 1000 + i AS doc_id, least(i * {n}, {o}) AS lead, i * {n} AS base, length(substring(text, i * {n} + 1, {n})) AS size, substring(text, greatest(i * {n} - {o}, 0) + 1, least(i * {n}, {o}) + {n} + {o}) AS text FROM (SELECT big, text, unnest(range(0, greatest(1, (length(text) + {n - 1}) // {n}))) AS i FROM dossiers)"
    out = "SELECT s.doc_id // 1000 AS doc_id, CAST(s.doc_id % 1000 AS INTEGER) AS idx, s.start >= lead AND s.start < lead + size AS own, entity_type, CAST(s.start - lead + base AS INTEGER) AS start, CAST(s.stop - lead + base AS INTEGER) AS stop, value, round(score, 6) AS score FROM d_same s JOIN windows w ON w.doc_id = s.doc_id"
    return _with(["v", "records"], body, dossiers=dossiers, windows=windows, raw=_raw("windows"), **_dedup("raw", "same"), found=out)


def _named_types() -> str:
    labels = ", ".join(f"({_q(label)}, {_q(kind)})" for label, kind in fixed.LABELS.items())
    names = ", ".join(map(_q, COLUMN_NAMES))
    return (
        f"WITH n AS (SELECT c_custkey AS k, lower(c_mktsegment) || '_' || list_extract([{names}], CAST(c_custkey % {len(COLUMN_NAMES)} + 1 AS BIGINT)) AS name FROM customer), p AS (SELECT *, replace(replace(lower(name), '_', ' '), '-', ' ') AS plain FROM n) "
        f"SELECT k, any_value(name) AS name, arg_min(kind, (strpos(plain, label), -length(label))) AS entity_type FROM p LEFT JOIN (VALUES {labels}) l(label, kind) ON contains(plain, label) GROUP BY k"
    )


def _people() -> str:
    from veilspark.sources.readers import CITIES, FIRST, LAST, STATES, STREETS

    pick = lambda words, step: f"list_extract([{', '.join(map(_q, words))}], CAST((k // {step}) % {len(words)} + 1 AS BIGINT))"
    pad = lambda x, w: f"lpad(CAST(({x}) % {10**w} AS VARCHAR), {w}, '0')"
    letter = lambda x: f"chr(CAST(65 + ({x}) % 26 AS INTEGER))"
    phone = lambda step: f"'+91' || (6000000000 + (k * {step}) % 3999999999)"
    return (
        f"SELECT CAST(k AS VARCHAR) AS id, {pick(FIRST, 1)} || ' ' || {pick(LAST, 8)} AS full_name, 'user' || k || '@mail.example.com' AS email, {phone(7919)} AS phone, {phone(104729)} AS alt_phone, (2000 + k % 8000) || ' ' || {pad('k * 7', 4)} || ' ' || {pad('k * 13', 4)} AS aadhaar, "
        f"'ABC' || {letter('k')} || {letter('k * 3')} || {pad('k', 4)} || {letter('k * 5')} AS pan, {pad('k % 28 + 1', 2)} || '/' || {pad('k % 12 + 1', 2)} || '/' || (1950 + k % 50) AS dob, CASE k % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, (k % 200 + 1) || ' ' || {pick(STREETS, 3)} AS address, "
        f"{pick(CITIES, 1)} AS city, {pick(STATES, 1)} AS state, CAST(100000 + (k * 37) % 899999 AS VARCHAR) AS pincode, CAST(100000000000 + k * 104729 AS VARCHAR) AS account_number, 'SBIN0' || {pad('k', 6)} AS ifsc FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)"
    )


def _entities() -> str:
    """Per form and value: mask, type, confidence and layer; the places follow from the lengths of what stands before. The stars of an address
    leave its first letter and its last four signs as they are, so these belong to no entity."""
    known = [("tokens", 1, "<<AADHAAR_001>>", "AADHAAR", 1.0, "regex"), ("tokens", 2, "<<PAN_001>>", "PAN", 1.0, "spacy"), ("tokens", 3, "<<EMAIL_ADDRESS_001>>", "EMAIL", 1.0, "regex"), ("stars", 1, "****", "PAN", 0.8, "regex"), ("stars", 2, "*****", "UPI", 0.8, "spacy"), ("stars", 3, "***@m***", "EMAIL", 0.9, "regex")]
    rows = ", ".join(f"({_q(f)}, {i}, {_q(m)}, {_q(t)}, CAST({c} AS DOUBLE), {_q(layer)})" for f, i, m, t, c, layer in known)
    return _with(
        ["v"],
        f"SELECT k, form, concat('synth-', start, '-', coalesce(san, 0)) AS id, entity_type, original, masked, CAST(start AS INTEGER) AS start, CAST(start + length(original) AS INTEGER) AS stop, confidence, layer FROM (SELECT k, e.*, CASE WHEN i = 1 THEN aadhaar WHEN i = 2 THEN pan WHEN form = 'stars' THEN substring(email, 2, length(email) - 5) ELSE email END AS original, "
        "CASE i WHEN 1 THEN 9 WHEN 2 THEN 19 + length(aadhaar) ELSE 30 + length(aadhaar) + length(pan) + (form = 'stars')::INTEGER END AS start, CASE i WHEN 1 THEN 9 WHEN 2 THEN 19 + length(m1) ELSE 30 + length(m1) + length(m2) + (form = 'stars')::INTEGER END AS san "
        f"FROM v, (SELECT *, max(CASE WHEN i = 1 THEN masked END) OVER (PARTITION BY form) AS m1, max(CASE WHEN i = 2 THEN masked END) OVER (PARTITION BY form) AS m2 FROM (VALUES {rows}) x(form, i, masked, entity_type, confidence, layer)) e)",
    )


def _shapes() -> str:
    types = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fixed.VIEWER_TYPES.items())
    shaped = " ".join("WHEN " + " AND ".join(f"regexp_matches(m, {_q(x)})" for x in shapes) + f" THEN {_q(kind)}" for kind, shapes in fixed.MASK_SHAPES)
    masked = f"CASE k % {len(MASKED)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(MASKED)) + " END"
    token = "regexp_full_match(m, '<<[A-Z_]+_[0-9]+>>')"
    return f"SELECT k, m AS masked, CASE WHEN {token} THEN CASE regexp_extract(m, '<<([A-Z_]+)_[0-9]+>>', 1) {types} ELSE 'NAME' END WHEN contains(m, '@') THEN 'EMAIL' {shaped} END AS entity_type FROM (SELECT k, {masked} AS m FROM (SELECT c_custkey AS k FROM customer))"


def _dedup(source: str, kind: str) -> dict[str, str]:
    """The fold as a recursion: each span meets the first accepted one that it overlaps."""
    by = "doc_id, entity_type" if kind == "same" else "doc_id"
    keys = by if kind == "same" else "doc_id"
    step = "CASE WHEN h = 0 THEN list_append(acc, x) WHEN x.score > acc[h].score THEN list_concat(list_concat(acc[1:h-1], [x]), acc[h+1:]) ELSE acc END"
    return {
        f"l_{kind}": f"SELECT {keys}, list({{'start': start, 'ord': ord, 'stop': stop, 'value': value, 'score': score, 'kind': entity_type}} ORDER BY start, ord) AS xs FROM {source} GROUP BY {by}",
        f"r_{kind}": f"SELECT {keys}, xs, 1 AS i, xs[1:1] AS acc FROM l_{kind} UNION ALL SELECT {keys}, xs, i + 1, {step} FROM (SELECT *, xs[i + 1] AS x, coalesce(list_position(list_transform(acc, lambda a: a.start < xs[i + 1].stop AND xs[i + 1].start < a.stop), true), 0) AS h FROM r_{kind} WHERE i < len(xs))",
        f"d_{kind}": f"SELECT doc_id, s.ord AS ord, s.kind AS entity_type, s.start AS start, s.stop AS stop, s.value AS value, s.score AS score FROM (SELECT doc_id, unnest(acc) AS s FROM r_{kind} WHERE i = len(xs))",
    }


def _with(names: list[str], body: str, **more: str) -> str:
    ctes = {n: CTES[n] for n in names} | more
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql})" for n, sql in ctes.items()) + " " + body


LISTED = "doc_id, ord, entity_type, start, stop, value, round(score, 6) AS score"


def _records(body: str, **more: str) -> str:
    return _with(["v", "records"], body, raw=_raw("records"), **more)


def _same(body: str) -> str:
    return _records(body, **_dedup("raw", "same"))


def _any(body: str, **more: str) -> str:
    return _records(body, **_dedup("raw", "any"), **more)


#: The steps for ASCII texts; where a look-around is needed, borders are captured and the step is taken twice.
CLEAN = "text"
for _p, _to in ((r"(\d),(\d)", r"\1 \2"), (r"(\d),(\d)", r"\1 \2"), (r"(\d)_(\d)", r"\1-\2"), (r"(\d)_(\d)", r"\1-\2"), (r"[ \t\r\f\v]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
    CLEAN = f"regexp_replace({CLEAN}, {_q(_p)}, {_q(_to)}, 'g')"
for _a, _b in (("l", "1"), ("O", "0")):
    for _p, _to in ((rf"(\d){_a}(\d)", rf"\1{_b}\2"), (rf"(\d){_a}(\d)", rf"\1{_b}\2"), (rf"(\d){_a}\b", rf"\1{_b}"), (rf"\b{_a}(\d)", rf"{_b}\1")):
        CLEAN = f"regexp_replace({CLEAN}, {_q(_p)}, {_q(_to)}, 'g')"
CLEAN = f"regexp_replace({CLEAN}, {_q(r'\b(\d{1,2})[.\-](\d{1,2})[.\-](\d{2,4})\b')}, {_q(r'\1/\2/\3')}, 'g')"

_kinds = {v: [k for k, x in fixed.LABELS.items() if x == v] for v in fixed.LABELS.values()}
LABEL_TYPE = "CASE " + " ".join(f"WHEN label IN ({', '.join(map(_q, names))}) THEN {_q(kind)}" for kind, names in _kinds.items()) + " END"
_LABEL = LABEL_PATTERN.replace("(?iu)", "(?i)")
PAIRS = {
    "lm": _placed("records", _LABEL, "1 AS one"),
    "lp": f"SELECT doc_id, label, val AS value, {LABEL_TYPE} AS entity_type, start AS label_start, start + length(label) AS label_end, start + length(label) + length(sign) AS value_start, start + length(label) + length(sign) + length(val) AS value_end FROM (SELECT doc_id, start, lower(regexp_extract(value, {_q(_LABEL)}, 1)) AS label, regexp_extract(value, {_q(_LABEL)}, 2) AS sign, regexp_replace(regexp_extract(value, {_q(_LABEL)}, 3), '^\\s+|\\s+$', '', 'g') AS val FROM lm) WHERE val <> ''",
}


def _column_types() -> str:
    names = ("aadhaar_no", "customer_phone", "emp_pan", "email_address", "full_name", "zip", "company", "c_custkey", "Date-Of-Birth", "notes")
    labels = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in fixed.LABELS.items())
    return f"SELECT n.name AS name, (SELECT arg_min(l.kind, instr(p, l.label) * 1000 - length(l.label)) FROM (VALUES {labels}) l(label, kind) WHERE instr(p, l.label) > 0) AS entity_type FROM (SELECT name, replace(replace(lower(name), '_', ' '), '-', ' ') AS p FROM (VALUES {', '.join(f'({_q(x)})' for x in names)}) t(name)) n"


def _case(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _boosted(score: str, frm: str = "raw") -> str:
    return f"SELECT doc_id, ord, entity_type, start, stop, value, round({score}, 6) AS score FROM {frm}"


def _context_words() -> str:
    import re

    near = " OR ".join(f"(entity_type = {_q(kind)} AND regexp_matches(b, {_q('|'.join(map(re.escape, words)))}))" for kind, words in fixed.CONTEXT_WORDS.items())
    return _records(_boosted(f"CASE WHEN {near} THEN least(1.0, greatest(score + 0.35, 0.4)) ELSE score END", "(SELECT r.*, lower(substring(text, greatest(1, start - 39), least(40, start))) AS b FROM raw r JOIN records USING (doc_id))"))


ANCHORED = (
    "SELECT doc_id, ord, round(CASE WHEN free AND inside AND score >= 0.55 AND score < 0.85 THEN least(1.0, score + 0.2) WHEN free AND inside AND score < 0.55 THEN 0.7 ELSE score END, 6) AS score, free AND inside AND score < 0.85 AS slide6_boosted, "
    "free AND NOT inside AND score < 0.55 AS standalone_non_pii, free AND inside AND score < 0.85 AS linked_to_identity FROM (SELECT *, entity_type <> 'EMAIL_ADDRESS' AS free, "
    "EXISTS (SELECT 1 FROM raw a WHERE a.doc_id = r.doc_id AND a.entity_type = 'EMAIL_ADDRESS' AND a.score >= 0.7 AND r.start BETWEEN a.start - 300 AND a.stop + 300) AS inside FROM raw r)"
)
DENSE = "SELECT s.doc_id, s.start, s.stop FROM sents s JOIN raw r ON r.doc_id = s.doc_id AND r.start >= s.start AND r.start < s.stop GROUP BY ALL HAVING count(*) >= 3"


def _masked(to: str) -> str:
    """Text around resolved spans put together again."""
    return (
        f"SELECT doc_id, string_agg(substring(text, before + 1, start - before) || {to}, '' ORDER BY start) || substring(any_value(text), max(stop) + 1) AS masked FROM "
        "(SELECT d.*, text, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start DESC) AS n FROM d_any d JOIN records USING (doc_id)) GROUP BY doc_id"
    )


TOKEN = "'<<' || entity_type || '_' || lpad(cast(n AS STRING), greatest(3, length(cast(n AS STRING)))::INTEGER, '0') || '>>'"
REPLACED = (
    "SELECT s.doc_id, list_reduce(list_concat([s.text], coalesce(x.vs, [])), lambda a, b: replace(a, b, '[REDACTED]')) AS masked{more} FROM {source} s LEFT JOIN "
    "(SELECT doc_id, list(value ORDER BY length(value) DESC, f, o) AS vs, sum(n) AS n FROM (SELECT doc_id, value, min(start) AS f, min(ord) AS o, count(*) AS n FROM d_same GROUP BY ALL) GROUP BY doc_id) x USING (doc_id)"
)
PACK = {
    "parts": "SELECT doc_id, text2, flatten(list_transform(regexp_extract_all(text2, '\\n+|[^\\n]+'), lambda p: CASE WHEN length(p) > 600 THEN list_transform(regexp_extract_all(p, '(?s:.*?\\. )|(?s:.+)'), lambda s, i: {'text': s, 'need': CASE WHEN i = 1 THEN length(p) ELSE length(s) END}) ELSE [{'text': p, 'need': length(p)}] END)) AS xs FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text2 FROM documents WHERE text IS NOT NULL)",
    "f": "SELECT doc_id, xs, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM parts UNION ALL SELECT doc_id, xs, i + 1, CASE WHEN length(cur) + xs[i + 1].need > 600 AND cur <> '' THEN list_append(done, cur) ELSE done END, CASE WHEN length(cur) + xs[i + 1].need > 600 AND cur <> '' THEN xs[i + 1].text ELSE cur || xs[i + 1].text END FROM f WHERE i < len(xs)",
    "fin": "SELECT doc_id, CASE WHEN cur <> '' THEN list_append(done, cur) WHEN len(done) = 0 THEN [''] ELSE done END AS cs FROM f WHERE i = len(xs)",
}
STATEMENT = r"""(?s:(?:[^;'"/\-]+|'(?:[^']|'')*'|"[^"]*"|--[^\n]*|/\*.*?\*/|['"/\-])+;?|;)"""


def _statements(pattern: str) -> str:
    return f"SELECT k, CAST(i - 1 AS INTEGER) AS idx, xs[i] AS statement FROM (SELECT k, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT k, list_filter(list_transform(regexp_extract_all(script, {_q(pattern)}), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS xs FROM (SELECT k, {SCRIPT} AS script FROM v)))"


DONE = "status = 'DONE'"
TOTALS = "SELECT name, CAST(sum(n) AS BIGINT) AS value FROM ({parts}) GROUP BY name"
SUMMED = " UNION ALL ".join(f"SELECT '{k}' AS name, id % {m} AS n FROM files WHERE {DONE}" for k, m in (("EMAIL_ADDRESS", 5), ("PAN", 3), ("IN_PHONE", 7)))
LAYERED = f"SELECT 'regex' AS name, id % 11 AS n FROM files WHERE {DONE} UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'spacy' ELSE 'presidio_spacy' END, id % 4 FROM files WHERE {DONE}"


def _search(order: str, name: str) -> str:
    return f"(SELECT '{name}' AS sort, id, total_pii FROM files WHERE {DONE} AND contains(lower(name), 'report_1') ORDER BY {order}, id LIMIT 10)"


SORTED = {"newest": "processed_at DESC NULLS FIRST", "oldest": "processed_at ASC NULLS LAST", "pii-desc": "total_pii DESC NULLS FIRST", "pii-asc": "total_pii ASC NULLS LAST", "name-az": "name ASC", "name-za": "name DESC"}
AUDITED = "SELECT a.id, a.action, a.user_id, a.\"at\", u.email AS user_email, f.name AS file_name FROM audit a JOIN users u ON u.id = a.user_id LEFT JOIN files f ON f.id = a.file_id"
LINES = (
    "WITH m AS (SELECT doc_id, text, regexp_replace(text, '[0-9]{3,}', '[REDACTED]', 'g') AS masked FROM documents), s AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(masked, chr(10)) AS b FROM m), "
    "l AS (SELECT doc_id, unnest(range(1, greatest(len(a), len(b)) + 1)) AS line_no, a, b FROM s), x AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(a[line_no], '') AS original, coalesce(b[line_no], '') AS sanitized FROM l) "
)
RUNS = (
    "WITH x AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS line_no, l_orderkey % 11 = 0 AS c FROM lineitem), y AS (SELECT *, sum(c::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, max(line_no) OVER (PARTITION BY doc_id) AS last FROM x), "
    "z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run, c) AS n, row_number() OVER (PARTITION BY doc_id, run, c ORDER BY line_no) AS a FROM y), h AS (SELECT *, line_no - a + 1 AS f, NOT c AND n > 5 AND line_no - a + 1 > 1 AND line_no - a + n < last AND a > 3 AND a <= n - 3 AS hid FROM z) "
    "SELECT doc_id, CAST(CASE WHEN hid THEN f + 3 ELSE line_no END AS INTEGER) AS start_line, CASE WHEN hid THEN 'collapsed' ELSE 'line' END AS kind, CAST(max(line_no) AS INTEGER) AS end_line, count(*) AS n FROM h GROUP BY 1, 2, 3"
)
WORDS_OF = f"SELECT {_fields(WORDS)}, '{{engine}}' AS engine, row_number() OVER () AS i FROM lineitem WHERE {{side}}"
BOX = {"a": WORDS_OF.format(engine="first", side="l_linenumber <= 3"), "b": WORDS_OF.format(engine="second", side="l_linenumber > 3")}
_wide = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
MEET = f"a.img_id = b.img_id AND {_wide} > 0 AND {_wide} / least(greatest(1, a.width * a.height), greatest(1, b.width * b.height)) > 0.5"
_word = lambda p: ", ".join(f"{p}.{c}" for c in [*WORDS, "engine"])
_types = [*fixed.ALL_TYPES, "ODD"]
_cap = lambda e: f"array_to_string(list_transform(string_split({e}, ' '), lambda w: upper(w[1:1]) || substring(w, 2)), ' ')"
PLAN_SIZE = "size / (1024.0 * 1024.0) > 5"


def oracle_sql() -> dict[str, str]:
    found = _found()
    # Without overlap a tile's crop is its core.
    found["tile_grid_plain"] = f"SELECT * REPLACE (core_left AS x_start, core_top AS y_start, core_right AS x_end, core_bottom AS y_end) FROM ({found['tile_grid']})"
    return found


def _found() -> dict[str, str]:
    documents = lambda body, **more: _with(["docs"], body, raw=_raw("docs"), **more)
    files = lambda body: _with(["files", "users", "audit"], body)
    return {
        "regex_detect_counts": documents("SELECT entity_type, count(*) AS n FROM d_same GROUP BY 1", **_dedup("raw", "same")),
        "regex_detect_spans": _records(f"SELECT {LISTED} FROM raw"),
        "document_spans": documents(f"SELECT {LISTED} FROM raw"),
        "clean_text": _with(["v", "records"], f"SELECT doc_id, {CLEAN} AS cleaned FROM records"),
        "label_pairs": _with(["v", "records"], "SELECT doc_id, label, value, entity_type, CAST(label_start AS INTEGER) AS label_start, CAST(value_start AS INTEGER) AS value_start, CAST(value_end AS INTEGER) AS value_end FROM lp", **PAIRS),
        "column_pii_type": _column_types(),
        "context_word_boost": _context_words(),
        "source_labels": _records(f"SELECT entity_type, CASE WHEN entity_type IN ({', '.join(map(_q, fixed.CUSTOM_TYPES))}) THEN 'regex' ELSE 'presidio_spacy' END AS layer, count(*) AS n FROM raw GROUP BY ALL"),
        "label_word_filter": "SELECT 'PERSON' AS entity_type, 'Customer' AS value, count(*) AS n FROM customer WHERE regexp_matches(c_name, '\\bCustomer\\b') UNION ALL SELECT 'LOCATION', 'Notes', count(*) FROM customer",
        "label_boost": _records(_boosted("CASE WHEN EXISTS (SELECT 1 FROM lp WHERE lp.doc_id = raw.doc_id AND lp.entity_type = raw.entity_type AND raw.start - lp.label_end BETWEEN 0 AND 50) THEN least(1.0, score + 0.15) ELSE score END"), **PAIRS),
        "proximity_boost": _records(_boosted("CASE WHEN c = 0 THEN score WHEN c <= 2 THEN least(1.0, score + 0.1) ELSE least(1.0, score + 0.2) END", "(SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN 150 PRECEDING AND 150 FOLLOWING) - 1 AS c FROM raw)")),
        "anchor_rule": _records(ANCHORED),
        "density_boost": _records(_boosted("CASE WHEN EXISTS (SELECT 1 FROM dense d WHERE d.doc_id = raw.doc_id AND raw.start >= d.start AND raw.start < d.stop) THEN least(1.0, score + 0.1) ELSE score END"), sents=f"SELECT *, start + length(value) AS stop FROM ({_placed('records', SENTENCE, '1 AS one')})", dense=DENSE),
        "column_boost": _records(_boosted("CASE WHEN entity_type = 'ACCOUNT_NUMBER' THEN greatest(score, 0.95) ELSE score END")),
        "dedup_any_type": _any(f"SELECT {LISTED} FROM d_any"),
        "dedup_same_type": _same(f"SELECT {LISTED} FROM d_same"),
        "tiering": _same("SELECT entity_type, CASE WHEN score < 0.6 THEN 'low' WHEN score >= 0.85 THEN 'high' ELSE 'medium' END AS tier, count(*) AS n FROM d_same GROUP BY ALL"),
        "type_summary": _same("SELECT doc_id, entity_type, count(*) AS n FROM d_same GROUP BY ALL"),
        "layer_breakdown": _same("SELECT doc_id, count(*) FILTER (ord % 4 > 1) AS regex, count(*) FILTER (ord % 4 = 1) AS presidio_spacy, count(*) FILTER (ord % 4 = 0) AS indic_bert FROM d_same GROUP BY doc_id"),
        "confidence_breakdown": _same("SELECT doc_id, count(*) FILTER (score >= 0.85) AS high_confidence, count(*) FILTER (score >= 0.6 AND score < 0.85) AS medium_confidence FROM d_same GROUP BY doc_id"),
        "document_summary": documents("SELECT doc_id, count(*) FILTER (score >= 0.85) AS high, count(*) FILTER (score >= 0.6 AND score < 0.85) AS medium, count(score) AS total, count(*) FILTER (entity_type = 'CVV') AS cvv, count(score) AS regex FROM docs LEFT JOIN d_same USING (doc_id) GROUP BY doc_id", **_dedup("raw", "same")),
        "merge_chunk_summaries": documents("SELECT job, key, CAST(sum(n) AS BIGINT) AS value FROM (SELECT doc_id % 7 AS job, entity_type AS key, 1 AS n FROM raw WHERE doc_id % 5 <> 0 UNION ALL SELECT DISTINCT doc_id % 7, unnest(['CVV', 'UPI']), 0 FROM docs) GROUP BY ALL"),
        "chunk_status": files("SELECT job, count(*) AS total, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'pending') AS pending, CAST(round_even(100.0 * count(*) FILTER (s = 'done') / count(*), 0) AS INTEGER) AS percent, CAST(floor((100.0 * count(*) FILTER (s = 'done') + 50.0 * count(*) FILTER (s = 'processing')) / count(*) + 0.5) AS INTEGER) AS progress FROM (SELECT id % 13 AS job, CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE CASE WHEN id % 8 = 3 THEN 'failed' ELSE 'pending' END END AS s FROM audit) GROUP BY job"),
        "job_success": files("SELECT job, NOT (bool_and(job < 10) AND sum(e) = 0) AS success, count(*) FILTER (job < 10) AS failed_parts, CAST(sum(e) AS BIGINT) AS extra FROM (SELECT id % 50 AS job, CASE WHEN (id % 50) % 2 = 0 THEN 0 ELSE 1 END AS e FROM audit) GROUP BY job"),
        "mask_redact": _any(_masked("'[REDACTED]'")),
        "mask_tokenize": _any(_masked(TOKEN)),
        "token_map": _any(f"SELECT doc_id, {TOKEN} AS token, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start DESC) AS n FROM d_any)"),
        "detokenize": _with(["v", "records"], "SELECT doc_id, text FROM records"),
        "mask_partial": _with(["v"], "SELECT k, 'u***@m***.com' AS m_email, substring(phone, 4, 4) || '******' AS m_phone, '**** **** **** ' || right(card, 4) AS m_card, '**** **** ' || right(aadhaar, 4) AS m_aadhaar, left(pan, 2) || '***' || right(pan, 2) AS m_pan, CASE WHEN contains(c_name, ' ') THEN split_part(c_name, ' ', 1) || ' ' || left(string_split(c_name, ' ')[-1], 1) || '****' ELSE left(c_name, 1) || '****' END AS m_c_name, '**/**/' || CASE WHEN 1950 + k % 80 BETWEEN 1900 AND 2099 THEN (1950 + k % 80)::STRING ELSE '****' END AS m_born, repeat('*', greatest(length(account) - 4, 4)) || right(account, 4) AS m_account, '[STREET REDACTED], Pune' AS m_place, '[REDACTED]' AS m_upi FROM v"),
        "value_map_replace": _same(REPLACED.format(source="records", more="")),
        "replace_once": _with(["v", "records"], "SELECT doc_id, replace(replace(replace(text, 'Aadhaar', chr(1)), 'A', '<x>'), chr(1), '[A]') AS masked FROM records"),
        "gated_engine": documents(REPLACED.format(source="docs", more=", coalesce(x.n, 0)::BIGINT AS total").replace("AS masked", "AS masked_text"), **_dedup("raw", "same")),
        "chunk_fixed": "SELECT CAST(floor(l_orderkey / 1000) AS BIGINT) AS chunk, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1",
        "fixed_width": "SELECT doc_id, CAST(i AS INTEGER) AS idx, substring(text, i * 700 + 1, 700) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 699) // 700))) AS i FROM documents)",
        "chunk_overlap": "SELECT doc_id, CAST(i AS INTEGER) AS idx, CASE WHEN i = 0 THEN '' ELSE substring(text, i * 700 - 49, 50) END AS before, substring(text, i * 700 + 1, 700) AS text, substring(text, (i + 1) * 700 + 1, 50) AS after FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 699) // 700))) AS i FROM documents)",
        "neighbour_rows": "SELECT conv_id, turn, coalesce(right(lag(text) OVER w, 20), '') AS before, coalesce(left(lead(text) OVER w, 20), '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
        "head_sample": "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS chunk, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 1000 < 100 GROUP BY 1",
        "paragraph_pack": _with([], "SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, cs[i] AS text FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM fin)", **PACK),
        "sql_statement_split": _with(["v"], _statements("[^;]*;|[^;]+$")),
        "sql_statement_split_aware": _with(["v"], _statements(STATEMENT)),
        "statement_context": "SELECT item_id, CAST(i AS INTEGER) AS idx, array_to_string(w[greatest(1, i * 10 - 1):i * 10], ';') AS before, array_to_string(w[i * 10 + 1:i * 10 + 10], ';') AS own, array_to_string(w[i * 10 + 11:i * 10 + 12], ';') AS after FROM (SELECT item_id, w, unnest(range(0, (len(w) + 9) // 10)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))",
        "tile_grid": "SELECT img_id, w, h, CAST(t AS INTEGER) AS tile_idx, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(cl AS INTEGER) AS core_left, CAST(ct AS INTEGER) AS core_top, CAST(cr AS INTEGER) AS core_right, CAST(cb AS INTEGER) AS core_bottom, CAST(greatest(0, cl - 50) AS INTEGER) AS x_start, CAST(greatest(0, ct - 50) AS INTEGER) AS y_start, CAST(least(w, cr + 50) AS INTEGER) AS x_end, CAST(least(h, cb + 50) AS INTEGER) AS y_end FROM (SELECT *, c * (w // 4) AS cl, r * (h // 4) AS ct, CASE WHEN one OR c = 3 THEN w ELSE (c + 1) * (w // 4) END AS cr, CASE WHEN one OR r = 3 THEN h ELSE (r + 1) * (h // 4) END AS cb FROM (SELECT *, t // 4 AS r, t % 4 AS c FROM (SELECT *, unnest(range(0, CASE WHEN one THEN 1 ELSE 16 END)) AS t FROM (SELECT *, w // 4 = 0 OR h // 4 = 0 AS one FROM (SELECT p_partkey AS img_id, CAST(p_partkey * 37 % 3000 + 2 AS INTEGER) AS w, CAST(p_partkey * 53 % 2000 + 3 AS INTEGER) AS h FROM part)))))",
        "merge_integrity": "SELECT doc_id, n AS lines, n AS merged_lines, s AS semicolons, s AS merged_semicolons, true AS intact FROM (SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n, CAST(length(text) - length(replace(text, ';', '')) AS INTEGER) AS s FROM documents)",
        "column_texts": "SELECT chunk, 's_name' AS \"column\", string_agg(s_name, ' | ' ORDER BY s_suppkey) AS text FROM (SELECT *, CAST(floor(s_suppkey / 40) AS BIGINT) AS chunk FROM supplier WHERE s_suppkey % 40 < 15) GROUP BY chunk UNION ALL SELECT chunk, 'nation', string_agg(s_nationkey::STRING, ' | ' ORDER BY s_suppkey) FROM (SELECT *, CAST(floor(s_suppkey / 40) AS BIGINT) AS chunk FROM supplier WHERE s_suppkey % 40 < 15) GROUP BY chunk",
        "sanitize_table": _with(["v"], "SELECT k, '[REDACTED]' AS email, '[REDACTED]' AS pan, '[REDACTED] / [REDACTED]' AS contact FROM v"),
        "json_root": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'object' ELSE 'scalar' END AS root FROM nation",
        "json_leaf_mask": _with(["v"], "SELECT k, concat('{\"mail\":\"[REDACTED]\",\"n\":', k::STRING, ',\"ids\":[\"[REDACTED]\",\"', upi, '\"]}') AS node FROM v"),
        "json_text_mask": _with(["v"], "SELECT k, concat('{\"k\": ', k::STRING, ', \"email\": \"', email, '\", \"ids\": [\"[PAN]\", \"', upi, '\"]}') AS j FROM v"),
        "run_mask": _with(["v"], "SELECT k, CAST(i AS INTEGER) AS run, CASE i WHEN 0 THEN '[X] and [X]' ELSE '' END AS text FROM (SELECT k, unnest([0, 1, 2]) AS i FROM v)"),
        "pii_distribution": files(TOTALS.format(parts=SUMMED)),
        "layer_distribution": files(TOTALS.format(parts=LAYERED)),
        "top_files": files(f"SELECT name, total_pii AS total FROM files WHERE {DONE} AND total_pii > 0 ORDER BY total_pii DESC, id LIMIT 12"),
        "dashboard_stats": files(f"SELECT count(*) AS files, count(*) FILTER ({DONE}) AS done, count(*) FILTER (status = 'FAILED') AS failed, CAST(coalesce(sum(total_pii), 0) AS BIGINT) AS total_pii, (SELECT count(*) FROM users) AS users FROM files"),
        "recent_files": files("SELECT f.id, f.name, u.name AS uploader, u.email AS uploader_email FROM (SELECT * FROM files ORDER BY uploaded_at DESC, id LIMIT 8) f JOIN users u ON u.id = f.uploaded_by"),
        "file_search": files(" UNION ALL ".join([_search(o, n) for n, o in SORTED.items()] + [f"SELECT 'image', id, total_pii FROM files WHERE {DONE} AND file_type IN ('png', 'jpg', 'jpeg') AND total_pii BETWEEN 1 AND 10"])),
        "file_page": files(f"SELECT id, name FROM files WHERE {DONE} ORDER BY name, id LIMIT 10 OFFSET 20"),
        "page_info": files(f"SELECT count(*) AS total, 30 < count(*) AS has_more FROM files WHERE {DONE}"),
        "admin_search": files("SELECT f.id, f.name, u.name AS uploader FROM files f JOIN users u ON u.id = f.uploaded_by WHERE contains(lower(f.name), '#00000001') OR contains(lower(u.name), '#00000001')"),
        "audit_page": files(f"SELECT id, action, user_email, file_name FROM ({AUDITED}) t ORDER BY t.\"at\" DESC, id LIMIT 50 OFFSET 50"),
        "audit_by_action": files(f"SELECT user_id, count(*) AS n, count(file_name) AS with_file FROM ({AUDITED}) WHERE action = 'click' GROUP BY user_id"),
        "user_file_counts": files("SELECT u.id, u.name, count(f.id) AS files FROM users u LEFT JOIN files f ON f.uploaded_by = u.id GROUP BY ALL"),
        "viewer_rollup": files(f"SELECT {_case('name', fixed.VIEWER_TYPES, _q('NAME'))} AS viewer_type, CAST(sum(n) AS BIGINT) AS n FROM ({SUMMED}) GROUP BY 1"),
        "layer_names_merged": files("SELECT id, CAST(id % 11 AS BIGINT) AS regex, CAST(id % 4 AS BIGINT) AS spacy, CAST(0 AS BIGINT) AS bert FROM files"),
        "role_projection": files(f"SELECT * EXCLUDE (pii_summary, layer_breakdown) FROM files WHERE {DONE}"),
        "download_names": files(f"SELECT id, regexp_replace(name, '\\.[^.]+$', '') || '_sanitized.' || file_type AS file_name, {_case('file_type', fixed.MIME_TYPES, _q('application/octet-stream'))} AS mime_type FROM files"),
        "upload_filter": files("SELECT id, CASE WHEN id % 7 = 0 THEN 'type' WHEN size > 52428800 THEN 'size' ELSE 'ok' END AS verdict FROM files"),
        "update_results": files("SELECT id, CASE WHEN status <> 'PROCESSING' THEN status WHEN id % 4 = 1 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN status = 'PROCESSING' THEN id % 9 ELSE total_pii END AS total_pii FROM files"),
        "delete_files": files("SELECT a.id, CASE WHEN f.id IS NULL THEN a.file_id END AS file_id FROM audit a LEFT JOIN (SELECT id FROM files WHERE id % 6 = 0) f ON f.id = a.file_id"),
        "delete_users": files("SELECT id, uploaded_by FROM files WHERE uploaded_by NOT IN (SELECT id FROM users WHERE role = 'ADMIN')"),
        "overlap_marked": f"WITH ps AS ({PARAGRAPHS}), g AS ({GROUPED}) SELECT doc_id, CAST(i AS INTEGER) AS idx, CASE WHEN i > 0 THEN right(gs[i], 500) || chr(10) || '###OVERLAP_BEFORE###' || chr(10) ELSE '' END || gs[i + 1] || CASE WHEN i < len(gs) - 1 THEN chr(10) || '###OVERLAP_AFTER###' || chr(10) || left(gs[i + 2], 500) ELSE '' END AS content FROM (SELECT doc_id, gs, unnest(range(0, len(gs))) AS i FROM g)",
        "overlap_merged": f"WITH ps AS ({PARAGRAPHS}), m AS (SELECT doc_id, len(ps) AS n, array_to_string(ps, chr(10) || chr(10)) || chr(10) AS again FROM ps), c AS (SELECT *, len(list_filter(string_split(again, chr(10) || chr(10)), lambda p: NOT regexp_full_match(p, '\\s*'))) AS k FROM m) SELECT doc_id, again, CAST(n AS INTEGER) AS paragraphs, CAST(k AS INTEGER) AS merged_paragraphs, k = n AS intact FROM c",
        "scripts_merged": "SELECT doc_id, '-- dump' || chr(10) || 'SET x = 1' || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY g) || chr(10) AS again FROM (SELECT doc_id, i // 3 AS g, string_agg('insert ' || chr(39) || regexp_replace(l, '[^a-z ]', '', 'g') || chr(39) || ';', chr(10) ORDER BY i) AS part FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id, g) GROUP BY doc_id",
        "stitched_text": "SELECT doc_id, text AS again FROM documents WHERE text IS NOT NULL",
        "chunk_union": _chunked("SELECT * FROM found"),
        "chunk_summaries": _chunked("SELECT doc_id, entity_type, count(*) AS n, true AS overlap FROM found GROUP BY ALL UNION ALL SELECT doc_id, entity_type, count(*), false FROM found WHERE own GROUP BY ALL"),
        "ciphertext_forms": _with(["v"], "SELECT k, email || ' ' || pan AS dots, CASE WHEN k % 7 = 0 THEN '[DECRYPTION_FAILED]' ELSE email || ' ' || pan END AS colons, email || ' ' || pan AS own, email || ' ' || pan AS plain FROM v"),
        "encryption_verdicts": "SELECT * FROM (VALUES ('none', 'no_data'), ('all', 'active'), ('some', 'partial'), ('blanks', 'active'), ('plain', 'partial')) v(field, verdict) WHERE (SELECT count(*) FROM customer) > 0",
        "entities_found_again": _entities(),
        "column_types": _named_types(),
        "people_of_customers": _people(),
        "mask_shapes": _shapes(),
        "dealt_queues": "SELECT k, CASE WHEN r + s + b = 0 THEN 'regex' ELSE trim(repeat('regex ', r) || repeat('spacy ', s) || repeat('bert ', b)) END AS layers, trim(repeat('PAN ', k % 3) || repeat('PHONE ', k % 2) || repeat('NAME ', k % 4)) AS types FROM (SELECT c_custkey AS k, c_custkey % 3 AS r, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 4 END AS s, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 ELSE 1 END AS b FROM customer)",
        "json_like_original": _with(["v"], "SELECT k, CASE WHEN k % 2 = 0 THEN '{' || chr(10) || '  \"z\": 1.50,' || chr(10) || '  \"a\": [' || chr(10) || '    \"' || email || '\"' || chr(10) || '  ]' || chr(10) || '}' ELSE '{\"z\": 1.50, \"a\": [\"' || email || '\"]}' END AS j FROM v"),
        "json_any_leaves": "SELECT doc_id, path, CAST(leaf_idx AS INTEGER) AS leaf_idx, value FROM (SELECT doc_id, '$.doc.parts[0].lines[' || i || ']' AS path, i AS leaf_idx, ls[i + 1] AS value FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) "
        "UNION ALL SELECT doc_id, '$.doc.parts[0].tag', len(string_split(text, chr(10))), 'en' FROM documents WHERE text IS NOT NULL) WHERE trim(value, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''",
        "json_any_mask": "SELECT doc_id, '{' || chr(10) || '  \"doc\": {' || chr(10) || '    \"doc_id\": ' || doc_id || ',' || chr(10) || '    \"parts\": [' || chr(10) || '      {' || chr(10) || '        \"lines\": [' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda l: '          ' || CAST(to_json(replace(replace(replace(l, 'the', '[T]'), 'doc', '[D]'), '1', '[1]')) AS VARCHAR)), ',' || chr(10)) "
        "|| chr(10) || '        ],' || chr(10) || '        \"tag\": \"en\"' || chr(10) || '      }' || chr(10) || '    ]' || chr(10) || '  },' || chr(10) || '  \"none\": []' || chr(10) || '}' AS j FROM documents WHERE text IS NOT NULL",
        "json_sanitized": _with(["v"], "SELECT k, concat('{\"k\": ', k::STRING, ', \"contact\": {\"email\": \"[REDACTED]\", \"list\": [\"[REDACTED]\", \"plain\", \" \", \"[REDACTED] / [REDACTED]\"]}}') AS masked_json, CAST(4 AS INTEGER) AS n_leaves, '$.contact.email $.contact.list[0] $.contact.list[3]' AS paths FROM v"),
        "line_segments": _segments(),
        "diff_lines": LINES + "SELECT doc_id, line_no, original, sanitized, CAST(coalesce(sum(length(original) + 1) OVER w, 0) AS BIGINT) AS orig_offset, CAST(coalesce(sum(length(sanitized) + 1) OVER w, 0) AS BIGINT) AS san_offset, original <> sanitized AS has_changes FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "unified_view": LINES + "SELECT doc_id, line_no, 'unchanged' AS side, original AS text FROM x WHERE original = sanitized UNION ALL SELECT doc_id, line_no, 'orig', original FROM x WHERE original <> sanitized UNION ALL SELECT doc_id, line_no, 'san', sanitized FROM x WHERE original <> sanitized",
        "collapse_runs": RUNS,
        "occurrences": _records("SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id, value, entity_type ORDER BY ord) AS INTEGER) AS occurrence, count(*) OVER (PARTITION BY doc_id, value, entity_type) AS occurrences FROM raw"),
        "line_number": _records("SELECT doc_id, ord, CAST(len(string_split(left(text, start), chr(10))) AS INTEGER) AS line_no FROM raw JOIN records USING (doc_id)"),
        "viewer_labels": f"SELECT k, {_case('kind', fixed.VIEWER_TYPES, _q('NAME'))} AS viewer, {_cap("replace(regexp_replace(kind, '^IN_', ''), '_', ' ')")} AS label, {_case('layer', fixed.LAYER_NAMES, 'layer')} AS layer_name, {_case('lower(layer)', fixed.CHART_LAYERS, _cap("replace(layer, '_', ' ')"))} AS chart, CASE WHEN k / 25 > 0.8 THEN 'bg-green-500' WHEN k / 25 >= 0.5 THEN 'bg-yellow-500' ELSE 'bg-red-500' END AS color, CASE WHEN length('a rather long name ' || k::STRING) > 18 THEN left('a rather long name ' || k::STRING, 17) || '…' ELSE 'a rather long name ' || k::STRING END AS short FROM (SELECT n_nationkey AS k, [{', '.join(map(_q, _types))}][n_nationkey % 20 + 1] AS kind, ['regex', 'spacy', 'bert', 'rule_based', 'my_layer'][n_nationkey % 5 + 1] AS layer FROM nation)",
        "reading_text": f"SELECT img_id, string_agg(text, ' ' ORDER BY y, x, text) AS text, count(*) AS words FROM (SELECT {_fields(WORDS)} FROM lineitem) GROUP BY 1",
        "focused_view": LINES + "SELECT doc_id, line_no, original, sanitized FROM x WHERE original <> sanitized",
        "confident_words": f"SELECT img_id, engine, count(*) AS n FROM (SELECT {_fields(WORDS)}, CASE WHEN l_linenumber <= 3 THEN 'first' ELSE 'second' END AS engine FROM lineitem) WHERE confidence > 0.5 GROUP BY 1, 2",
        "ocr_merge": _with([], f"SELECT {_word('a')} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {MEET} AND b.confidence > a.confidence) UNION ALL SELECT {_word('b')} FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {MEET}) UNION ALL SELECT {_word('b')} FROM a JOIN b ON {MEET} AND b.confidence > a.confidence", **BOX),
        "bbox_match": _with([], "SELECT v.img_id, v.value, b.x AS x0, b.y AS y0, b.x + b.width AS x1, b.y + b.height AS y1 FROM (SELECT DISTINCT img_id, concat('W', (img_id % 50)::STRING, '!') AS value FROM a) v JOIN b ON b.img_id = v.img_id AND (contains(lower(v.value), lower(b.text)) OR contains(lower(b.text), lower(v.value)))", **BOX),
        "tile_dedup": _with([], "SELECT img_id, engine AS entity_type, text AS value, count(*) AS tiles FROM a GROUP BY ALL", **BOX),
        "dominant_engine": _with([], "SELECT img_id, CASE WHEN count(*) FILTER (engine = 'second') > count(*) FILTER (engine = 'first') THEN 'second' ELSE 'first' END AS engine FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY img_id", **BOX),
        "exif_text": "SELECT s_suppkey, concat_ws(chr(10), 'GPS: ' || printf('%.6f', CASE WHEN k % 2 = 0 THEN -lat ELSE lat END) || ', ' || printf('%.6f', lon), CASE WHEN k % 3 <> 0 THEN 'Model: M1' END, 'Artist: ' || s_name) AS text FROM (SELECT *, s_suppkey AS k, (s_suppkey % 90) + (s_suppkey % 60) / 60 + (s_suppkey % 7) * 1.5::DOUBLE / 3600 AS lat, (s_suppkey % 180) + (s_suppkey % 30) / 60 + 0.0::DOUBLE AS lon FROM supplier)",
        "encrypt_roundtrip": "SELECT c_custkey, c_name AS plain, true AS encrypted, '[DECRYPTION_FAILED]' AS wrong_key, c_name AS passed_on FROM customer",
        "encryption_probe": "SELECT 'partial' AS verdict",
        "pipeline_plan": files(f"SELECT id, CASE WHEN file_type = 'png' THEN 'D' WHEN file_type IN ('csv', 'json') THEN 'A' WHEN {PLAN_SIZE} THEN 'B' ELSE 'C' END AS rule, CASE file_type WHEN 'png' THEN 16 WHEN 'csv' THEN 10000 WHEN 'json' THEN 1500 WHEN 'txt' THEN CASE WHEN {PLAN_SIZE} THEN 100000 ELSE 30000 END ELSE CASE WHEN {PLAN_SIZE} THEN 15 ELSE 5 END END AS chunk_size, file_type IN ('txt', 'pdf') AND NOT {PLAN_SIZE} AS use_bert FROM files"),
        # A file of an unknown type is not masked, and its text is not given out.
        "sanitize_files": documents("SELECT doc_id, CASE WHEN error IS NULL THEN masked_text END AS masked_text, error FROM (" + REPLACED.format(source="docs", more=", CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'unknown file type' END AS error").replace("AS masked", "AS masked_text") + ")", **_dedup("raw", "same")),
        "pii_report": _records("SELECT 1 AS \"Line\", entity_type AS \"Entity Type\", value AS \"Original Value\", '[REDACTED]' AS \"Masked Value\", printf('%.2f', score) AS \"Confidence\", 'regex' AS \"Layer\" FROM raw"),
        "joined_chunks": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
        "size_gates": files("SELECT id, size / 1048576.0 > 5 AS chunked, size / 1048576.0 <= 100 AS valid FROM files"),
        "paragraph_pack_whole": _with([], "SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, cs[i] AS text FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM fin)", **PACK | {"parts": PACK["parts"].replace("length(p) > 600", "false")}),
        "files_by_age": files(" UNION ALL ".join(f"SELECT '{k}' AS since, id FROM files WHERE {DONE}" + (f" AND processed_at * 400 >= 31536000 - {n} * 86400" if n else "") for k, n in {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "ever": None}.items())),
        "types_seen": documents("SELECT entity_type, min(ord) AS first, count(*) AS n FROM raw GROUP BY 1"),
        "exif_hits": _records("SELECT k, CAST(count(value) FILTER (contains(concat('Artist: ', email, '; ', pan), value)) AS INTEGER) AS hits FROM v LEFT JOIN raw ON doc_id = k GROUP BY k"),
        "encrypted_fields": "SELECT c_custkey, c_name, c_mktsegment, true AS hidden, c_name AS node_name, CAST(c_custkey AS BIGINT) AS node_key FROM customer",
        "fresh_requests": "SELECT n_nationkey, 40 - n_nationkey * 3 <= 30 AND n_nationkey * 3 - 40 <= 5 AS accepted, false AS forged FROM nation",
        "insert_files": files("SELECT id, name, status, total_pii FROM files UNION ALL SELECT -o_orderkey, concat('new_', o_orderkey::VARCHAR, '.txt'), 'PROCESSING', NULL FROM orders"),
        "files_looked_up": files("SELECT a.file_id AS id, f.name, f.id IS NOT NULL AS found FROM (SELECT DISTINCT file_id FROM audit WHERE file_id IS NOT NULL) a LEFT JOIN files f ON f.id = a.file_id"),
        "report_json": _records(f"SELECT doc_id, ord, CAST(json_object('id', ord, 'entity_type', entity_type, 'original', value, 'masked', '[REDACTED]', 'start', start, 'end', stop, 'confidence', score, 'layer', 'regex') AS VARCHAR) AS json FROM raw"),
        "json_leaf_detection": _with(["v"], "SELECT k, unnest(['email', 'inner.pan']) AS path, '[REDACTED]' AS masked FROM v"),
        "json_array_parts": _with(["v"], "SELECT k, concat('[\"', email, '\",{\"z\":1,\"a\":\"x\"},null,', k::VARCHAR, ',true]') AS j FROM v"),
        "json_object_parts": _with(["v"], "SELECT k, concat('{\"z\":', k::VARCHAR, ',\"mail\":\"', email, '\",\"a\":2}') AS j FROM v"),
        "json_indent": "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 END AS INTEGER) AS indent FROM nation",
        "replace_in_order": _with(["v", "records"], "SELECT doc_id, replace(replace(text, 'A', '<x>'), 'Aadhaar', '[A]') AS masked FROM records"),
        "time_left": files("SELECT job, CASE WHEN n > 0 THEN round((t - n) * (job * 60) / CAST(n AS DOUBLE), 6) END AS seconds FROM (SELECT id % 13 AS job, count(*) AS t, count(*) FILTER (id % 4 IN (0, 2)) AS n FROM audit GROUP BY 1)"),
        "entities_of_type": _records("SELECT doc_id, ord, value FROM raw WHERE entity_type = 'PAN'"),
        "page_values": _records("SELECT DISTINCT CAST(floor(doc_id / 50) AS BIGINT) AS page, value FROM raw"),
        "file_ids": _with(["v"], "SELECT k, print AS file_id FROM v"),
        "audit_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }

"""DuckDB SQL for the cross-check of every registered query.

Each statement re-states a query's semantics in plain SQL over the test
tables (pre-registered as views). DuckDB's regex engine (RE2) has ASCII-only
``\\b``/``\\d``, so patterns are used without Spark's ``(?U)`` prefix; on the
test tables both engines agree.
"""

from __future__ import annotations

from veilscan import rules

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# String columns of the test tables (fixed schemas).
STRING_COLUMNS: dict[str, list[str]] = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Distinct web hosts of the pages, as source names.
HOSTS = (
    "SELECT DISTINCT h AS name FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) "
    "WHERE h <> ''"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _patterns(profile: str) -> dict[str, str]:
    return rules.SIMPLE_PATTERNS if profile == "simple" else rules.CONTENT_PATTERNS


def types_str(text: str, profile: str = "content") -> str:
    """Comma-joined matching types in rule order ('' when none)."""
    cases = [f"CASE WHEN regexp_matches({text}, {q(p)}) THEN {q(t)} END" for t, p in _patterns(profile).items()]
    return "concat_ws(',', " + ", ".join(cases) + ")"


def classification(types: str) -> str:
    lst_expr = f"string_split({types}, ',')"
    parts = [f"WHEN list_has_any({lst_expr}, {lst(m)}) THEN {q(n)}" for n, m in rules.RISK_TIERS]
    return "CASE " + " ".join(parts) + f" ELSE {q(rules.NO_RISK)} END"


def access(cls: str) -> str:
    parts = [f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.ACCESS_LEVELS.items()]
    return f"CASE {cls} " + " ".join(parts) + f" ELSE {q(rules.DEFAULT_ACCESS_LEVEL)} END"


def name_types(name: str) -> str:
    cases = []
    for t, pats in rules.COLUMN_NAME_PATTERNS.items():
        cond = " OR ".join(f"contains(lower({name}), {q(p)})" for p in pats)
        cases.append(f"CASE WHEN {cond} THEN {q(t)} END")
    return "concat_ws(',', " + ", ".join(cases) + ")"


def source_types_list(name: str) -> str:
    parts = []
    for kws, types in rules.SOURCE_NAME_RULES:
        cond = " OR ".join(f"contains(lower({name}), {q(k)})" for k in kws)
        parts.append(f"CASE WHEN {cond} THEN {lst(types)} ELSE []::VARCHAR[] END")
    expr = parts[0]
    for p in parts[1:]:
        expr = f"list_concat({expr}, {p})"
    return expr


def head_bytes(text: str, n: int) -> str:
    tries = [f"try(decode(encode({text})[1:{n - k}]))" for k in range(4)]
    return "coalesce(" + ", ".join(tries) + ")"


def _findings(source_sql: str, keys: list[str], text: str, profile: str = "content") -> str:
    k = ", ".join(keys)
    return f"""
WITH t AS (SELECT {k}, {types_str(text, profile)} AS pii_types FROM {source_sql}),
c AS (SELECT {k}, pii_types, {classification('pii_types')} AS data_classification FROM t WHERE pii_types <> '')
SELECT {k}, pii_types, data_classification, {access('data_classification')} AS access_level FROM c"""


def _attributes_cte() -> str:
    """Every attribute with the number of rows that have it."""
    counted = "\n  UNION ALL ".join(
        f"SELECT {q(t)} AS table_name, column_name, rows FROM "
        f"(UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE rows)"
        for t in TABLE_NAMES
    )
    return f"""cat AS (SELECT table_name, column_name, rows FROM ({counted})),
{_findings_of_cat('rows, ')}"""


def _findings_of_cat(more: str = "") -> str:
    return f"""cf AS (SELECT table_name, column_name, {more}{name_types('column_name')} AS pii_types FROM cat),
cfc AS (SELECT table_name, column_name, {more}pii_types, {classification('pii_types')} AS data_classification FROM cf)"""


def _catalog_cte() -> str:
    names = ", ".join(q(n) for n in TABLE_NAMES)
    return f"""cat AS (
  SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({names})
),
{_findings_of_cat()}"""


def _column_tags_cte() -> str:
    return f"""ctags AS (
  SELECT table_name, column_name, s.tag_key AS tag_key, s.tag_value AS tag_value FROM (
    SELECT table_name, column_name, unnest([
      struct_pack(tag_key := 'PIIType', tag_value := CASE WHEN pii_types = '' THEN 'NONE' ELSE split_part(pii_types, ',', 1) END),
      struct_pack(tag_key := 'DataClassification', tag_value := data_classification),
      struct_pack(tag_key := 'AccessLevel', tag_value := {access('data_classification')}),
      struct_pack(tag_key := 'DataGovernance', tag_value := CASE WHEN pii_types <> '' THEN 'PII_DETECTED' ELSE 'PUBLIC' END),
      struct_pack(tag_key := 'PIIClassification', tag_value := CASE WHEN pii_types = '' THEN NULL
          WHEN data_classification IN {tuple(rules.HIGHLY_SENSITIVE_CLASSES)!r} THEN 'HIGHLY_SENSITIVE'
          WHEN data_classification = 'MEDIUM_RISK' THEN 'SENSITIVE' ELSE 'CONFIDENTIAL' END)
    ]) AS s FROM cfc
  ) WHERE s.tag_value IS NOT NULL
)"""


# Sources found in the data: web hosts as file sources, documents.source as item tables.
SOURCES = """SELECT type, name, max(filled) AS filled FROM (
  SELECT 'file' AS type, regexp_extract(url, '^https?://([^/?#]+)', 1) AS name, length(html) > 0 AS filled FROM pages
  UNION ALL SELECT 'table', source, length(text) > 0 FROM documents
) WHERE name <> '' GROUP BY type, name"""
HOST_SOURCES = f"SELECT 'file' AS type, name, true AS filled FROM ({HOSTS})"


def _sources_cte(src: str = SOURCES) -> str:
    risk = (
        "CASE WHEN len(l) = 0 THEN 'NO_RISK' "
        f"WHEN len(l) >= {rules.SOURCE_HIGH_RISK_MIN_TYPES} THEN 'HIGH' ELSE 'MEDIUM' END"
    )
    return f"""src AS ({src}),
sl AS (SELECT type, name, coalesce(filled, false) AS tagged, {source_types_list('name')} AS l FROM src),
scls AS (
  SELECT type, name AS source, l, array_to_string(l, ',') AS pii_types, {risk} AS risk_level, tagged FROM sl
),
stags AS (
  SELECT source, pii_types, risk_level, tagged,
    CASE WHEN tagged THEN {access('risk_level')} END AS access_level,
    CASE WHEN tagged THEN coalesce(l[1], 'NONE') END AS pii_type,
    CASE WHEN NOT tagged THEN NULL WHEN len(l) = 0 THEN 'PUBLIC' WHEN risk_level IN ('HIGH', 'CRITICAL_RISK') THEN 'PII_DETECTED'
         ELSE 'REQUIRES_MASKING' END AS data_governance
  FROM scls
),
counts AS (
  SELECT
    count(*) FILTER (WHERE type = 'file') AS file_sources,
    count(*) FILTER (WHERE type = 'table') AS table_sources,
    count(*) AS total_cataloged,
    count(*) FILTER (WHERE tagged) AS successful,
    count(*) FILTER (WHERE NOT tagged) AS failed,
    count(*) AS total_classified,
    count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
    count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
    count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
    count(*) FILTER (WHERE risk_level = 'NO_RISK') AS no_risk,
    count(*) FILTER (WHERE tagged) AS tagged_resources
  FROM scls
)"""


def _doc_objects_cte() -> str:
    return f"""objs AS (
  SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, strlen(text)::BIGINT AS size_bytes,
         {types_str('text')} AS pii_types
  FROM documents
),
objf AS (SELECT path, size_bytes, pii_types, {classification('pii_types')} AS data_classification FROM objs WHERE pii_types <> '')"""


def _stored_objects_sql() -> str:
    flags = ", ".join(f"bool_or(regexp_matches(line, {q(p)})) AS h{i}" for i, p in enumerate(rules.CONTENT_PATTERNS.values()))
    types = ", ".join(f"CASE WHEN h{i} THEN {q(t)} END" for i, t in enumerate(rules.CONTENT_PATTERNS))
    return f"""
WITH lines AS (SELECT source, coalesce(text, '') || '#' AS line FROM documents),
flags AS (SELECT source, sum(strlen(line) + 1)::BIGINT AS size_bytes, {flags} FROM lines GROUP BY source),
typed AS (SELECT source, size_bytes, concat_ws(',', {types}) AS pii_types FROM flags)
SELECT source, 'text/plain' AS content_type, size_bytes, 0::BIGINT AS unreadable, pii_types, {classification('pii_types')} AS data_classification
FROM typed"""


def _items_cte() -> str:
    js = "to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in DOCUMENT_COLUMNS) + "))::VARCHAR"
    flags = ", ".join(
        f"bool_or(regexp_matches(js, {q(p)})) AS h{i}" for i, p in enumerate(rules.CONTENT_PATTERNS.values())
    )
    types = "concat_ws(',', " + ", ".join(
        f"CASE WHEN h{i} THEN {q(t)} END" for i, t in enumerate(rules.CONTENT_PATTERNS)
    ) + ")"
    js = f"regexp_replace({js}, '[^\\x00-\\x7F]+', '\\\\uxxxx', 'g')"
    return f"""ij AS (SELECT source, {js} AS js FROM documents),
iflags AS (SELECT source AS table_name, count(*) AS item_count, {flags} FROM ij GROUP BY source),
it AS (SELECT table_name, item_count, {types} AS pii_types FROM iflags),
itf AS (SELECT table_name, item_count, pii_types, {classification('pii_types')} AS data_classification FROM it WHERE pii_types <> '')"""


def _pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {n}, '0')"


def _people_cte() -> str:
    k = "c_custkey"
    return f"""ppl AS (
  SELECT {k}, c_name,
    CASE WHEN {k} % 13 = 0 THEN '' ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
    CASE WHEN {k} % 11 = 0 THEN NULL
         WHEN {k} % 3 = 0 THEN '(' || {_pad(f'{k} % 1000', 3)} || ') ' || {_pad(f'{k} % 900 + 100', 3)} || '-' || {_pad(k, 4)}
         WHEN {k} % 3 = 1 THEN {_pad(f'{k} % 1000', 3)} || '-' || {_pad(f'{k} % 900 + 100', 3)} || '-' || {_pad(f'{k} % 10000', 4)}
         ELSE {_pad(f'{k} % 1000', 3)} || '.' || {_pad(f'{k} % 900 + 100', 3)} || '.' || {_pad(f'{k} % 10000', 4)} END AS phone,
    CASE WHEN {k} % 4 = 0 THEN {_pad(f'{k} % 1000', 3)} || '-' || {_pad(f'{k} % 100', 2)} || '-' || {_pad(f'{k} % 10000', 4)}
         WHEN {k} % 4 = 1 THEN {_pad(f'{k} % 1000', 3)} || '-' || {_pad(f'{k} % 100', 2)} || '-' || {_pad(f'{k} % 10000', 4)} || 'x'
         WHEN {k} % 4 = 2 THEN {_pad(f'{k} % 1000000000', 9)} || '7'
         ELSE {_pad(f'{k} % 100', 2)} || '-' || {_pad(f'{k} % 100', 2)} END AS ssn,
    CASE WHEN {k} % 7 = 0 THEN {_pad(f'{k} % 1000', 3)}
         WHEN {k} % 2 = 0 THEN '4111-1111-1111-' || {_pad(f'{k} % 10000', 4)}
         ELSE '4111 1111 1111 ' || {_pad(f'{k} % 10000', 4)} END AS credit_card_number,
    {_pad(f'{k} % 12 + 1', 2)} || '/' || {_pad(f'{k} % 28 + 1', 2)} || '/' || CAST(1940 + {k} % 60 AS VARCHAR) AS date_of_birth,
    30000 + ({k} * 37) % 90000 AS salary,
    CAST(18 + {k} % 60 AS INTEGER) AS age,
    CAST({k} % 900 + 100 AS VARCHAR) || ' Main Street' AS street_address,
    c_nationkey, c_acctbal, c_mktsegment
  FROM customer
)"""


def _guard(v: str, expr: str) -> str:
    return f"CASE WHEN {v} IS NULL OR {v} = '' THEN {v} ELSE {expr} END"


def _partial(v: str, first: int, last: int, ch: str = "*") -> str:
    n = f"length({v})"
    parts = []
    if first > 0:
        parts.append(f"left({v}, {first})")
    parts.append(f"repeat({q(ch)}, {n} - {first + last})")
    if last > 0:
        parts.append(f"right({v}, {last})")
    return f"CASE WHEN {n} <= {first + last} THEN repeat({q(ch)}, {n}) ELSE " + " || ".join(parts) + " END"


def _generic_format(v: str, ch: str) -> str:
    return f"regexp_replace({v}, '[a-zA-Z0-9]', {q(ch)}, 'g')"


def _format(v: str, pii_type: str, ch: str = "*") -> str:
    if pii_type == "SSN":
        return (
            f"CASE WHEN regexp_matches({v}, '^\\d{{3}}-\\d{{2}}-\\d{{4}}') THEN {q(ch * 3 + '-' + ch * 2 + '-' + ch * 4)} "
            f"WHEN regexp_matches({v}, '^\\d{{9}}') THEN {q(ch * 9)} ELSE {_generic_format(v, ch)} END"
        )
    if pii_type == "PHONE":
        return f"regexp_replace({v}, '\\d', {q(ch)}, 'g')"
    if pii_type == "CREDIT_CARD":
        return f"CASE WHEN length({v}) >= 4 THEN repeat({q(ch)}, length({v}) - 4) || right({v}, 4) ELSE {_generic_format(v, ch)} END"
    return _generic_format(v, ch)


def _mask(col: str, pii_type: str, strategy: str, first: int = 0, last: int = 0, ch: str = "*") -> str:
    v = f"CAST({col} AS VARCHAR)"
    if strategy == rules.PARTIAL_MASK:
        e = _partial(v, first, last, ch)
    elif strategy == rules.FULL_MASK:
        e = f"repeat({q(ch)}, length({v}))"
    elif strategy == rules.HASH:
        e = f"substr(sha256({v}), 1, {rules.HASH_HEX_CHARS})"
    elif strategy == rules.TOKENIZE:
        e = f"'TOKEN_{pii_type}_' || substr(md5({v}), 1, {rules.TOKEN_HEX_CHARS})"
    elif strategy == rules.REDACT:
        e = q(f"[REDACTED_{pii_type}]")
    else:
        e = _format(v, pii_type, ch)
    return _guard(v, e)


PEOPLE_TYPES = {
    "c_name": "NAME", "email": "EMAIL", "phone": "PHONE", "ssn": "SSN", "credit_card_number": "CREDIT_CARD",
    "date_of_birth": "DATE_OF_BIRTH", "salary": "SALARY", "age": "AGE", "street_address": "ADDRESS",
}
PEOPLE_COLUMNS = ["c_custkey", "c_name", "email", "phone", "ssn", "credit_card_number", "date_of_birth",
                  "salary", "age", "street_address", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _masked(v: str, pii_type: str, custom: dict[str, tuple] | None = None) -> str:
    strategy, first, last, ch = (custom or {}).get(pii_type, rules.DEFAULT_MASKING[pii_type] + ("*",))
    return _mask(v, pii_type, strategy, first, last, ch)


def _masking_sql(custom: dict[str, tuple]) -> str:
    sel = [f"{_masked(c, PEOPLE_TYPES[c], custom)} AS {c}" if c in PEOPLE_TYPES else c for c in PEOPLE_COLUMNS]
    sel += [
        f"{_masked('email', 'EMAIL', custom)} AS contact_email",
        f"concat_ws(';', {_masked('phone', 'PHONE', custom)}, {_masked(q('none'), 'PHONE', custom)}) AS contact_phones",
        "c_custkey AS contact_id",
    ]
    return f"WITH {_people_cte()}\nSELECT " + ",\n  ".join(sel) + " FROM ppl"


def _masked_values_sql() -> str:
    typed = {"email": "EMAIL", "phone": "PHONE", "ssn": "SSN", "credit_card_number": "CREDIT_CARD"}
    rows = [f"SELECT c_custkey, {q(t)} AS pii_type, {_masked(c, t)} AS masked FROM ppl" for c, t in typed.items()]
    rows.append("SELECT c_custkey, 'SEGMENT' AS pii_type, c_mktsegment AS masked FROM ppl")
    return f"WITH {_people_cte()}\n" + "\nUNION ALL ".join(rows)


def _entity_sql() -> str:
    from veilscan.plans.standins import ENTITY_NAMES

    n = len(ENTITY_NAMES)
    names = lst(ENTITY_NAMES)
    emap = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in rules.ENTITY_TYPE_MAP.items())
    rank = " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(rules.CONTENT_TYPES))
    scores = ", ".join(
        f"max(score) FILTER (WHERE pii_type = {q(t)}) AS score_{t.lower()}" for t in rules.CONTENT_TYPES
    )
    return f"""
WITH t AS (SELECT doc_id, {types_str('text')} AS types FROM documents),
pat AS (SELECT doc_id, unnest(string_split(types, ',')) AS pii_type FROM t WHERE types <> ''),
ent_raw AS (
  SELECT doc_id, {names}[doc_id % {n} + 1] AS type, 0.5 + (doc_id % 50) / 100.0 AS score FROM documents
  UNION ALL
  SELECT doc_id, {names}[(doc_id * 3 + 1) % {n} + 1] AS type, 0.6 + (doc_id % 37) / 100.0 AS score FROM documents
),
ent AS (SELECT doc_id, CASE type {emap} END AS pii_type, score FROM ent_raw),
u AS (
  SELECT doc_id, pii_type, 0.7::DOUBLE AS score, 0 AS src FROM pat
  UNION ALL
  SELECT doc_id, pii_type, score::DOUBLE, 1 AS src FROM ent WHERE pii_type IS NOT NULL
),
g AS (SELECT doc_id, pii_type, max(score) AS score, min(src) AS src, CASE pii_type {rank} END AS rnk FROM u GROUP BY doc_id, pii_type),
r AS (SELECT doc_id, string_agg(pii_type, ',' ORDER BY src, rnk) AS pii_types, {scores} FROM g GROUP BY doc_id)
SELECT doc_id, pii_types, {', '.join('score_' + t.lower() for t in rules.CONTENT_TYPES)},
  {classification('pii_types')} AS data_classification FROM r"""


def _column_content_profile_sql() -> str:
    selects = []
    for table, cols in STRING_COLUMNS.items():
        structs = []
        for c in cols:
            for t, p in rules.CONTENT_PATTERNS.items():
                structs.append(
                    f"struct_pack(column_name := {q(c)}, pii_type := {q(t)}, "
                    f"rows := count(*) FILTER (WHERE regexp_matches({c}, {q(p)})))"
                )
        selects.append(
            f"SELECT {q(table)} AS table_name, s.column_name AS column_name, s.pii_type AS pii_type, s.rows AS rows "
            f"FROM (SELECT unnest(l) AS s FROM (SELECT [{', '.join(structs)}] AS l FROM {table}))"
        )
    return "SELECT * FROM (\n" + "\nUNION ALL\n".join(selects) + "\n) WHERE rows > 0"


def _tag_log_cte() -> str:
    keys = list(rules.COLUMN_TAG_DEFINITIONS)
    value_cases = " ".join(
        f"WHEN {q(k)} THEN {lst(v)}[user_id % {len(v)} + 1]" for k, v in rules.COLUMN_TAG_DEFINITIONS.items()
    )
    return f"""lg0 AS (
  SELECT 'app' AS database, event_type AS table_name,
    CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'col_' || CAST(user_id % 4 AS VARCHAR) END AS column_name,
    {lst(keys)}[event_id % {len(keys)} + 1] AS tag_key, user_id, event_id AS seq
  FROM events
),
lg AS (SELECT database, table_name, column_name, tag_key, CASE tag_key {value_cases} END AS tag_value, seq FROM lg0)"""


def _defs_values(defs: dict[str, list[str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, vs in defs.items() for v in vs) + ") AS d(tag_key, tag_value)"


def _json_attributes_sql(table: str, column: str) -> str:
    """Attributes of JSON texts without repeated keys and odd key names."""
    types = types_str("v")
    hits = ", ".join(f"CASE WHEN bool_or(list_contains(string_split(ty, ','), {q(t)})) THEN {q(t)} END" for t in rules.CONTENT_PATTERNS)
    kind = """CASE WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN t.type = 'VARCHAR' THEN 'STRING'
      WHEN t.type = 'DOUBLE' THEN 'DECIMAL' WHEN t.type = 'NULL' THEN 'VOID' ELSE t.type END"""
    return f"""
WITH leaves AS (
  SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, {kind} AS value_type, json_extract_string(e.{column}, t.fullkey) AS v
  FROM {table} e, json_tree(e.{column}) t WHERE json_valid(e.{column}) AND (t.atom IS NOT NULL OR t.type = 'NULL')
  UNION ALL SELECT '$', 'MALFORMED', {column} FROM {table} WHERE NOT json_valid({column})),
seen AS (SELECT path, value_type, coalesce({types}, '') AS ty FROM leaves),
counted AS (
  SELECT path, value_type, count(*) AS n_values, count(*) FILTER (WHERE ty <> '') AS n_hits,
    concat_ws(',', {hits}) AS pii_types,
    CASE WHEN path = '$' THEN '' ELSE {name_types("regexp_extract(path, '([A-Za-z0-9_]+)(\\[\\])*$', 1)")} END AS name_types
  FROM seen GROUP BY path, value_type),
classed AS (SELECT *, {classification("concat_ws(',', nullif(pii_types, ''), nullif(name_types, ''))")} AS data_classification FROM counted)
SELECT *, {access('data_classification')} AS access_level FROM classed"""


def oracle_sql() -> dict[str, str]:
    content_cls = classification("pii_types")
    out = {
        "content_findings": _findings("documents", ["doc_id"], "text"),
        "content_findings_pages": _findings("pages", ["page_id"], "html"),
        "conversation_findings": _findings("conversations", ["conv_id", "turn"], "text"),
        "simple_findings": _findings("documents", ["doc_id"], "text", "simple"),
        "head_byte_findings": _findings(
            f"(SELECT doc_id, {head_bytes('text', 1024)} AS hb FROM documents)", ["doc_id"], "hb"
        ),
        "head_char_findings": _findings(
            f"(SELECT doc_id, left(text, 1000) AS hc FROM documents)", ["doc_id"], "hc", "simple"
        ),
        "object_findings": f"WITH {_doc_objects_cte()}\nSELECT path, size_bytes, pii_types, data_classification FROM objf",
        "finding_split": f"""
SELECT source, {types_str('text')} <> '' AS has_pii, count(*) AS documents FROM documents GROUP BY ALL""",
        "type_summary": f"""
WITH t AS (SELECT doc_id, source, {types_str('text')} AS types FROM documents),
e AS (SELECT doc_id, source, unnest(string_split(types, ',')) AS pii_type FROM t WHERE types <> '')
SELECT pii_type, count(*) AS documents, count(DISTINCT source) AS sources FROM e GROUP BY pii_type""",
        "source_table_types": f"WITH {_items_cte()}\nSELECT table_name, item_count, pii_types, data_classification FROM itf",
        "string_attribute_findings": f"""
WITH t AS (
  SELECT page_id,
    concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(url, {q(p)}) OR regexp_matches(html, {q(p)}) THEN {q(ty)} END" for ty, p in rules.SIMPLE_PATTERNS.items())}) AS pii_types,
    concat_ws(',', CASE WHEN page_id IS NOT NULL THEN 'page_id' END, CASE WHEN url IS NOT NULL THEN 'url' END,
              CASE WHEN html IS NOT NULL THEN 'html' END) AS attributes
  FROM pages)
SELECT page_id, pii_types, attributes FROM t WHERE pii_types <> ''""",
        "column_content_profile": _column_content_profile_sql(),
        "entity_merge": _entity_sql(),
        "column_name_findings": f"""
WITH {_attributes_cte()}
SELECT table_name, column_name, rows, pii_types, data_classification, {access('data_classification')} AS access_level FROM cfc""",
        "analyze_tables": f"""
WITH {_attributes_cte()}
SELECT table_name, column_name, pii_types <> '' AS is_pii,
  CASE WHEN pii_types = '' THEN 'N/A' ELSE split_part(pii_types, ',', 1) END AS pii_type,
  CASE WHEN pii_types = '' THEN 0.0 ELSE {rules.NAME_CONFIDENCE} END::DOUBLE AS confidence FROM cf""",
        "column_tags": f"WITH {_attributes_cte()},\n{_column_tags_cte()}\nSELECT table_name, column_name, tag_key, tag_value FROM ctags",
        "table_classes": f"""
WITH {_attributes_cte()},
tg AS (
  SELECT table_name, concat_ws(',', {', '.join(f"CASE WHEN bool_or(list_contains(string_split(pii_types, ','), {q(t)})) THEN {q(t)} END" for t in rules.COLUMN_TYPES)}) AS pii_types,
    count(*) AS columns, count(*) FILTER (WHERE pii_types <> '') AS pii_columns
  FROM cf GROUP BY table_name),
tc AS (SELECT *, {content_cls} AS data_classification FROM tg)
SELECT table_name, pii_types, columns, pii_columns, data_classification, {access('data_classification')} AS access_level FROM tc""",
        "catalog_round_trip": "WITH n AS (" + " UNION ALL ".join(f"SELECT {q(t)} AS t, count(*) AS rows FROM {t}" for t in TABLE_NAMES) + """)
SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS column_type,
  (ordinal_position - 1)::BIGINT AS ordinal, rows
FROM information_schema.columns JOIN n ON table_name = t""",
        "risk_breakdown": f"""
WITH {_sources_cte()}
SELECT CASE GROUPING_ID(type, risk_level) WHEN 0 THEN 'type,risk_level' WHEN 1 THEN 'type' WHEN 2 THEN 'risk_level' ELSE 'total' END AS level,
  type, risk_level, count(*) AS sources, count(*) FILTER (tagged) AS tagged, count(*) FILTER (pii_types <> '') AS with_pii,
  round(100.0 * count(*) / (SELECT count(*) FROM scls), 6) AS share
FROM scls GROUP BY GROUPING SETS ((type, risk_level), (type), (risk_level), ())
HAVING count(*) > 0""",
        "source_classes": f"WITH {_sources_cte()}\nSELECT source, pii_types, risk_level, access_level, pii_type, data_governance FROM stags",
        "source_tag_table": f"""
WITH {_sources_cte()}
SELECT source AS table_name, s.k AS tag_key, s.v AS tag_value FROM (
  SELECT source, unnest([struct_pack(k := 'DataClassification', v := risk_level), struct_pack(k := 'AccessLevel', v := access_level),
                         struct_pack(k := 'PIIType', v := pii_type), struct_pack(k := 'DataGovernance', v := data_governance)]) AS s
  FROM stags WHERE tagged)""",
        "page_host_classes": f"WITH {_sources_cte(HOST_SOURCES)}\nSELECT source, pii_types, risk_level, access_level, pii_type, data_governance FROM stags",
        "page_host_kpis": f"""
WITH {_sources_cte(HOST_SOURCES)}
SELECT file_sources + table_sources AS total_sources, successful AS cataloged_sources,
  high_risk + medium_risk AS pii_sources, high_risk AS high_risk_sources,
  least(100.0, tagged_resources / greatest(1, high_risk + medium_risk) * 100.0)::DOUBLE AS compliance_score,
  file_sources, table_sources, greatest(0, file_sources + table_sources - successful) AS uncataloged,
  high_risk, medium_risk, low_risk FROM counts""",
        "discovery_kpis": f"""
WITH {_sources_cte()}
SELECT file_sources + table_sources AS total_sources, successful AS cataloged_sources,
  high_risk + medium_risk AS pii_sources, high_risk AS high_risk_sources,
  least(100.0, tagged_resources / greatest(1, high_risk + medium_risk) * 100.0)::DOUBLE AS compliance_score,
  file_sources, table_sources, greatest(0, file_sources + table_sources - successful) AS uncataloged,
  high_risk, medium_risk, low_risk FROM counts""",
        "pii_type_counts": f"""
WITH {_sources_cte()}
SELECT pii_type, count(*) AS occurrences FROM (SELECT unnest(l) AS pii_type FROM scls) GROUP BY pii_type""",
        "tag_keys_used": f"""
WITH {_sources_cte()}
SELECT DISTINCT unnest(['DataClassification', 'AccessLevel', 'PIIType', 'DataGovernance']) AS tag_key FROM scls WHERE tagged""",
        "workflow_summary": f"""
WITH {_sources_cte()}
SELECT file_sources + table_sources AS data_sources, total_cataloged AS cataloged_items,
  total_classified AS classified_sources, high_risk AS high_risk_sources FROM counts""",
        "tag_definitions": f"""
WITH {_attributes_cte()},
{_column_tags_cte()},
{_tag_log_cte()},
ex AS (SELECT DISTINCT tag_key, tag_value FROM ({_defs_values(rules.SOURCE_TAG_DEFINITIONS)})),
wanted AS (SELECT DISTINCT tag_key, tag_value FROM (SELECT tag_key, tag_value FROM lg UNION ALL SELECT tag_key, tag_value FROM ctags))
SELECT tag_key, tag_value, 'exists' AS status FROM ex
UNION ALL
SELECT w.tag_key, w.tag_value, 'created' AS status FROM wanted w ANTI JOIN ex USING (tag_key, tag_value)""",
        "tag_upsert": f"""
WITH {_catalog_cte()},
{_column_tags_cte()},
{_tag_log_cte()},
u AS (
  SELECT 'main' AS database, table_name, column_name, tag_key, tag_value, 0::BIGINT AS seq FROM ctags
  UNION ALL SELECT database, table_name, column_name, tag_key, tag_value, seq FROM lg
)
SELECT database, table_name, column_name, tag_key, arg_max(tag_value, seq) AS tag_value, max(seq) AS seq
FROM u GROUP BY database, table_name, column_name, tag_key""",
        "stored_tag_upsert": f"""
WITH {_catalog_cte()},
{_column_tags_cte()},
{_tag_log_cte()},
u AS (
  SELECT 'main' AS database, table_name, column_name, tag_key, tag_value, 0::BIGINT AS seq FROM ctags
  UNION ALL SELECT database, table_name, column_name, tag_key, tag_value, seq FROM lg
)
SELECT database, table_name, column_name, tag_key, arg_max(tag_value, seq) AS tag_value, max(seq) AS seq
FROM u GROUP BY database, table_name, column_name, tag_key""",
        "registry": f"""
WITH ex AS (SELECT 'main.' || t AS resource FROM (SELECT unnest({lst(TABLE_NAMES)}) AS t)),
nw AS (SELECT resource FROM ex UNION SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents)
SELECT resource, 'already_registered' AS status FROM ex
UNION ALL
SELECT resource, 'registered' AS status FROM nw WHERE resource NOT IN (SELECT resource FROM ex)""",
        "scan_totals": f"""
WITH {_catalog_cte()},
{_doc_objects_cte()},
{_items_cte()},
tot AS (SELECT
  (SELECT count(DISTINCT table_name) FROM cat) AS total_tables,
  (SELECT count(*) FROM cf) AS total_columns,
  (SELECT count(*) FROM cf WHERE pii_types <> '') AS pii_columns_found,
  (SELECT count(*) FROM cf WHERE pii_types = '') AS no_risk_columns_found,
  (SELECT count(*) FROM objf) AS objects_with_pii,
  (SELECT count(*) FROM itf) AS item_tables_with_pii)
SELECT total_tables + objects_with_pii + item_tables_with_pii AS total_sources, total_tables, total_columns,
  pii_columns_found, no_risk_columns_found, objects_with_pii + item_tables_with_pii AS pii_sources_found,
  total_tables AS glue_tables_scanned, objects_with_pii, item_tables_with_pii FROM tot""",
        "classification_summary": f"""
WITH {_catalog_cte()},
{_doc_objects_cte()},
{_items_cte()},
u AS (
  SELECT data_classification, 'main.' || table_name AS t FROM cfc
  UNION ALL SELECT data_classification, 'unknown' AS t FROM objf
  UNION ALL SELECT data_classification, table_name AS t FROM itf
)
SELECT data_classification, t AS table_name, count(*) AS count FROM u GROUP BY ALL""",
        "source_summary": """
SELECT count(*) AS objects, count(DISTINCT source) AS item_tables, count(*) + count(DISTINCT source) AS total_sources
FROM documents""",
        "row_samples": f"""
SELECT event_type, event_id, user_id, value FROM (
  SELECT event_type, event_id, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events
) WHERE rn <= 10""",
        "table_stats": "\nUNION ALL\n".join(
            f"SELECT {q(t)} AS table_name, (SELECT count(*) FROM {t}) AS item_count, count(*) AS attributes, "
            f"string_agg(column_name, ',' ORDER BY ordinal_position) AS attribute_names "
            f"FROM information_schema.columns WHERE table_name = {q(t)}"
            for t in TABLE_NAMES
        ),
        "masked_values": _masked_values_sql(),
        "masking_default": _masking_sql({}),
        "masking_strategies": _masking_sql({
            "NAME": (rules.FULL_MASK, 0, 0, "*"),
            "SALARY": (rules.HASH, 0, 0, "*"),
            "EMAIL": (rules.TOKENIZE, 0, 0, "*"),
            "PHONE": (rules.FORMAT_PRESERVE, 0, 0, "#"),
            "CREDIT_CARD": (rules.FORMAT_PRESERVE, 0, 0, "*"),
            "ADDRESS": (rules.FORMAT_PRESERVE, 0, 0, "$"),
            "DATE_OF_BIRTH": (rules.PARTIAL_MASK, 2, 4, "*"),
            "AGE": (rules.REDACT, 0, 0, "*"),
        }),
    }
    out["registry_batch"] = """
SELECT DISTINCT 'user/' || user_id AS resource,
  CASE WHEN user_id IN (SELECT c_custkey FROM customer) THEN 'already_registered' ELSE 'registered' END AS status
FROM events WHERE user_id IS NOT NULL"""
    out["committed_totals"] = out["scan_totals"]
    out["committed_findings"] = " UNION ALL ".join(
        f"SELECT {q(part)} AS part, * RENAME ({key} AS id) FROM ({out[name]})"
        for part, key, name in (("documents", "doc_id", "content_findings"), ("pages", "page_id", "content_findings_pages"))
    )
    out["stored_table_stats"] = " UNION ALL ".join(
        f"""
SELECT {q(table)} AS table_name, coalesce(sum(1 + length(t) - length(replace(t, chr(10), ''))), 0)::BIGINT AS item_count,
  coalesce(sum(strlen(t) + 1), 0)::BIGINT AS size_bytes, {q(column + ':string')} AS attributes FROM (SELECT coalesce({column}, '') AS t FROM {table})"""
        for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"))
    )
    out["stored_object_findings"] = _stored_objects_sql()
    out["event_attributes"] = _json_attributes_sql("events", "props")
    return out

"""Detection operators: DataFrame in, findings DataFrame out.

All detection is built-in Column expressions evaluated inside the scan stage.
Shapes are chosen so each regex runs once per row (see
``functions.detect.one_row_if_any``) and only hit rows leave the stage.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from veilscan import rules
from veilscan.functions import classify as C
from veilscan.functions import detect as D
from veilscan.functions import text as T
from veilscan.sources.samples import sample_rows


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def with_classification(df: DataFrame, types_col: str = "pii_types") -> DataFrame:
    """Add ``data_classification`` and ``access_level`` from a types array."""
    cls = C.data_classification(F.col(types_col))
    return df.withColumn("data_classification", cls).withColumn(
        "access_level", C.access_level(F.col("data_classification"))
    )


# --------------------------------------------------------------------------
# Content detection
# --------------------------------------------------------------------------


def content_findings(
    df: DataFrame,
    id_cols,
    text: str | Column,
    profile: str | dict[str, str] = "content",
    score: float = rules.PATTERN_CONFIDENCE,
    keep_cols=(),
) -> DataFrame:
    """Rows of ``df`` whose text matches at least one pattern.

    Output: ``id_cols + keep_cols, pii_types array<string> (rule order),
    confidence map<string,double>, data_classification, access_level``.
    The detection expression is evaluated once per input row, inside the
    scan stage; no shuffle.
    """
    ids = _cols(id_cols) + list(keep_cols)
    text_col, digit_run, pre = _prepared(df, ids, text, profile)
    out = pre.select(
        *ids, F.explode(D.one_row_if_any(D.content_types(text_col, profile, digit_run))).alias("pii_types")
    )
    out = out.withColumn("confidence", D.confidence_map(F.col("pii_types"), score))
    return with_classification(out)


def _prepared(df: DataFrame, ids: list[str], text: str | Column, profile):
    """Project the text once (it may be a sample expression) and, when numeric
    patterns are present, the shared three-digit guard once."""
    t = F.col(text) if isinstance(text, str) else text
    pre = df.select(*ids, t.alias("__text"))
    digit_run = None
    if D.needs_digit_run(D.profile_patterns(profile)):
        pre = pre.select("*", D.has_digit_run(F.col("__text")).alias("__digits"))
        digit_run = F.col("__digits")
    return F.col("__text"), digit_run, pre


def content_findings_long(
    df: DataFrame, id_cols, text: str | Column, profile: str | dict[str, str] = "content"
) -> DataFrame:
    """Long form ``(ids, pii_type)``: one row per (row, matching type)."""
    ids = _cols(id_cols)
    text_col, digit_run, pre = _prepared(df, ids, text, profile)
    return pre.select(*ids, F.explode(D.content_types(text_col, profile, digit_run)).alias("pii_type"))


def head_byte_findings(df: DataFrame, id_cols, text: str, n: int, **kw) -> DataFrame:
    """S4 + D2: detection on the first ``n`` UTF-8 bytes of each text."""
    return content_findings(df, id_cols, T.head_bytes(F.col(text), n), **kw)


def head_char_findings(
    df: DataFrame,
    id_cols,
    text: str,
    n: int,
    profile: str | dict[str, str] = "simple",
    **kw,
) -> DataFrame:
    """S5 + D3: detection on the first ``n`` characters of texts that are valid
    UTF-8 (an undecodable object is skipped, as a strict decode would)."""
    valid = df.where(F.is_valid_utf8(F.col(text)))
    return content_findings(valid, id_cols, T.head_chars(F.col(text), n), profile=profile, **kw)


# --------------------------------------------------------------------------
# Column-name detection over a catalog
# --------------------------------------------------------------------------


def column_name_findings(columns: DataFrame, name_col: str = "column_name") -> DataFrame:
    """One finding per catalog column: types by name, 0.8 scores, class, access."""
    types = D.name_types(F.col(name_col))
    out = columns.withColumn("pii_types", types).withColumn(
        "confidence", D.confidence_map(F.col("pii_types"), rules.NAME_CONFIDENCE)
    )
    return with_classification(out)


def analyze_table(columns: DataFrame, database: str | None = None, table: str | None = None) -> DataFrame:
    """Per column of one table: name, type, is_pii, first type or ``N/A``,
    max confidence or 0.0."""
    cols = columns
    if database is not None:
        cols = cols.where(F.col("database") == database)
    if table is not None:
        cols = cols.where(F.col("table_name") == table)
    types = D.name_types(F.col("column_name"))
    return cols.select(
        "database",
        "table_name",
        F.col("column_name").alias("name"),
        F.col("column_type").alias("type"),
        (F.size(types) > 0).alias("is_pii"),
        C.primary_type(types, "N/A").alias("pii_type"),
        F.when(F.size(types) > 0, F.lit(rules.NAME_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def quoted(name: str) -> str:
    """A column's name as a reference, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def _cell(column: str, value: Column) -> Column:
    return F.struct(F.lit(column).alias("column_name"), value.alias("value"))


def string_parts(value: Column, kind: DataType) -> Column | None:
    """All strings inside ``value`` of type ``kind`` as an array (fields,
    elements, map keys and values, at any depth); None if it can hold none."""
    if isinstance(kind, StringType):
        return F.array(value)
    if isinstance(kind, StructType):
        parts = [string_parts(value.getField(f.name), f.dataType) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        none = F.array().cast("array<string>")
        return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else None
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType):
            return value
        if string_parts(F.lit(None).cast(kind.elementType), kind.elementType) is None:
            return None
        return F.flatten(F.transform(value, lambda x: string_parts(x, kind.elementType)))
    if isinstance(kind, MapType):
        sides = [
            string_parts(F.map_keys(value), ArrayType(kind.keyType)),
            string_parts(F.map_values(value), ArrayType(kind.valueType)),
        ]
        none = F.array().cast("array<string>")
        sides = [F.coalesce(p, none) for p in sides if p is not None]
        return F.concat(*sides) if sides else None
    return None


def string_values(tables: dict[str, DataFrame], min_bytes: int = 0) -> DataFrame | None:
    """Every string of the given tables in long form
    ``(table_name, column_name, value)``, those inside structs, arrays and maps
    under their top-level column: one narrow branch per table (so the plan
    grows with the number of tables, not columns) that unpivots the table's
    string columns with ``inline``; no shuffle. Strings shorter than
    ``min_bytes`` (and NULLs when ``min_bytes`` > 0) are dropped right after
    the unpivot. None when no table has a string."""
    parts = []
    for name, df in tables.items():
        scols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        nested = {
            f.name: string_parts(F.col(quoted(f.name)), f.dataType)
            for f in df.schema.fields
            if isinstance(f.dataType, (StructType, ArrayType, MapType))
        }
        nested = {c: p for c, p in nested.items() if p is not None}
        if not scols and not nested:
            continue
        if len(scols) == 1 and not nested:
            part = df.select(F.lit(name).alias("table_name"), F.lit(scols[0]).alias("column_name"),
                             F.col(quoted(scols[0])).alias("value"))
        else:
            cells = [F.array(*[_cell(c, F.col(quoted(c))) for c in scols])] if scols else []
            for c, p in nested.items():
                none = F.slice(F.array(_cell(c, F.lit(None).cast("string"))), 1, 0)
                cells.append(F.coalesce(F.transform(p, partial(_cell, c)), none))
            part = df.select(F.lit(name).alias("table_name"), F.inline(F.concat(*cells)))
        if min_bytes > 0:
            part = part.where(F.octet_length("value") >= min_bytes)
        parts.append(part)
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_content_profile(
    tables: dict[str, DataFrame], profile: str | dict[str, str] = "content", min_rows: int = 1
) -> DataFrame:
    """Content profile of every string column: per (table, column, type) the
    number of rows whose value matches. Rows with fewer than ``min_rows``
    matches are dropped.

    One detection expression over the unpivoted cells and one grouped
    aggregation; per-type counters are partial aggregates, so each task
    ships at most one row per (table, column) whatever the skew. Cells too
    short for any pattern never leave the unpivot.
    """
    if min_rows < 1:
        raise ValueError("min_rows must be >= 1: columns without a match are not reported")
    patterns = D.profile_patterns(profile)
    cells = string_values(tables, D.min_match_bytes(patterns))
    if cells is None:
        if not tables:
            raise ValueError("no tables given")
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table_name string, column_name string, pii_type string, rows bigint")
    text_col, digit_run, pre = _prepared(cells, ["table_name", "column_name"], "value", profile)
    hits = D.content_hits(text_col, profile, digit_run)
    g = pre.groupBy("table_name", "column_name").agg(
        *[F.count_if(h).alias(f"__n{i}") for i, (_, h) in enumerate(hits)]
    )
    entries = F.array(*[
        F.struct(F.lit(t).alias("pii_type"), F.col(f"__n{i}").alias("rows")) for i, t in enumerate(patterns)
    ])
    out = g.select("table_name", "column_name", F.inline(entries))
    return out.where(F.col("rows") >= min_rows)


# --------------------------------------------------------------------------
# Item tables scanned as serialised JSON rows
# --------------------------------------------------------------------------


def _types_from_flags(flags: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(f, F.lit(t)) for t, f in flags]))


def _item_flags(df: DataFrame, table: Column, carried: list[Column], profile, ascii_escape: bool) -> DataFrame:
    """Per row: ``table_name``, ``carried`` and one flag per type of the row's JSON.

    A match never crosses a JSON separator (quote, colon, comma, brace,
    space), so matching the row's JSON equals matching each field's own JSON
    {"c":value} and OR-ing. Per field, the cheap guards (length, literals,
    digit run) skip long texts the numeric id fields would otherwise let
    through. Each field's JSON and guard are projected once.
    """
    patterns = D.profile_patterns(profile)
    fields = []
    for c in df.columns:
        js = F.to_json(F.struct(F.col(quoted(c))))
        fields.append(T.ascii_escaped(js) if ascii_escape else js)
    names = [f"__c{i}" for i in range(len(carried))]
    pre = df.select(
        table.alias("table_name"),
        *[c.alias(n) for c, n in zip(carried, names, strict=True)],
        *[j.alias(f"__j{i}") for i, j in enumerate(fields)],
    )
    digits = [None] * len(fields)
    if D.needs_digit_run(patterns):
        pre = pre.select("*", *[D.has_digit_run(F.col(f"__j{i}")).alias(f"__d{i}") for i in range(len(fields))])
        digits = [F.col(f"__d{i}") for i in range(len(fields))]
    hits = [
        reduce(lambda a, b: a | b, [D.content_hit(F.col(f"__j{i}"), t, p, digit_run=digits[i]) for i in range(len(fields))])
        for t, p in patterns.items()
    ]
    return pre.select("table_name", *names, *[h.alias(f"__hit_{i}") for i, h in enumerate(hits)])


def _item_findings(per_table: DataFrame, profile, extra: list[str]) -> DataFrame:
    """Tables with a hit, classified, from one row of flags per table."""
    flags = [(t, F.col(f"__hit_{i}")) for i, t in enumerate(D.profile_patterns(profile))]
    out = per_table.select("table_name", "item_count", *extra, _types_from_flags(flags).alias("pii_types"))
    out = out.where(F.size("pii_types") > 0)
    out = out.withColumn("confidence", D.confidence_map(F.col("pii_types"), rules.ITEM_TABLE_CONFIDENCE))
    return with_classification(out)


def scan_items_json(
    df: DataFrame,
    table_col: str | None = None,
    table_name: str | None = None,
    key_cols=None,
    max_items: int | None = None,
    profile: str | dict[str, str] = "content",
    ascii_escape: bool = True,
) -> DataFrame:
    """Serialise each row to JSON, run content detection on it, and union the
    types per table. Only tables with a hit are returned.

    With ``ascii_escape`` non-ASCII characters take the shape of the
    ``\\uXXXX`` escapes an ASCII JSON encoder writes (``text.ascii_escaped``),
    so word boundaries next to them behave as in that form.

    ``table_col`` groups one DataFrame into many item tables; otherwise the
    whole DataFrame is one table called ``table_name``. ``max_items`` makes it
    an explicit sample of the first n rows per table by ``key_cols``. The
    aggregation is max() per flag, so the shuffle carries one partial row per
    table per task, whatever the skew.

    Output: ``table_name, item_count, pii_types, confidence,
    data_classification, access_level``. ``item_count`` is the whole table's.
    """
    if max_items is not None and table_col is None:
        df = df.withColumn("__table", F.lit(table_name or "table"))
        sampled = sample_rows(df, max_items, key_cols, group_cols=["__table"]).drop("__table")
    elif max_items is not None:
        sampled = sample_rows(df, max_items, key_cols, group_cols=[table_col])
    else:
        sampled = df
    name = F.col(quoted(table_col)) if table_col and table_col != "__table" else F.lit(table_name or "table")
    payload = sampled if "__table" not in sampled.columns else sampled.drop("__table")
    flags = _item_flags(payload, name, [], profile, ascii_escape)
    n = len(D.profile_patterns(profile))
    aggs = [F.max(f"__hit_{i}").alias(f"__hit_{i}") for i in range(n)]
    if max_items is None:
        aggs.append(F.count(F.lit(1)).alias("item_count"))
    per_table = flags.groupBy("table_name").agg(*aggs)
    if max_items is not None:
        counts = df.groupBy(name.alias("table_name")).agg(F.count(F.lit(1)).alias("item_count"))
        per_table = per_table.join(counts, "table_name")
    return _item_findings(per_table, profile, [])


def scan_item_tables(tables: dict[str, DataFrame], profile: str | dict[str, str] = "content") -> DataFrame:
    """D5 over several tables with one aggregation: rows of all tables are
    flagged, then combined per file and per table. Adds ``size_bytes``, the
    size of the table's files (NULL for a table that is not read from files)."""
    parts = []
    for name, df in tables.items():
        try:
            file = df.select("_metadata.file_path", "_metadata.file_size")
            carried = [F.col("_metadata.file_path"), F.col("_metadata.file_size")] if file.columns else []
        except AnalysisException:
            carried = [F.lit(None).cast("string"), F.lit(None).cast("bigint")]
        parts.append(_item_flags(df, F.lit(name), carried, profile, True))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    flags = [f"__hit_{i}" for i in range(len(D.profile_patterns(profile)))]
    per_file = rows.groupBy("table_name", "__c0").agg(
        *[F.max(f).alias(f) for f in flags], F.count(F.lit(1)).alias("item_count"), F.max("__c1").alias("size_bytes")
    )
    per_table = per_file.groupBy("table_name").agg(
        *[F.max(f).alias(f) for f in flags], F.sum("item_count").alias("item_count"), F.sum("size_bytes").alias("size_bytes")
    )
    return _item_findings(per_table, profile, ["size_bytes"])


def scan_documents_once(docs: DataFrame, table_col: str, text_col: str, profile: str | dict[str, str] = "content") -> DataFrame:
    """Both content scans of one table in one pass: each row's text as an
    object (D9) and each row's JSON as an item of ``table_col`` (D5).

    One row per table: ``table_name, item_count``, the items' flags
    ``__hit_i``, and ``objects_<class>``, the objects with PII per class."""
    patterns = D.profile_patterns(profile)
    digits = D.has_digit_run(F.col(quoted(text_col))) if D.needs_digit_run(patterns) else None
    found = C.data_classification(D.content_types(F.col(quoted(text_col)), profile, digits))
    rows = _item_flags(docs, F.col(quoted(table_col)), [found], profile, True)
    return rows.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("item_count"),
        *[F.max(f"__hit_{i}").alias(f"__hit_{i}") for i in range(len(patterns))],
        *[F.count_if(F.col("__c0") == name).alias(f"objects_{name}") for name, _ in rules.RISK_TIERS],
    )


def totals_of_scan(per_table: DataFrame, profile: str | dict[str, str] = "content") -> DataFrame:
    """Per table of ``scan_documents_once``: objects_with_pii, item_tables_with_pii (1 or 0)."""
    hit = reduce(lambda a, b: a | b, [F.col(f"__hit_{i}") for i in range(len(D.profile_patterns(profile)))])
    objects = reduce(lambda a, b: a + b, [F.col(f"objects_{name}") for name, _ in rules.RISK_TIERS])
    return per_table.select(objects.alias("objects_with_pii"), hit.cast("long").alias("item_tables_with_pii"))


def classes_of_scan(per_table: DataFrame, profile: str | dict[str, str] = "content") -> DataFrame:
    """The findings of ``scan_documents_once`` counted: ``data_classification, table_name, count``, the
    items' by their table and the objects' under ``unknown``. Each table's row is read once."""
    types = _types_from_flags([(t, F.col(f"__hit_{i}")) for i, t in enumerate(D.profile_patterns(profile))])
    entry = lambda c, t, n: F.struct(c.alias("data_classification"), t.alias("table_name"), n.alias("count"))
    item = entry(C.data_classification(types), F.col("table_name"), (F.size(types) > 0).cast("long"))
    objects = [entry(F.lit(name), F.lit("unknown"), F.col(f"objects_{name}")) for name, _ in rules.RISK_TIERS]
    rows = per_table.select(F.inline(F.filter(F.array(item, *objects), lambda e: e["count"] > 0)))
    return rows.groupBy("data_classification", "table_name").agg(F.sum("count").alias("count"))


def items_of_scan(per_table: DataFrame, profile: str | dict[str, str] = "content") -> DataFrame:
    """The item findings (D5) of ``scan_documents_once``."""
    return _item_findings(per_table, profile, [])


# --------------------------------------------------------------------------
# String attributes of sampled items, simple rule set
# --------------------------------------------------------------------------


def scan_string_attributes(
    df: DataFrame,
    key_cols,
    table_name: str,
    max_items: int | None = None,
    profile: str | dict[str, str] = "simple",
) -> DataFrame:
    """Per row: run the simple detector on every string attribute; emit the
    distinct types (rule order) and the row's attribute names (non-null
    columns). Rows without a hit are dropped."""
    keys = _cols(key_cols)
    sampled = df if max_items is None else sample_rows(df, max_items, keys)
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    patterns = D.profile_patterns(profile)
    digits = {}
    if D.needs_digit_run(patterns) and string_cols:
        sampled = sampled.select(
            "*", *[D.has_digit_run(F.col(quoted(c))).alias(f"__d{i}") for i, c in enumerate(string_cols)]
        )
        digits = {c: F.col(f"__d{i}") for i, c in enumerate(string_cols)}
    flags = []
    for t, p in patterns.items():
        if not string_cols:
            break
        cond = None
        for c in string_cols:
            h = D.content_hit(F.col(quoted(c)), t, p, digit_run=digits.get(c))
            cond = h if cond is None else cond | h
        flags.append((t, cond))
    types = _types_from_flags(flags) if flags else F.array().cast("array<string>")
    attrs = F.array_compact(F.array(*[F.when(F.col(quoted(c)).isNotNull(), F.lit(c)) for c in df.columns]))
    hit = sampled.select(
        F.lit(table_name).alias("table_name"),
        *keys,
        F.explode(D.one_row_if_any(types)).alias("pii_types"),
        attrs.alias("attributes"),
    )
    return hit


# --------------------------------------------------------------------------
# Merge an external entity recogniser's findings
# --------------------------------------------------------------------------


def _map_entity_type(c: Column) -> Column:
    expr = None
    for src, dst in rules.ENTITY_TYPE_MAP.items():
        expr = F.when(c == F.lit(src), F.lit(dst)) if expr is None else expr.when(c == F.lit(src), F.lit(dst))
    return expr


def merge_entity_scores(
    pattern_long: DataFrame,
    entities: DataFrame,
    id_col: str = "doc_id",
    entity_type_col: str = "type",
    score_col: str = "score",
) -> DataFrame:
    """Merge pattern findings ``(id, pii_type)`` (score 0.7) with recogniser
    entities ``(id, type, score)``.

    Entity types are mapped (CREDIT_DEBIT_NUMBER -> CREDIT_CARD, DATE_TIME ->
    DATE_OF_BIRTH, EMAIL/SSN/PHONE as is; others dropped); per (id, type) the
    maximum score wins. Types: pattern types first, then types only the
    recogniser found, each group in rule order.

    One shuffle on ``id``; the per-type maxima are partial aggregates, so
    map-side combine bounds what each task sends per id.
    """
    types = rules.CONTENT_TYPES
    pat = pattern_long.select(
        F.col(id_col), F.col("pii_type"), F.lit(rules.PATTERN_CONFIDENCE).alias("score"), F.lit(0).alias("src")
    )
    ent = (
        entities.select(F.col(id_col), _map_entity_type(F.col(entity_type_col)).alias("pii_type"),
                        F.col(score_col).cast("double").alias("score"), F.lit(1).alias("src"))
        .where(F.col("pii_type").isNotNull())
    )
    u = pat.unionByName(ent)
    aggs = []
    for i, t in enumerate(types):
        is_t = F.col("pii_type") == F.lit(t)
        aggs.append(F.max(F.when(is_t, F.col("score"))).alias(f"__s{i}"))
        aggs.append(F.min(F.when(is_t, F.col("src"))).alias(f"__o{i}"))
    g = u.groupBy(id_col).agg(*aggs)
    entries = F.array(
        *[F.struct(F.col(f"__o{i}").alias("src"), F.lit(i).alias("rank"), F.lit(t).alias("pii_type"),
                   F.col(f"__s{i}").alias("score")) for i, t in enumerate(types)]
    )
    present = F.array_sort(F.filter(entries, lambda e: e["score"].isNotNull()))
    out = g.select(
        id_col,
        F.transform(present, lambda e: e["pii_type"]).alias("pii_types"),
        F.map_from_entries(F.transform(present, lambda e: F.struct(e["pii_type"], e["score"]))).alias("confidence"),
        *[F.col(f"__s{i}").alias(f"score_{t.lower()}") for i, t in enumerate(types)],
    )
    return with_classification(out)


# --------------------------------------------------------------------------
# Object scan
# --------------------------------------------------------------------------


def scan_objects(
    objects: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    size_col: str | None = "size_bytes",
    n_bytes: int | None = None,
) -> DataFrame:
    """Objects ``(path, size, text)`` -> findings for objects whose text holds
    PII (clean objects are not returned). The whole text is read; ``n_bytes``
    makes it an explicit sample of the first bytes."""
    keep = [c for c in (size_col,) if c and c in objects.columns]
    text = F.col(text_col) if n_bytes is None else T.head_bytes(F.col(text_col), n_bytes)
    out = content_findings(objects, [path_col], text, keep_cols=keep)
    return out.withColumn("source_type", F.lit("object"))

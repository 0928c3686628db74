"""M9: mask whole tables from findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType

from veilscan import rules
from veilscan.functions.mask import MaskingRule, mask, merged_rules
from veilscan.operators.findings import quoted


def types_of_name(name: str) -> list[str]:
    """Column-name profile of one name, on the driver (same rule as ``name_types``)."""
    low = name.lower()
    return [t for t, patterns in rules.COLUMN_NAME_PATTERNS.items() if any(p in low for p in patterns)]


def column_types_by_name(df: DataFrame) -> dict[str, list[str]]:
    """Column-name profile over schema metadata only (the number of columns, not rows)."""
    return {name: types_of_name(name) for name in df.columns}


def _first(types: list[str] | str | None) -> str | None:
    return (types[0] if types else None) if isinstance(types, list) else types


def _masked(
    value: Column, kind: DataType, path: str, inherited: str | None, type_of: Callable[[str], str | None], by: dict
) -> Column | None:
    """``value`` with everything typed inside it masked; None if nothing is.

    A part's type is that of its own name or else that of what it lies in."""
    own = type_of(path) or inherited
    if isinstance(kind, StructType):
        parts = {f.name: _masked(value.getField(f.name), f.dataType, f"{path}.{f.name}", own, type_of, by) for f in kind.fields}
        if all(p is None for p in parts.values()):
            return None
        fields = [(value.getField(n) if p is None else p).alias(n) for n, p in parts.items()]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        probe = _masked(F.lit(None).cast(kind.elementType), kind.elementType, path, own, type_of, by)
        inside = lambda x: _masked(x, kind.elementType, path, own, type_of, by)
        return None if probe is None else F.transform(value, inside)
    if isinstance(kind, MapType):
        if own is not None and own in by:
            raise ValueError(f"map {path!r} may hold {own} in its keys, which cannot be masked; convert it first")
        probe = _masked(F.lit(None).cast(kind.valueType), kind.valueType, path, own, type_of, by)
        inside = lambda _, v: _masked(v, kind.valueType, path, own, type_of, by)
        return None if probe is None else F.transform_values(value, inside)
    if own is None:
        return None
    if isinstance(kind, BinaryType) and own in by:
        raise ValueError(f"binary {path!r} holds {own} and cannot be masked; convert it first")
    return mask(value, own, by)


def mask_table(
    df: DataFrame,
    column_types: dict[str, list[str] | str] | None = None,
    custom_rules: dict[str, MaskingRule] | None = None,
    suffix: str | None = None,
) -> DataFrame:
    """Mask every column that has findings by its first PII type.

    ``column_types`` maps column -> types (e.g. from ``column_name_findings``
    collected as metadata); nested parts are named by their path with dots. By
    default the column-name profile is applied to ``df``'s own schema, nested
    field names included. Inside structs, arrays and map values each leaf is
    masked by the type of its own name or of what it lies in. Masked leaves
    become strings; the rest passes through. What may hold PII but cannot be
    masked (map keys, binary) is an error. With ``suffix`` the masked value is
    added as ``<col><suffix>`` and the original is kept (a side-by-side preview).
    """

    def type_of(path: str) -> str | None:
        if column_types is not None:
            return _first(column_types.get(path))
        return _first(types_of_name(path.rpartition(".")[2] if path not in df.columns else path))

    by = merged_rules(custom_rules)
    exprs = []
    for field in df.schema.fields:
        c = F.col(quoted(field.name))
        m = _masked(c, field.dataType, field.name, None, type_of, by)
        if m is None:
            exprs.append(c)
        else:
            m = m.alias(field.name + (suffix or ""))
            exprs.extend([c, m] if suffix else [m])
    return df.select(*exprs)


def mask_preview(df: DataFrame, n: int = 10, key_cols=None, **kw) -> DataFrame:
    """Side-by-side preview of the first ``n`` rows (by key) masked."""
    base = df.orderBy(*([key_cols] if isinstance(key_cols, str) else key_cols)).limit(n) if key_cols else df.limit(n)
    return mask_table(base, suffix="_masked", **kw)


__all__ = ["mask_table", "mask_preview", "column_types_by_name"]

"""Detection rules compiled to Spark Column expressions (no UDFs).

* ``name_types``   - column-name profile: lower-cased substring tests.
* ``content_types`` - content profile: Java regexes with ``(?U)`` so that
  ``\\b \\d \\w \\s`` are Unicode-aware like Python's ``re``.
* ``source_types`` - source-name profile: keyword groups, duplicates kept.

Every function returns ``array<string>`` in rule order.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules

# Necessary conditions of the fixed patterns, keyed by pattern text (a custom
# pattern gets no guard): the shortest possible match in characters (a text
# has at least as many bytes as characters, so ``octet_length`` is an O(1)
# test), literal characters one of which must occur, and whether a run of
# three digits must occur. Cheap tests in front of the regex skip the texts
# that cannot match; results are unchanged.
_GUARDS: dict[str, tuple[int, tuple[str, ...], bool]] = {
    rules.CONTENT_PATTERNS["EMAIL"]: (6, ("@",), False),
    rules.CONTENT_PATTERNS["SSN"]: (11, ("-",), True),
    rules.CONTENT_PATTERNS["PHONE"]: (10, (), True),
    rules.CONTENT_PATTERNS["CREDIT_CARD"]: (16, (), True),
    rules.CONTENT_PATTERNS["DATE_OF_BIRTH"]: (10, ("/", "-"), True),
    rules.SIMPLE_PATTERNS["PHONE"]: (12, ("-",), True),
}
_NO_GUARD = (0, (), False)
DIGIT_RUN = r"(?U)\d{3}"


def min_match_bytes(patterns: dict[str, str]) -> int:
    """A lower bound on the byte length of any text one of ``patterns`` can
    match (0 when a pattern is not one of the fixed ones)."""
    return min((_GUARDS.get(p, _NO_GUARD)[0] for p in patterns.values()), default=0)


def needs_digit_run(patterns: dict[str, str]) -> bool:
    return any(_GUARDS.get(p, _NO_GUARD)[2] for p in patterns.values())


def has_digit_run(text) -> Column:
    """Boolean: three consecutive (Unicode) digits occur in ``text``."""
    t = _col(text)
    return (F.octet_length(t) >= 3) & t.rlike(DIGIT_RUN)


# First characters a match of a fixed pattern can start with. Java tries every
# position; a one-character lookahead in front rejects most of them with one
# class test before any boundary or alternation work. The match set is
# unchanged.
_FIRST_CHAR: dict[str, str] = {
    rules.CONTENT_PATTERNS["SSN"]: r"\d",
    rules.CONTENT_PATTERNS["PHONE"]: r"[(\d]",
    rules.CONTENT_PATTERNS["CREDIT_CARD"]: r"\d",
    rules.CONTENT_PATTERNS["DATE_OF_BIRTH"]: r"[01]",
    rules.SIMPLE_PATTERNS["PHONE"]: r"\d",
}


# Java has no bound on retries: a long run of local-part characters without an
# "@" behind it would be tried from every place in it. The linear form enters
# a run only at its start and only if an "@" ends it, goes to the run's first
# word boundary once, and takes the rest. It matches in the same texts: if any
# boundary in the run can begin a match, so can the first.
_LOCAL = "[A-Za-z0-9._%+-]"
_LINEAR: dict[str, str] = {
    rules.CONTENT_PATTERNS["EMAIL"]: rf"(?<!{_LOCAL})(?={_LOCAL}++@)(?>{_LOCAL}*?\b){_LOCAL}++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b",
}


# Python's ``re`` on str: \w is a Unicode letter or number or "_" (combining
# marks, connector punctuation and joiners are not), \s also covers
# \x1c-\x1f, \d is a decimal digit (Nd). Java's (?U) classes differ on the
# first two, so those escapes are spelled out; \d keeps (?U).
_PY_WORD = r"\p{L}\p{N}_"
_PY_SPACE = r"\s\x1c-\x1f"
_PY_BOUNDARY = rf"(?:(?<=[{_PY_WORD}])(?![{_PY_WORD}])|(?<![{_PY_WORD}])(?=[{_PY_WORD}]))"
_PY_NON_BOUNDARY = rf"(?:(?<=[{_PY_WORD}])(?=[{_PY_WORD}])|(?<![{_PY_WORD}])(?![{_PY_WORD}]))"
# A boundary right before a digit token holds iff the previous character is
# not a word character; right after one, iff the next is not. One lookaround
# instead of four.
_PY_BOUNDARY_BEFORE_DIGIT = rf"(?<![{_PY_WORD}])"
_PY_BOUNDARY_AFTER_DIGIT = rf"(?![{_PY_WORD}])"
_ENDS_WITH_DIGIT_TOKEN = re.compile(r"(?<!\\)\\d(\{\d+(,\d*)?\})?$")


def _python_classes(pattern: str) -> str:
    r"""Rewrite \b \B \w \W \s \S of a Python pattern with Python's
    definitions (inside and outside character classes)."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if in_class:
                out.append({"w": _PY_WORD, "s": _PY_SPACE}.get(e, c + e))
            elif e == "b" and pattern.startswith("\\d", i + 2):
                out.append(_PY_BOUNDARY_BEFORE_DIGIT)
            elif e == "b" and _ENDS_WITH_DIGIT_TOKEN.search(pattern[:i]):
                out.append(_PY_BOUNDARY_AFTER_DIGIT)
            else:
                out.append({
                    "b": _PY_BOUNDARY, "B": _PY_NON_BOUNDARY,
                    "w": f"[{_PY_WORD}]", "W": f"[^{_PY_WORD}]",
                    "s": f"[{_PY_SPACE}]", "S": f"[^{_PY_SPACE}]",
                }.get(e, c + e))
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            i += 1
            # a "]" (after an optional "^") right after "[" is a literal
            if i < len(pattern) and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < len(pattern) and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def java_regex(python_pattern: str) -> str:
    """Python ``re`` pattern -> Java pattern with Python's Unicode classes,
    plus a first-character lookahead for known fixed patterns."""
    if python_pattern in _LINEAR:
        return "(?U)" + _python_classes(_LINEAR[python_pattern])
    first = _FIRST_CHAR.get(python_pattern)
    return "(?U)" + (f"(?={first})" if first else "") + _python_classes(python_pattern)


def profile_patterns(profile: str | dict[str, str]) -> dict[str, str]:
    if isinstance(profile, dict):
        return profile
    if profile in ("content", "column", "agent"):
        return rules.CONTENT_PATTERNS
    if profile == "simple":
        return rules.SIMPLE_PATTERNS
    raise ValueError(f"unknown content profile {profile!r}")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hit(
    text: str | Column, pii_type: str, pattern: str, prefilter: bool = True, digit_run: Column | None = None
) -> Column:
    """Boolean: ``pattern`` (Python syntax) finds a match in ``text``.

    ``digit_run`` may carry a precomputed ``has_digit_run(text)`` column so the
    guard is evaluated once per row for all numeric patterns.
    """
    t = _col(text)
    hit = t.rlike(java_regex(pattern))
    min_len, lits, digits = _GUARDS.get(pattern, _NO_GUARD) if prefilter else _NO_GUARD
    guard = (F.octet_length(t) >= min_len) if min_len > 0 else None
    if lits:
        lit_guard = reduce(lambda a, b: a | b, [t.contains(x) for x in lits])
        guard = lit_guard if guard is None else guard & lit_guard
    if digits:
        d = digit_run if digit_run is not None else has_digit_run(t)
        guard = d if guard is None else guard & d
    return hit if guard is None else guard & hit


def content_hits(
    text: str | Column, profile: str | dict[str, str] = "content", digit_run: Column | None = None
) -> list[tuple[str, Column]]:
    """``[(type, boolean Column)]`` in rule order."""
    return [(name, content_hit(text, name, p, digit_run=digit_run)) for name, p in profile_patterns(profile).items()]


def content_types(
    text: str | Column, profile: str | dict[str, str] = "content", digit_run: Column | None = None
) -> Column:
    """``array<string>`` of the types whose pattern matches ``text``, rule order.

    NULL or empty text gives an empty array.
    """
    hits = content_hits(text, profile, digit_run)
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits]))


def name_types(name: str | Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """Column-name profile: a type hits when any of its patterns is a substring
    of the lower-cased name. ``array<string>`` in rule order."""
    patterns = patterns or rules.COLUMN_NAME_PATTERNS
    low = F.lower(_col(name))
    hits = []
    for pii_type, pats in patterns.items():
        cond = reduce(lambda a, b: a | b, [low.contains(p) for p in pats])
        hits.append(F.when(cond, F.lit(pii_type)))
    return F.array_compact(F.array(*hits))


def source_types(name: str | Column, groups=None) -> Column:
    """Source-name profile: each keyword group that matches appends its types;
    duplicates are kept on purpose (they count towards the risk level)."""
    groups = groups or rules.SOURCE_NAME_RULES
    low = F.lower(_col(name))
    empty = F.array().cast("array<string>")
    parts = []
    for keywords, types in groups:
        cond = reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])
        parts.append(F.when(cond, F.array(*[F.lit(t) for t in types])).otherwise(empty))
    return F.concat(*parts)


def confidence_map(types: Column, score: float) -> Column:
    """``map<string,double>`` giving every type in ``types`` the same score."""
    return F.map_from_arrays(types, F.transform(types, lambda _: F.lit(float(score))))


def one_row_if_any(types: Column) -> Column:
    """Generator argument that yields ``types`` once when non-empty, else nothing.

    ``explode(one_row_if_any(arr))`` keeps each regex evaluated once per row:
    a ``where(size(arr) > 0)`` after a projection makes Catalyst copy the
    whole detection expression into the filter.
    """
    return F.filter(F.array(types), lambda a: F.size(a) > 0)

"""Sampling expressions for text: byte-limited and character-limited heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head_bytes(text: str | Column, n: int) -> Column:
    """First ``n`` UTF-8 bytes of ``text`` decoded with a cut character dropped
    (what a byte-range read followed by a lenient decode returns).

    A cut can only split the last character, so the longest of the prefixes of
    ``n``..``n-3`` bytes that is valid UTF-8 is the answer. The text is first
    cut to ``n`` characters (never fewer than ``n`` bytes) so long texts are
    not encoded whole.
    """
    t = _col(text)
    raw = F.encode(F.left(t, F.lit(n)), "UTF-8")
    candidates = []
    for k in range(4):
        if n - k < 0:
            break
        s = F.substring(raw, 1, n - k).cast("string")
        candidates.append(F.when(F.is_valid_utf8(s), s))
    # Text holding invalid bytes elsewhere: drop every undecodable byte.
    fallback = F.replace(F.make_valid_utf8(F.substring(raw, 1, n).cast("string")), F.lit("�"), F.lit(""))
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(*candidates, fallback))


def head_chars(text: str | Column, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.left(_col(text), F.lit(n))


def suffix_filter(path: str | Column, suffixes=rules.DIRECT_SCAN_SUFFIXES) -> Column:
    """Case-sensitive file-suffix test."""
    p = _col(path)
    cond = None
    for s in suffixes:
        c = p.endswith(s)
        cond = c if cond is None else cond | c
    return cond


# Python's json.dumps escapes each non-ASCII character as \uXXXX (a surrogate
# pair for astral characters). For the fixed content patterns only the shape
# of an escape matters: no match can cross its backslash or start at a hex
# character (each follows a word character); only an EMAIL local part can
# start at the "u", and it accepts hex digits and letters alike. So one
# placeholder of that shape - backslash, "u", four non-digit word characters -
# gives the same matches as the real escape. A run of escapes behaves like one
# (each inner backslash only separates word characters no match can start
# at), so each run of non-ASCII characters becomes one placeholder. Texts
# whose byte and character lengths agree are pure ASCII and left as they are.
# The property test in tests/test_operators.py checks this against json.dumps.
_NON_ASCII_RUN = r"[^\x00-\x7F]+"
_ESCAPE_SHAPE = r"\\uxxxx"  # Java replacement syntax for the literal \uxxxx


def ascii_escaped(json_text: str | Column) -> Column:
    """JSON text with non-ASCII characters in escape shape (see above)."""
    t = _col(json_text)
    shaped = F.regexp_replace(t, F.lit(_NON_ASCII_RUN), F.lit(_ESCAPE_SHAPE))
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(shaped)

"""Quality rules against plain Python and numpy, and odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import ODD, frame, prose, words_of
from veilscan.llm import outliers as O

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, equal = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            equal += line in seen
            seen.add(line)
    n, repeat = len(words), len(covered)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), equal, repeat, n < 50 or 100 * repeat > 50 * n)


def vector(b):
    n, chars, symbols, lines, repeat, _ = b
    raw = [math.log(chars / n), math.log1p(symbols * 1000 / chars), math.log1p(lines * 100 / n), math.log1p(repeat * 100 / n)]
    return tuple(math.floor(v * O.UNIT + 0.5) for v in raw)


def squared(x, m, cov):
    d = x - m
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)


def bins(d2):
    safe = np.maximum(d2, 1e-300)
    return np.where(d2 <= 0, O.LOWEST, np.clip(np.floor(np.log2(safe) * O.BINS), O.LOWEST, O.HIGHEST)).astype(int)


def lower_median(values):
    return np.sort(values, axis=0)[(len(values) + 1) // 2 - 1]


def fitted(x):
    """Centre, scatter and scale of one group's different vectors."""
    x, n, ridge = np.array(sorted(x)) / O.UNIT, len(x), np.diag(np.square(O.SPREAD))
    half = (n + 5) // 2

    def of(part):
        m = part.mean(axis=0)
        return m, part.T @ part / len(part) - np.outer(m, m) + ridge

    m = lower_median(x)
    d = np.sqrt((lower_median(np.abs(x - m)) * 1.4826) ** 2 + np.square(O.SPREAD))
    z = (x - m) / d
    length = np.sqrt((z**2).sum(axis=1, keepdims=True))
    scatters = [np.eye(4)]
    for part in (np.divide(z, length, out=np.zeros_like(z), where=length > 0), np.tanh(z)):
        scatters.append(part.T @ part / n + 0.01 * np.eye(4))
    currents = [(m, s * np.outer(d, d)) for s in scatters]
    falls = None
    for step in range(O.MOST_STEPS):
        following = []
        for c in currents:
            b = bins(squared(x, *c))
            cut = np.sort(b)[half - 1]
            following.append(of(x[b <= cut]))
        falls = max(np.linalg.slogdet(a[1])[1] - np.linalg.slogdet(b[1])[1] for a, b in zip(currents, following, strict=True))
        currents = following
        if step and falls <= 1e-9:
            break
    best = min(currents, key=lambda c: np.linalg.slogdet(c[1])[1])

    def scale(c):
        return max(1.0, 2 ** ((np.sort(bins(squared(x, *c)))[half - 1] + 1) / O.BINS) / O.MEDIAN_OF_NORMAL)

    limit = bins(np.array([scale(best) * O.beyond(O.REFIT)]))[0]
    last = of(x[bins(squared(x, *best)) <= limit])
    return (*last, scale(last))


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = words_of(rng, rng.randrange(40, 300))
        if rng.random() < 0.1:
            words = [w + rng.choice(["#", "|", "<>", "$$"]) for w in words]
        if rng.random() < 0.1:
            words += words[:30]
        if rng.random() < 0.05:
            words = ["x" + w * 4 for w in words]
        text = "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)
        if rng.random() < 0.1:
            text += "\nsame line\nsame line\n"
        rows.append((i, text, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "en", "de", None])))
    # copies of one text are a third of the rows
    return rows + [(n + i, rows[0][1], "a", "en") for i in range(n // 2)]


def brute(rows, min_rows):
    found = [(r, base(r[1])) for r in rows]
    vectors = defaultdict(set)
    for r, b in found:
        if not b[5]:
            vectors[r[3], r[2]].add(vector(b))
    rest = defaultdict(int)
    for (lang, _), v in vectors.items():
        rest[lang] += len(v) if len(v) < min_rows else 0
    name = {}
    groups = defaultdict(set)
    for (lang, source), v in vectors.items():
        name[lang, source] = ("s", lang, source) if len(v) >= min_rows else ("l", lang) if rest[lang] >= min_rows else "rest"
        groups[name[lang, source]] |= v
    fits = {g: fitted(v) for g, v in groups.items() if len(v) >= min_rows}
    for r, b in found:
        far = None
        if not b[5] and name[r[3], r[2]] in fits:
            m, cov, factor = fits[name[r[3], r[2]]]
            far = squared(np.array([vector(b)]) / O.UNIT, m, cov)[0] / factor
        yield (r[0], *b, not b[5] and (far or 0) <= O.beyond(O.REJECT), far)


@pytest.mark.parametrize("min_rows", [40, 75])
def test_outliers_equal_brute_force(spark, min_rows):
    rows = corpus(5, 700)
    found = sorted(tuple(r) for r in O.judged(frame(spark, rows, extra=True), min_rows=min_rows).collect())
    expected = sorted(brute(rows, min_rows))
    assert [f[:8] for f in found] == [e[:8] for e in expected]
    assert {f[7] for f in found if not f[6]} == {True, False}
    for f, e in zip(found, expected, strict=True):
        assert f[8] == (None if e[8] is None else pytest.approx(e[8], rel=1e-6))


def test_statistics_of_odd_texts(spark):
    texts = [
        None,
        "",
        " \n\t\x0b\x0c\r",
        "a b c a b c a b c",
        "a a a a a",
        "\na\n\n b \na\n\na",
        "# * $ % & | < > #",
        "é 🙂  x ñ",
        "one two \x1cthree",
        "word " * 60000 + "end",
        " ".join(str(i % 5000) for i in range(40000)),
        prose(3, 500) + "\r\n" + prose(3, 500) + "\n",
    ]
    rows = O.statistics(frame(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == base(texts[r["doc_id"]])


def test_odd_tables(spark):
    assert O.judged(frame(spark, [])).collect() == []
    found = O.judged(frame(spark, ODD, extra=True)).collect()
    assert len(found) == len(ODD) and not any(r["kept"] for r in found)
    # too few for a fit: only the base rejects
    few = O.judged(frame(spark, [(i, prose(i, 80) + " #" * i) for i in range(30)])).collect()
    assert all(r["kept"] and r["distance"] is None for r in few)
    # one text only, however often
    same = O.judged(frame(spark, [(None, prose(1, 80))] * 100)).collect()
    assert len(same) == 100 and all(r["kept"] for r in same)


def test_ordinary_texts_stay_beside_copies(spark):
    """Copies that are most of a group do not become its only ordinary text."""
    rows = [(i, prose(i, 60 + i), "s", "en") for i in range(90)] + [(1000 + i, "stamp " + prose(7, 70), "s", "en") for i in range(300)]
    rows += [(2000 + i, " ".join(w + "||" for w in prose(i + 500, 80).split()), "s", "en") for i in range(20)]
    found = {r["doc_id"]: r["kept"] for r in O.judged(frame(spark, rows)).collect()}
    assert all(kept for i, kept in found.items() if i < 2000)
    assert not any(kept for i, kept in found.items() if i >= 2000)


def test_tail_of_chi_squared():
    assert O.beyond(0.5) == pytest.approx(3.356694, abs=1e-5)
    assert O.beyond(0.025) == pytest.approx(11.143287, abs=1e-5)


def test_no_python_on_the_main_path(spark, monkeypatch):
    """No job of the operator has a Python node in its plan."""
    plans = []
    monkeypatch.setattr(O, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or _staged(df, name))
    out = O.judged(frame(spark, corpus(2, 120)))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any(re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", p) for p in plans)


def _staged(df, name):
    from veilscan.llm.common import staged

    return staged(df, name)

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import ODD, frame, prose, words_of
from veilscan.llm.suffix_dedup import SuffixIndex, remove_repeats, sliding_min


def brute(texts, span):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - span + 1):
            if starts[x[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), runs, bytes(b for b, g in zip(x, gone) if not g)))
    return out


def check(spark, texts, span, reach):
    docs = frame(spark, list(enumerate(texts)), extra=True)
    found = {r.doc_id: r for r in remove_repeats(docs, span=span, reach=reach).collect()}
    for i, want in enumerate(brute(texts, span)):
        r = found[i]
        assert (r.n_bytes, r.n_removed, len(r.edges) // 2, bytes(r.kept)) == want, (i, texts[i])


@pytest.mark.parametrize("seed", range(4))
def test_repeats_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    span, reach = ((60, 30), (40, 20), (100, 80), (33, 4))[seed]
    passages = [prose(1000 + i, rng.randrange(5, 40)) for i in range(8)]
    texts = ["", None, "a" * 300, "a" * 39, "ab" * 200, "é" * 70, prose(1, 80), prose(1, 80)]
    for i in range(60):
        parts = [prose(i * 10 + k, rng.randrange(0, 30)) for k in range(3)]
        text = rng.choice([" ", "."]).join([parts[0], rng.choice(passages), parts[1], rng.choice(passages)[rng.randrange(30) :], parts[2]])
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text + text[at : at + rng.randrange(150)]
        if rng.random() < 0.3 and texts[-1]:
            at = rng.randrange(len(texts[-1]))
            text = texts[-1][:at] + "#" + texts[-1][at + rng.randrange(3) :]
        texts.append(text)
    check(spark, texts, span, reach)


def test_passages_of_over_fifty_words_by_their_bytes(spark):
    passages = [" ".join(words_of(random.Random(n), n, 90)) for n in range(51, 151, 3)]
    long = " ".join(words_of(random.Random(9), 150, 90))
    passages += [long[:399], long[-400:]]
    assert sum(len(p) < 400 for p in passages) > 5 and sum(len(p) >= 400 for p in passages) > 5
    rows = [(2 * k + i, f"{prose(500 + 2 * k + i, 40)}{'#@'[i]}{p}{'|~'[i]}{prose(900 + 2 * k + i, 40)}") for k, p in enumerate(passages) for i in range(2)]
    clean = [(1000 + i, prose(1300 + i, 120)) for i in range(60)]
    texts = dict(rows + clean)
    found = {r.doc_id: r for r in remove_repeats(frame(spark, rows + clean)).collect()}
    for i, text in texts.items():
        passage = passages[i // 2] if i < 1000 else ""
        gone = passage if len(passage) >= 400 else ""
        at = text.index(passage)
        assert found[i].n_bytes == len(text)
        assert (found[i].n_removed, found[i].edges) == (len(gone), [at, at + len(gone)] if gone else []), i
        assert found[i].kept.decode() == (text.replace(gone, "") if gone else text)


def test_hot_cores_and_small_groups(spark, monkeypatch):
    import veilscan.llm.suffix_dedup as module

    monkeypatch.setattr(module, "ENTRIES_TOGETHER", 3)
    hot = prose(5, 12)
    check(spark, [f"{i} {prose(i, 6)} {hot}{i}" for i in range(120)], 50, 25)


def test_odd_tables(spark):
    assert remove_repeats(frame(spark, [])).collect() == []
    found = remove_repeats(frame(spark, ODD)).collect()
    assert len(found) == len(ODD)
    # the one long text repeats within itself
    assert {(r.n_bytes, r.n_removed) for r in found if r.doc_id == 6} == {(150000, 150000)}
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, []), span=100, reach=99)


def test_family_of_arrays_marks_both_sides():
    rng = np.random.default_rng(3)
    index, seen = SuffixIndex(), []
    for _ in range(21):
        batch = rng.integers(0, 3000, rng.integers(0, 60)).astype(np.uint64)
        index.add(batch)
        seen.append(batch)
    keys = np.concatenate(seen)
    distinct, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    assert (index.repeated[: index.size] == (count[place] > 1)).all()
    sizes = [n for n, _, _ in index.levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)


def test_sliding_min():
    values = np.random.default_rng(1).integers(0, 1 << 60, 1000).astype(np.uint64)
    for width in (1, 7, 200, 1000):
        want = [values[i : i + width].min() for i in range(1000 - width + 1)]
        assert (sliding_min(values, width) == want).all()

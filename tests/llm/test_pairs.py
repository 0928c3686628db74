import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import ODD, frame, prose, words_of
from veilscan.llm import decontaminate as dec
from veilscan.llm import minhash as mh


def shingle_set(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def brute_classes(rows):
    """Class of each row: the smallest doc_id that links connect it with."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or brute_similarity(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return {i: min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(rows))}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return words


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for cluster in range(12):
        base = words_of(rng, rng.choice([40, 90, 200]))
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            base = edited(rng, base, rng.randrange(1, 3)) if rng.random() < 0.5 else base  # chains
            rows.append(" ".join(edited(rng, base, rng.randrange(0, 4))))
    rows += ["one two three", "one two three", "One  two THREE", "same same same same same same", "", " "]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(i, None) for i in range(1000, 1003)]


@pytest.mark.parametrize("seed", range(2))
def test_classes_are_those_of_brute_force(spark, seed):
    rows = near_rows(seed)
    found = {r.doc_id: r for r in mh.near_duplicates(frame(spark, rows, extra=True)).collect()}
    want = brute_classes(rows)
    for i, (doc_id, text) in enumerate(rows):
        assert found[doc_id].class_id == want[i], text
        assert found[doc_id].kept == (doc_id == want[i])


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = words_of(rng, 120)
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(300)] + [(i, " ".join(base)) for i in range(300, 500)]
    rows += [(i, prose(i, 60)) for i in range(500, 600)]
    found = {r.doc_id: r.class_id for r in mh.near_duplicates(frame(spark, rows)).collect()}
    want = brute_classes(rows)
    assert [found[i] for i, _ in rows] == [want[k] for k in range(len(rows))]


def test_what_pivots_leave_is_compared_exactly(spark):
    rows = near_rows(5)
    found = {r.doc_id: r.class_id for r in mh.near_duplicates(frame(spark, rows), rounds=0).collect()}
    want = brute_classes(rows)
    assert [found[i] for i, _ in rows] == [want[k] for k in range(len(rows))]


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(1)
    a = words_of(rng, 300, 60)
    texts = [" ".join(a), " ".join(edited(rng, a, 8)), " ".join(a[:150]), "tiny text"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    shingle, weight, counts = mh.weights(*mh.shingles(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])])))
    got = mh.dart_signatures(shingle, weight, counts, 4000)
    assert (got != mh._NONE).all()
    sets = [shingle_set(t) for t in texts]
    assert counts.tolist() == [len(s) for s in sets] and weight.sum() == sum(sum(s.values()) for s in sets)
    for i in range(4):
        for j in range(4):
            assert (got[i] == got[j]).mean() == pytest.approx(brute_similarity(sets[i], sets[j]), abs=0.04)


def test_components(spark):
    rng = random.Random(2)
    name = lambda i: i.to_bytes(2, "big") * 8
    pairs = [(name(i), name(i + 1)) for i in range(40)] + [(name(200), name(200 + i)) for i in range(1, 30)]
    pairs += [(name(rng.randrange(300, 400)), name(rng.randrange(300, 400))) for _ in range(60)]
    pairs = [p for p in pairs if p[0] != p[1]]
    found = {bytes(r.node): bytes(r.comp) for r in mh.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    parent = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent


def test_near_dedup_of_odd_tables(spark):
    assert mh.near_duplicates(frame(spark, [])).collect() == []
    docs = frame(spark, ODD + [(9, "one")], extra=True)
    assert mh.near_duplicates(docs).count() == len(ODD) + 1
    kept = mh.keep_one(docs)
    assert kept.columns == docs.columns
    # empty and null texts are equal, blank ones are not; 4, 4 and 9 have one text
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "None"]


# --- decontamination -------------------------------------------------------------------------

ITEM = "Compute how far a train moves when Anna lets it run for 12 hours at 80 km and then Anna adds 12 coins"


def hits(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = dec.contaminated(frame(spark, list(enumerate(texts)), extra=True), bench).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_copied_and_reparameterised_items_are_found(spark):
    other = ITEM.replace("Anna", "Boris").replace("12", "7.5").replace("80 km", "55 mph")
    inconsistent = ITEM.replace("adds 12", "adds 13")
    texts = [
        f"{prose(1, 50)} {ITEM} {prose(2, 50)}",
        f"{prose(3, 50)}. {other}. {prose(4, 50)}",
        f"{prose(5, 50)}. {inconsistent}",
        ITEM.lower().upper(),
        prose(6, 300),
        " ".join(ITEM.split()[:9]),
        " ".join(ITEM.split()[:10]),
        None,
        "",
    ]
    found = hits(spark, texts, [ITEM, prose(99, 30), "too short", None])
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 0), (6, 0)}
    # the first word begins a sentence in the item only, which the literal form does not mind
    assert {d for (d, _), r in found.items() if r.copied} == {0, 3, 6}
    assert found[0, 0].windows == found[3, 0].windows == found[0, 0].item_windows
    # its last 12 is another number than its first: no copy, but each run of windows agrees in itself
    assert found[2, 0].windows == found[2, 0].item_windows


LONG = (
    "The farmer Maria counted 14 crates of pears in the old barn before she drove 30 miles to the market in Lisbon "
    "where her cousin Pedro bought 14 of them and paid with coins that were kept in a wooden box under the stairs"
)


def test_copies_with_other_capitals_marks_and_values_are_found(spark):
    boundary = LONG.split()
    texts = [
        LONG.upper(),
        LONG.title(),
        LONG.replace(" ", "\n"),
        f"{prose(1, 30)} {LONG.replace('14 crates', '15 crates')} {prose(2, 30)}",
        LONG.replace("Maria", "Chloe").replace("Pedro", "Igor").replace("14", "91").replace("30 miles", "8 km"),
        # values that correspond in the first half only
        LONG.replace("Maria", "Chloe").replace("14 crates", "91 crates").replace("14 of them", "92 of them"),
        " ".join(boundary[20:30]),
        " ".join(boundary[20:29]),
        LONG.replace("barn", "shed").replace("market", "fair").replace("coins", "notes").replace("crates", "boxes"),
        " ".join(sorted(boundary)),
        prose(3, 200),
    ]
    found = hits(spark, texts, [LONG])
    assert {d for d, _ in found} >= {0, 1, 2, 3, 4, 5, 6}
    assert not {d for d, _ in found} & {7, 9, 10}
    assert not found[4, 0].copied and found[0, 0].copied and found[1, 0].copied


def test_short_items_and_items_of_numbers_and_names(spark):
    items = ["Who wrote Hamlet?", "Yes", "12 + 7 = 19 and 19 - 7 = 12 so 12 + 19 = 31", "Anna Boris Carla Dmitri Elena Farid Grace Hugo Ines Juri"]
    texts = [
        f"{prose(1, 20)} who wrote Hamlet {prose(2, 20)}",
        "Who wrote Macbeth?",
        f"{prose(3, 20)}. Yes. {prose(4, 20)}",
        f"{prose(3, 20)} yes {prose(4, 20)}",
        f"{prose(5, 20)} {items[2]} {prose(6, 20)}",
        f"{prose(5, 20)} 12 + 8 = 20 and 20 - 8 = 12 so 12 + 20 = 32 {prose(6, 20)}",
        f"{prose(7, 20)} {items[3].lower()} {prose(8, 20)}",
        "Ines Juri Anna Boris",
        "yes",
    ]
    assert set(hits(spark, texts, items)) == {(0, 0), (2, 1), (4, 2), (6, 3), (8, 1)}


def test_scripts_without_spaces_are_cut_by_character(spark):
    item = "列车从北京出发以每小时八十公里的速度行驶十二小时"
    texts = [f"前言。{item}。后记", "列车从上海出发", f"\u201c{LONG}\u201d", LONG.replace(" ", "\u00a0").replace("barn", "barn\u2014")]
    assert set(hits(spark, texts, [item, LONG])) == {(0, 0), (2, 1), (3, 1)}


def test_verbatim_windows_are_those_of_brute_force(spark):
    rng = random.Random(7)
    items = [prose(500 + i, rng.randrange(5, 30)) for i in range(25)]
    texts = []
    for i in range(120):
        item = rng.choice(items).split()
        lo = rng.randrange(len(item))
        passage = item[lo : lo + rng.randrange(3, 30)]
        texts.append(" ".join(words_of(rng, 20) + passage + words_of(rng, 20)))
    found = {k: r.windows for k, r in hits(spark, texts, items).items()}
    want = {}
    for d, text in enumerate(texts):
        t = text.split()
        for i, item in enumerate(items):
            w = item.split()
            size = min(len(w), dec.WINDOW)
            n = len(w) - size + 1
            by_shift = Counter()
            for p in range(n):
                for q in range(len(t) - size + 1):
                    if t[q : q + size] == w[p : p + size]:
                        by_shift[q - p] += 1
            if by_shift and max(by_shift.values()) >= min(dec.MIN_WINDOWS, n):
                want[d, i] = max(by_shift.values())
    assert found == want


def test_without_the_filter_the_result_is_the_same(spark, monkeypatch):
    texts = [f"{prose(i, 30)} {ITEM if i % 3 else ''}" for i in range(30)]
    with_filter = hits(spark, texts, [ITEM, "one two three four five"])
    monkeypatch.setattr(dec, "FILTER_WINDOWS", 0)
    assert set(hits(spark, texts, [ITEM, "one two three four five"])) == set(with_filter) != set()


def test_decontamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert dec.contaminated(frame(spark, []), bench).collect() == []
    assert dec.contaminated(frame(spark, ODD), bench.limit(0)).collect() == []
    docs = frame(spark, ODD + [(None, ITEM), (70, ITEM), (70, "clean")], extra=True)
    kept = dec.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    # each row is judged by its own text, also if it shares its doc_id or has none
    want = [(i, t) for i, t in [*ODD, (70, "clean")]]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))
    clash = docs.withColumn("bad_id", F.lit(1)).withColumn("key", F.lit(2)).withColumn("window", F.lit(3))
    assert dec.drop_contaminated(clash, bench).count() == len(want)


def test_a_third_of_the_rows_without_id(spark):
    rows = [(None if i % 3 == 0 else i, f"{prose(i, 40)} {ITEM if i % 10 == 0 else ''}") for i in range(300)]
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    kept = dec.drop_contaminated(frame(spark, rows), bench)
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in rows if ITEM not in t)

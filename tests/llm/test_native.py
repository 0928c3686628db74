import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tests.llm.data import ODD, frame, prose
from veilscan.llm import mixing
from veilscan.llm.exact_dedup import exact_dedup
from veilscan.llm.mixing import mix, mixed, word_count
from veilscan.llm.sharding import shard_of, shard_slots, with_shard


def slots(docs):
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return shard_slots(rows, "doc_id", 16).collect()


def test_appended_shards_take_rows_only_into_themselves(spark):
    ids = spark.range(4000)
    found = ids.select("id", *(shard_of(F.col("id"), n).alias(f"s{n}") for n in range(1, 24))).collect()
    for row in found:
        assert row.s1 == 0
        for n in range(2, 24):
            assert row[f"s{n}"] in (row[f"s{n - 1}"], n - 1)
    for n in (5, 16, 23):
        share = Counter(row[f"s{n}"] for row in found)
        assert len(share) == n and max(share.values()) < 1.5 * 4000 / n
    with pytest.raises(ValueError):
        shard_of(F.col("id"), 0)


def test_slots_have_no_gap_and_follow_the_key(spark):
    docs = frame(spark, ODD + [(i, str(i)) for i in range(10, 900)] + [(7, "again")] * 20000)
    found = slots(docs)
    assert len(found) == docs.count()
    by_shard = defaultdict(list)
    for row in found:
        by_shard[row.shard].append(row.slot)
        assert row.grown_shard in (row.shard, 16)
    for got in by_shard.values():
        assert sorted(got) == list(range(len(got)))
    assert len({row.shard for row in found if row.doc_id == 7}) == 1
    again = {(r.doc_id, r.slot, r.shard) for r in slots(docs.repartition(7))}
    assert again == {(r.doc_id, r.slot, r.shard) for r in found}


def test_shards_of_odd_tables(spark):
    assert slots(frame(spark, [])) == []
    out = with_shard(frame(spark, ODD, extra=True), "doc_id", 4)
    assert out.count() == len(ODD) and out.where("shard is null").isEmpty()


def targets(sizes: dict, most=3.0, weights=(5, 2, 1)) -> dict:
    """Reshare what is above the limit until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return full | share
        full |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(3))
def test_mix_reaches_the_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["b", "a", "ü", "Z", None, "hot", "hot", "hot"]), rng.choice([0, 3, 50, 400, 4000])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = mix(df, fan_in=8).collect()
    assert sorted((r.doc_id, r.size) for r in found) == sorted((r[0], r[2]) for r in rows)
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    want = targets(sizes)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert int(r.target / r.source_size) <= r.copies <= min(3, -(-r.target // r.source_size))
        taken[r.source] += r.size * r.copies
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2000
    again = {(r.doc_id, r.copies) for r in mix(df.repartition(5), fan_in=8).collect()}
    assert again == {(r.doc_id, r.copies) for r in found}


def test_rounding_keeps_each_expected_number(spark):
    df = spark.range(40).selectExpr("id as doc_id", "if(id < 10, 'a', 'b') as source", "cast(1 + id % 7 as long) as size")
    runs = 30
    total = Counter()
    for seed in range(runs):
        for r in mix(df, seed=seed, fan_in=64).collect():
            total[r.source] += r.copies / runs
            ratio = r.target / r.source_size
    want = {r.source: r.target / r.source_size * (10 if r.source == "a" else 30) for r in mix(df).collect()}
    for source, expected in want.items():
        assert total[source] == pytest.approx(expected, rel=0.12)
    assert ratio > 0


def brute_pairs(items, unit):
    """Pivotal rounding of (draw, row, size, mass) pair by pair; ``unit`` draws a number for two."""
    (draw, row, size, mass), settled = items[0], {}
    for draw2, row2, size2, mass2 in items[1:]:
        up, down = min(size - mass, mass2), min(mass, size2 - mass2)
        rise = up + down == 0 or unit[draw, draw2] * (up + down) < down
        step = up if rise else -down
        own_limit = size - mass if rise else mass
        if abs(step) == own_limit:  # the one held so far is done, the other goes on with what is left
            settled[row] = rise
            draw, row, size, mass = draw2, row2, size2, mass2 - step
        else:
            settled[row2] = not rise
            mass += step
    return row, mass, settled


@pytest.mark.parametrize("seed", range(4))
def test_pairing_off_is_that_of_brute_force(spark, seed):
    rng = random.Random(seed)
    items = []
    for row in range(rng.choice([1, 2, 17, 60])):
        size = float(rng.choice([1, 2, 8, 64, 1024]))
        items.append((rng.getrandbits(40), row, size, size * rng.choice([0.25, 0.5, 0.75, 0.125])))  # exact in binary
    draws = spark.createDataFrame([(x[0], y[0]) for x in items for y in items], "a long, b long")
    unit = {(r.a, r.b): r.u for r in draws.select("a", "b", mixing._unit(F.col("a"), F.col("b"), F.lit(seed)).alias("u")).collect()}
    df = spark.createDataFrame([(items,)], "items array<struct<draw:long,row:long,size:double,mass:double>>")
    state = df.select(mixing._pair_off(F.col("items"), seed).alias("s")).select("s.*").first()
    row, mass, settled = brute_pairs(items, unit)
    assert (state.left.row, state.left.mass) == (row, mass)
    assert {d.row: d.up for d in state.settled} == settled and len(state.settled) == len(items) - 1
    size_of = {x[1]: x[2] for x in items}
    assert mass + sum(size_of[r] for r, up in settled.items() if up) == sum(x[3] for x in items)


def test_mix_of_odd_tables(spark):
    assert mix(frame(spark, []).withColumn("size", F.lit(1))).collect() == []
    assert mixed(frame(spark, [])).collect() == []
    nothing = frame(spark, [(1, None, "a"), (2, "", "b")])
    assert {r.copies for r in mix(nothing.withColumn("size", word_count(F.col("text")))).collect()} == {0}
    docs = frame(spark, [(7, "two words", "a")] * 500 + [(8, "b " * 40, "b")] + [(*r, None) for r in ODD], extra=True)
    rows = docs.drop("size").withColumn("size", word_count(F.col("text")))
    got = mix(rows).collect()
    assert len(got) == docs.count()
    out = mixed(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return sorted(
        ((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g),
        key=str,
    )


@pytest.mark.parametrize("digest", [None, lambda c: F.crc32(c.cast("binary")) % 3])
def test_exact_dedup_compares_whole_texts(spark, digest):
    rows = [(i, prose(i % 37, 20)) for i in range(300)] + [(i, "hot") for i in range(400, 900)] + ODD
    docs = frame(spark, rows, extra=True)
    found = exact_dedup(docs, digest=digest).collect() if digest else exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_crc_of_the_query_is_the_usual_one(spark):
    assert spark.range(1).select(F.crc32(F.lit("añ").cast("binary"))).first()[0] == crc32("añ".encode())

"""Two-level scans against plain loops, over many ranges and with a key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from rollsift.operators import ordering as od
from rollsift.operators import relations as rl
from rollsift.operators import sampling as sp
from rollsift.operators import scans
from rollsift.operators.batches import cat_packs


def test_dense_index_of_a_wide_table(ranges):
    """600,000 rows of a wide payload: every index once, in order."""
    n = 600_000
    df = ranges.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("payload"))
    got = sp.dense_index(df, "k", "at").agg(F.count("*"), F.countDistinct("at"), F.min("at"), F.max("at"), F.count_if(F.col("at") != F.col("k"))).first()
    assert tuple(got) == (n, n, 0, n - 1, 0)


def test_dense_index_of_equal_rows(ranges):
    df = ranges.range(50_000).select((F.col("id") % 2 * 0).alias("k"))
    got = sp.dense_index(df, "k", "at").agg(F.count("*"), F.countDistinct("at"), F.max("at"), F.count_distinct(F.lit(1))).first()
    assert tuple(got)[:3] == (50_000, 50_000, 49_999)
    # one value of the order still spans ranges
    assert scans.ranged(df, ["k"]).select("_part").distinct().count() > 4
    assert sp.dense_index(df.limit(0), "k", "at").count() == 0


def _hot(spark, n=20_000, seed=1):
    """(key, order, tokens): a null key and small ones beside one with most rows."""
    r = random.Random(seed)
    rows = [(r.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), i, r.choice([0, 1, 2, 3, 50, None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, at long, tokens int").repartition(7)


def _by_key(rows):
    out = {}
    for k, at, t in sorted(rows, key=lambda x: x[1]):
        out.setdefault(k, []).append((at, t))
    return out


def test_places_sums_and_previous_rows(ranges):
    rows, df = _hot(ranges)
    want = {}
    for k, xs in _by_key(rows).items():
        total, last = 0, None
        for i, (at, t) in enumerate(xs):
            want[at] = (i, len(xs), total, last)
            total, last = total + (t or 0), t
    got = scans.scanned(df, ["key"], ["at"], at="i", size="n", sums={"so_far": "tokens"}, previous={"before": "tokens"})
    assert {r["at"]: (r["i"], r["n"], r["so_far"], r["before"]) for r in got.collect()} == want


def _runs(xs, budget):
    """(at, run, held before) of whole runs, by the rule itself."""
    out, run, held, current = [], 0, 0, []
    for at, t in xs:
        current.append((at, run, held))
        held += t or 0
        if held >= budget:
            out, run, held, current = out + current, run + 1, 0, []
    return out


@pytest.mark.parametrize("budget", [1, 7, 60, 20_000, 10**9])
def test_runs_of_a_budget(ranges, budget):
    rows, df = _hot(ranges, 6000, budget)
    want = sorted(x for xs in _by_key(rows).values() for x in _runs(xs, budget))
    got = scans.restarting(df, budget, ["key"], ["at"], "tokens", "run", "held")
    assert sorted((r["at"], r["run"], r["held"]) for r in got.collect()) == want
    assert scans.restarting(df.limit(0), budget, ["key"], ["at"], "tokens").count() == 0


def test_one_key_of_a_million_rows(ranges):
    """The key spans many ranges; the largest task's share is that of one range."""
    n = 1_000_000
    df = ranges.range(n).select(F.lit(1).alias("key"), F.col("id").alias("at"), (F.crc32(F.col("id").cast("string")) % 5).alias("tokens"))
    got = scans.restarting(df, 1000, ["key"], ["at"], "tokens", "run", "held").agg(F.count("*"), F.max("run"), F.count_distinct("run"), F.sum(F.col("run") * F.col("held"))).first()
    tokens = [r[0] for r in df.orderBy("at").select("tokens").collect()]
    want = _loop(tokens, 1000)
    assert tuple(got) == want
    sizes = [r["count"] for r in scans.ranged(df, ["key", "at"]).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * n / 16


def _loop(tokens, budget):
    rows = last = run = held = mixed = 0
    begun = part = 0
    for t in tokens:
        part += run * held
        begun += 1
        held += t
        if held >= budget:
            rows, last, mixed = rows + begun, run, mixed + part
            run, held, begun, part = run + 1, 0, 0, 0
    return rows, last, last + 1, mixed


def test_negative_tokens_are_refused(ranges):
    with pytest.raises(Exception, match="negative"):
        scans.restarting(ranges.createDataFrame([(1, 1, -3)], "key int, at int, tokens int"), 5, ["key"], ["at"], "tokens").count()


def test_operators_on_a_hot_key(ranges):
    rows, df = _hot(ranges, 5000)
    xs = _by_key(rows)
    full = {at: i // 64 for k in xs for i, (at, _) in enumerate(xs[k]) if i // 64 < len(xs[k]) // 64}
    assert {r["at"]: r["batch_id"] for r in od.batches_of(df, 64, "at", ["key"]).collect()} == full
    turns = {at: i + 1 for k in xs for i, (at, _) in enumerate(xs[k])}
    assert {r["at"]: r["turn"] for r in sp.round_robin(df, "key", "at").collect()} == turns
    before = {xs[k][i][0]: xs[k][i - 1][1] if i else None for k in xs for i in range(len(xs[k]))}
    assert {r["at"]: r["previous_tokens"] for r in rl.previous(df, ["key"], "at", ["tokens"]).collect()} == before
    packs = sorted((at, run, held, min(dict(xs[k])[at] or 0, 20 - held)) for k in xs for at, run, held in _runs(xs[k], 20))
    got = cat_packs(df.fillna({"tokens": 0}), 20, ["key"], "at", sample="at", length="tokens")
    assert sorted((r["sample_id"], r["pack"], r["start"], r["taken"]) for r in got.collect()) == packs


def test_token_buckets_of_a_hot_key(ranges):
    """Levels and waits of a plain loop, with events at one time and idle stretches."""
    from rollsift.operators.admission import rate_limited

    r = random.Random(9)
    rows, t = [], 0
    for i in range(4000):
        t += r.choice([0, 0, 1, 2, 400])
        rows.append((r.choice([None, "a", "hot", "hot", "hot"]), t, i, r.choice([0, 1, 5, 30, None])))
    level, at, want = {}, {}, {}
    for k, t, i, c in rows:
        held = min(50, level.get(k, 50) + 3 * (t - at.get(k, t))) - (c or 0)
        level[k], at[k], want[i] = held, t, (held, max(0, -(held // 3)))
    df = ranges.createDataFrame(rows, "key string, t long, i long, cost int").repartition(5)
    assert {x["i"]: (x["level"], x["wait"]) for x in rate_limited(df, ["key"], "t", ["i"], "cost", 3, 50).collect()} == want

"""Cases with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rollsift.functions import arrays as ar
from rollsift.functions import scalars as sc
from rollsift.operators import advantage as adv
from rollsift.operators import filters as fl
from rollsift.operators import losses as ls
from rollsift.operators import metrics as m
from rollsift.operators import timeseries as ts
from rollsift.operators.batches import balanced, cat_packs, cost_of, first_fit_decreasing, round_robin_selection, split_until, stacked
from rollsift.operators.trajectories import merge_steps


def advantages(spark, rewards, lengths=None, **kw):
    rows = [("g", i, float(r), (lengths or [1] * len(rewards))[i]) for i, r in enumerate(rewards)]
    df = spark.createDataFrame(rows, "group_id string, i int, reward double, len int")
    return [r["advantage"] for r in adv.group_advantage(df, length="len", **kw).orderBy("i").collect()]


def test_advantage_sums_to_zero(spark):
    assert advantages(spark, [0.25, 2, -0.75, 0.5]) == pytest.approx([-0.25, 1.5, -1.25, 0])
    assert advantages(spark, [3]) == [0]


def test_length_penalty(spark):
    rewards, lengths = [1, 0, 0.5], [64, 8, 16]
    mean = sum(rewards) / 3
    got = advantages(spark, rewards, lengths, length_penalty=3, max_seq_len=128)
    shaped = [r - 3 * mean * n / 128 for r, n in zip(rewards, lengths, strict=True)]
    assert got == pytest.approx([x - sum(shaped) / 3 for x in shaped])
    gated = advantages(spark, rewards, lengths, length_penalty=3, max_seq_len=128, gate_by_reward=True)
    shaped = [r - r * 3 * mean * n / 128 for r, n in zip(rewards, lengths, strict=True)]
    assert gated == pytest.approx([x - sum(shaped) / 3 for x in shaped])
    with pytest.raises(ValueError):
        advantages(spark, [1, 0], length_penalty=1)


def test_length_weighted_baseline(spark):
    assert advantages(spark, [1, 0, 0], [10, 30, 60], length_weighted_baseline=True) == pytest.approx([0.9, -0.1, -0.1])


def test_custom_advantage(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 0.5)], "group_id string, reward double")
    assert sorted(r["advantage"] for r in adv.custom_advantage(df, lambda g: g["reward"] * 2).collect()) == [1, 2]


# a vocabulary of 1,000 and an offset of 0.5: tokens from 701 on that are less likely than this are gibberish
RARE = -math.log(1000) - 0.5


@pytest.mark.parametrize(
    "ids, lps, want",
    [
        ([[3, 7, 900]], [[-2.0, RARE - 3, RARE - 0.01]], 2), ([[3, 700, 650, 1]], [[RARE - 1, RARE - 1, RARE - 5, -9.0]], None), ([[999, 998]], [[RARE + 0.01, -0.1]], None),
        ([[1], [2, 3], [701, 800]], [[-0.1], [-0.2, -0.3], [RARE, RARE - 2]], 4), ([None, None, [750]], [None, None, [RARE - 4]], 0),
    ],
)
def test_gibberish(spark, ids, lps, want):
    df = spark.createDataFrame([(ids, lps)], "ids array<array<bigint>>, lps array<array<double>>")
    assert df.select(fl.gibberish_index("ids", "lps", 1000, 700, 0.5)).first()[0] == want


@pytest.mark.parametrize(
    "lps, window, want",
    [([-0.9, -0.002, -0.003, -0.004], 3, 3), ([-0.005] * 6, 7, None), ([-0.02, -0.004] * 4, 2, None), ([-0.001, -0.5, -0.001, -0.009, -1.5, -0.002, -0.001, -0.003], 3, 7)],
)
def test_repetition(spark, lps, window, want):
    df = spark.createDataFrame([([lps],)], "lps array<array<double>>")
    assert df.select(fl.repetition_index("lps", window, 0.99)).first()[0] == want


def test_first_filter_wins_and_marks_shadow(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "a boolean, b boolean")
    chain = [fl.RolloutFilter("mark", F.col("a"), enforce=False), fl.RolloutFilter("drop", F.col("b"))]
    assert [tuple(r)[2:] for r in fl.apply_filters(df, chain).collect()] == [("mark", False), ("drop", True), (None, False)]


def steps(*parts):
    return [{"prompt_ids": p, "prompt_mask": [False] * len(p), "completion_ids": c, "completion_mask": [True] * len(c), "completion_logprobs": lp} for p, c, lp in parts]


FIVE = steps(
    ([1, 2], [3, 4], [-0.1, -0.2]), ([1, 2, 3, 4, 5, 6], [7, 8], [-0.3, -0.4]), (list(range(1, 11)), [11, 12], [-0.5, -0.6]),
    ([100, 101, 102, 103], [104, 105], [-0.7, -0.8]), (list(range(100, 108)), [108, 109], [-0.9, -1.0]),
)


def test_merge_breaks_into_two_samples():
    a, b = merge_steps(FIVE, False)
    assert (a.prompt, a.ids) == ([1, 2], list(range(3, 13)))
    assert a.mask == [True, True, False, False, True, True, False, False, True, True]
    assert a.logprobs == [-0.1, -0.2, 0, 0, -0.3, -0.4, 0, 0, -0.5, -0.6]
    assert (b.prompt, b.ids, b.mask) == ([100, 101, 102, 103], list(range(104, 110)), [True, True, False, False, True, True])


def test_merge_interleaved_agents_and_longest_prefix():
    agents = merge_steps(steps(([1, 2], [3, 4], [-0.1, -0.2]), ([1, 2, 3, 4, 5, 6], [7, 8], [-0.3, -0.4]), ([100, 101], [102, 103], [-0.5, -0.6]), (list(range(1, 11)), [11, 12], [-0.7, -0.8])), False)
    assert [x.ids for x in agents] == [list(range(3, 13)), [102, 103]]
    a, b = merge_steps(steps(([1, 2], [3, 4], [-0.1, -0.2]), ([1, 2, 3, 4, 5], [6], [-0.3]), ([1, 2], [3, 4, 5, 6, 7], [-0.4] * 5), (list(range(1, 9)), [9], [-0.9])), False)
    assert (a.ids, a.mask) == ([3, 4, 5, 6], [True, True, False, True])
    assert (b.ids, b.mask) == ([3, 4, 5, 6, 7, 8, 9], [True] * 5 + [False, True])


def test_merge_edges():
    assert merge_steps([], False) is None
    (x,) = merge_steps(FIVE[:2], True)
    assert x.mask == [False] * 6 and x.logprobs == [-0.1, -0.2, 0, 0, -0.3, -0.4]
    assert merge_steps([{**FIVE[0], "completion_ids": None}], False) is None


def test_packing_and_balance():
    items = [(n, "rl", False) for n in (6, 6, 5, 5, 4, 4)]
    bins = first_fit_decreasing(items, 12)
    assert len(bins) == 3 and len(split_until(bins, [x[0] for x in items], 4)) == 4
    assert first_fit_decreasing([(4, "rl", False), (4, "sft", False)], 16) == [[0], [1]]
    groups = balanced([100, 90, 80, 70], 2)
    assert sorted(sum([100, 90, 80, 70][i] for i in g) for g in groups) == [170, 170]
    with pytest.raises(ValueError):
        balanced([1, 2, 3], 2)


def test_cat_and_stack(spark):
    df = spark.createDataFrame([("r", i, i, n) for i, n in enumerate([5, 5, 5, 5])], "run string, sample_id long, arrival long, length int")
    rows = cat_packs(df, 8, ["run"], "arrival").orderBy("pack", "start").collect()
    assert [(r["pack"], r["sample_id"], r["taken"]) for r in rows] == [(0, 0, 5), (0, 1, 3), (1, 2, 5), (1, 3, 3)]
    df = spark.createDataFrame([("r", i, i, 200) for i in range(5)], "run string, sample_id long, arrival long, length int")
    rows = stacked(df, 1024, ["run"], "arrival").orderBy("batch", "position").collect()
    assert [(r["batch"], r["bucket"], r["sample_id"]) for r in rows] == [(0, 256, i) for i in range(4)]


def plain_selection(buffers, steps, budget, position):
    """Run after run, sample after sample."""
    queues, names, taken, used = {r: list(b) for r, b in buffers.items()}, list(buffers), [], 0
    for _ in range(len(names) + 1):
        ready = [k for k in ((position + d) % len(names) for d in range(len(names))) if queues[names[k]] and queues[names[k]][0][2] <= steps[names[k]]]
        if used >= budget or not ready:
            return taken, position
        run, position = names[ready[0]], (ready[0] + 1) % len(names)
        while queues[run] and queues[run][0][2] <= steps[run]:
            sample, tokens, _ = queues[run][0]
            if used and used + tokens > budget:
                return taken, position
            queues[run].pop(0)
            if used + tokens <= budget:
                taken.append((run, sample))
                used += tokens
    return taken, position


def test_round_robin(spark):
    cases = [({"a": [(1, 4, 0), (2, 4, 0), (3, 4, 1)], "b": [(4, 100, 0), (5, 3, 0)]}, 12, 0)]
    rng = random.Random(4)
    for _ in range(12):
        at = iter(range(1000))
        cases.append(({r: [(next(at), rng.choice([2, 3, 5, 30]), rng.choice([0, 0, 0, 1])) for _ in range(rng.randrange(5))] for r in "abc"}, rng.choice([4, 9, 16]), rng.randrange(3)))
    for buffers, budget, position in cases:
        steps = {r: 0 for r in buffers}
        rows = [(r, n, s, t, k) for r, b in buffers.items() for n, (s, t, k) in enumerate(b)]
        samples = spark.createDataFrame(rows, "run string, arrival long, sample long, tokens long, step long")
        runs = spark.createDataFrame([(r, n, steps[r]) for n, r in enumerate(buffers)], "run string, place long, current_step long")
        want, after = plain_selection(buffers, steps, budget, position)
        got, place = round_robin_selection(samples, runs, budget, position)
        assert [(r["run"], r["sample"]) for r in got.orderBy("used", "sample").collect()] == want
        assert place == after or not any(t <= budget for b in buffers.values() for _, t, k in b if not k)


def plain_fit(items, capacity):
    bins, free, kinds = [], [], []
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, kind, alone = items[i]
        at = None if alone else next((b for b in range(len(bins)) if kinds[b] == kind and free[b] >= length), None)
        if at is None:
            bins.append([])
            free.append(capacity)
            kinds.append(("alone", i) if alone else kind)
            at = len(bins) - 1
        bins[at].append(i)
        free[at] -= length
    return bins


def test_first_fit_and_swaps_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        items = [(rng.randrange(1, 20), rng.choice("ab"), rng.random() < 0.1) for _ in range(rng.randrange(40))]
        assert first_fit_decreasing(items, 20) == plain_fit(items, 20)
        parts = rng.randrange(1, 5)
        weights = [rng.randrange(1, 50) for _ in range(parts * rng.randrange(1, 6))]
        groups = balanced(weights, parts)
        assert sorted(i for g in groups for i in g) == list(range(len(weights))) and len({len(g) for g in groups}) == 1
        loads = [sum(weights[i] for i in g) for g in groups]
        now = (max(loads), max(loads) - min(loads))
        for a in range(parts):
            for b in range(a + 1, parts):
                for x in groups[a]:
                    for y in groups[b]:
                        after = list(loads)
                        after[a] += weights[y] - weights[x]
                        after[b] -= weights[y] - weights[x]
                        assert (max(after), max(after) - min(after)) >= now


def test_walks_keep_null_keys_together(spark):
    df = spark.createDataFrame([(None, i, i, 5) for i in range(4)] + [(7, i, 10 + i, 4) for i in range(4)], "run long, sample_id long, arrival long, length int")
    rows = cat_packs(df, 8, ["run"], "arrival").orderBy("run", "pack", "start").collect()
    assert [(r["run"], r["pack"], r["sample_id"]) for r in rows] == [(None, 0, 0), (None, 0, 1), (None, 1, 2), (None, 1, 3), (7, 0, 0), (7, 0, 1), (7, 1, 2), (7, 1, 3)]


@pytest.mark.parametrize("ids, bounds, longest", [(range(8), [0, 8], 8), (range(8, 16), [0, 8], 8), ([0, 1, 2, 3, 0, 1, 2], [0, 4, 7], 4), ([5, 6, 7, 0, 1, 2], [0, 3, 6], 3)])
def test_boundaries(spark, ids, bounds, longest):
    df = spark.createDataFrame([(list(ids),)], "p array<int>")
    assert tuple(df.select(ar.sequence_boundaries("p"), ar.longest_sequence("p")).first()) == (bounds, longest)


def test_pass_at_k(spark):
    df = spark.createDataFrame([(4, 1, 1), (4, 1, 2), (4, 1, 4), (3, 0, 1), (3, 0, 2)], "n long, c long, k long")
    assert [r[0] for r in df.select(ar.pass_at_k("n", "c", "k")).collect()] == pytest.approx([0.25, 0.5, 1.0, 0, 0])


def test_max_violation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), ([0.0, 0.0],)], "a array<double>")
    assert [r[0] for r in df.select(ar.max_violation("a")).collect()] == [0.5, 0, 0]


def test_counter_rate_skips_resets(spark):
    rows = [("A", "x", "0", 0, "v", 10.0), ("A", "x", "0", 10, "v", 30.0), ("B", "x", "0", 0, "v", 50.0), ("B", "x", "0", 10, "v", 5.0)]
    df = spark.createDataFrame(rows, "endpoint string, role string, engine string, ts long, metric string, value double")
    assert {r["ts"]: r["rate"] for r in ts.counter_rate(df, "v").collect()} == {0: None, 10: 2.0}


def test_solve_rates(spark):
    rows = [("g0", 0.0), ("g0", 0.0), ("g1", 1.0), ("g1", 0.0), ("g2", 1.0), ("g2", 1.0)]
    df = spark.createDataFrame([("e", g, r) for g, r in rows], "env_name string, group_id string, reward double")
    sizes = spark.createDataFrame([("e", 2)], "env_name string, group_size int")
    got = {r["scope"]: r for r in m.solve_rates(df, sizes).collect()}["all"]
    assert (got["solve_none"], got["solve_all"], got["effective"]) == pytest.approx((1 / 3, 1 / 3, 1 / 3))


def test_generation_truncated(spark):
    df = spark.createDataFrame([(True, None), (True, "prompt_too_long"), (False, "x")], "is_truncated boolean, stop_condition string")
    assert df.select(F.avg(m.generation_truncated().cast("double"))).first()[0] == pytest.approx(1 / 3)


def test_sft_loss(spark):
    df = spark.createDataFrame([([-0.1, -0.5, -0.2], [-0.1, -0.5, -0.2], [0.0] * 3, [True, False, True], "sft")], "t array<double>, i array<double>, a array<double>, m array<boolean>, mode string")
    toks = ls.tokens("t", "i", "a", "m")
    assert df.select(ls.loss(toks, "mode", F.lit(2.0))).first()[0] == pytest.approx(0.15)
    assert df.select(ls.export_columns(toks, "mode")).first()[0] is None
    with pytest.raises(Exception, match="unknown training mode"):
        df.select(ls.loss(toks, F.lit("other"), F.lit(1.0))).collect()


def test_distribution_takes_the_lower_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    r = m.distribution(df, "x").first()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (2.5, 2.0, 1.0, 4.0)


def test_non_finite_values_go(spark):
    df = spark.createDataFrame([({"finite": 1.0, "nan": float("nan")}, [0.5, float("inf")])], "m map<string,double>, a array<double>")
    assert tuple(df.select(ar.drop_non_finite_values("m"), ar.drop_non_finite("a")).first()) == ({"finite": 1.0}, [0.5])


def test_scalars(spark):
    df = spark.createDataFrame([("  x y\n", "env@1", {"a_total": 2.0, "b": 1.0})], "t string, e string, m map<string,double>")
    got = df.select(sc.strip_content("t"), sc.base_environment("e"), sc.suffix_value("m", "_total"), sc.format_number(F.lit(2500000)), sc.format_seconds(F.lit(90061))).first()
    assert tuple(got) == ("x y", "env", 2.0, "2.50M", "1d 1h")


def test_exact_sample(spark):
    df = spark.range(37)
    assert fl.exact_sample(df, 0.5, "id").count() == 18
    assert [fl.exact_sample(df, r, "id").count() for r in (None, 1.5, 0, 0.001)] == [37, 37, 0, 1]


def test_smoothing_repeats_the_last_mean(spark):
    df = spark.createDataFrame([("k", t, v) for t, v in enumerate([1.0, 3.0, None, 5.0])], "metric string, ts int, value double")
    assert [r["smoothed"] for r in ts.smoothed(df, window=2).orderBy("ts").collect()] == [1.0, 2.0, 2.0, 4.0]

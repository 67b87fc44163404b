"""Training steps take every sample, also when fewer tokens than the budget are ready."""

import random

from pyspark.sql import functions as F

from rollsift.operators import batches as bt
from rollsift.plans import queries

SF = "/root/testdata/sf0.001"


def whole_steps(queues, budget):
    """Queues (sample, tokens, step) a run, in turns from step to step; what is ready is taken, enough or not."""
    out, at, names, steps = [], 0, sorted(queues), dict.fromkeys(queues, 0)
    ready = lambda run: queues[run] and queues[run][0][2] <= steps[run]
    while any(ready(run) for run in names):
        used, taken, full = 0, [], False
        while used < budget and not full and any(ready(run) for run in names):
            run, at = names[at], (at + 1) % len(names)
            while ready(run):
                sample, tokens, _ = queues[run][0]
                full = used + tokens > budget
                if full:
                    break
                queues[run].pop(0)
                taken.append((run, sample))
                used += tokens
        for run in {x[0] for x in taken}:
            steps[run] += not ready(run)
        out.append(sorted(taken))
    return out


def test_steps_without_a_wait_empty_the_buffer(spark):
    r = random.Random(4)
    queues = {run: [(100 * n + k, r.choice([3, 9, 20]), k // 12) for k in range(30)] for n, run in enumerate("ab")}
    rows = [(run, n, s, t, k) for run in queues for n, (s, t, k) in enumerate(queues[run])]
    buffer = spark.createDataFrame(rows, "run string, arrival long, sample long, tokens long, step long")
    runs = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "run string, place long, current_step long")
    assert bt.next_step(buffer, runs, 10_000) is None
    want, got, position = whole_steps(queues, 200), [], 0
    while (taken := bt.next_step(buffer, runs, 200, position, wait=False)) is not None:
        chosen, buffer, runs, position = taken
        got.append(sorted((x["run"], x["sample"]) for x in chosen.collect()))
    assert got == want and sum(map(len, got)) == len(rows) and buffer.count() == 0


def test_every_sample_of_a_wide_table_is_in_a_step(spark, tmp_path):
    """Ids so far apart that 8,000 of them hold a few samples only."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") * 1001)
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes = sorted(tuple(r) for r in items.groupBy("l_orderkey").count().collect())
    width, queues = max(8000, (sizes[-1][0] - sizes[0][0]) // 4 + 1), {"run0": [], "run1": []}
    for i, n in sizes:
        queues[f"run{i % 2}"].append((i, n, i // width))
    want = whole_steps(queues, sum(n for _, n in sizes) // 6 + 1)
    got = queries.QUERIES["p15_packed_steps"](spark, str(tmp_path)).collect()
    assert [sorted((r["run"], r["sample"]) for r in got if r["train_step"] == k) for k in range(len(want))] == want and len(got) == len(sizes)


def test_steps_of_few_and_no_samples(spark, tmp_path):
    """A sixth of the tokens is less than a sample, and steps have gaps between them."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").limit(6).withColumn("l_orderkey", F.array(*[F.lit(x) for x in (3, 3, 3, 3, 1 << 40, (1 << 40) + 7)])[F.monotonically_increasing_id().cast("int")])
    items.coalesce(1).write.parquet(f"{tmp_path}/few/lineitem.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    of = lambda name: sorted(tuple(r) for r in queries.QUERIES["p15_packed_steps"](spark, f"{tmp_path}/{name}").collect())
    assert of("few") == [(0, "run0", 1 << 40), (1, "run1", 3), (2, "run1", (1 << 40) + 7)] and of("none") == []

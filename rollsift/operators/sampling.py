"""Sources: interleaving, weighted schedules, epochs, rank shares, evaluation triggers.

Orders come from hashes of stable keys, never from partition order, so every
run and every cluster size gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollsift.functions.scalars import HASH_BITS, hash_number
from rollsift.operators.scans import dense_index, scanned


def tagged(df: DataFrame, subset: str | None, split: str | None, order: str) -> DataFrame:
    """Lineage columns and a dense index from 0 in the order of a key."""
    return dense_index(df.withColumn("__subset", F.lit(subset).cast("string")).withColumn("__split", F.lit(split).cast("string")), order, "__index")


def subset_splits(subsets: list[str] | None, splits: list[str] | None) -> list[tuple[str | None, str]]:
    """Pairs to read: none gives the train split; both lists pair up and must be equally long."""
    if subsets and splits:
        if len(subsets) != len(splits):
            raise ValueError("subsets and splits differ in number")
        return list(zip(subsets, splits, strict=True))
    if subsets:
        return [(s, "train") for s in subsets]
    if splits:
        return [(None, s) for s in splits]
    return [(None, "train")]


def interleave(frames: list[DataFrame], index: str = "__index", until: str = "first_exhausted") -> DataFrame:
    """One row of each in turn, by index, until the shortest ends or (wrapping around) the longest does.

    Every row computes its own places, so nothing is sorted; ``__place`` is the order."""
    sizes = [f.agg(F.max(index)).first()[0] for f in frames]
    if any(s is None for s in sizes):
        return frames[0].limit(0).withColumn("__place", F.lit(0).cast("long"))
    sizes = [int(s) + 1 for s in sizes]
    length = min(sizes) if until == "first_exhausted" else max(sizes)
    out = None
    for d, (f, n) in enumerate(zip(frames, sizes, strict=True)):
        turns = F.sequence(F.col(index).cast("long"), F.lit(length - 1).cast("long"), F.lit(n).cast("long"))
        rows = f.where(F.col(index) < length).withColumn("__turn", F.explode(turns)).withColumn("__place", F.col("__turn") * len(frames) + d).drop("__turn")
        out = rows if out is None else out.unionByName(rows)
    return out


def interleave_by_probability(frames: list[DataFrame], probabilities: list[float], draws: int | None = None, seed: int = 0, index: str = "__index", until: str = "first_exhausted") -> DataFrame:
    """Each place picks a dataset by its probability and takes that dataset's next row, wrapping around.

    It ends after ``draws`` places, or without them with the place that takes the last row of the first dataset to end,
    or of the last one (``all_exhausted``). A dataset without rows gives no places, as in ``interleave``."""
    spark = frames[0].sparkSession
    sizes = [f.count() for f in frames]
    if not all(sizes):
        return frames[0].limit(0).withColumn("__place", F.lit(0).cast("long"))
    weights = [(str(i), p) for i, p in enumerate(probabilities)]
    if draws is None:
        draws = draws_until(spark, weights, sizes, until, seed)
    picks = weighted_schedule(spark, weights, draws, seed)
    out = None
    for d, (f, n) in enumerate(zip(frames, sizes, strict=True)):
        wanted = picks.where(F.col("source") == str(d)).select(F.col("draw").alias("__place"), (F.col("position") % n).alias(index))
        rows = f.join(wanted, index)
        out = rows if out is None else out.unionByName(rows)
    return out


def draws_until(spark: SparkSession, weights: list[tuple[str, float]], sizes: list[int], until: str = "first_exhausted", seed: int = 0) -> int:
    """Draws after which the first source, or every one, has been drawn as often as its size.

    The schedule doesn't depend on its length, so a guess that is too short is doubled; a number a source is collected."""
    total = sum(w for _, w in weights)
    expected = [n * total / w for (_, w), n in zip(weights, sizes, strict=True) if w > 0]
    every = until == "all_exhausted"
    if not expected or every and len(expected) < len(weights):
        raise ValueError("a source of no weight is never exhausted")
    guess = int(1.1 * (max if every else min)(expected)) + 100
    last = F.create_map(*[F.lit(x) for (name, _), n in zip(weights, sizes, strict=True) for x in (name, n - 1)])
    while True:
        ends = [r["draw"] for r in weighted_schedule(spark, weights, guess, seed).where(F.col("position") == F.try_element_at(last, F.col("source"))).select("draw").collect()]
        if len(ends) == len(weights) or ends and not every:
            return (max if every else min)(ends) + 1
        guess *= 2


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return hash_number(*key, seed=seed).cast("double") / F.lit(float(1 << HASH_BITS))


#: Draws of a block of the schedule, as a power of two.
BLOCK_BITS = 16


def weighted_schedule(spark: SparkSession, weights: list[tuple[str, float]], draws: int, seed: int = 0) -> DataFrame:
    """(draw, source, position): sources with replacement by weight; position counts a source's draws.

    Ranks are taken inside blocks of draws and moved by the blocks' counts: no task holds all draws of a source."""
    total = sum(w for _, w in weights)
    u, case, acc = F.col("_u"), F.lit(weights[-1][0]), 0.0
    bounds = []
    for name, w in weights:
        acc += w / total
        bounds.append((name, acc))
    for name, upper in reversed(bounds[:-1]):
        case = F.when(u < upper, F.lit(name)).otherwise(case)
    picked = spark.range(draws).withColumnRenamed("id", "draw").withColumn("_u", uniform(F.col("draw"), seed=seed)).withColumn("source", case).drop("_u")
    picked = picked.withColumn("_block", F.shiftright("draw", BLOCK_BITS))
    counts = picked.groupBy("source", "_block").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("source", "_block", F.coalesce(earlier, F.lit(0)).alias("_before"))
    ranked = picked.withColumn("_at", F.row_number().over(W.partitionBy("source", "_block").orderBy("draw")) - 1)
    return ranked.join(before, ["source", "_block"]).select("draw", "source", (F.col("_before") + F.col("_at")).alias("position"))


def scheduled_examples(schedule: DataFrame, datasets: DataFrame, source: str = "env_name", key: str = "example_id", seed: int = 0) -> DataFrame:
    """Examples of the schedule: each source is reshuffled by hash at every epoch.

    datasets: (env_name, example_id). A draw whose cost doesn't fit is the caller's to leave out; its pick counts."""
    sized = datasets.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy(source)))
    wanted = schedule.join(F.broadcast(sized.groupBy(F.col(source).alias("source")).agg(F.first("_size").alias("_size"))), "source")  # a row a source
    wanted = wanted.withColumn("epoch", F.floor(F.col("position") / F.col("_size"))).withColumn("_at", F.col("position") % F.col("_size")).drop("_size")
    epochs = wanted.select("source", "epoch").distinct()
    shuffled = datasets.withColumnRenamed(source, "source").join(epochs, "source")
    order = W.partitionBy("source", "epoch").orderBy(hash_number(F.col("epoch"), F.col(key), seed=seed), key)
    ranked = shuffled.withColumn("_at", F.row_number().over(order).cast("long") - 1)
    return wanted.join(ranked, ["source", "epoch", "_at"]).drop("_at")


def epoch_order(df: DataFrame, epoch: int, seed: int = 0, key: str = "__index") -> DataFrame:
    """The epoch's order: ``__shuffle`` to sort by."""
    return df.withColumn("__shuffle", hash_number(F.lit(epoch), F.col(key), seed=seed))


def rank_share(df: DataFrame, rank: int, world: int, step: str = "step") -> DataFrame:
    """Steps of one data rank, counted from 1."""
    return df.where(F.pmod(F.col(step) - 1, F.lit(world)) == rank)


def epoch_of(step: Column, n_examples: int) -> Column:
    return F.floor((step - 1) / n_examples).cast("long")


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows; -1 for all."""
    return df if n < 0 else df.orderBy(order).limit(n)


def fake_samples(spark: SparkSession, n: int, vocab: int, seq_len: int, variable: bool = False, increasing: bool = True, seed: int = 0) -> DataFrame:
    """Samples of fixed or hashed lengths with increasing or hashed token ids."""
    length = (F.floor(uniform(F.col("sample"), F.lit("length"), seed=seed) * (seq_len - 1)) + 2).cast("int") if variable else F.lit(seq_len + 1)
    token = (lambda i: i % vocab) if increasing else (lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("sample"), i), F.lit(vocab)))
    rows = spark.range(n).withColumnRenamed("id", "sample").withColumn("ids", F.transform(F.sequence(F.lit(0), length - 1), lambda i: token(i.cast("long"))))
    return rows.select(
        "sample", F.slice("ids", F.lit(1), F.size("ids") - 1).alias("input_ids"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("target_ids"),
        F.sequence(F.lit(0), F.size("ids") - 2).alias("position_ids"), F.array_repeat(F.lit(True), F.size("ids") - 1).alias("loss_mask"),
    )


def fake_packed(spark: SparkSession, n: int, vocab: int, seq_len: int, seed: int = 0) -> DataFrame:
    """Rows of exactly ``seq_len`` tokens, made of documents of 1 to seq_len/8 tokens, the last one cut."""
    most = max(seq_len // 8, 1)
    lengths = F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("row"), i), F.lit(most)) + 1).cast("int"))
    places = F.slice(F.flatten(F.transform(lengths, lambda k: F.sequence(F.lit(0), k - 1))), 1, seq_len)
    return spark.range(n).withColumnRenamed("id", "row").withColumn("position_ids", places).withColumn(
        "input_ids", F.transform("position_ids", lambda p, i: F.pmod(F.xxhash64(F.lit(seed + 1), F.col("row"), i), F.lit(vocab)))
    )


def evaluation_fires(step: Column, interval: Column, first_step: int, skip_first: bool = False, resumed: bool = False) -> Column:
    """Whether an environment is evaluated at a step: on the interval, or at the first trigger of a fresh run."""
    first = (step == first_step) & F.lit(not resumed)
    return F.when(first, F.lit(not skip_first)).otherwise(step % interval == 0)


def round_robin(df: DataFrame, source: str, order: str) -> DataFrame:
    """``turn`` and ``source``: A1, B1, A2, ...; sources that have ended are skipped."""
    return scanned(df, [source], [order], at="turn").withColumn("turn", F.col("turn") + 1)


def resumed(df: DataFrame, step: int, index: str = "__index") -> DataFrame:
    """What a reader that has given ``step`` rows gives next in its epoch: rows from there on, with epoch and step."""
    n = df.agg(F.max(index)).first()[0]
    if n is None:
        return df.withColumn("epoch", F.lit(0).cast("long")).withColumn("step", F.lit(0).cast("long"))
    epoch, at = divmod(step, int(n) + 1)
    return df.where(F.col(index) >= at).withColumn("epoch", F.lit(epoch).cast("long")).withColumn("step", (F.col(index) + epoch * (int(n) + 1) + 1).cast("long"))

"""Group-relative advantages.

One hash exchange on the group key serves every variant: all means are window
aggregates over the same partitioning, so Catalyst plans one shuffle and one
sort-free window per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_advantage(
    df: DataFrame,
    group: str = "group_id",
    reward: str = "reward",
    length: str | None = None,
    length_penalty: float | None = None,
    gate_by_reward: bool = False,
    max_seq_len: int | None = None,
    length_weighted_baseline: bool = False,
    out: str = "advantage",
) -> DataFrame:
    """Reward minus the group's baseline.

    ``length_penalty`` subtracts ``coef * mean(reward) * len / max_seq_len``
    first (times the reward itself when ``gate_by_reward``); the mean in the
    penalty is of unpenalised rewards, the baseline of penalised ones. With
    ``length_weighted_baseline`` the baseline is ``sum(len*r)/sum(len)`` and is
    null when the total length is 0.
    """
    if length_penalty is not None and max_seq_len is None:
        raise ValueError("a length penalty needs max_seq_len")
    if (length_penalty is not None or length_weighted_baseline) and length is None:
        raise ValueError("length column is needed")
    w = W.partitionBy(group)
    r: Column = F.col(reward).cast("double")
    if length_penalty is not None:
        penalty = F.lit(float(length_penalty)) * F.avg(r).over(w) * F.col(length) / F.lit(float(max_seq_len))
        if gate_by_reward:
            penalty = penalty * r
        df = df.withColumn("_shaped", r - penalty)
    else:
        df = df.withColumn("_shaped", r)
    s = F.col("_shaped")
    if length_weighted_baseline:
        total = F.sum(F.col(length)).over(w)
        base = F.when(total != 0, F.sum(F.col(length) * s).over(w) / total)
    else:
        base = F.avg(s).over(w)
    return df.withColumn(out, s - base).drop("_shaped")


def reward_as_advantage(df: DataFrame, reward: str = "reward", out: str = "advantage") -> DataFrame:
    """Advantage when no advantage function is configured."""
    return df.withColumn(out, F.col(reward).cast("double"))


def custom_advantage(df: DataFrame, fn, group: str = "group_id", out: str = "advantage") -> DataFrame:
    """``fn(pandas.DataFrame) -> sequence`` per group, one value for each row in order.

    Groups lie one after another in their partition; a batch of many becomes one frame, and a group is held across
    batches until its last row has come."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    key = "_group_key"
    simple = isinstance(df.schema[group].dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType))
    keyed = df.withColumn(key, F.col(group) if simple else F.to_json(F.struct(group)))

    def valued(table):
        """Whole groups, one after another: a frame is made once and cut into its groups."""
        codes = table[key].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        table = table.drop_columns([key])
        frame, values = table.to_pandas(), []
        for start, end in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
            part = list(fn(frame.iloc[start:end].reset_index(drop=True)))
            if len(part) != end - start:
                raise ValueError("an advantage function returns one value for each row")
            values += [float(v) for v in part]
        # as from pandas: what isn't a number is null
        return table.append_column(out, pa.array(values, pa.float64(), from_pandas=True)).to_batches()

    def run(batches):
        held = []  # rows of the group that is open
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(key).dictionary_encode("encode").indices.to_numpy()
            last = int(np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[-1])
            same = not last and held and len(pa.concat_arrays([held[-1].column(key)[-1:], b.column(key)[:1]]).dictionary_encode("encode").dictionary) == 1
            if not same:
                # the open group ends before the batch's last one begins
                done = [*held, *([b.slice(0, last)] if last else [])]
                if done:
                    yield from valued(pa.Table.from_batches(done))
                held = []
            held.append(b.slice(last))
        if held:
            yield from valued(pa.Table.from_batches(held))

    return keyed.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)

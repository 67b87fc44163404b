"""Micro-batch packing, splitting, balancing and bucketing.

Only metadata (ids, lengths, modes) enters the packing functions, one group per
(run, step) or rank; token arrays are joined back by sample id and concatenated
by native expressions.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollsift.functions.arrays import concat_tokens, field, positions, spread, truncate
from rollsift.operators.scans import restarting
from rollsift.sources.scratch import written

Cost = Callable[[Sequence[int]], float]


def cost_of(linear: float = 1.0, quadratic: float = 0.0) -> Cost:
    """Work of a bin of sequences: linear * sum(n) + quadratic * sum(n*n)."""
    return lambda lengths: linear * sum(lengths) + quadratic * sum(n * n for n in lengths)


def attention_coefficients(hidden: int, heads: int, kv_heads: int, head_dim: int, intermediate: int, layers: int, vocab: int) -> tuple[float, float]:
    """(linear, quadratic) work a token: projections, feed-forward and head; attention scores and values."""
    projections = 2 * hidden * head_dim * (2 * heads + 2 * kv_heads)
    feed_forward = 6 * hidden * intermediate
    return float(layers * (projections + feed_forward) + 2 * hidden * vocab), float(layers * 2 * heads * head_dim)


def prepared(df: DataFrame, seq_len: int) -> DataFrame:
    """Samples as aligned arrays of at most ``seq_len`` tokens."""
    ids = concat_tokens("prompt_ids", "completion_ids")
    first_temperature = F.coalesce(F.try_element_at(F.col("completion_temperatures"), F.lit(1)), F.lit(1.0))
    cut = lambda c: truncate(c, seq_len)
    return df.select(
        *[c for c in df.columns if c not in ("prompt_ids", "prompt_mask", "completion_ids", "completion_mask", "completion_logprobs", "completion_temperatures", "teacher_logprobs", "advantage", "reward", "env_name")],
        cut(ids).alias("input_ids"), cut(concat_tokens("prompt_mask", "completion_mask")).alias("loss_mask"),
        cut(spread(F.coalesce(F.col("advantage"), F.lit(0.0)), ids)).alias("advantages"), cut(spread(F.col("reward"), ids)).alias("rewards"),
        cut(F.concat(F.array_repeat(F.lit(0.0), F.size("prompt_ids")), F.col("completion_logprobs"))).alias("inference_logprobs"),
        cut(F.concat(spread(first_temperature, "prompt_ids"), F.col("completion_temperatures"))).alias("temperatures"),
        cut(F.col("teacher_logprobs")).alias("teacher_logprobs"), cut(positions(ids)).alias("position_ids"), cut(spread(F.col("env_name"), ids)).alias("env_names"),
    )


class Rooms:
    """Free room of bins in a tree of maxima: the first bin with enough is found in as many steps as the tree is high."""

    def __init__(self) -> None:
        self.width, self.count, self.tree = 1, 0, [0, 0]

    def set(self, place: int, room: int) -> None:
        at = place + self.width
        self.tree[at] = room
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])

    def add(self, room: int) -> int:
        if self.count == self.width:
            rooms = self.tree[self.width :]
            self.width *= 2
            self.tree = [0] * (2 * self.width)
            self.tree[self.width : self.width + len(rooms)] = rooms
            for at in range(self.width - 1, 0, -1):
                self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        self.set(self.count, room)
        self.count += 1
        return self.count - 1

    def first(self, room: int) -> int | None:
        if not self.count or self.tree[1] < room:
            return None
        at = 1
        while at < self.width:
            at = 2 * at if self.tree[2 * at] >= room else 2 * at + 1
        return at - self.width


def first_fit_decreasing(items: list[tuple[int, Hashable, bool]], capacity: int) -> list[list[int]]:
    """Bins of item numbers. items: (length, class, alone); only equal classes share, and none that is alone.

    Longest first, ties by place; an item goes into the first bin, in order of creation, with room."""
    bins: list[list[int]] = []
    rooms: dict[Hashable, Rooms] = defaultdict(Rooms)
    bin_at: dict[Hashable, list[int]] = defaultdict(list)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, kind, alone = items[i]
        place = None if alone else rooms[kind].first(max(length, 1))
        if place is not None:
            left = rooms[kind].tree[place + rooms[kind].width] - length
            bins[bin_at[kind][place]].append(i)
            rooms[kind].set(place, left)
            continue
        if not alone:
            rooms[kind].add(capacity - length)
            bin_at[kind].append(len(bins))
        bins.append([i])
    return bins


def halves(items: list[int], weights: Sequence[float]) -> tuple[list[int], list[int]]:
    """Two sides of nearly equal weight: by falling weight, each item evens out the lead of the side before it."""
    sides: dict[bool, list[int]] = {True: [], False: []}
    lead = 0.0  # of the first side
    for i in sorted(items, key=lambda i: -weights[i]):
        to_first = lead <= 0
        sides[to_first].append(i)
        lead += weights[i] if to_first else -weights[i]
    return sides[True], sides[False]


def split_until(bins: list[list[int]], weights: Sequence[float], workers: int) -> list[list[int]]:
    """Bins for the workers to share evenly: as long as their number is no multiple of the workers, the heaviest bin
    of several items becomes two; of equally heavy ones the last. weights: an item's work, which adds up in a bin."""
    out = {n: list(b) for n, b in enumerate(bins)}
    heaviest = [(-sum(weights[i] for i in b), -n) for n, b in out.items() if len(b) > 1]
    heapq.heapify(heaviest)
    missing = -len(bins) % workers if bins else workers
    while missing and heaviest:
        n = -heapq.heappop(heaviest)[1]
        added = len(out)
        out[n], out[added] = halves(out[n], weights)
        missing -= 1
        for k in (n, added):
            if len(out[k]) > 1:
                heapq.heappush(heaviest, (-sum(weights[i] for i in out[k]), -k))
    return list(out.values())


def balanced(weights: Sequence[float], parts: int) -> list[list[int]]:
    """Equally many items for each part with nearly equal sums: largest differencing, then the best swaps."""
    if not weights or len(weights) % parts:
        raise ValueError("items must be a positive multiple of the parts")
    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    heap: list = []
    for n, at in enumerate(range(0, len(order), parts)):
        sets = sorted(((weights[i], [i]) for i in order[at : at + parts]), key=lambda s: -s[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], n, sets))
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the heaviest set of one meets the lightest of the other
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    groups = [sorted(s[1]) for s in heap[0][2]]
    return _swapped(weights, groups)


def _swapped(weights: Sequence[float], groups: list[list[int]]) -> list[list[int]]:
    """Swaps of two items while the largest load, then the spread of the loads, gets smaller; the best swap first.

    Only the heaviest group can lower the largest load and only the lightest one the spread beside it, so that
    swaps of other pairs aren't tried."""
    w = np.asarray(weights, float)
    members = [np.array(g) for g in groups]
    loads = np.array([w[g].sum() for g in members])
    while len(members) > 1:
        ends = {int(loads.argmax()), int(loads.argmin())}
        tries = []
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                if a in ends or b in ends:
                    tries.append(_best_swap(w, members, loads, a, b))
        top, spread_, a, b, i, j = min(tries)
        if (top, spread_) >= (loads.max(), loads.max() - loads.min()):
            break
        moved = w[members[b][j]] - w[members[a][i]]
        members[a][i], members[b][j] = members[b][j], members[a][i]
        loads[a] += moved
        loads[b] -= moved
    return [g.tolist() for g in members]


def _best_swap(w: np.ndarray, members: list[np.ndarray], loads: np.ndarray, a: int, b: int) -> tuple:
    """(largest load, spread, a, b, place in a, place in b) of the best swap between two groups."""
    others = np.delete(loads, [a, b])
    moved = w[members[b]][None, :] - w[members[a]][:, None]
    high, low = np.maximum(loads[a] + moved, loads[b] - moved), np.minimum(loads[a] + moved, loads[b] - moved)
    if len(others):
        high, low = np.maximum(high, others.max()), np.minimum(low, others.min())
    spread_ = high - low
    at = np.lexsort((spread_.ravel(), high.ravel()))[0]
    i, j = divmod(int(at), moved.shape[1])
    return float(high[i, j]), float(spread_[i, j]), a, b, i, j


ASSIGNED = "sample_id bigint, bin int, position int, worker int, turn int, is_dummy boolean"


def assign(df: DataFrame, seq_len: int, workers: int, keys: tuple[str, ...] = ("run_id", "step"), linear: float = 1.0, quadratic: float = 0.0) -> DataFrame:
    """Bins, workers and turns of the samples of each (run, step).

    df: keys, sample_id, arrival, length, mode, multimodal, and routed if some samples have routed experts: bins hold
    samples of one mode that all have them or all lack them. Multimodal bins come first at equal turns on all
    workers; each kind is filled up with copies of its first bin, marked as dummies, which carry no loss."""
    cost = cost_of(linear, quadratic)
    picked = df.select(*keys, "sample_id", "arrival", F.least("length", F.lit(seq_len)).alias("length"), "mode", "multimodal", (F.coalesce("routed", F.lit(False)) if "routed" in df.columns else F.lit(False)).alias("routed"))
    schema = T.StructType([*picked.schema.fields[: len(keys)], *T._parse_datatype_string(ASSIGNED).fields])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("arrival", kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        items = list(zip(lengths, zip(frame["mode"].tolist(), frame["routed"].tolist(), strict=True), frame["multimodal"].tolist(), strict=True))
        bins = first_fit_decreasing(items, seq_len)
        if workers > 1:
            bins = split_until(bins, [cost([n]) for n in lengths], workers)
        rows, base = [], 0
        for multimodal in (True, False):
            kind = [(b, False) for b in bins if items[b[0]][2] == multimodal]
            if not kind:
                continue
            kind += [(kind[0][0], True)] * (-len(kind) % workers)
            for w, group in enumerate(balanced([cost([lengths[i] for i in b]) for b, _ in kind], workers)):
                for turn, g in enumerate(group):
                    rows += [(int(frame["sample_id"][i]), base + g, p, w, turn + base // workers, kind[g][1]) for p, i in enumerate(kind[g][0])]
            base += len(kind)
        out = pd.DataFrame(rows, columns=schema.names[len(keys) :])
        for i, k in enumerate(keys):
            out.insert(i, k, frame[k].iloc[0])
        return out

    return picked.groupBy(*keys).applyInPandas(pack, schema)


def materialised(samples: DataFrame, assigned: DataFrame, keys: tuple[str, ...] = ("run_id", "step"), multiple: int = 1, adapters: int | None = None) -> DataFrame:
    """Packed bins with concatenated arrays, padded to a multiple; dummies have no loss and no advantage.

    ``adapters``: how many there are; samples then have ``adapter``, a number from 0, and bins ``adapter_tokens``, a count
    for each. Samples may have ``type_ids``; a sample without them has zeros."""
    token_columns = ["input_ids", "loss_mask", "advantages", "inference_logprobs", "position_ids", "temperatures", "env_names", "teacher_logprobs", "rewards"]
    rows = assigned.join(samples, [*keys, "sample_id"])
    n = F.size("input_ids")
    filled = {
        "loss_mask": F.when(F.col("is_dummy"), F.array_repeat(F.lit(False), n)).otherwise(F.col("loss_mask")),
        "advantages": F.when(F.col("is_dummy"), F.array_repeat(F.lit(0.0), n)).otherwise(F.col("advantages")),
        "teacher_logprobs": F.coalesce("teacher_logprobs", F.array_repeat(F.lit(0.0), n)),
        "rewards": F.transform("rewards", lambda r: F.coalesce(r, F.lit(float("nan")))),
    }
    if "type_ids" in samples.columns:
        token_columns.append("type_ids")
        filled["type_ids"] = F.coalesce("type_ids", F.array_repeat(F.lit(0).cast("long"), n))
    for name, value in filled.items():
        rows = rows.withColumn(name, value)
    ordered = F.array_sort(F.collect_list(F.struct("position", *token_columns, *(["adapter"] if adapters else []))))
    packed = rows.groupBy(*keys, "bin", "worker", "turn", "is_dummy").agg(ordered.alias("_rows"))
    packed = packed.select(
        *keys, "bin", "worker", "turn", "is_dummy", *[F.flatten(F.transform("_rows", field(c))).alias(c) for c in token_columns],
        F.transform("_rows", lambda r: F.size(r["input_ids"])).alias("sequence_lengths"), *([_adapter_tokens(adapters).alias("adapter_tokens")] if adapters else []),
    )
    return padded(packed, multiple)


def _adapter_tokens(adapters: int) -> Column:
    """Tokens of each adapter among a bin's ``_rows``."""
    own = lambda a: F.filter("_rows", lambda r: r["adapter"] == a)
    return F.transform(F.sequence(F.lit(0), F.lit(adapters - 1)), lambda a: F.aggregate(own(a), F.lit(0), lambda s, r: s + F.size(r["input_ids"])))


def padded(df: DataFrame, multiple: int) -> DataFrame:
    """Arrays filled up to a multiple; the padding is one more sequence, with positions of its own."""
    if multiple <= 1:
        return df
    n = F.pmod(-F.size("input_ids"), F.lit(multiple))
    fills = {"input_ids": F.lit(1).cast("long"), "loss_mask": F.lit(False), "advantages": F.lit(0.0), "inference_logprobs": F.lit(0.0), "temperatures": F.lit(1.0), "env_names": F.lit(""), "teacher_logprobs": F.lit(0.0), "rewards": F.lit(float("nan")), "type_ids": F.lit(0).cast("long")}
    df = df.withColumn("_pad", n)
    for name, fill in fills.items():
        if name in df.columns:
            df = df.withColumn(name, F.concat(F.col(name), F.array_repeat(fill, F.col("_pad"))))
    if "adapter_tokens" in df.columns:  # padding counts for the last one
        last = F.size("adapter_tokens") - 1
        df = df.withColumn("adapter_tokens", F.transform("adapter_tokens", lambda x, i: F.when(i == last, x + F.col("_pad")).otherwise(x)))
    places = F.when(F.col("_pad") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_pad") - 1, F.lit(0))), lambda i: i.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("position_ids", F.concat("position_ids", places))
    return df.withColumn("sequence_lengths", F.when(F.col("_pad") > 0, F.concat("sequence_lengths", F.array("_pad"))).otherwise(F.col("sequence_lengths"))).drop("_pad")


def _walk(df: DataFrame, keys: list[str], order: str, columns: list[str], schema: str, start: Callable[[], object], feed: Callable) -> DataFrame:
    """Reads each key's rows in order and yields what ``feed(state, row)`` returns; constant memory beside the state.

    Keys are hash-partitioned and sorted on disk, so a key of any size streams through one task."""
    picked = df.select(*keys, order, *columns).repartition(*keys).sortWithinPartitions(*keys, order)
    full = T.StructType([*[picked.schema[k] for k in keys], *T._parse_datatype_string(schema).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            out = []
            # a null key is a key: as NaN it would differ from itself
            names = frame[keys].astype(object).where(frame[keys].notna(), None).itertuples(index=False, name=None)
            rest = frame.iloc[:, len(keys) + 1 :].itertuples(index=False, name=None)
            for name, row in zip(names, rest, strict=True):
                if name != key:
                    key, state = name, start()
                out += [(*key, *x) for x in feed(state, row)]
            yield pd.DataFrame(out, columns=full.names)

    return picked.mapInPandas(run, full)


def cat_packs(df: DataFrame, seq_len: int, keys: list[str], order: str, sample: str = "sample_id", length: str = "length") -> DataFrame:
    """Samples appended until a pack is full; what runs over is cut off, an unfinished pack isn't given.

    Returns keys, pack, sample_id, start, taken."""
    rows = df.select(*keys, order, F.col(sample).cast("long").alias("sample_id"), F.col(length).alias("_length"))
    packs = restarting(rows, seq_len, keys, [order], "_length", "pack", "start")
    taken = F.least(F.col("_length").cast("long"), F.lit(seq_len) - F.col("start"))
    return packs.select(*keys, "pack", "sample_id", F.col("start").cast("int").alias("start"), taken.cast("int").alias("taken"))


def bucket_sizes(area: int) -> list[int]:
    """Halves of the area while 256 divides them, smallest first."""
    if area % 256:
        raise ValueError("the area must be a multiple of 256")
    out = []
    while area % 256 == 0:
        out.append(area)
        area //= 2
    return out[::-1]


def bucket_of(length: Column, area: int) -> Column:
    """The smallest bucket that holds a sample."""
    sizes = bucket_sizes(area)
    case = F.lit(sizes[-1])
    for s in reversed(sizes[:-1]):
        case = F.when(length <= s, F.lit(s)).otherwise(case)
    return case


class Ladder:
    """Buckets of rising sample size and equal area, each with what it holds and the step since which it waits."""

    def __init__(self, area: int, timeout: int):
        self.area, self.timeout, self.step = area, timeout, 0
        self.sizes = bucket_sizes(area)
        self.places = {s: area // s for s in self.sizes}
        self.held: dict[int, list[tuple]] = {s: [] for s in self.sizes}
        self.waits: dict[int, int] = {}

    #: What ``state`` gives: the step, what waits in the buckets and since when.
    STATE = "step long, held array<struct<bucket:int,sample_id:long,length:int>>, waits array<struct<bucket:int,step:long>>"

    def state(self) -> tuple:
        return self.step, [(s, item, n) for s in self.sizes for item, n in self.held[s]], sorted(self.waits.items())

    def resume(self, state: tuple) -> Ladder:
        self.step = state[0]
        for s, item, n in state[1]:
            self.held[s].append((item, n))
        self.waits = {s: step for s, step in state[2]}
        return self

    def put(self, item: int, n: int) -> list[tuple]:
        """Takes a sample in; gives a batch (step, bucket, position, item, length) when one is due."""
        n = min(n, self.area)
        size = min(s for s in self.sizes if s >= n)
        self.held[size].append((item, n))
        if len(self.held[size]) >= self.places[size]:
            return self._give(size)
        if self.step > self.waits.setdefault(size, self.step) + self.timeout:
            return self._give(self._raised(size))
        return []

    def _raised(self, size: int) -> int:
        """The bucket that an overdue one ends in: it joins the next as long as both leave room there; then it is filled up."""
        for above in self.sizes[self.sizes.index(size) + 1 :]:
            if len(self.held[above]) + len(self.held[size]) >= self.places[above]:
                break
            self.held[above] += self.held.pop(size)
            self.held[size] = []
            self.waits.pop(size, None)
            size = above
        self.held[size] += [(None, 1)] * (self.places[size] - len(self.held[size]))
        return size

    def _give(self, size: int) -> list[tuple]:
        batch = [(self.step, size, p, item, n) for p, (item, n) in enumerate(self.held[size])]
        self.held[size] = []
        self.waits.pop(size, None)
        self.step += 1
        return batch


def stacked(df: DataFrame, area: int, keys: list[str], order: str, timeout: int = 10, sample: str = "sample_id", length: str = "length") -> DataFrame:
    """Batches of samples of one bucket, given when the bucket's area is full or waits too long.

    A late bucket first moves up while the next one has room, then is filled with dummies (null sample ids). Batches
    follow from all samples before them, so a key is one sequence; shards of a stream are keys of their own."""
    return _walk(df, keys, order, [sample, length], "batch bigint, bucket int, position int, sample_id bigint, taken int", lambda: Ladder(area, timeout), lambda ladder, row: ladder.put(*row))


def ready_samples(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples (run, arrival, sample, tokens, step) that precede the first one beyond its run's current step.

    runs: (run, place, current_step), a row a run; ``place`` is kept."""
    so_far = W.partitionBy("run").orderBy("arrival", "sample").rowsBetween(W.unboundedPreceding, 0)
    beyond = F.max((F.col("step") > F.col("current_step")).cast("int")).over(so_far)
    return samples.join(runs, "run").withColumn("_beyond", beyond).where("_beyond = 0").drop("_beyond", "current_step")


def enough_tokens(samples: DataFrame, runs: DataFrame, budget: int) -> DataFrame:
    """One row: tokens that are ready, and whether they reach the budget."""
    return ready_samples(samples, runs).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("enough", F.col("tokens") >= budget)


def round_robin_selection(samples: DataFrame, runs: DataFrame, budget: int, position: int = 0) -> tuple[DataFrame, int]:
    """Samples (run, sample, tokens, used: tokens so far) taken under a token budget, and the next position.

    Runs take turns from ``position`` on, each giving all its ready samples in order; the first that would go over the
    budget ends it. Samples that alone are over the budget are dropped while nothing is taken. Token sums add up within
    runs and, over a row a run, between them, so that no task sees all samples; two rows reach the driver."""
    n = runs.count()
    if not n:
        return ready_samples(samples, runs).select("run", "sample", "tokens", F.col("tokens").alias("used")), position
    queue = F.struct(F.pmod(F.col("place") - position, F.lit(n)).alias("turn"), "arrival", "sample")
    ready = ready_samples(samples, runs).withColumn("at", queue).where(F.col("tokens").isNotNull())
    first = ready.where(F.col("tokens") <= budget).agg(F.min("at").alias("at")).first()["at"]
    if first is None:
        last = ready.agg(F.max("at").alias("at")).first()["at"]
        return ready.limit(0).select("run", "sample", "tokens", F.col("tokens").alias("used")), position if last is None else (position + last["turn"] + 1) % n
    start = F.struct(F.lit(first["turn"]).alias("turn"), F.lit(first["arrival"]).alias("arrival"), F.lit(first["sample"]).alias("sample"))
    counted = ready.where(F.col("at") >= start.cast(ready.schema["at"].dataType))
    by_run = counted.groupBy(F.col("at.turn").alias("turn")).agg(F.sum("tokens").alias("n"))
    before = by_run.select("turn", (F.sum("n").over(W.orderBy("turn")) - F.col("n")).alias("before"))  # a row a run
    inside = F.sum("tokens").over(W.partitionBy("run").orderBy("arrival", "sample").rowsBetween(W.unboundedPreceding, 0))
    summed = counted.withColumn("turn", F.col("at.turn")).withColumn("_inside", inside).join(before, "turn").withColumn("used", F.col("_inside") + F.col("before"))
    # the run that is open when the budget is reached or passed is the last one asked
    last = summed.where(F.col("used") - F.col("tokens") < budget).agg(F.max("turn")).first()[0]
    return summed.where(F.col("used") <= budget).select("run", "sample", "tokens", "used"), (position + last + 1) % n


def packed(samples: DataFrame, runs: DataFrame, budget: int, seq_len: int, workers: int, position: int = 0, together: bool = False, multiple: int = 1) -> tuple[DataFrame, int]:
    """A training step: samples are selected under the budget, packed, balanced over the workers and concatenated.

    samples: the columns of ``prepared`` and run, arrival, sample_id, step, mode, multimodal. Runs are packed each on its
    own (adapters of several runs) or together (one run's batch)."""
    tokens = (F.size("prompt_ids") + F.size("completion_ids")).alias("tokens")
    taken, after = round_robin_selection(samples.select("run", "arrival", F.col("sample_id").alias("sample"), tokens, "step"), runs, budget, position)
    key = F.lit("all") if together else F.col("run")
    chosen = samples.join(taken.select(F.col("sample").alias("sample_id")), "sample_id", "left_semi").withColumn("pack", key)
    lengths = chosen.select("pack", "sample_id", "arrival", (F.size("prompt_ids") + F.size("completion_ids")).alias("length"), "mode", "multimodal")
    plan = assign(lengths, seq_len, workers, ("pack",))
    return materialised(prepared(chosen, seq_len), plan, ("pack",), multiple), after


def next_step(buffer: DataFrame, runs: DataFrame, budget: int, position: int = 0, wait: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """One training step from what is buffered: (selected, buffer, runs, position), the last three as the next step finds
    them; None if fewer tokens than the budget are ready. Without ``wait``, as after a time out, such a step takes what is
    ready, and None means that nothing is.

    buffer: (run, arrival, sample, tokens, step), arrivals in order within a run; runs: (run, place, current_step). Selected
    samples leave, and so do those that are over the budget by themselves while nothing is taken. A run whose buffer is
    empty or goes on with a later step has its step counted up. All three are written tables: the steps of a long run
    have no lineage, and whoever resumes reads them."""
    # written once: the rest of the step sorts what is ready alone, not all that is buffered
    ready = written(ready_samples(buffer, runs), "ready")
    tokens = ready.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if tokens < budget and (wait or not tokens):
        return None
    taken, after = round_robin_selection(ready.drop("place"), runs, budget, position)
    taken = written(taken, "selected")
    # in the order of turns, everything up to the last row taken has left
    n = runs.count()
    at = F.struct(F.pmod(F.col("place") - position, F.lit(n)).alias("turn"), "arrival", "sample")
    ready = ready.withColumn("_at", at)
    first = ready.join(taken.select("sample"), "sample", "left_semi").agg(F.min("_at").alias("at")).first()["at"]
    gone = taken.select("run", "sample")
    if first is not None:
        start = F.struct(F.lit(first["turn"]).alias("turn"), F.lit(first["arrival"]).alias("arrival"), F.lit(first["sample"]).alias("sample")).cast(ready.schema["_at"].dataType)
        gone = gone.unionByName(ready.where(F.col("_at") < start).select("run", "sample"))
    else:
        gone = ready.select("run", "sample")
    rest = written(buffer.join(gone.hint("shuffle_hash"), ["run", "sample"], "left_anti").select(*buffer.columns), "buffer")
    heads = rest.groupBy("run").agg(F.min_by("step", F.struct("arrival", "sample")).alias("_head"))
    moved = runs.join(taken.select("run").distinct().withColumn("_took", F.lit(True)), "run", "left").join(heads, "run", "left")
    done = F.coalesce("_took", F.lit(False)) & (F.col("_head").isNull() | (F.col("_head") > F.col("current_step")))
    progress = moved.select("run", "place", (F.col("current_step") + done.cast("int")).cast(runs.schema["current_step"].dataType).alias("current_step"))
    return taken, rest, written(progress, "runs"), after


def run_progress(selected: DataFrame, pending: DataFrame, run: str = "run_id", tokens: str = "tokens") -> DataFrame:
    """Samples and tokens of each run, and whether its step is done: nothing of it is pending."""
    used = selected.groupBy(run).agg(F.count("*").alias("samples"), F.sum(tokens).alias("tokens"))
    left = pending.groupBy(run).agg(F.count("*").alias("_left"))
    return used.join(left, run, "left").select(run, "samples", "tokens", F.coalesce(F.col("_left") == 0, F.lit(True)).alias("step_done"))

"""Expressions over token-aligned arrays. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def field(name: str):
    """The lambda that takes a field of a struct."""
    return lambda x: x[name]


def concat_tokens(prompt, completion) -> Column:
    """Prompt tokens, then completion tokens."""
    return F.concat(_c(prompt), _c(completion))


def truncate(array, n: int) -> Column:
    return F.slice(_c(array), 1, n)


def spread(value, like) -> Column:
    """A scalar repeated to the length of an array."""
    return F.array_repeat(_c(value), F.size(_c(like)))


def positions(like) -> Column:
    """0, 1, ... for each element."""
    return F.transform(_c(like), lambda _, i: i.cast("long"))


def align_length(array, n, zero) -> Column:
    """Cut to ``n`` elements or filled up with ``zero``."""
    a, n = _c(array), n if isinstance(n, Column) else F.lit(n)
    return F.slice(F.concat(a, F.array_repeat(zero, F.greatest(n - F.size(a), F.lit(0)))), F.lit(1), n)


def pad_to_multiple(array, multiple: int, fill) -> Column:
    a = _c(array)
    return F.concat(a, F.array_repeat(fill, F.pmod(-F.size(a), F.lit(multiple))))


def shift_left(array, pad) -> Column:
    """Element i+1 at i; ``pad`` at the end."""
    a = _c(array)
    return F.when(F.size(a) > 0, F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.array(pad))).otherwise(a)


def shift_right(array, pad) -> Column:
    """Element i-1 at i; ``pad`` in front."""
    a = _c(array)
    return F.when(F.size(a) > 0, F.concat(F.array(pad), F.slice(a, F.lit(1), F.size(a) - 1))).otherwise(a)


def uniform_logprob_pad(vocab: int) -> Column:
    """Pad for log probabilities: log(1/V)."""
    return F.lit(-1.0) * F.log(F.lit(float(vocab)))


def uniform_entropy_pad(vocab: int) -> Column:
    return F.log(F.lit(float(vocab)))


def common_prefix_length(a, b) -> Column:
    """How many leading elements are equal."""
    pairs = F.zip_with(F.slice(_c(a), F.lit(1), F.least(F.size(_c(a)), F.size(_c(b)))), F.slice(_c(b), F.lit(1), F.least(F.size(_c(a)), F.size(_c(b)))), lambda x, y: x == y)
    first_off = F.array_position(pairs, F.lit(False))
    return F.when(first_off > 0, first_off - 1).otherwise(F.size(pairs)).cast("int")


def starts_with(array, prefix) -> Column:
    return F.slice(_c(array), F.lit(1), F.greatest(F.size(_c(prefix)), F.lit(0))) == _c(prefix)


def first_non_empty(*arrays) -> Column:
    return F.coalesce(*[F.when(F.size(_c(a)) > 0, _c(a)) for a in arrays])


def sequence_boundaries(position_ids) -> Column:
    """Starts of sequences (position 0; the first always at 0) and the total length."""
    p = _c(position_ids)
    zeros = F.filter(F.transform(p, lambda x, i: F.when(x == 0, i)), lambda i: i.isNotNull())
    return F.array_distinct(F.concat(F.array(F.lit(0)), zeros, F.array(F.size(p))))


def longest_sequence(position_ids) -> Column:
    b = sequence_boundaries(position_ids)
    return F.array_max(F.zip_with(F.slice(b, F.lit(2), F.size(b) - 1), F.slice(b, F.lit(1), F.size(b) - 1), lambda x, y: x - y))


def trim_trailing(array, is_padding, *aligned) -> Column:
    """Length up to the last element that isn't padding; ``is_padding(element, index)``."""
    kept = F.transform(_c(array), lambda x, i: F.when(~is_padding(x, i), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(kept), F.lit(0))


def append_if_missing(array, token) -> Column:
    a = _c(array)
    return F.when((F.size(a) > 0) & (F.element_at(a, -1) == token), a).otherwise(F.concat(a, F.array(token)))


def next_token_shift(ids, mask) -> Column:
    """input_ids, target_ids, loss_mask and position_ids of next-token prediction."""
    i, m = _c(ids), _c(mask)
    n = F.greatest(F.size(i) - 1, F.lit(0))
    return F.struct(
        F.slice(i, F.lit(1), n).alias("input_ids"), F.slice(i, F.lit(2), n).alias("target_ids"), F.slice(m, F.lit(2), n).alias("loss_mask"),
        positions(F.slice(i, F.lit(1), n)).alias("position_ids"),
    )


def total(array) -> Column:
    return F.aggregate(_c(array), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def count_true(mask) -> Column:
    return F.size(F.filter(_c(mask), lambda x: x))


def masked_mean(values, mask) -> Column:
    """Mean over the mask; 0 for an empty one."""
    kept = F.zip_with(_c(values), _c(mask), lambda v, m: F.when(m, v.cast("double")).otherwise(0.0))
    return total(kept) / F.greatest(count_true(mask), F.lit(1))


def bin_cost(lengths, linear: float = 1.0, quadratic: float = 0.0) -> Column:
    """linear * sum(n) + quadratic * sum(n*n)."""
    return F.aggregate(_c(lengths), F.lit(0.0), lambda acc, n: acc + n * F.lit(linear) + n * n * F.lit(quadratic))


def drop_non_finite(array) -> Column:
    return F.filter(_c(array), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def drop_non_finite_values(mapping) -> Column:
    return F.map_filter(_c(mapping), lambda _, x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def max_violation(array) -> Column:
    """(max - mean) / mean; 0 for an empty array or a zero mean."""
    mean = total(array) / F.size(_c(array))
    return F.when((F.size(_c(array)) > 0) & (mean != 0), (F.array_max(_c(array)) - mean) / mean).otherwise(0.0)


def pass_at_k(n, c, k) -> Column:
    """Unbiased estimate 1 - prod(1 - k/i for i in n-c+1..n); 1 where fewer than k fail."""
    n, c, k = _c(n), _c(c), _c(k)
    # sequence() counts down when its end is smaller, so c = 0 is a case of its own
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - k / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - product)


def powers_of_two(n) -> Column:
    """1, 2, 4, ... up to n."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda p: p <= _c(n))


def modality_types(ids, mapping) -> Column:
    """Token id to modality type, 0 where the map has none."""
    return F.transform(_c(ids), lambda x: F.coalesce(F.try_element_at(_c(mapping), x), F.lit(0)))


def decode_bytes(encoded) -> Column:
    """base64 text to an array of unsigned bytes."""
    raw = F.hex(F.unbase64(_c(encoded)))
    return F.transform(F.filter(F.split(raw, "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))

"""Token-level objectives as values: log ratios, masks and sums over aligned arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class LossSettings:
    """Defaults of the objectives."""

    mask_low: float = 0.2
    mask_high: float = 0.2
    advantage_tau: float = 1.0
    kl_tau: float = 1e-3
    ipo_threshold: float = 0.1


def log_ratio(trainer: Column, inference: Column) -> Column:
    return trainer - inference


def mismatch_kl(trainer: Column, inference: Column) -> Column:
    """r - log r - 1 for the importance ratio r."""
    lr = trainer - inference
    return F.exp(lr) - lr - 1


def probability_change(trainer: Column, inference: Column) -> Column:
    return F.exp(trainer) - F.exp(inference)


def dropped_by_change(trainer: Column, inference: Column, advantage: Column, low: float, high: float) -> Column:
    """The probability moved too far in the direction that the advantage asks for."""
    d = probability_change(trainer, inference)
    return F.when(advantage > 0, d > high).otherwise(d < -low)


def tokens(trainer="trainer_logprobs", inference="inference_logprobs", advantage="advantages", mask="loss_mask", teacher=None) -> Column:
    """Aligned arrays as an array of structs t, i, a, m (and q, the teacher's)."""
    parts = [_c(trainer).alias("t"), _c(inference).alias("i"), _c(advantage).alias("a"), _c(mask).alias("m")]
    if teacher is not None:
        parts.append(_c(teacher).alias("q"))
    return F.arrays_zip(*parts)


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + term(x))


def policy_loss(toks: Column, s: LossSettings = LossSettings()) -> Column:
    """Masked policy gradient with a squared log-ratio term over the loss mask."""

    def term(x: Column) -> Column:
        keep = x["m"] & ~dropped_by_change(x["t"], x["i"], x["a"], s.mask_low, s.mask_high)
        lr = log_ratio(x["t"], x["i"])
        gain = F.when(keep, F.lit(s.advantage_tau) * x["a"] * F.exp(lr)).otherwise(0.0)
        return F.when(x["m"], F.lit(s.kl_tau) * lr * lr).otherwise(0.0) - gain

    return _sum(toks, term)


def ipo_loss(toks: Column, s: LossSettings = LossSettings()) -> Column:
    """As the policy loss, masked where the probability moved by more than a threshold either way."""

    def term(x: Column) -> Column:
        keep = x["m"] & (F.abs(probability_change(x["t"], x["i"])) <= s.ipo_threshold)
        lr = log_ratio(x["t"], x["i"])
        gain = F.when(keep, F.lit(s.advantage_tau) * x["a"] * F.exp(lr)).otherwise(0.0)
        return F.when(x["m"], F.lit(s.kl_tau) * lr * lr).otherwise(0.0) - gain

    return _sum(toks, term)


def distillation_loss(toks: Column, s: LossSettings = LossSettings()) -> Column:
    """The advantage is the teacher's log ratio; masks follow the original advantage's sign."""

    def term(x: Column) -> Column:
        keep = x["m"] & ~dropped_by_change(x["t"], x["i"], x["a"], 0.2, 0.2)
        lr = log_ratio(x["t"], x["i"])
        gain = F.when(keep, (x["q"] - x["t"]) * F.exp(lr)).otherwise(0.0)
        return F.when(x["m"], F.lit(1e-3) * lr * lr).otherwise(0.0) - gain

    return _sum(toks, term)


def sft_loss(toks: Column) -> Column:
    """Negative log likelihood over the mask."""
    return _sum(toks, lambda x: F.when(x["m"], -x["t"]).otherwise(0.0))


def loss(toks: Column, mode, scale, s: LossSettings = LossSettings(), has_teacher: bool = False) -> Column:
    """By training mode (rl, opd, sft), divided by the scale; an unknown mode is an error."""
    m = _c(mode)
    value = F.when(m == "rl", policy_loss(toks, s)).when(m == "sft", sft_loss(toks))
    if has_teacher:
        value = value.when(m == "opd", distillation_loss(toks, s))
    value = value.otherwise(F.raise_error(F.concat(F.lit("unknown training mode "), F.coalesce(m, F.lit("null")))).cast("double"))
    return value / _c(scale)


def export_columns(toks: Column, mode, s: LossSettings = LossSettings()) -> Column:
    """Per-token ratio columns and masks; null for sft."""
    out = F.transform(
        toks,
        lambda x: F.struct(
            log_ratio(x["t"], x["i"]).alias("log_importance_ratio"),
            F.exp(log_ratio(x["t"], x["i"])).alias("importance_ratio"),
            mismatch_kl(x["t"], x["i"]).alias("mismatch_kl"),
            probability_change(x["t"], x["i"]).alias("prob_delta"),
            (x["m"] & dropped_by_change(x["t"], x["i"], x["a"], s.mask_low, s.mask_high)).alias("is_masked"),
            (x["m"] & (x["a"] > 0) & (probability_change(x["t"], x["i"]) > s.mask_high)).alias("is_masked_high"),
            (x["m"] & (x["a"] < 0) & (probability_change(x["t"], x["i"]) < -s.mask_low)).alias("is_masked_low"),
        ),
    )
    return F.when(_c(mode) != "sft", out)


def loss_scale(masks: Column) -> Column:
    """Aggregate: trainable tokens of all rows, 1 at least."""
    return F.greatest(F.sum(F.size(F.filter(masks, lambda x: x))), F.lit(1))

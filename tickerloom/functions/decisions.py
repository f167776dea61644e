"""Probabilities to decisions: direction, abstention, confidence, polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, clamp


def direction(prob: Column | str) -> Column:
    return F.when(as_col(prob) >= 0.5, "UP").otherwise("DOWN")


def direction_or_abstain(prob: Column | str, abstain: Column) -> Column:
    return F.when(abstain, "ABSTAIN").otherwise(direction(prob))


def fixed_abstain(variance: Column | str, confidence_threshold: float = 0.65) -> Column:
    return as_col(variance) > F.lit(1.0 - confidence_threshold)


def direction_strength(prob: Column | str) -> Column:
    return F.abs(as_col(prob) - 0.5) * 2.0


def stability(variance: Column | str) -> Column:
    return clamp(1.0 - as_col(variance), 0.0, 1.0)


def confidence(prob: Column | str, variance: Column | str) -> Column:
    return direction_strength(prob) * stability(variance)


def outcome(predicted: Column | str, actual: Column | str) -> Column:
    predicted = as_col(predicted)
    return (
        F.when(predicted == "ABSTAIN", "ABSTAIN")
        .when(predicted == as_col(actual), "CORRECT")
        .otherwise("WRONG")
    )


def polarity(pos: Column | str, neg: Column | str, margin: float = 0.15) -> Column:
    net = as_col(pos) - as_col(neg)
    return F.when(net >= margin, "Positive").when(net <= -margin, "Negative").otherwise("Mixed")


def reported_output(direction_col: Column | str, confidence_col: Column | str, floor: float = 0.20) -> Column:
    d = as_col(direction_col)
    return (
        F.when(d == "ABSTAIN", d)
        .when(as_col(confidence_col) < floor, F.concat(F.lit("LOW-CONFIDENCE "), d))
        .otherwise(d)
    )


def matches_expected(actual: Column | str, expected: Column | str) -> Column:
    """NULL when nothing was expected."""
    expected = as_col(expected)
    return F.when(expected != "", as_col(actual) == expected)


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(x)))


def temper(probs: list[Column], temperature: float) -> list[Column]:
    """Soften a probability vector: normalised exp(log(p + 1e-9) / T)."""
    raised = [F.exp(F.ln(as_col(p) + 1e-9) / F.lit(float(temperature))) for p in probs]
    total = sum(raised[1:], raised[0])
    return [r / total for r in raised]


def log_softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    scaled = [as_col(x) / F.lit(float(temperature)) for x in logits]
    top = F.greatest(*scaled)
    total = F.lit(0.0)
    for x in scaled:
        total = total + F.exp(x - top)
    return [x - top - F.ln(total) for x in scaled]


def distillation_loss(logits: list[Column], soft: list[Column], hard_index: Column | str,
                      temperature: float = 4.0, alpha: float = 0.7) -> Column:
    """Per-row alpha * KL(soft || student at T) + (1 - alpha) * cross entropy."""
    soft_log = log_softmax(logits, temperature)
    plain_log = log_softmax(logits)
    kl = F.lit(0.0)
    for s, q in zip(soft, soft_log):
        s = as_col(s)
        kl = kl + F.when(s > 0, s * (F.ln(s) - q)).otherwise(0.0)
    picked = F.element_at(F.array(*plain_log), as_col(hard_index).cast("int") + 1)
    return F.lit(alpha) * kl - F.lit(1.0 - alpha) * picked

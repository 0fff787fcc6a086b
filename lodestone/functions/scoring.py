"""Numeric formulas as Column expressions: decay, confidence, rewards, fitness, transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def idf(n: Column, df: Column) -> Column:
    """Always positive inverse document frequency: ``ln((n - df + 0.5) / (df + 0.5) + 1)``."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def harmonic(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return 2 * a * b / (a + b + eps)


def ensemble_alpha(z: Column) -> Column:
    return 1 / (1 + F.exp(F.abs(z)))


def reliability(z: Column) -> Column:
    return 1 / (1 + F.abs(z))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def inverse_yeo_johnson(y: Column, lam: float) -> Column:
    """The four branches of the inverse power transform."""
    up = F.exp(y) - 1 if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    down = 1 - F.exp(-y) if lam == 2 else 1 - F.pow(1 - (2 - lam) * y, F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational erfc approximation (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Chebyshev coefficients of the published erfc approximation.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def retention(age: Column, stability: Column) -> Column:
    return F.exp(-age / stability)


def time_decay(days: Column, rate: float = 0.05) -> Column:
    return F.exp(-rate * days)


def pattern_confidence(c: Column, months: Column, failures: Column) -> Column:
    return c * F.exp(-0.1 * months) - 1.5 * failures


def reinforced(c: Column, times: Column) -> Column:
    """``c += 0.1 (1 - c)``, so many times, in closed form."""
    return 1 - (1 - c) * F.pow(F.lit(0.9), times)


def weekly_decay(c: Column, weeks: Column) -> Column:
    return F.greatest(c - 0.05 * weeks, F.lit(0.0))


def code_reward(delta: Column, attempt: Column) -> Column:
    return F.greatest(delta - 0.01 * attempt, F.lit(0.0))


def band_reward(x: Column, low: Column, high: Column) -> Column:
    """Inside the band 1 plus a centring bonus up to 0.5; outside minus the squared relative distance."""
    width = high - low
    place = (x - low) / width
    return F.when(x < low, -F.pow((low - x) / width, F.lit(2.0))).when(x > high, -F.pow((x - high) / width, F.lit(2.0))).otherwise(1 + 0.5 * (1 - F.abs(2 * place - 1)))


def fitness(recall: Column, judge: Column, mrr: Column, cost: Column) -> Column:
    return 0.4 * recall + 0.3 * judge + 0.2 * mrr + 0.1 * cost


def floored_score(score: Column, words: Column) -> Column:
    """A zero for more than 30 words counts as 0.15."""
    return F.when((score == 0) & (words > 30), F.lit(0.15)).otherwise(score)


def length_bin(n: Column) -> Column:
    """``floor(log2(max(n, 1)))``, exact at powers of two."""
    return F.length(F.bin(F.greatest(n, F.lit(1)).cast("long"))) - 1


def prescription(score: Column) -> Column:
    return F.when(score >= 0.80, "MERGE").when(score >= 0.50, "migrate").when(score >= 0.30, "xref").otherwise("low")


def ari_reading(ari: Column) -> Column:
    return F.when(ari > 0.7, "strong").when(ari > 0.3, "moderate").otherwise("weak")


def evidence_confidence(age_months: Column, citations: Column) -> Column:
    return F.when((age_months < 3) | (F.coalesce(citations, F.lit(0)) == 0), F.lit(0.70)).otherwise(F.lit(0.85))

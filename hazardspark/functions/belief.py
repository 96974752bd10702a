"""Evidence, caution and cost as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardspark import config


def logit(p: Column) -> Column:
    """Null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def kernel(distance_m: Column, bandwidth: float = config.KERNEL_M, cutoff: float = config.KERNEL_CUTOFF_M) -> Column:
    return F.when(distance_m > cutoff, 0.0).when(distance_m >= 0, F.exp(-distance_m / bandwidth))


def decay(age_s: Column, tau: Column) -> Column:
    return F.when((age_s >= 0) & (tau > 0), F.exp(-age_s / tau))


def reliability_weight(alpha: Column, reference: float = config.REFERENCE_RELIABILITY) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), logit(alpha) / logit(F.lit(reference))))


def pessimistic_wald(p: Column, n_eff: Column, z: Column) -> Column:
    return F.least(F.lit(1.0), p + z * F.sqrt(p * (1 - p) / (n_eff + 1)))


def v_safe_kmh(depth_mm: Column, most_mm: float = 300.0) -> Column:
    h = F.least(depth_mm, F.lit(most_mm))
    return F.when(depth_mm >= 0, F.greatest(F.lit(0.0), 0.0009 * h * h - 0.5529 * h + 86.9448))


def slowdown(kmh: Column, depth_mm: Column) -> Column:
    """1 without a depth; null where the road cannot be driven at all."""
    v = v_safe_kmh(depth_mm)
    return F.when(depth_mm.isNull(), 1.0).when(v > 0, F.greatest(F.lit(1.0), kmh / v))


def edge_cost(seconds: Column, kmh: Column, p: Column, depth_mm: Column, severity: Column, lam: Column, h_max_mm: Column, epsilon: Column) -> Column:
    """Seconds with risk; null: the edge is removed (deeper than allowed with at least epsilon probability, or not drivable)."""
    breached = F.coalesce((depth_mm > h_max_mm) & (p >= epsilon), F.lit(False))
    return F.when(~breached, seconds * (1 + p * (slowdown(kmh, depth_mm) - 1)) + lam * p * severity * seconds)


def confidence_band(n_eff: Column, age_s: Column, tau: Column) -> Column:
    return F.when(age_s > 2 * tau, "stale").when(n_eff < 1, "low").when(n_eff < 3, "moderate").otherwise("high")

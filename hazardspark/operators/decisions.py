"""Advice on a route, adoption of an alert rule and the scores behind it, and learned signal timing against stopwatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much more weight a class gives to high and moderate risk.
SENSITIVITY = {"commuter": 1.0, "cyclist": 1.25, "pedestrian": 1.5, "emergency": 1.6}
#: Centres and width of the levels lower, moderate and high on the risk score, and belief without evidence.
CENTRES, WIDTH, NO_EVIDENCE = (0.08, 0.40, 0.80), 0.17, (0.15, 0.55, 0.30)
#: Utility of proceed, wait and avoid under lower, moderate and high risk; sharpness of the choice.
UTILITY, SHARPNESS = ((1.0, 0.15, -1.0), (0.35, 0.75, 0.30), (-0.5, 0.30, 1.0)), 4.0
#: Evidence score by confidence band, and the risk that a live accident or unmet limits lift a route to.
EVIDENCE, ACCIDENT_FLOOR = {"high": 1.0, "moderate": 0.65, "low": 0.30, "stale": 0.20}, 0.6
LEVELS, ACTIONS = ("lower", "moderate", "high"), ("proceed", "wait", "avoid")


def _lookup(values: dict[str, float], key: Column, otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(otherwise))


def _within(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def advise(facts: DataFrame) -> DataFrame:
    """facts with risk_<level>, action_<action>, evidence_score, evidence, reasons (two at most), chosen_p and compared.

    Columns used: worst_p and penalty_ratio (null: unknown, taken as the worst), accidents, limits_not_met, user_class, confidence,
    data_gaps, event_state, restricted, blocked, and candidates, an array of (seconds, risk) with the chosen route first.
    """
    c = F.col
    base = _lookup(EVIDENCE, c("confidence"), EVIDENCE["stale"]) - 0.1 * F.least(c("data_gaps"), F.lit(3))
    dry = c("event_state") == "dry"
    accident = c("accidents") > 0
    score = 0.7 * _within(F.coalesce("worst_p", F.lit(1.0)), 0.0, 1.0) + 0.3 * _within(F.coalesce(c("penalty_ratio") / 0.5, F.lit(1.0)), 0.0, 1.0)
    rows = facts.withColumns({
        "evidence_score": _within(F.when(dry, base * 0.7).otherwise(base), 0.05, 1.0),
        "__r": F.when(accident | c("limits_not_met"), F.greatest(score, F.lit(ACCIDENT_FLOOR))).otherwise(score),
        "__s": _lookup(SENSITIVITY, c("user_class"), 1.0),
    })
    near = [F.exp(-F.pow(c("__r") - x, 2) / (2 * WIDTH * WIDTH)) for x in CENTRES]
    rows = rows.withColumns({f"__n{i}": x for i, x in enumerate(near)})
    total = c("__n0") + c("__n1") + c("__n2")
    rows = rows.withColumns({f"risk_{k}": c("evidence_score") * c(f"__n{i}") / total + (1 - c("evidence_score")) * NO_EVIDENCE[i] for i, k in enumerate(LEVELS)})
    weights = (F.lit(1.0), F.sqrt("__s"), c("__s"))
    felt = [c(f"risk_{k}") * w for k, w in zip(LEVELS, weights, strict=True)]
    utility = lambda row: SHARPNESS * sum((u * x for u, x in zip(row, felt, strict=True)), F.lit(0.0)) / (felt[0] + felt[1] + felt[2])
    rows = rows.withColumns({f"__u{a}": utility(row) for a, row in zip(ACTIONS, UTILITY, strict=True)})
    best = F.greatest(*[f"__u{a}" for a in ACTIONS])
    shares = {a: F.exp(c(f"__u{a}") - best) for a in ACTIONS}
    rows = rows.withColumns({f"action_{a}": x / (shares["proceed"] + shares["wait"] + shares["avoid"]) for a, x in shares.items()})
    nothing = (c("worst_p") < 0.05) & (c("penalty_ratio") < 0.01) & ~accident & ~c("limits_not_met") & ~dry
    reasons = F.array(
        F.when(c("limits_not_met"), "limits_not_met"),
        F.when(accident, "accident_on_route"),
        F.when((c("restricted") > 0) & ~c("limits_not_met"), "restricted_avoided"),
        F.when(c("worst_p") >= 0.5, "high_risk_street").when(c("worst_p") >= 0.2, "some_risk_streets").when(nothing, "no_hazard_found"),
        F.when(c("blocked") > 0, "flooded_alternatives_avoided"),
        F.when(c("confidence") == "stale", "stale_data").when(c("confidence") == "low", "little_data"),
        F.when(dry, "no_event"),
    )
    # time lost in hours and a risk charge by sensitivity; a temperature of a quarter hour
    worth = F.transform("candidates", lambda x: (-x["seconds"] / 3600 - 2.0 * c("__s") * x["risk"]) / 0.25)
    rows = rows.withColumn("__w", worth)
    odds = F.transform("__w", lambda x: F.exp(x - F.array_max("__w")))
    many = F.coalesce(F.size("candidates"), F.lit(0)) >= 2
    out = rows.withColumns({
        "evidence": F.when(c("evidence_score") >= 0.7, "strong").when(c("evidence_score") >= 0.4, "some").otherwise("little"),
        "reasons": F.slice(F.filter(reasons, lambda x: x.isNotNull()), 1, 2),
        "chosen_p": F.when(many, F.get(odds, F.lit(0)) / F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)).otherwise(1.0),
        "compared": F.when(many, F.size("candidates")).otherwise(1),
    })
    return out.drop("__r", "__s", "__w", *[f"__n{i}" for i in range(3)], *[f"__u{a}" for a in ACTIONS])


def warning_scores(rows: DataFrame, episodes: DataFrame, rule: str = "rule", wet: str = "wet") -> DataFrame:
    """One row of scores of an alert rule. rows (t, period 'wet' or 'dry', rule and wet: boolean, null unknown; later_wet: whether it was
    wet 6 or 12 h later); episodes (warned: the rule 6 h before the first wet step)."""
    r, w, season = F.col(rule), F.col(wet), F.col("period") == "wet"
    on = season & r
    sums = rows.agg(
        F.count_if(season & r & w).alias("hits"), F.count_if(season & ~r & w).alias("misses"), F.count_if(season & r & ~w).alias("false_alarms"),
        F.count_if(~season & r.isNotNull()).alias("dry_known"), F.count_if(~season & r).alias("dry_on"),
        F.count_if(on & F.col("later_wet").isNotNull()).alias("judged"), F.count_if(on & ~F.col("later_wet")).alias("unconfirmed"),
    )
    ahead = episodes.agg(F.count("*").alias("episodes"), F.count_if("warned").alias("warned"))
    part = lambda a, b: F.try_divide(F.col(a), b)
    return sums.crossJoin(F.broadcast(ahead)).select(  # one row each
        part("hits", F.col("hits") + F.col("misses")).alias("pod"), part("false_alarms", F.col("hits") + F.col("false_alarms")).alias("far"), "episodes",
        part("warned", F.col("episodes")).alias("share_warned"), part("dry_on", F.col("dry_known")).alias("dry_share"), part("unconfirmed", F.col("judged")).alias("unconfirmed_share"),
    )


def adoption(scores: DataFrame, least_episodes: int = 10) -> DataFrame:
    """scores with the three criteria (POD and FAR; half of the episodes warned, null where there are too few to test; at most 5 % of dry
    steps switched on), whether all are met, and what follows."""
    c = F.col
    detects = F.coalesce((c("pod") >= 0.5) & (c("far") <= 0.5), F.lit(False))
    ahead = F.when(c("episodes") >= least_episodes, F.coalesce(c("share_warned") >= 0.5, F.lit(False)))
    quiet = F.coalesce(c("dry_share") <= 0.05, F.lit(False))
    out = scores.withColumns({"detects": detects, "warns_ahead": ahead, "quiet_when_dry": quiet})
    met = c("detects") & F.coalesce("warns_ahead", F.lit(False)) & c("quiet_when_dry")
    return out.withColumns({"all_met": met, "advice": F.when(met, "on by default").otherwise("off by default")})


def evaluate_timing(learned: DataFrame, stopwatch: DataFrame, fixed_sd_s: float = 5.0) -> DataFrame:
    """A row for each site with stopwatch cycles. learned (site, approach, bin, cycle_s or null, passes), stopwatch (site, bin or null,
    cycle_s): median and deviation of the stopwatch cycles, whether the cycle is fixed, and the error of the learned cycle of the
    approach and bin with the most passes among the bins that the stopwatch covers (all, if it names none). Ties: first by name."""
    watch = stopwatch.filter("cycle_s IS NOT NULL").groupBy("site").agg(F.count("*").alias("cycles"), F.percentile("cycle_s", 0.5).alias("median_s"), F.stddev("cycle_s").alias("sd_s"))
    covered = stopwatch.groupBy("site").agg(F.collect_set("bin").alias("bins"))  # at most the bins of a day
    fits = learned.join(covered, "site").filter((F.size("bins") == 0) | F.array_contains("bins", F.col("bin")))
    best = fits.groupBy("site").agg(F.min_by(F.struct("approach", "bin", F.col("cycle_s").alias("learned_s"), "passes"), F.struct(-F.col("passes"), "approach", "bin")).alias("b"))
    rows = watch.join(best, "site", "left").select("site", "cycles", "median_s", "sd_s", F.coalesce(F.col("sd_s") <= fixed_sd_s, F.lit(False)).alias("fixed"), "b.*")
    return rows.withColumn("error_s", F.abs(F.col("learned_s") - F.col("median_s")))


def timing_verdict(sites: DataFrame, most_error_s: float) -> DataFrame:
    """One row: the median error over sites with a fixed cycle (a site without a learned cycle fails, an endless error) and whether it is
    too large."""
    error = F.when(F.col("fixed"), F.coalesce(F.col("error_s"), F.lit(float("inf"))))
    n = sites.agg(F.count(error).alias("fixed_sites"), F.percentile(error, 0.5).alias("median_error"), F.count_if(F.col("learned_s").isNull() & ~F.col("fixed")).alias("none_and_not_fixed"), F.count_if(F.col("learned_s").isNull() & F.col("fixed")).alias("none_but_fixed"))
    finite = F.col("median_error") < float("inf")
    failed = F.coalesce(F.col("median_error") > most_error_s, F.lit(True))
    return n.select("fixed_sites", F.when(finite, F.col("median_error")).alias("median_error_s"), failed.alias("failed"), "none_and_not_fixed", "none_but_fixed")


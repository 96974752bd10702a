"""Scores of forecasts: calibration, discrimination, conformal flags and resampling.

Ranks over all rows come from buckets: scores are cut at quantiles, rows are ranked inside a bucket, and a small table of bucket totals
gives each bucket's start. So no window orders all rows in one task, even if all scores differ or one score holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brier_murphy(df: DataFrame, p: str = "score", y: str = "y", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    by = by or []
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    cells = df.groupBy(*by, b).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("se"))
    every = Window.partitionBy(*by)
    cells = cells.withColumns({"all_n": F.sum("n").over(every), "all_y": F.sum("sy").over(every)})
    base = F.col("all_y") / F.col("all_n")
    return cells.groupBy(*by).agg(
        (F.sum("se") / F.first("all_n")).alias("brier"),
        (F.sum(F.col("n") * F.pow((F.col("sp") - F.col("sy")) / F.col("n"), 2)) / F.first("all_n")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("sy") / F.col("n") - base, 2)) / F.first("all_n")).alias("resolution"),
        F.first(base * (1 - base)).alias("uncertainty"),
    )


def reliability_table(df: DataFrame, p: str = "score", y: str = "y", bins: int = 10, w: str | None = None) -> DataFrame:
    weight = F.col(w) if w else F.lit(1.0)
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), (F.sum(weight * F.col(p)) / F.sum(weight)).alias("mean_p"), (F.sum(weight * F.col(y)) / F.sum(weight)).alias("rate"))


def _cuts(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    return [sorted(set(q)) for q in df.approxQuantile(columns, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))]


def _below(value: Column, cuts: list[float]) -> Column:
    """How many cuts are less than the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def _with_starts(df: DataFrame, keys: list[str], by: list[str], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """df with, for each of `sums`, its total over the buckets (keys) before the row's own: `before_<name>`."""
    totals = df.groupBy(*by, *keys).agg(*[s.alias(f"before_{n}") for n, s in sums.items()])  # few rows by group
    w = Window.partitionBy(*by).orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys])
    starts = totals.select(*[F.col(k).alias(f"__k_{k}") for k in (*by, *keys)], *[(F.sum(f"before_{n}").over(w) - F.col(f"before_{n}")).alias(f"before_{n}") for n in sums])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*by, *keys)]
    return df.join(starts, same).drop(*[f"__k_{k}" for k in (*by, *keys)])


def running(at: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = False, buckets: int = 64) -> DataFrame:
    """at (one row per value and group) with `c_<sum>`: the sum up to and including the row in the order of value."""
    by = by or []
    (cuts,) = _cuts(at, [value], buckets)
    rows = _with_starts(at.withColumn("__b", F.coalesce(_below(F.col(value), cuts), F.lit(-1))), ["__b"], by, {s: F.sum(s) for s in sums}, descending)
    inside = Window.partitionBy(*by, "__b").orderBy(F.desc(value) if descending else F.asc(value))
    return rows.withColumns({f"c_{s}": F.sum(s).over(inside) + F.col(f"before_{s}") for s in sums}).drop("__b", *[f"before_{s}" for s in sums])


def ranked(df: DataFrame, score: str, ties: str, by: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """df with `rank` from 1 by score and then ties; rows without a score are left out.

    A score that holds more than a share of 1/buckets of the rows is a cut itself and a bucket of its own, which is cut again by ties
    (where these are numbers), so buckets stay small whatever the scores.
    """
    by = by or []
    rows = df.filter(F.col(score).isNotNull())
    number = dict(df.dtypes)[ties].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    cuts, *tie_cuts = _cuts(rows, [score, ties] if number else [score], buckets)
    alone = F.array_contains(F.array(*map(F.lit, cuts)), F.col(score).cast("double")) if cuts else F.lit(False)
    fine = F.when(alone, _below(F.col(ties), tie_cuts[0])).otherwise(0) if number else F.lit(0)
    rows = rows.withColumns({"__b": 2 * _below(F.col(score), cuts) + alone.cast("int"), "__f": F.coalesce(fine, F.lit(-1))})
    rows = _with_starts(rows, ["__b", "__f"], by, {"rank": F.count("*")})
    inside = F.row_number().over(Window.partitionBy(*by, "__b", "__f").orderBy(score, ties))
    return rows.withColumn("rank", F.col("before_rank") + inside).drop("__b", "__f", "before_rank")


def adaptive_ece(df: DataFrame, n: int, p: str = "score", y: str = "y", ties: str = "id", bins: int = 10) -> DataFrame:
    size = max(1, n // bins)
    cells = ranked(df, p, ties).groupBy(F.floor((F.col("rank") - 1) / size).alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return cells.agg(F.sum(F.col("n") / n * F.abs(F.col("mp") - F.col("my"))).alias("ece"))


def grouped_ece(df: DataFrame, by: list[str], p: str = "score", y: str = "y", ties: str = "id", bins: int = 10) -> DataFrame:
    """(by, ece): the same in each group, whose bins are by its own size."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    b = F.floor((F.col("rank") - 1) / F.greatest(F.lit(1), F.floor(F.col("__n") / bins)))
    cells = ranked(df, p, ties, by).join(sizes, by).groupBy(*by, "__n", b.alias("__c")).agg(F.count("*").alias("m"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return cells.groupBy(*by).agg(F.sum(F.col("m") / F.col("__n") * F.abs(F.col("mp") - F.col("my"))).alias("ece"))


def event_recall(alerts: DataFrame, happened: DataFrame, place: str, before: int = 1) -> DataFrame:
    """One row: events (place, first_day, last_day; event_id), and how many of them have an alert (place, day) from `before` days ahead to
    their end. Alerts are met by place and month, so a place's alerts are not all held against all its events."""
    month = lambda d: F.year(d) * 12 + F.month(d)
    start = F.date_sub("first_day", before)
    e = happened.select("event_id", place, start.alias("__a"), F.col("last_day").alias("__b")).withColumn("__m", F.explode(F.sequence(month("__a"), month("__b"))))
    hit = e.join(alerts.select(place, "day").distinct().withColumn("__m", month("day")), [place, "__m"]).filter(F.col("day").between(F.col("__a"), F.col("__b"))).select("event_id").distinct()
    return happened.agg(F.count("*").alias("events")).crossJoin(hit.agg(F.count("*").alias("found")))  # one row each


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def auroc(df: DataFrame, p: str = "score", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """By midranks; null if a class is missing."""
    by = by or []
    at = df.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    mid = F.col("c_n") - F.col("n") + (F.col("n") + 1) / 2
    sums = running(at, p, ["n"], by).withColumn("mid", mid).groupBy(*by).agg(F.sum(F.col("pos") * F.col("mid")).alias("r"), F.sum("pos").alias("np"), (F.sum("n") - F.sum("pos")).alias("nn"))
    value = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return sums.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), value).alias("auroc"))


def weighted_ap_auc(df: DataFrame, score: str = "score", y: str = "y", w: str = "w", by: list[str] | None = None) -> DataFrame:
    """Average precision and AUC with row weights; rows of one score count together, positives before their own negatives' half."""
    by = by or []
    return _ap_auc(df.groupBy(*by, score).agg(F.sum(F.col(w) * F.col(y)).alias("tp"), F.sum(F.col(w) * (1 - F.col(y))).alias("fp")), score, by)


def _ap_auc(at: DataFrame, score: str, by: list[str]) -> DataFrame:
    """The same from the weights of the positives (tp) and the others (fp) at each score."""
    pos, neg = F.sum("tp"), F.sum("fp")
    behind = F.sum(F.col("tp") * (F.col("fp") / 2 - F.col("c_fp")))  # the negatives behind a score are neg - c_fp
    return running(at, score, ["tp", "fp"], by, descending=True).groupBy(*by).agg(
        F.when(pos > 0, F.sum(F.col("tp") * F.col("c_tp") / (F.col("c_tp") + F.col("c_fp"))) / pos).alias("ap"),
        F.when((pos > 0) & (neg > 0), (behind + pos * neg) / (pos * neg)).alias("auc"),
    )


def conformal_thresholds(df: DataFrame, alpha: float, score: str = "score", y: str = "y", group: str = "grp", ties: str = "id") -> DataFrame:
    """(group, tau, n): the floor(alpha (n + 1))-th smallest score of the group's positives; null (flag all) where that is none."""
    pos = df.filter(F.col(y) == 1)
    n = pos.groupBy(group).agg(F.count("*").alias("n")).withColumn("k", F.floor(F.lit(alpha) * (F.col("n") + 1)))
    at = ranked(pos, score, ties, [group]).join(n, group).filter(F.col("rank") == F.col("k")).select(group, F.col(score).alias("tau"))
    return n.join(at, group, "left").select(group, "tau", "n")


def conformal_rates(df: DataFrame, thresholds: DataFrame, score: str = "score", y: str = "y", group: str = "grp") -> DataFrame:
    flags = df.join(thresholds.select(group, "tau"), group, "left").withColumn("flag", F.col("tau").isNull() | (F.col(score) >= F.col("tau")))
    share = lambda k: F.avg(F.when(F.col(y) == k, F.col("flag").cast("double")))
    return flags.groupBy(group).agg(share(1).alias("coverage"), share(0).alias("false_flag"), F.count("*").alias("n"))


def bootstrap_weights(blocks: DataFrame, replicates: int, seed: int = 1, block: str = "b") -> DataFrame:
    """(rep, block, times): how often replicate rep draws a block (numbered from 0 to n-1, few rows) in n independent draws with replacement.
    Draw k takes the block numbered by the first 15 hex digits of MD5("seed:rep:k"), mod n, so another engine draws the same. Blocks
    that a replicate does not draw have no row."""
    n = blocks.agg(F.count("*").alias("n"))
    draws = blocks.select(F.col(block).alias("k")).crossJoin(F.broadcast(n)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    key = F.md5(F.concat_ws(":", F.lit(seed), "rep", F.col("k").cast("long")))
    drawn = F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % F.col("n")
    return draws.select("rep", drawn.alias(block)).groupBy("rep", block).agg(F.count("*").alias("times"))


def block_bootstrap(blocks: DataFrame, replicates: int, num: str = "num", den: str = "den", block: str = "b", seed: int = 1) -> DataFrame:
    """blocks (b from 0 to n-1, num, den): sums of each block, few rows. (rep, value = sum of num over sum of den of the blocks drawn)."""
    drawn = bootstrap_weights(blocks, replicates, seed, block).join(blocks, block)
    return drawn.groupBy("rep").agg((F.sum(F.col("times") * F.col(num)) / F.sum(F.col("times") * F.col(den))).alias("value"))


def joint_block_bootstrap(rows: DataFrame, blocks: DataFrame, scores: list[str], replicates: int, y: str = "y", block: str = "b", top: float = 0.1, seed: int = 1) -> DataFrame:
    """(rep, scorer, ap, auc, capture) of each score over the blocks drawn, all scores with the same draws; rep null: over all rows.

    capture: share of the positives at or above the score that cuts off the top share of all rows (linear percentile, the same for all
    replicates). rows: block, y, a column for each score. Rows are combined by score and block before replicates are dealt to them.
    """
    cells = rows.unpivot([block, y], scores, "scorer", "value").filter("value IS NOT NULL").groupBy("scorer", "value", block).agg(F.sum(y).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    cut = rows.agg(*[F.percentile(s, 1 - top).alias(s) for s in scores]).unpivot([], scores, "scorer", "cut")  # a row for each score
    cells = cells.join(F.broadcast(cut), "scorer")
    every = cells.withColumns({"rep": F.lit(None).cast("int"), "times": F.lit(1).cast("long")})
    drawn = cells.join(bootstrap_weights(blocks, replicates, seed, block), block).select(every.columns).unionByName(every)
    by = ["rep", "scorer"]
    at = drawn.groupBy(*by, "value", "cut").agg(F.sum(F.col("times") * F.col("pos")).alias("tp"), F.sum(F.col("times") * (F.col("n") - F.col("pos"))).alias("fp"))
    hit = F.sum(F.when(F.col("value") >= F.col("cut"), F.col("tp")).otherwise(0.0))
    capture = at.groupBy(*by).agg(F.try_divide(hit, F.sum("tp")).alias("capture"))
    measured = _ap_auc(at.drop("cut"), "value", by)
    same = measured["rep"].eqNullSafe(capture["rep"]) & (measured["scorer"] == capture["scorer"])
    return measured.join(capture, same).select(measured["rep"], measured["scorer"], "ap", "auc", "capture")


def leave_one_group_out(df: DataFrame, group: str = "grp", place: str = "block", y: str = "y") -> DataFrame:
    """For each row's group and place, the rate elsewhere: over all other groups, and of the place in other groups (null where it has
    none). Totals less the group's own totals; no row is read again for each group."""
    by = df.groupBy(group, place).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("n"))
    over = lambda *k: Window.partitionBy(*k)
    all_s, all_n, g_s, g_n = F.sum("s").over(over()), F.sum("n").over(over()), F.sum("s").over(over(group)), F.sum("n").over(over(group))
    p_s, p_n = F.sum("s").over(over(place)) - F.col("s"), F.sum("n").over(over(place)) - F.col("n")
    return by.select(group, place, F.try_divide(all_s - g_s, all_n - g_n).alias("base"), F.when(p_n > 0, p_s / p_n).alias("history"), "n")


def scorecard(df: DataFrame, m: str, b: str, low: str | None = None, prevalence: str | None = None) -> DataFrame:
    """df with skill over the baseline b and a verdict; with the lower bound of the difference (low), no skill is seen where it is not
    above 0; with the prevalence, the lift of the score over it."""
    skill = (F.col(m) - F.col(b)) / (1 - F.col(b))
    verdict = F.when(F.coalesce(F.col(low) <= 0, F.lit(False)), "no evidence of skill (interval holds 0)").when(skill < 0, "no evidence of skill (negative)") if low else F.when(skill < 0, "no evidence of skill (negative)")
    out = df.withColumns({"skill": skill, "verdict": verdict.when(skill >= 0.30, "useful").when(skill >= 0.10, "modest").otherwise("marginal")})
    return out.withColumn("lift", F.try_divide(F.col(m), F.col(prevalence))) if prevalence else out


def allocate_by_rank(df: DataFrame, value: str, score: str, ties: str = "id") -> DataFrame:
    """The same values given out again in the order of the scores, nulls last."""
    filled = df.withColumn("__s", F.coalesce(score, F.lit(float("inf"))))
    a = ranked(filled, "__s", ties).select(ties, "rank")
    b = ranked(df.withColumn("__k", F.col(ties)), value, "__k").select("rank", F.col(value).alias("allocated"))
    return a.join(b, "rank").select(ties, "allocated")


def stratified_sample(df: DataFrame, by: list[str], quota: int, key: Column) -> DataFrame:
    """Up to quota rows of each stratum, lowest key first, with weight stratum size / rows taken."""
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    top = df.withColumn("__k", key).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__k"))).filter(F.col("__r") <= quota)
    return top.join(n, by).withColumn("weight", F.col("__n") / F.least(F.col("__n"), F.lit(quota))).drop("__k", "__r", "__n")


def top_alerts(df: DataFrame, n: int, share: float = 0.02, score: str = "score", ties: str = "id") -> DataFrame:
    """Rows at or above the score of rank floor(n (1 - share)) (from 0, ascending)."""
    at = ranked(df, score, ties).filter(F.col("rank") == int(n * (1 - share)) + 1).select(F.col(score).alias("__thr"))
    return df.crossJoin(F.broadcast(at)).filter(F.col(score) >= F.col("__thr")).drop("__thr")

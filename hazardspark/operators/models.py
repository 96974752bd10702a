"""Models fitted by groups, folds and areas, scored where they have not learned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark.operators.scoring import bootstrap_weights, ranked, weighted_ap_auc

Written = Callable[[DataFrame, str], DataFrame]


def _vectors(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    out = rows.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(out)


def fitted_gbt(train: DataFrame, features: list[str], label: str, weight: str, depth: int = 3, rounds: int = 10, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `p`, the probability of a boosted-tree model of the training rows."""
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, weightCol=weight).fit(_vectors(train, features, label))
    return lambda rows: model.transform(_vectors(rows, features, label)).withColumn("p", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")


def train_gbt_grid(rows: DataFrame, features: list[str], grid: list[tuple[int, int]], written: Written, label: str = "y", weight: str = "w", part: str = "part", ties: str = "id", share: float = 0.02) -> DataFrame:
    """One row: depth and rounds of the model of the grid (depth, rounds) that is best by average precision on part 'val' (ties: the
    first), and on part 'test' its average precision, AUC and recall of the positives among the top share of alerts. It learns from
    part 'train' only; parts are areas or times, so no place is on both sides."""
    side = lambda k: rows.filter(F.col(part) == k)
    best = None
    for depth, rounds in grid:
        score = fitted_gbt(side("train"), features, label, weight, depth, rounds)
        ap = weighted_ap_auc(score(side("val")), "p", label, weight).first()["ap"] or 0.0
        if best is None or ap > best[0]:
            best = (ap, depth, rounds, score)
    ap, depth, rounds, score = best
    test = written(score(side("test")), "grid-test")
    n = test.count()
    top = ranked(test, "p", ties).filter(F.col("rank") > int(n * (1 - share)))
    recall = top.agg(F.sum(label).alias("hit")).crossJoin(test.agg(F.sum(label).alias("all"))).select(F.try_divide("hit", "all").alias("alert_recall"))
    chosen = rows.sparkSession.createDataFrame([(depth, rounds, ap)], "depth int, rounds int, val_ap double")
    return chosen.crossJoin(weighted_ap_auc(test, "p", label, weight)).crossJoin(recall)  # one row each


def isotonic_out_of_fold(rows: DataFrame, folds: int, score: str = "score", label: str = "y", fold: str = "fold") -> DataFrame:
    """rows with `calibrated`: each fold's scores by an isotonic fit of the other folds. A fold is 0 to folds - 1."""
    data = rows.withColumns({"label": F.col(label).cast("double"), "features": F.col(score)})
    out = None
    for k in range(folds):
        model = IsotonicRegression().fit(data.filter(F.col(fold) != k).select("label", "features"))
        part = model.transform(data.filter(F.col(fold) == k)).withColumnRenamed("prediction", "calibrated").drop("label", "features")
        out = part if out is None else out.unionByName(part)
    return out


def logistic_out_of_group(rows: DataFrame, groups: list, features: list[str], label: str = "y", group: str = "grp") -> DataFrame:
    """rows with `p`: each group's probabilities by a logistic model of the other groups (few, listed); the rate elsewhere where the
    others hold one class only."""
    out = None
    for g in groups:
        rest, own = rows.filter(~F.col(group).eqNullSafe(F.lit(g))), rows.filter(F.col(group).eqNullSafe(F.lit(g)))
        base = rest.agg(F.avg(F.col(label).cast("double"))).first()[0]
        if base in (None, 0.0, 1.0):
            part = own.withColumn("p", F.lit(base).cast("double"))
        else:
            model = LogisticRegression(maxIter=50, regParam=0.01).fit(_vectors(rest, features, label))
            part = model.transform(_vectors(own, features, label)).withColumn("p", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def best_single_feature(rows: DataFrame, features: list[str], label: str, weight: str) -> tuple[str, float]:
    """The feature with the highest average precision, lower values first (ties: the first named)."""
    found = [(weighted_ap_auc(rows.withColumn("__s", -F.col(f)), "__s", label, weight).first()["ap"] or 0.0, f) for f in features]
    ap, name = max(found, key=lambda x: x[0])
    return name, ap


def transfer_eval(rows: DataFrame, inside: Column, features: list[str], replicates: int, written: Written, label: str = "y", weight: str = "w", block: str = "block") -> DataFrame:
    """One row: average precision inside an area of a model that has not seen it and of the best single feature outside, their difference,
    and its 2.5 and 97.5 percent bounds over replicates that draw the area's blocks anew, both scores with the same draws
    (`bootstrap_weights`)."""
    outside = rows.filter(~inside)
    name, _ = best_single_feature(outside, features, label, weight)
    scored = fitted_gbt(outside, features, label, weight)(rows.filter(inside)).withColumn("single", -F.col(name))
    area = written(scored, "transfer")
    names = sorted(r[0] for r in area.select(block).distinct().collect())  # blocks of one area
    numbered = rows.sparkSession.createDataFrame(list(enumerate(names)), ["__b", block])
    each = area.join(numbered, block).join(bootstrap_weights(numbered, replicates, block="__b"), "__b").withColumns({"__w": F.col(weight) * F.col("times"), "__rep": F.col("rep")})
    ap = lambda df, s, w, by, to: weighted_ap_auc(df, s, label, w, by).select(*by, F.col("ap").alias(to))
    diff = ap(each, "p", "__w", ["__rep"], "m").join(ap(each, "single", "__w", ["__rep"], "s"), "__rep").select((F.col("m") - F.col("s")).alias("d"))
    bounds = diff.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    point = ap(area, "p", weight, [], "model_ap").crossJoin(ap(area, "single", weight, [], "single_ap"))
    return point.crossJoin(bounds).select(F.lit(name).alias("single"), "model_ap", "single_ap", (F.col("model_ap") - F.col("single_ap")).alias("gain"), "low", "high")

"""Measures of the estimates against what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.config import IDLE_CAUSES, Config
from fleetstream.functions.stats import ratio_or_zero
from fleetstream.operators.attribution import weather_stop
from fleetstream.operators.baselines import CAUSE_COLUMNS
from fleetstream.operators.scan import scan
from fleetstream.session import stage


def eval_eta(rows: DataFrame) -> DataFrame:
    """Errors of model and planner, overall (task_type NULL) and per task type, and band coverage."""
    c = F.col
    lo, hi = F.least("p10_min", "p90_min"), F.greatest("p10_min", "p90_min")
    d = rows.rollup("task_type").agg(
        F.count("*").alias("n"), F.avg(F.abs(c("p50_min") - c("actual_min"))).alias("mae_model"),
        F.avg(F.abs(c("planner_estimate_min") - c("actual_min"))).alias("mae_planner"),
        F.avg(((c("actual_min") >= lo) & (c("actual_min") <= hi)).cast("double")).alias("coverage"),
    )
    return d.withColumn("relative_improvement", F.when(c("mae_planner") > 0, (c("mae_planner") - c("mae_model")) / c("mae_planner")))


def precision_recall(rows: DataFrame, truth: str = "is_anomaly", predicted: str = "is_anomalous") -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    d = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    c = F.col
    d = d.withColumns({"precision": ratio_or_zero(c("tp"), c("tp") + c("fp")), "recall": ratio_or_zero(c("tp"), c("tp") + c("fn"))})
    return d.withColumn("f1", ratio_or_zero(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def pr_auc(rows: DataFrame, truth: str, score: str, key: str, ranges: int | None = None) -> DataFrame:
    """Area under precision over recall by the trapezoid rule, rows by score descending, ties by key.

    Rows are range-partitioned on (score, key), so equal scores are spread too;
    counts of earlier ranges are carried as one row per range. Without
    ``ranges``, their number follows the session and the size of the table.
    """
    d = rows.select((-F.col(score)).alias("__neg"), F.col(key).alias("__key"), F.col(truth).cast("int").alias("__y"))
    cut = d.repartitionByRange("__neg", "__key") if ranges is None else d.repartitionByRange(ranges, "__neg", "__key")
    d = stage(cut.withColumn("__chunk", F.spark_partition_id()), "ranked")
    d = scan(d, [], "__chunk", ["__neg", "__key"], sums={"__n": F.lit(1).cast("long"), "__tp": F.col("__y").cast("long")})
    c = F.col
    here = c("__tp") / c("__n")
    before = F.when(c("__n") == 1, 1.0).otherwise((c("__tp") - c("__y")) / (c("__n") - 1))
    # recall moves only on positive rows, by one over their number
    return d.agg(F.sum(c("__y")).alias("n_pos"), F.sum(c("__y") * (here + before) / 2).alias("__a")).select(
        "n_pos", F.when(c("n_pos") > 0, c("__a") / c("n_pos")).otherwise(0.0).alias("pr_auc")
    )


def recall_by_type(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("anomaly_type", F.lit("")) != "").groupBy("anomaly_type").agg(
        F.avg(F.col("is_anomalous").cast("double")).alias("recall"), F.count("*").alias("n")
    )


def cause_rows(windows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """True (dominant seconds) and re-derived cause of each idle window."""
    c = F.col
    cols = [c(x) for x in CAUSE_COLUMNS]
    total = sum(cols[1:], cols[0])
    top = F.greatest(*cols)
    true = F.coalesce(*[F.when(v == top, k) for k, v in zip(IDLE_CAUSES, cols)])
    pred = (
        F.when(c("idle_s_planned") > 0, "PLANNED").when(c("idle_s_machine") > 0, "MACHINE").when(weather_stop(cfg), "WEATHER")
        .when((c("truck_present_ratio") < 0.5) | (c("hauler_queue_mean") < 0.5), "SITE").otherwise("OPERATOR")
    )
    return windows.where(total > 0).withColumns({"true_cause": true, "predicted_cause": pred})


def agreement(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("true_cause") == F.col("predicted_cause")).cast("double")).alias("agreement"))


def confusion(rows: DataFrame) -> DataFrame:
    """True causes as rows, predicted causes as columns."""
    return rows.groupBy("true_cause").pivot("predicted_cause", list(IDLE_CAUSES)).count().na.fill(0)

"""Unusual windows: isolation forest, calibration, robust-z fallback and drivers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstream.config import WINDOW_FEATURES, Config
from fleetstream.functions.ids import warm_event_id
from fleetstream.functions.stats import clamp, position_left, robust_z
from fleetstream.operators.baselines import eligible

NODE_DDL = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def is_eligible() -> Column:
    cond = (F.col("working_ratio") >= 0.5) & (F.col("cycle_count") >= 2)
    for f in WINDOW_FEATURES:
        cond = cond & F.col(f).isNotNull()
    return F.coalesce(cond, F.lit(False))


def stats_map(stats: DataFrame) -> Column:
    """The feature statistics (one row per feature) as a one-value subquery."""
    return stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "mad"))))).scalar()


def feature_z(stats_col: str = "__stats") -> dict[str, Column]:
    out = {}
    for f in WINDOW_FEATURES:
        s = F.col(stats_col)[f]
        out[f] = robust_z(F.col(f), F.coalesce(s["median"], F.lit(0.0)), F.coalesce(s["mad"], F.lit(0.0)))
    return out


def drivers_array(stats_col: str = "__stats") -> Column:
    """All features with value and robust z, largest |z| first, feature order on ties."""
    items = []
    for i, (f, z) in enumerate(feature_z(stats_col).items()):
        items.append(F.struct((-F.abs(z)).alias("neg"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).alias("value"), z.alias("z")))
    return F.array_sort(F.array(*items))


def calibrate(score: Column, quantiles: Column) -> Column:
    """Share of training scores below the score, in thousandths, within [0, 1]."""
    return clamp(position_left(quantiles, score) / F.lit(1000.0), 0.0, 1.0)


def quantile_array(quantiles: DataFrame) -> Column:
    return quantiles.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"])).scalar()


def score_anomalies(
    windows: DataFrame, stats: DataFrame | None, forest: DataFrame | None = None, quantiles: DataFrame | None = None, cfg: Config = Config()
) -> DataFrame:
    """Add method, reason, score, threshold, is_anomalous and the top three drivers.

    Forest when its tables are given, else robust z, else UNAVAILABLE; windows
    that are not working windows are SKIPPED.
    """
    c = F.col
    ok = is_eligible()
    d = windows.withColumn("__ok", ok)
    has_forest = forest is not None and quantiles is not None
    if has_forest:
        d = forest_scores(d, forest)
        d = d.withColumn("__q", quantile_array(quantiles))
        d = d.withColumn("score", F.round(calibrate(c("raw_score"), c("__q")), 4)).drop("raw_score", "__q")
        method, threshold, hit = "IFOREST", cfg.anomaly_threshold, c("score") >= cfg.anomaly_threshold
    elif stats is not None:
        method, threshold, hit = "ROBUST_Z", cfg.robust_z_threshold, None
    else:
        method, threshold, hit = "UNAVAILABLE", None, F.lit(False)
    if stats is not None:
        d = d.withColumn("__stats", stats_map(stats)).withColumn("__d", F.when(c("__ok"), drivers_array()))
        top = F.transform(F.slice("__d", 1, 3), lambda x: F.struct(x["feature"].alias("feature"), F.round(x["value"], 4).alias("value"), F.round(x["z"], 3).alias("robust_z")))
        d = d.withColumn("drivers", top)
        if not has_forest:
            # not from the sorted drivers: a reader of scores alone then pays for no sorting
            peak = F.when(c("__ok"), F.greatest(*[F.abs(z) for z in feature_z().values()]))
            d = d.withColumn("__peak", peak).withColumn("score", F.round("__peak", 3))
            hit = c("__peak") > threshold
    if "score" not in d.columns:
        d = d.withColumn("score", F.lit(None).cast("double"))
    few = F.col("frame_count") < cfg.min_frames if "frame_count" in windows.columns else F.lit(False)
    d = d.withColumns({
        "method": F.when(c("__ok"), method).otherwise("SKIPPED"),
        "reason": F.when(few, "INSUFFICIENT_FRAMES").when(~c("__ok"), "NOT_WORKING_WINDOW"),
        "threshold": F.when(c("__ok"), F.lit(threshold)),
        "is_anomalous": F.coalesce(c("__ok") & hit, F.lit(False)),
        "score": F.when(c("__ok"), c("score")),
    })
    return d.drop("__ok", "__stats", "__d", "__peak")


def anomaly_events(scored: DataFrame) -> DataFrame:
    d = scored.where("is_anomalous")
    return d.select(
        warm_event_id(F.col("window_id"), F.lit("OPERATIONAL_ANOMALY")).alias("event_id"), F.lit("OPERATIONAL_ANOMALY").alias("type"),
        F.lit("WARNING").alias("severity"), "machine_id", "operator_id", "site_id", F.col("window_end").alias("ts"),
        F.concat(F.lit("anomaly@"), F.col("method")).alias("source_engine"), F.col("last_seq").alias("frame_seq"),
        F.to_json(F.struct("window_id", "score", "threshold", "method", "drivers")).alias("evidence"),
    )


# --- isolation forest --------------------------------------------------------

def tree_samples(train: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Up to ``sample`` rows per tree: those with the smallest hash of (row, tree).

    Each row is tested against a hash limit per tree before it is emitted, so
    the shuffle carries a few hundred rows per tree whatever the input size.
    """
    d = eligible(train)
    total = d.agg(F.count("*")).scalar()
    space = 1_000_000_000
    # twice the wanted share: a shortfall below ``sample`` is then out of reach
    limit = F.least(F.lit(float(space)), F.lit(2.0 * sample * space) / total)
    at = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(space))
    d = d.withColumn("__limit", limit).withColumn(
        "tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: at(t) < F.col("__limit")))
    )
    w = Window.partitionBy("tree").orderBy(at(F.col("tree")), key)
    d = d.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= sample)
    return d.select("tree", *[F.col(f).cast("double").alias(f) for f in WINDOW_FEATURES])


def fit_forest(train: DataFrame, key: str = "window_id", trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Node table of an isolation forest; one bounded sample per tree."""
    height = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.drop(columns="tree").to_numpy()
        x = x[np.lexsort(x.T)]
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        next_id = 1
        while todo:
            node, idx, depth = todo.pop()
            lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= height or len(idx) <= 1 or len(open_) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            f = int(rng.choice(open_))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = x[idx, f] <= cut
            nodes.append((tree, node, f, cut, next_id, next_id + 1, len(idx), depth))
            todo += [(next_id, idx[left], depth + 1), (next_id + 1, idx[~left], depth + 1)]
            next_id += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])

    return tree_samples(train, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODE_DDL)


def _average_path(n: np.ndarray) -> np.ndarray:
    n = n.astype(float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = n[big]
    out[big] = 2.0 * (np.log(m - 1) + np.euler_gamma) - 2.0 * (m - 1) / m
    return out


def _add_paths(rows: DataFrame, nodes: pd.DataFrame) -> DataFrame:
    """Add the path lengths of some trees to ``__path``, and what they are divided by to ``__norm``."""
    trees = []
    for _, t in nodes.sort_values("node").groupby("tree"):
        depth = t["depth"].to_numpy() + _average_path(t["size"].to_numpy())
        trees.append((t["feature"].to_numpy(), t["split"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), depth, int(t["size"].iloc[0])))
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    features = list(WINDOW_FEATURES)

    def add(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            ok = ~np.isnan(x).any(axis=1)
            xs = x[ok]
            total, norm = np.zeros(len(xs)), 0.0
            for feature, split, left, right, depth, n in shared.value:
                at = np.zeros(len(xs), dtype=int)
                while len(inner := np.flatnonzero(feature[at] >= 0)):
                    a = at[inner]
                    go = xs[inner, feature[a]] <= split[a]
                    at[inner] = np.where(go, left[a], right[a])
                total += depth[at]
                norm += float(_average_path(np.array([n]))[0])
            path = pdf["__path"].to_numpy(dtype=float, copy=True)
            path[ok] += total
            path[~ok] = np.nan
            yield pdf.assign(__path=path, __norm=pdf["__norm"] + norm)

    return rows.mapInPandas(add, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]))


def forest_scores(windows: DataFrame, forest: DataFrame, block_nodes: int = 200_000) -> DataFrame:
    """Add ``raw_score`` = 2^(-mean path / c(n)); NULL where a feature is missing.

    The forest is shipped in blocks of whole trees with about ``block_nodes``
    nodes, one step per block; steps add up path lengths, so the result is the
    same for any number of blocks.
    """
    sizes = sorted((r["tree"], r["count"]) for r in forest.groupBy("tree").count().collect())
    blocks, filled = [[]], 0
    for tree, n in sizes:
        if blocks[-1] and filled + n > block_nodes:
            blocks.append([])
            filled = 0
        blocks[-1].append(tree)
        filled += n
    d = windows.withColumns({"__path": F.lit(0.0), "__norm": F.lit(0.0)})
    for trees in blocks:
        d = _add_paths(d, forest.where(F.col("tree").between(trees[0], trees[-1])).toPandas()) if trees else d
    score = F.pow(F.lit(2.0), -F.col("__path") / F.greatest("__norm", F.lit(1e-12)))
    return d.withColumn("raw_score", F.when(~F.isnan(F.coalesce("__path", F.lit(float("nan")))), score)).drop("__path", "__norm")

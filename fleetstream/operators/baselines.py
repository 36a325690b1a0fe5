"""Statistics learned from history: splits, idle baselines, feature spreads, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.config import WINDOW_FEATURES, Config
from fleetstream.operators.attribution import KEY_SEP
from fleetstream.operators.scan import grid_quantiles, join_null_safe
from fleetstream.session import stage

CAUSE_COLUMNS = ["idle_s_planned", "idle_s_machine", "idle_s_weather", "idle_s_site", "idle_s_operator"]


def time_split(day: Column, n_days: int) -> Column:
    """70 / 10 / 20 split by day index."""
    return F.when(day < int(n_days * 0.7), "train").when(day < int(n_days * 0.8), "val").otherwise("test")


def idle_windows(windows: DataFrame) -> DataFrame:
    """Windows with idle seconds of any cause, with the operator's share."""
    total = sum((F.col(c) for c in CAUSE_COLUMNS[1:]), F.col(CAUSE_COLUMNS[0]))
    return windows.where(total > 0).withColumn("operator_idle_ratio", F.col("idle_s_operator") / F.col("window_s"))


def at_levels(rows: DataFrame) -> DataFrame:
    """Each row once per grouping level, with the level's key text."""
    def entry(level: str, *cols: str) -> Column:
        return F.struct(F.lit(level).alias("level"), (F.concat_ws(KEY_SEP, *cols) if cols else F.lit("global")).alias("key"))

    return rows.withColumn("__l", F.explode(F.array(
        entry("operator_context", "operator_id", "task_type", "weather", "operator_skill"),
        entry("skill_context", "operator_skill", "task_type", "weather"),
        entry("task_type", "task_type"), entry("global"),
    ))).withColumns({"level": F.col("__l")["level"], "key": F.col("__l")["key"]}).drop("__l")


def level_counts(rows: DataFrame) -> DataFrame:
    """Windows per group at all four levels in one pass of grouping sets."""
    sets = [
        [F.col("operator_id"), F.col("task_type"), F.col("weather"), F.col("operator_skill")],
        [F.col("operator_skill"), F.col("task_type"), F.col("weather")], [F.col("task_type")], [],
    ]
    return rows.groupingSets(sets, "operator_id", "task_type", "weather", "operator_skill").agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid")
    )


def medians(counted: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Exact median and median absolute deviation per key, for groups of any size."""
    # one row per group, read twice below: written once instead of computed twice
    med = stage(grid_quantiles(counted, keys, value, 2, [1], weight=weight, step="__k").select(*keys, "n", F.col("q").alias("median")), "medians")
    off = join_null_safe(counted, med.select(*keys, "median"), keys).withColumn("__off", F.abs(F.col(value) - F.col("median")))
    mad = grid_quantiles(off, keys, "__off", 2, [1], weight=weight, step="__k").select(*keys, F.col("q").alias("mad"))
    return join_null_safe(med, mad, keys)


def ewma_last(rows: DataFrame, keys: list[str], value: str, order: list[str], alpha: float, parts: list[Column] | None = None) -> DataFrame:
    """Last value of the exponentially weighted mean (first value as start) in the given order, over all rows.

    A row with ``back`` rows after it weighs alpha * (1 - alpha)^back, the first
    row (1 - alpha)^back. ``parts`` cut the order into chunks, coarse to fine,
    each never falling along the order; rows are ranked inside a chunk, and the
    sums of chunks are discounted by the rows of later chunks, level by level.
    """
    c = F.col
    parts = parts or [c(order[0])]
    names = [f"__p{i}" for i in range(len(parts))]
    d = rows.select(*keys, *order, c(value).alias("__v"), *[p.alias(n) for n, p in zip(names, parts)])
    w = Window.partitionBy(*keys, *names).orderBy(*[c(o).desc() for o in order])
    d = d.withColumn("__back", F.row_number().over(w) - 1)
    kept = lambda n: F.pow(F.lit(1.0 - alpha), n)
    s = d.groupBy(*keys, *names).agg(
        F.sum(kept(c("__back")) * alpha * c("__v")).alias("s"), F.count("*").alias("n"), F.max_by("__v", "__back").alias("first")
    )
    while names:
        part = names.pop()
        later = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, *names).orderBy(c(part).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        s = s.withColumn("s", c("s") * kept(later)).groupBy(*keys, *names).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min_by("first", part).alias("first"))
    return s.select(*keys, (c("s") + (1.0 - alpha) * kept(c("n") - 1) * c("first")).alias("ewma"))


def id_part(rows: DataFrame, name: str) -> Column:
    """A beginning of an id, which never falls along the order of ids, to cut rows into chunks.

    The machine with its separator if every id has one, else what all ids begin
    with and two characters more; one row per id would make chunks useless.
    """
    ends = rows.agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.bool_and(F.contains(F.col(name), F.lit(":"))).alias("machines"))
    one = F.lit(1)
    common = F.filter(F.sequence(one, F.length("lo") + 1), lambda i: F.substr("lo", one, i) == F.substr("hi", one, i))
    found = ends.select(F.struct("machines", (F.least(F.size(common), F.length("lo")) + 2).alias("n"))).scalar()
    machine = F.concat(F.substring_index(name, ":", 1), F.lit(":"))
    return F.when(found["machines"], machine).otherwise(F.substr(name, one, found["n"]))


def idle_baselines(train: DataFrame, cfg: Config = Config(), order: list[str] | None = None) -> DataFrame:
    """level, key, n, ewma, median, mad of the operator idle ratio (rounded to four places)."""
    order = order or ["dd", "window_id"]
    rows = idle_windows(train)
    context = ["operator_id", "task_type", "weather", "operator_skill"]
    counted = rows.groupBy(*context, "operator_idle_ratio").agg(F.count("*").alias("c"))
    stats = medians(at_levels(counted), ["level", "key"], "operator_idle_ratio", "c")
    ordered = rows.select(*context, *order, "operator_idle_ratio")
    parts = [F.col(order[0])]
    if "window_id" in order[1:]:
        # shuffled by chunk once, before each row is taken at four levels: a chunk of a level lies in one task already
        ordered = ordered.withColumn("__part", id_part(rows, "window_id")).repartition(order[0], "__part")
        parts.append(F.col("__part"))
    ewma = ewma_last(at_levels(ordered), ["level", "key"], "operator_idle_ratio", order, cfg.ewma_alpha, parts)
    d = stats.join(ewma, ["level", "key"])
    return d.select("level", "key", "n", *[F.round(c, 4).alias(c) for c in ("ewma", "median", "mad")])


def eligible(windows: DataFrame) -> DataFrame:
    """Working windows with all features: the rows anomaly scoring applies to."""
    cond = (F.col("working_ratio") >= 0.5) & (F.col("cycle_count") >= 2)
    for f in WINDOW_FEATURES:
        cond = cond & F.col(f).isNotNull()
    return windows.where(cond)


def feature_rows(windows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Unpivot the window features to (feature, value)."""
    return windows.unpivot(keep or [], list(WINDOW_FEATURES), "feature", "value")


def feature_stats(train: DataFrame) -> DataFrame:
    """feature, n, median, mad over the eligible windows."""
    return medians(feature_rows(eligible(train)), ["feature"], "value")


def score_quantiles(scores: DataFrame, score: str = "score") -> DataFrame:
    """1,001 exact score quantiles: k, q."""
    return grid_quantiles(scores, [], score, 1000).select("k", "q")


def content_hash(df: DataFrame) -> DataFrame:
    """Order-insensitive hash of all rows: n and content_hash, the MD5 of the sum of the rows' own.

    A row's text joins its columns by name with ``|``; NULL is ``~``, and floating
    numbers are given in whole millionths. Sums are partial per task.
    """
    fraction = {"double", "float"}
    text = [F.coalesce((F.floor(F.col(c) * 1e6 + 0.5) if kind in fraction else F.col(c)).cast("string"), F.lit("~")) for c, kind in sorted(df.dtypes)]
    total = F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.substring(F.md5(F.coalesce(total, F.lit(0)).cast("string")), 1, 8).alias("content_hash"))


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """Up to ``k`` rows per group, chosen by a hash of the key: the same rows on every run."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws(":", F.col(key), F.lit(str(seed))), 256), key)
    return df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= k).drop("__rk")

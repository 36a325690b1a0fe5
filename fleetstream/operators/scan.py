"""Ordered scans over one key that may hold a large share of all rows.

A plain window over a key puts the whole key in one task. Here the timeline of
a key is cut into chunks by a value that never decreases in the scan order
(an hour of event time, a block of sequence numbers). Each chunk is scanned on
its own, one summary row per chunk is carried forward over the key, and the
carried value is joined back:

    rows --(key, chunk)--> local running values --+--> combined
      \\--> one row per chunk --(key)--> carry ---/

The window over the bare key only ever sees one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.session import stage

CARRY = "__carry_"
#: Most rows of a join side that is broadcast after they were counted.
BROADCAST_ROWS = 100_000


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_free(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds columns to group, sort and join by instead of ``keys``, in which a NULL is a value like any other."""
    names = {f"__key{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for i, k in enumerate(keys)}
    return df.withColumns(names) if keys else df, list(names)


def seconds(ts: str | Column) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp")) / F.lit(1e6)


def time_chunk(ts: str | Column, width_s: int) -> Column:
    return F.floor(F.unix_seconds(_col(ts).cast("timestamp")) / F.lit(width_s)).cast("long")


def scan(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    prior_maxs: dict[str, Column] | None = None,
    sinces: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values per key in one pass; all are inclusive of the row but for two.

    ``sums``, ``maxs``, ``mins``, ``lasts`` (last non-null value); ``prevs`` are
    values of the row before (NULL on the first row of a key); ``prior_maxs``
    are maxima over the rows before; ``sinces`` count the rows after the latest
    row where a condition held (all rows so far if it never did). Rows whose key
    is NULL are a key of their own.
    """
    df, keys = null_free(df, keys)
    sums, maxs, mins, lasts, prevs = sums or {}, maxs or {}, mins or {}, lasts or {}, prevs or {}
    prior_maxs, sinces = prior_maxs or {}, sinces or {}
    local = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    over_key = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)

    position = F.struct(*order)
    per_chunk, carried = [], []
    for name, expr in sums.items():
        per_chunk.append(F.sum(expr).alias(name))
        carried.append(F.sum(name).over(over_key).alias(CARRY + name))
    for name, expr in maxs.items():
        per_chunk.append(F.max(expr).alias(name))
        carried.append(F.max(name).over(over_key).alias(CARRY + name))
    for name, expr in mins.items():
        per_chunk.append(F.min(expr).alias(name))
        carried.append(F.min(name).over(over_key).alias(CARRY + name))
    for name, expr in lasts.items():
        per_chunk.append(F.max(F.when(expr.isNotNull(), F.struct(position.alias("p"), expr.alias("v")))).alias(name))
        carried.append(F.last(F.col(name)["v"], ignorenulls=True).over(over_key).alias(CARRY + name))
    for name, expr in prevs.items():
        per_chunk.append(F.max(F.struct(position.alias("p"), expr.alias("v"))).alias(name))
        carried.append(F.last(F.col(name)["v"]).over(over_key).alias(CARRY + name))

    for name, expr in prior_maxs.items():
        per_chunk.append(F.max(expr).alias(name))
        carried.append(F.max(name).over(over_key).alias(CARRY + name))
    source = df
    if sinces:
        source = source.withColumn("__rn", F.row_number().over(local))
        per_chunk.append(F.count("*").alias("__n"))
    for name, cond in sinces.items():
        per_chunk.append(F.max(F.when(cond, F.col("__rn"))).alias(name))

    summary = source.groupBy(*keys, chunk).agg(*per_chunk)
    simple = list(carried)
    if sinces:
        summary = summary.withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys).orderBy(chunk)))
        for name in sinces:
            # rows after the hit, less all rows so far: adding the rows up to a later chunk gives the count there
            at_hit = F.when(F.col(name).isNotNull(), F.col("__n") - F.col(name) - F.col("__total"))
            simple.append(
                (F.col("__total") - F.col("__n") + F.coalesce(F.last(at_hit, ignorenulls=True).over(over_key), F.lit(0))).alias(CARRY + name)
            )
    carry = summary.select(*keys, chunk, *simple)
    joined = df.join(carry, [*keys, chunk], "left")

    out = {}
    for name, expr in sums.items():
        out[name] = F.sum(expr).over(upto) + F.coalesce(F.col(CARRY + name), F.lit(0))
    for name, expr in maxs.items():
        out[name] = F.greatest(F.max(expr).over(upto), F.col(CARRY + name))
    for name, expr in mins.items():
        out[name] = F.least(F.min(expr).over(upto), F.col(CARRY + name))
    for name, expr in lasts.items():
        out[name] = F.coalesce(F.last(expr, ignorenulls=True).over(upto), F.col(CARRY + name))
    for name, expr in prevs.items():
        first = F.row_number().over(local) == 1
        out[name] = F.when(first, F.col(CARRY + name)).otherwise(F.lag(expr).over(local))
    for name, expr in prior_maxs.items():
        out[name] = F.greatest(F.max(expr).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.col(CARRY + name))
    for name, cond in sinces.items():
        joined = joined.withColumn("__rn", F.row_number().over(local))
        hit = F.max(F.when(cond, F.col("__rn"))).over(upto)
        out[name] = F.when(hit.isNotNull(), F.col("__rn") - hit).otherwise(F.col("__rn") + F.col(CARRY + name))
    return joined.withColumns(out).drop("__rn", *keys, *[c for c in joined.columns if c.startswith(CARRY)])


def numbered(df: DataFrame, keys: list[str], chunk: str, order: list[str], name: str = "seq") -> DataFrame:
    """Row number per key without sorting a whole key in one task."""
    return scan(df, keys, chunk, order, sums={name: F.lit(1).cast("long")})


def gap_sessions(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], gap_s: float, chunk_s: int, prefix: str = "sess"
) -> DataFrame:
    """Sessions of rows whose gap to the previous row of the key is at most ``gap_s``.

    Adds ``{prefix}_gap_s`` (seconds to the previous row, NULL on the first),
    ``{prefix}_first_ts`` and ``{prefix}_pos`` (1-based position in the session).
    """
    c = F.col
    d, keys = null_free(df.withColumn("__chunk", time_chunk(ts, chunk_s)), keys)
    w = Window.partitionBy(*keys, "__chunk").orderBy(ts, *tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"__rn": F.row_number().over(w), "__gap": seconds(ts) - seconds(F.lag(ts).over(w))})
    # latest session start inside the chunk; the chunk's first row is not known yet
    d = d.withColumn("__cut", F.last(F.when(c("__gap") > gap_s, F.struct(c(ts).alias("ts"), c("__rn").alias("rn"))), ignorenulls=True).over(upto))

    over = Window.partitionBy(*keys).orderBy("__chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    s = d.groupBy(*keys, "__chunk").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.max("__cut").alias("cut")
    )
    s = s.withColumns({"before_ts": F.lag("last_ts").over(over), "total": F.sum("n").over(over)})
    linked = F.coalesce(seconds("first_ts") - seconds("before_ts") <= gap_s, F.lit(False))
    starts = c("cut").isNotNull() | ~linked
    s = s.withColumns({
        "linked": linked,
        "start": F.when(starts, F.coalesce(c("cut")["ts"], c("first_ts"))),
        "count": F.when(starts, F.coalesce(c("n") - c("cut")["rn"] + 1, c("n")) - c("total")),
    })
    carry = s.select(
        *keys, "__chunk", c("before_ts").alias("__before_ts"), c("linked").alias("__linked"), c("first_ts").alias("__chunk_ts"),
        F.last("start", ignorenulls=True).over(before).alias("__start"),
        (c("total") - c("n") + F.last("count", ignorenulls=True).over(before)).alias("__count"),
    )
    d = d.join(carry, [*keys, "__chunk"])
    inside = c("__cut").isNotNull()
    out = {
        f"{prefix}_gap_s": F.when(c("__rn") == 1, seconds(ts) - seconds("__before_ts")).otherwise(c("__gap")),
        f"{prefix}_first_ts": F.when(inside, c("__cut")["ts"]).when(c("__linked"), c("__start")).otherwise(c("__chunk_ts")),
        f"{prefix}_pos": F.when(inside, c("__rn") - c("__cut")["rn"] + 1).when(c("__linked"), c("__rn") + c("__count")).otherwise(c("__rn")).cast("long"),
    }
    return d.select(*df.columns, *[v.alias(k) for k, v in out.items()])


#: Distinct values of a key that one task ranks, about; most ranges of a key.
RANGE_ROWS, MOST_RANGES = 50_000, 4096


def _range_cuts(counted: DataFrame, keys: list[str], range_rows: int) -> DataFrame:
    """keys, __cuts (rising, empty for a key of at most ``range_rows`` values), __n (rows) from values (__v) with counts (__c).

    The cuts come from a mergeable sketch, as many as the values ask for; a
    sketch of a small key is small, and is never turned into cuts.
    """
    agg = counted.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col("__v").cast("double"), F.lit(4 * MOST_RANGES)).alias("__s"), F.count("*").alias("__d"), F.sum("__c").alias("__n")
    )
    ranges = F.least(F.ceil(F.col("__d") / range_rows), F.lit(MOST_RANGES)).cast("int")
    # one literal: thousands of them would slow planning down
    grid = F.split(F.lit(",".join(str(i / MOST_RANGES) for i in range(1, MOST_RANGES))), ",").cast("array<double>")
    chosen = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.element_at("__q", (i * MOST_RANGES / ranges).cast("int")))
    d = agg.withColumn("__q", F.when(F.col("__d") > range_rows, F.kll_sketch_get_quantile_double("__s", grid)))
    return d.select(*keys, F.when(F.col("__q").isNotNull(), F.array_distinct(chosen)).otherwise(F.array().cast("array<double>")).alias("__cuts"), "__n")


def _range_of(value: Column, cuts: str) -> Column:
    """Number of cuts below the value: first among every 64th of them, then among the 64 that follow."""
    below = lambda part: F.size(F.filter(part, lambda c: c < value))
    coarse = below(F.filter(cuts, lambda c, i: i % 64 == 63))
    return coarse * 64 + below(F.slice(cuts, coarse * 64 + 1, F.lit(63)))


def grid_quantiles(
    df: DataFrame, keys: list[str], value: str, steps: int, wanted: list[int] | None = None, range_rows: int = RANGE_ROWS,
    weight: str | None = None, step: str = "k",
) -> DataFrame:
    """Exact quantiles k/steps per key with linear interpolation, for groups of any size.

    Equal values are counted before the shuffle; a key with more than
    ``range_rows`` of them is then cut into ranges of about that many, so that
    no task holds a whole key. Returns
    one row per key and quantile: its number (column ``step``), n and ``q``.
    ``weight`` counts a row several times.
    """
    rows = F.count("*") if weight is None else F.sum(weight)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(rows.alias("__c"))
    splits = _range_cuts(counted, keys, range_rows)
    # null-safe join: a key of a grouping set is NULL when rolled up
    if keys:
        joined = counted.alias("a").join(splits.alias("b"), _same("a", "b", keys)).select("a.*", "b.__cuts", "b.__n")
    else:
        one = splits.select(F.struct("__cuts", "__n")).scalar()
        joined = counted.withColumn("__s", one).select("*", "__s.*").drop("__s")
    ranged = joined.withColumn("__b", _range_of(F.col("__v").cast("double"), "__cuts")).drop("__cuts")
    before = (
        ranged.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__bc").over(
                    Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    w = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        ranged.alias("a").join(before.alias("b"), _same("a", "b", [*keys, "__b"]))
        .select("a.*", "b.__before")
        .withColumn("__hi", F.col("__before") + F.sum("__c").over(w))
        .withColumn("__lo", F.col("__hi") - F.col("__c"))
    )
    # rank of quantile k is k*(n-1) div steps; keep the k whose lower or upper neighbour is in this row
    last = F.col("__n") - 1
    k_from = F.when(last > 0, F.greatest(F.lit(0), F.floor((F.col("__lo") - 1) * steps / last) - 1)).otherwise(0)
    k_to = F.when(last > 0, F.least(F.lit(steps), F.ceil(F.col("__hi") * steps / last) + 1)).otherwise(steps)
    ks = F.sequence(k_from.cast("long"), k_to.cast("long"))
    if wanted is not None:
        ks = F.array_intersect(ks, F.array(*[F.lit(k).cast("long") for k in wanted]))
    hits = (
        ranks.select(*keys, "__v", "__lo", "__hi", "__n", F.explode(ks).alias("__step"))
        .withColumn("__r", F.expr(f"(__step * (__n - 1)) div {steps}"))
        .withColumn("__f", F.expr(f"(__step * (__n - 1)) % {steps}") / F.lit(float(steps)))
    )
    at = lambda r: (F.col("__lo") <= r) & (r < F.col("__hi"))
    return (
        hits.groupBy(*keys, "__step")
        .agg(
            F.max(F.when(at(F.col("__r")), F.col("__v"))).alias("__a"),
            F.max(F.when(at(F.col("__r") + 1), F.col("__v"))).alias("__b"),
            F.max("__f").alias("__f"),
            F.max("__n").alias("n"),
        )
        .where(F.col("__a").isNotNull())
        .select(
            *keys, F.col("__step").alias(step), "n",
            (F.col("__a") + F.coalesce((F.col("__b") - F.col("__a")) * F.col("__f"), F.lit(0.0))).alias("q"),
        )
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a NULL being equal to a NULL: rows without a key keep their own timeline or group."""
    more = [F.col(f"__r.{c}") for c in right.columns if c not in keys]
    return left.alias("__l").join(right.alias("__r"), _same("__l", "__r", keys), how).select("__l.*", *more)


def _same(a: str, b: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def broadcast_if_few(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and counted; up to ``BROADCAST_ROWS`` rows are broadcast, so that the other side of a join stays where it is."""
    written = stage(df, name)
    return F.broadcast(written) if written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else written


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
    values: list[str], bucket_s: int = 60, few: bool = False,
) -> DataFrame:
    """Latest ``right`` row of the key at or before each ``left`` row (left outer).

    Both sides are cut into time buckets. Each bucket knows the row carried in
    from earlier ones, so the join is an equi-join on (key, bucket) with an
    interval filter; a hot key is spread over its buckets. ``right`` must have
    at most one row per key and time. A NULL key meets a NULL key. ``few``: the
    right side is likely small and is counted, to leave ``left`` unshuffled.
    """
    names = keys
    lhs, keys = null_free(left.withColumn("__bk", time_chunk(left_ts, bucket_s)), names)
    right, _ = null_free(right, names)
    rhs = right.select(*keys, F.col(right_ts).cast("timestamp").alias("__from"), F.struct(*values).alias("__val"))
    rhs = rhs.withColumn("__bk", time_chunk("__from", bucket_s))
    needed = lhs.select(*keys, "__bk").distinct()
    ends = rhs.groupBy(*keys, "__bk").agg(F.max(F.struct("__from", "__val")).alias("__end"))
    over_key = Window.partitionBy(*keys).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        needed.join(ends, [*keys, "__bk"], "full")
        .withColumn("__in", F.last("__end", ignorenulls=True).over(over_key))
        .where(F.col("__in").isNotNull())
        .select(*keys, F.col("__in")["__from"].alias("__from"), F.col("__in")["__val"].alias("__val"), "__bk")
    )
    points = rhs.select(*keys, "__from", "__val", "__bk").unionByName(carried)
    in_bucket = Window.partitionBy(*keys, "__bk").orderBy("__from")
    spans = points.withColumn("__to", F.lead("__from").over(in_bucket))
    if few:
        spans = broadcast_if_few(spans, "spans")
    l, r = lhs.alias("l"), spans.alias("r")
    t = F.col(f"l.{left_ts}").cast("timestamp")
    cond = F.col("l.__bk") == F.col("r.__bk")
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    cond = cond & (F.col("r.__from") <= t) & (F.col("r.__to").isNull() | (t < F.col("r.__to")))
    return l.join(r, cond, "left").select(
        *[F.col(f"l.{c}") for c in left.columns], *[F.col("r.__val")[v].alias(v) for v in values]
    )

"""Operational and evaluation analytics: percentiles, histograms, rates, alerts, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from . import etl


#: Accuracy of the sketch that brackets a rank: it leaves about 4 / ACCURACY of a group's rows. A bracket of more than BRACKET distinct values is cut into BINS.
ACCURACY, BRACKET, BINS = 10_000, 500_000, 1_000


def nearest_ranks(df: DataFrame, value: str, points: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """Per group sorted[ceil(p * n) - 1] for each name: p, exactly. value: a number; NaN comes after all others.

    Selection in two passes: a mergeable sketch of bounded size brackets each rank, and only the bracket's values are counted and ordered,
    after what lies below it was counted. A bracket that still holds many distinct values is narrowed by counts per bin, so no task
    orders a group.
    """
    groups = groups or []
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    names = list(points)
    shares = [x for p in points.values() for x in (max(p - 2 / ACCURACY, 0.0), min(p + 2 / ACCURACY, 1.0))]
    sketch = rows.groupBy(*groups).agg(F.count("*").alias("_all"), F.percentile_approx("_v", shares, ACCURACY).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # The sketch's ends are no bounds, so a rank next to them is bracketed by the least and the greatest value.
    low = lambda k, p: F.when(F.lit(p <= 4 / ACCURACY), F.col("_min")).otherwise(F.col("_q")[2 * k])
    high = lambda k, p: F.when(F.lit(p >= 1 - 4 / ACCURACY), F.col("_max")).otherwise(F.col("_q")[2 * k + 1])
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.ceil(F.col("_all") * p), F.lit(1)).alias("rank"), low(k, p).alias("lo"), high(k, p).alias("hi")) for k, (n, p) in enumerate(points.items())])
    brackets = written(sketch.select(*groups, F.explode(each).alias("b")).select(*groups, "b.*"))
    found = _select(rows, brackets, groups)
    missed = written(brackets.select(*groups, "name", "rank").join(_keyed(found, groups), [*[F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)], F.col("name") == F.col("_kn")], "left_anti"))
    if missed.limit(1).count():  # a bracket that the sketch's error moved off its rank: take the whole range
        wide = rows.groupBy(*groups).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        found = found.unionByName(_select(rows, written(_beside(missed, wide, groups)), groups))
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in names])


def _keyed(found: DataFrame, groups: list[str]) -> DataFrame:
    return found.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], F.col("name").alias("_kn"))


def _select(rows: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, name, _v): the value at each bracket's rank, if it lies in the bracket."""
    small = F.broadcast(brackets) if brackets.count() <= 100_000 else brackets
    named = small.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] or F.lit(True)
    met = rows.join(named, same).where(F.col("_v") <= F.col("hi"))
    inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))
    held = written(met.groupBy(*groups, "name", "rank", inside.alias("_v")).agg(F.count("*").alias("_n")))
    by = [*groups, "name"]
    below = held.where("_v is null").select(*groups, "name", F.col("_n").alias("_below"))
    held = held.where("_v is not null")
    while True:
        many = held.groupBy(*by).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where(F.col("c") > BRACKET)
        many = written(many)
        if not many.limit(1).count():
            break
        # Only the bin that holds the rank stays; what lies below it is counted.
        sized = _beside(held, many.drop("c").withColumn("wide", F.lit(True)), by)
        spot = F.when(F.col("wide"), F.least(F.floor((F.col("_v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        binned = written(sized.withColumn("bin", F.coalesce(spot, F.lit(0))))
        counts = _beside(binned.groupBy(*by, "rank", "bin").agg(F.sum("_n").alias("n")), below, by)
        w = Window.partitionBy(*by).orderBy("bin")
        run = counts.withColumn("upto", F.coalesce("_below", F.lit(0)) + F.sum("n").over(w))
        hit = run.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*by, "bin", (F.col("upto") - F.col("n")).alias("_below"))
        hit = written(hit)
        held = written(_beside(binned, hit.withColumnRenamed("bin", "at"), by).where(F.col("bin") == F.col("at")).select(*by, "rank", "_v", "_n"))
        below = hit.drop("bin")
    w = Window.partitionBy(*by).orderBy("_v")
    run = _beside(held, below, by).withColumn("upto", F.coalesce("_below", F.lit(0)) + F.sum("_n").over(w))
    return run.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("_n") < F.col("rank"))).select(*by, "_v")


def _beside(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """right's columns beside left's of the same group; null groups are groups too."""
    if not groups:
        return left.join(right, F.lit(True), "left")
    renamed = right.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    return left.join(renamed, same, "left").drop(*[f"_g{i}" for i in range(len(groups))])


def response_stats(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    groups = groups or []
    totals = df.groupBy(*groups).agg(F.count(value).alias("n"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"), zero(F.avg(value)).alias("avg"))
    ranks = nearest_ranks(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, groups)
    return _beside(totals, ranks, groups).withColumns({c: zero(F.col(c)) for c in ("p50", "p95", "p99")})


def call_stats(calls: DataFrame, order: list[str], last: int = 1000) -> DataFrame:
    """Over the last calls: total, success rate, mean latency, tokens; zeros when there are none."""
    recent = calls.orderBy(*[F.desc(c) for c in order]).limit(last)
    return recent.agg(F.count("*").alias("total"), F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def throughput(df: DataFrame, ok: Column, start: str, end: str) -> DataFrame:
    seconds = F.max(end).cast("double") - F.min(start).cast("double")
    return df.agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("errors"), (F.count_if(ok) / F.nullif(seconds, F.lit(0.0))).alias("per_second"))


def counters(samples: DataFrame) -> DataFrame:
    """name, labels, value: increments summed per name and sorted labels."""
    return samples.withColumn("labels", sorted_labels(F.col("labels"))).groupBy("name", "labels").agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    return samples.withColumn("labels", sorted_labels(F.col("labels"))).groupBy("name", "labels").agg(F.max_by("value", "ts").alias("value"))


def sorted_labels(labels: Column) -> Column:
    """A map's identity: 'k=v' pairs in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, le, bucket, total, value_sum): values <= le; one pass, conditional counts, then unpivoted."""
    groups = groups or []
    wide = df.groupBy(*groups).agg(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("bucket")) for b in bounds]).alias("b"), F.count(value).alias("total"), F.sum(value).alias("value_sum"))
    return wide.select(*groups, F.explode("b").alias("b"), "total", "value_sum").select(*groups, "b.le", "b.bucket", "total", "value_sum")


def histogram_quantile(buckets: DataFrame, q: float, groups: list[str] | None = None) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches q of the total; above the last bound, that bound."""
    groups = groups or []
    w = Window.partitionBy(*groups).orderBy("le")
    low, below = F.coalesce(F.lag("le").over(w), F.lit(0.0)), F.coalesce(F.lag("bucket").over(w), F.lit(0))
    rank = F.lit(q) * F.col("total")
    value = low + (F.col("le") - low) * (rank - below) / F.nullif(F.col("bucket") - below, F.lit(0))
    per = buckets.withColumns({"_v": value, "_reached": F.col("bucket") >= rank})
    return per.groupBy(*groups).agg(F.coalesce(F.min_by(F.when(F.col("_reached"), F.col("_v")), F.when(F.col("_reached"), F.col("le"))), F.max("le")).alias("quantile"))


def increase_rate(samples: DataFrame, value: str, ts: str, window: str, groups: list[str]) -> DataFrame:
    """Per window: increase of a counter (a fall is a restart from 0) divided by the window's seconds.

    Steps are taken inside each window; a window's first sample meets the last of the series' window before, so a series is split over tasks by time.
    """
    by = samples.withColumn("_w", F.window(ts, window))
    w = Window.partitionBy(*groups, "_w").orderBy(ts)
    before = F.lag(value).over(w)
    rise = lambda now, old: F.when(old.isNull(), 0).when(now < old, now).otherwise(now - old)
    inner = by.withColumn("_step", rise(F.col(value), before))
    per = inner.groupBy(*groups, "_w").agg(F.sum("_step").alias("_inside"), F.min_by(value, ts).alias("_first"), F.max_by(value, ts).alias("_last"))
    last = F.lag("_last").over(Window.partitionBy(*groups).orderBy("_w.start"))
    seconds = F.col("_w.end").cast("double") - F.col("_w.start").cast("double")
    out = per.withColumn("increase", F.col("_inside") + rise(F.col("_first"), last))
    return out.select(*groups, F.col("_w.start").alias("window_start"), "increase", (F.col("increase") / seconds).alias("rate"))


def filled(df: DataFrame, series: DataFrame, on: list[str], value: str) -> DataFrame:
    """All of series, 0 where df has no row."""
    return series.join(df, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def alerts(df: DataFrame, ts: str, failing: Column, window: str, threshold: float, runs: int, groups: list[str] | None = None) -> DataFrame:
    """Windows in which the failing share is above threshold for `runs` windows in a row."""
    groups = groups or []
    per = df.groupBy(*groups, F.window(ts, window).alias("w")).agg(F.avg(failing.cast("int")).alias("share"))
    w = Window.partitionBy(*groups).orderBy("w.start").rowsBetween(-(runs - 1), 0)
    hot = F.sum((F.col("share") > threshold).cast("int")).over(w)
    return per.withColumn("firing", hot >= runs).select(*groups, F.col("w.start").alias("window_start"), "share", "firing")


def pareto_front(df: DataFrame, cost: str, gain: str, tie: str, parts: int = 64) -> DataFrame:
    """Rows with no row of at least their gain at a cost as low.

    One pass over (gain desc, cost, tie) finds a front; it runs over `parts` parts first, so only their fronts meet in one task.
    """

    def front(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(gain), cost, tie).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_least", F.min(cost).over(w)).where(F.col("_least").isNull() | (F.col(cost) < F.col("_least"))).drop("_least")

    # Per gain only the cheapest row can be on the front.
    cheapest = df.groupBy(gain).agg(F.min_by(F.struct(*df.columns), F.struct(cost, tie)).alias("r")).select("r.*")
    some = front(cheapest.withColumn("_part", F.pmod(F.xxhash64(gain), F.lit(parts))), "_part")
    return front(some.drop("_part"))


def best_variant(df: DataFrame, group: str, cost: str, gain: str, floor: float, tie: str) -> DataFrame:
    """Per group the cheapest row with gain >= floor, else the one of the highest gain."""
    ok = F.col(gain) >= floor
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(ok), F.when(ok, F.col(cost)), F.desc(gain), tie))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def recommendations(df: DataFrame, cost: str, gain: str, tie: str, floors: dict[str, float]) -> DataFrame:
    """(use, tie): for each use the cheapest row whose gain reaches its floor; a use that none reaches has no row."""
    picks = [F.struct(F.lit(use).alias("use"), F.min_by(F.when(F.col(gain) >= floor, F.col(tie)), F.when(F.col(gain) >= floor, F.struct(cost, tie))).alias(tie)) for use, floor in floors.items()]
    return df.agg(F.array(*picks).alias("p")).select(F.explode("p").alias("p")).select("p.*").where(F.col(tie).isNotNull())


def pivoted(df: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def config_variants(configs: DataFrame, variants: DataFrame, has: str, needs: str) -> DataFrame:
    """Every configuration with every search variant it can run: a variant that needs a feature goes with configurations that have it."""
    return configs.join(variants, F.col(has) | ~F.col(needs))


def improvement(cold: Column, warm: Column) -> Column:
    return (cold - warm) / F.nullif(cold, F.lit(0)) * 100


def resource_stats(df: DataFrame, snapshots: str, groups: list[str]) -> DataFrame:
    """Min, max, mean and p95 over all groups' exploded snapshots."""
    rows = df.select(*groups, F.explode(snapshots).alias("x"))
    totals = rows.groupBy(*groups).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("avg"))
    return _beside(totals, nearest_ranks(rows, "x", {"p95": 0.95}, groups), groups)


def failure_rate(df: DataFrame, ts_seconds: str, failed: Column, window_s: int, groups: list[str] | None = None) -> DataFrame:
    """Adds calls, failures and failure_rate of the sliding window that ends at each row."""
    w = Window.partitionBy(*(groups or [])).orderBy(ts_seconds).rangeBetween(-window_s, 0)
    out = df.withColumns({"calls": F.count("*").over(w), "failures": F.sum(failed.cast("long")).over(w)})
    return out.withColumn("failure_rate", F.col("failures") / F.col("calls"))


def breaker_trips(df: DataFrame, min_calls: int, rate: float, failures: int) -> DataFrame:
    """Rows at which a breaker would open: enough failures, or a high rate over enough calls."""
    return df.withColumn("open", (F.col("failures") >= failures) | ((F.col("calls") >= min_calls) & (F.col("failure_rate") >= rate)))


def filter_stats(runs: DataFrame, groups: list[str], latency: str = "latency", results: str = "results") -> DataFrame:
    """Mean of the latencies above 0 and mean number of results."""
    return runs.groupBy(*groups).agg(F.avg(F.when(F.col(latency) > 0, F.col(latency))).alias("avg_latency"), F.avg(results).alias("avg_results"))


def ranked_by_recall(runs: DataFrame, recall: str, latency: str, tie: str) -> DataFrame:
    """rank from 1: by recall to two digits, the lower latency first among equals. Numbered by ranges of the order."""
    order = ["_down", latency, tie]
    out = etl.batched(runs.withColumn("_down", -F.round(recall, 2)), order, 1)
    return out.withColumn("rank", F.col("row_index") + 1).drop("_down", "row_index", "batch_file")


def slowest(rows: DataFrame, by: str, ties: list[str], n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def code_histogram(rows: DataFrame, code: str) -> DataFrame:
    """Rows per code, the most frequent first."""
    return rows.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code)


def combinations(rows: DataFrame, *columns: str) -> DataFrame:
    """Every combination of the columns' distinct values: the series that gap filling wants."""
    found = [rows.select(c).distinct() for c in columns]
    return reduce(DataFrame.crossJoin, found)

"""Trace and request analytics over span and request tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

# Upper bounds of the duration histogram in seconds.
DURATION_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
# Shares of the percentiles, and the ranges of a group among which their rows are looked for.
QUANTILES = {"p50": Decimal("0.50"), "p95": Decimal("0.95"), "p99": Decimal("0.99")}
QUANTILE_RANGES = 256


def _millis(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000.0


def traces(spans: DataFrame) -> DataFrame:
    """Finished traces: the root has ended and no span is open.

    `spans(trace_id, span_id, parent_span_id, name, start, end, status_code)`.
    Every aggregate is partial, so a trace with most of the spans is no hot spot.
    """
    root = F.coalesce("parent_span_id", F.lit("")) == ""
    ended = F.col("end").isNotNull()
    closing = F.when(root & ended, F.struct(F.col("end"), F.col("span_id")))
    grouped = spans.groupBy("trace_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("span_count"),
        F.max_by("name", closing).alias("root_name"), F.max_by("status_code", closing).alias("status_code"),
        F.count_if(~ended).alias("_open"), F.count_if(root & ended).alias("_roots"),
    )
    return grouped.filter((F.col("_roots") > 0) & (F.col("_open") == 0)).select(
        "trace_id", "root_name", "status_code", "start", "end", "span_count",
        _millis(F.col("start"), F.col("end")).alias("duration_ms"))


def trace_search(spans: DataFrame, min_duration_ms: float = 0.0, status: str = "", name_contains: str = "",
                 since=None, limit: int = 0) -> DataFrame:
    """Matching traces, newest end first; the limit is a distributed top-k."""
    found = traces(spans)
    if min_duration_ms > 0:
        found = found.filter(F.col("duration_ms") >= min_duration_ms)
    if status:
        found = found.filter(F.col("status_code") == status)
    if name_contains:
        found = found.filter(F.contains(F.lower("root_name"), F.lit(name_contains.lower())))
    if since is not None:
        found = found.filter(F.col("end") >= F.lit(since))
    found = found.orderBy(F.desc("end"), F.asc("trace_id"))
    return found.limit(limit) if limit > 0 else found


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of one finished trace by start; the id filter reaches the scan."""
    own = spans.filter(F.col("trace_id") == trace_id)
    return own.join(traces(own).select("trace_id"), "trace_id", "left_semi").orderBy("start", "span_id")


def active_spans(spans: DataFrame, now: Column) -> DataFrame:
    """Spans without an end and their age, newest start first."""
    return (spans.filter(F.col("end").isNull())
            .select("trace_id", "span_id", "name", "start", _millis(F.col("start"), now).alias("age_ms"))
            .orderBy(F.desc("start"), F.asc("span_id")))


def trace_stats(spans: DataFrame) -> DataFrame:
    """One row: stored and error traces, traces and spans still active."""
    done = traces(spans).agg(
        F.count_if(F.col("status_code") != "Error").alias("traces_stored"),
        F.count_if(F.col("status_code") == "Error").alias("error_traces_stored"),
        F.min("end").alias("oldest_end"), F.max("end").alias("newest_end"))
    open_ = spans.groupBy("trace_id").agg(
        F.count_if(F.col("end").isNull()).alias("_open"),
        F.count_if(F.col("end").isNotNull() & (F.coalesce("parent_span_id", F.lit("")) == "")).alias("_roots"),
    ).agg(F.count_if((F.col("_open") > 0) | (F.col("_roots") == 0)).alias("traces_active"),
          F.coalesce(F.sum("_open"), F.lit(0)).alias("spans_active"))
    # one row each
    return done.withColumn("_one", F.lit(1)).join(open_.withColumn("_one", F.lit(1)), "_one").drop("_one")


def status_class(code: Column) -> Column:
    return (F.when(code >= 500, F.lit("5xx")).when(code >= 400, F.lit("4xx")).when(code >= 300, F.lit("3xx"))
            .when(code >= 200, F.lit("2xx")).otherwise(F.lit("unknown")))


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests per method, route template and status class."""
    route = F.coalesce(F.nullif(F.col("route"), F.lit("")), F.lit("unknown"))
    return requests.groupBy("method", route.alias("path"), status_class(F.col("status_code")).alias("status")).agg(
        F.count(F.lit(1)).alias("requests"))


def duration_histogram(requests: DataFrame, seconds: str = "duration_s") -> DataFrame:
    """Cumulative counts per upper bound (the last is infinity), with count and sum.

    One aggregation with a conditional count per bound; nothing is sorted.
    """
    route = F.coalesce(F.nullif(F.col("route"), F.lit("")), F.lit("unknown"))
    counts = requests.groupBy("method", route.alias("path")).agg(
        *[F.count_if(F.col(seconds) <= bound).alias(f"_b{i}") for i, bound in enumerate(DURATION_BOUNDS)],
        F.count(F.lit(1)).alias("count"), F.sum(seconds).alias("sum_s"))
    buckets = F.array(
        *[F.struct(F.lit(bound).alias("le"), F.col(f"_b{i}").alias("n")) for i, bound in enumerate(DURATION_BOUNDS)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return counts.select("method", "path", "count", "sum_s", F.explode(buckets).alias("_b")).select(
        "method", "path", F.col("_b.le").alias("le"), F.col("_b.n").alias("cumulative"), "count", "sum_s")


def query_counts(queries: DataFrame) -> DataFrame:
    """Queries per source and outcome."""
    return queries.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("queries"))


def duration_percentiles(requests: DataFrame, seconds: str = "duration_s") -> DataFrame:
    """Exact p50, p95 and p99 per method and route: the smallest duration that so large a share does not exceed.

    Approximate quantiles cut each group into ranges. Counts per range tell in which
    one a wanted row stands, and only the distinct durations of that range are put in
    order, so no group is sorted whole.
    """
    route = F.coalesce(F.nullif(F.col("route"), F.lit("")), F.lit("unknown"))
    # a struct is equal to itself even where a field is null
    rows = requests.select(F.struct("method", route.alias("path")).alias("_of"), F.col(seconds).alias("_v"))
    cuts = F.percentile_approx("_v", [i / QUANTILE_RANGES for i in range(1, QUANTILE_RANGES)], 10_000)
    groups = rows.groupBy("_of").agg(F.array_distinct(cuts).alias("_cuts"))
    counted = rows.filter(F.col("_v").isNotNull()).groupBy("_of", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = counted.join(groups, "_of").select("_of", "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    whole = Window.partitionBy("_of")  # of at most QUANTILE_RANGES rows
    sums = ranged.groupBy("_of", "_range").agg(F.sum("_n").alias("_n"))
    sums = sums.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_range")), "_all": F.sum("_n").over(whole)})
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("_all").cast("decimal(20,0)") * share).cast("bigint").alias("at"))
                       for name, share in QUANTILES.items()])
    sought = sums.withColumn("_q", F.explode(places)).withColumn("_at", F.col("_q.at") - F.col("_upto") + F.col("_n"))
    sought = sought.filter(F.col("_at").between(F.lit(1), F.col("_n"))).select("_of", "_range", "_q.name", "_at")
    near = ranged.join(sought, ["_of", "_range"])
    upto = F.sum("_n").over(Window.partitionBy("_of", "_range", "name").orderBy("_v"))
    found = near.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_at"))
    found = found.groupBy("_of").agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in QUANTILES])
    return groups.join(found, "_of", "left").select("_of.method", "_of.path", *QUANTILES)

"""Percentiles, histograms, rates and load accounting."""

from __future__ import annotations

import contextlib
import time as clock
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [0.001, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.075, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
#: Upper bounds of the cost histogram, in dollars.
COST_BOUNDS = [0.0001, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.1, 0.25, 0.5, 1.0]
#: Classes of tokens that are billed apart, with the price of each.
TOKEN_CLASSES = {"input": "input_per_mtok", "output": "output_per_mtok", "cache_write": "cache_write_per_mtok", "cache_read": "cache_read_per_mtok"}
QUANTILES = (0.5, 0.95, 0.99)


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Per group the values at sorted position floor((n - 1) * q), as columns p50 and the like.

    A group is sorted by value over (group, value) counts, so repeated values cost one row and no group is collected."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("_n").over(Window.partitionBy(*by))
    ranked = counts.withColumn("_upto", upto).withColumn("_total", total)
    picks = [F.min(F.when(F.col("_upto") > F.floor((F.col("_total") - 1) * q), F.col(value))).alias(f"p{round(q * 100):d}") for q in quantiles]
    return ranked.groupBy(*by).agg(F.sum("_n").alias("n"), *picks)


def discrete_percentiles(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Per group n, the least values that at least the given shares of the group's values don't exceed (p50 and the like), most and mean.

    As in nearest_rank over (group, value) counts: no group is collected."""
    counts = df.groupBy(*by, value).agg(F.count(value).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    ranked = counts.withColumn("_upto", upto).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_total") * q), F.col(value))).alias(f"p{round(q * 100):d}") for q in quantiles]
    mean = F.try_divide(F.sum(F.col(value).cast("double") * F.col("_n")), F.sum("_n"))
    return ranked.groupBy(*by).agg(F.sum("_n").alias("n"), *picks, F.max(value).alias("most"), mean.alias("mean"))


def latency_percentiles(df: DataFrame, by: list[str], micros: str) -> DataFrame:
    """Per group n, p50_ms, p95_ms, p99_ms, max_ms and mean_ms of microseconds, exact (discrete) percentiles."""
    p = discrete_percentiles(df, by, micros)
    return p.select(*by, "n", *[F.round(F.col(f"p{round(q * 100):d}") / 1000, 6).alias(f"p{round(q * 100):d}_ms") for q in QUANTILES], F.round(F.col("most") / 1000, 6).alias("max_ms"), F.round(F.col("mean") / 1000, 6).alias("mean_ms"))


def sketch_percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same by mergeable sketches, for sizes at which sorting is too much; relative rank error about 1 in 10,000."""
    p = [F.percentile_approx(value, q, 10000).alias(f"p{round(q * 100):d}") for q in QUANTILES]
    return df.groupBy(*by).agg(F.count(value).alias("n"), *p)


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """The least upper bound that is not below the value; infinity above all."""
    out = F.lit(float("inf"))
    for bound in reversed(bounds):
        out = F.when(value <= bound, F.lit(bound)).otherwise(out)
    return out


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by, le, n, cumulative): observations per bucket, empty ones included, and running counts. Nulls aren't observed."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, bucket_of(F.col(value), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.select(*by).distinct().withColumn("le", F.explode(F.array(*[F.lit(b) for b in bounds], F.lit(float("inf")))))
    same = [every[c].eqNullSafe(counts[c]) for c in (*by, "le")]
    filled = every.join(counts, reduce(Column.__and__, same), "left").select(*[every[c] for c in (*by, "le")], "n").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("cumulative", F.sum("n").over(Window.partitionBy(*by).orderBy("le")))


def histogram_quantile(cumulative: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, value): the quantile by linear interpolation within its bucket; the last finite bound if it lies above all."""
    w = Window.partitionBy(*by).orderBy("le")
    h = cumulative.withColumn("_total", F.max("cumulative").over(Window.partitionBy(*by))).withColumn("_below", F.coalesce(F.lag("cumulative").over(w), F.lit(0))).withColumn("_from", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    target = F.col("_total") * q
    inside = h.filter((F.col("cumulative") >= target) & (F.col("_below") < target))
    linear = F.col("_from") + (F.col("le") - F.col("_from")) * (target - F.col("_below")) / (F.col("cumulative") - F.col("_below"))
    return inside.select(*by, F.round(F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(linear), 6).alias("value"))


def load_report(samples: DataFrame, by: list[str]) -> DataFrame:
    """Open-loop load: samples (by, intended_us, actual_us, service_us, ok) as percentiles with and without the wait that a late start adds.

    fell_behind: some request began over 50 ms late. Failed requests count for the error rate only."""
    delay = F.greatest(F.col("actual_us") - F.col("intended_us"), F.lit(0))
    s = samples.withColumn("delay", delay).withColumn("good", F.when(F.col("ok"), F.col("service_us"))).withColumn("corrected", F.col("good") + F.col("delay"))
    p95 = [discrete_percentiles(s, by, c, (0.95,)).select(*[F.col(x).alias(f"_{c}_{x}") for x in by], F.round(F.col("p95") / 1000, 6).alias(f"{'naive' if c == 'good' else c}_p95_ms")) for c in ("corrected", "good")]
    out = s.groupBy(*by).agg(F.count(F.lit(1)).alias("sent"), F.round(F.max("delay") / 1000, 6).alias("max_delay_ms"), (F.max("delay") > 50000).alias("fell_behind"), F.round(F.count_if(~F.col("ok")) / F.count(F.lit(1)), 6).alias("error_rate"))
    for c, x in zip(("corrected", "good"), p95, strict=True):
        same = [out[b].eqNullSafe(x[f"_{c}_{b}"]) for b in by]
        out = out.join(x, reduce(Column.__and__, same)).drop(*[f"_{c}_{b}" for b in by])
    return out


def render_load(report: DataFrame) -> DataFrame:
    """report with one fixed-width line a row."""
    late = F.when(F.col("fell_behind"), "  << fell behind").otherwise("")
    return report.withColumn("line", F.format_string("n=%-6d err %5.2f%%  corrected p95 %8.2f ms  naive p95 %8.2f ms  max delay %8.2f ms%s", "sent", F.col("error_rate") * 100, "corrected_p95_ms", "naive_p95_ms", "max_delay_ms", late))


def run_load(spark: SparkSession, op: Callable[[int], object], rate: float, seconds: float, warmup: int = 20) -> DataFrame:
    """Samples (i, intended_us, actual_us, service_us, ok) of an operation that is called at a fixed rate; one that raises isn't ok. Late calls start at once."""
    for i in range(warmup):
        with contextlib.suppress(Exception):
            op(i)
    rows = []
    start = clock.perf_counter()
    for i in range(int(rate * seconds)):
        clock.sleep(max(0.0, i / rate - (clock.perf_counter() - start)))
        began = clock.perf_counter()
        try:
            op(i)
            ok = True
        except Exception:
            ok = False
        rows.append((i, int(i / rate * 1e6), int((began - start) * 1e6), int((clock.perf_counter() - began) * 1e6), ok))
    return spark.createDataFrame(rows, "i bigint, intended_us bigint, actual_us bigint, service_us bigint, ok boolean")


def schedule(spark, rate: int, seconds: int, warmup: int = 20) -> DataFrame:
    """(i, intended_us, warmup): when each request of an open-loop test is due."""
    return spark.range(rate * seconds + warmup).select(F.col("id").alias("i"), F.floor(F.col("id") * 1000000 / rate).alias("intended_us"), (F.col("id") < warmup).alias("warmup"))


def budget_checks(measured: DataFrame) -> DataFrame:
    """Rows (name, budget, measured, lower_is_better) with passed, headroom (null without budget) and tight (passed with under a tenth to spare)."""
    passed = F.when(F.col("lower_is_better"), F.col("measured") <= F.col("budget")).otherwise(F.col("measured") >= F.col("budget"))
    gap = F.when(F.col("lower_is_better"), F.col("budget") - F.col("measured")).otherwise(F.col("measured") - F.col("budget"))
    headroom = F.round(F.try_divide(gap, F.nullif(F.col("budget"), F.lit(0.0))), 6)
    return measured.withColumn("passed", passed).withColumn("headroom", headroom).withColumn("tight", F.col("passed") & (F.col("headroom") < 0.1))


def budgets(spark: SparkSession, values: dict[str, tuple[float, bool]]) -> DataFrame:
    """(name, budget, lower_is_better) of declared budgets; the values are the caller's."""
    return spark.createDataFrame([(k, float(v), low) for k, (v, low) in values.items()], "name string, budget double, lower_is_better boolean")


def budget_report(checks: DataFrame, **conditions: str) -> DataFrame:
    """One row about the rows of budget_checks: whether all passed (true without any), how many, the names that failed and that are tight, and the conditions they were measured under."""

    def names(which: Column) -> Column:
        return F.array_sort(F.coalesce(F.collect_list(F.when(which, F.col("name"))), F.array().cast("array<string>")))

    report = checks.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("n_checks"), names(~F.coalesce("passed", F.lit(False))).alias("failures"), names(F.col("tight")).alias("tight"))
    return report.withColumns({k: F.lit(v) for k, v in conditions.items()})


def rate_windows(events: DataFrame, by: list[str], time: str, size: str, slide: str) -> DataFrame:
    """(window_start, by, n, per_second): sliding counts."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    w = F.window(F.col(time).cast("timestamp"), size, slide)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n", F.round(F.col("n") / seconds, 6).alias("per_second"))


def ratio_windows(events: DataFrame, time: str, size: str, slide: str, **conditions: Column) -> DataFrame:
    """(window_start, n, one column a condition): the share of each sliding window's events that fulfil it (a hit rate, a degraded rate)."""
    w = F.window(F.col(time).cast("timestamp"), size, slide)
    shares = [F.round(F.count_if(c) / F.count(F.lit(1)), 6).alias(name) for name, c in conditions.items()]
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *shares).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", *conditions)


def running_budget(spend: DataFrame, trace: str, seq: str, amount: str, budget: float) -> DataFrame:
    """spend with what was spent before each row of its trace, what remained, and whether the row still fits."""
    before = F.coalesce(F.sum(amount).over(Window.partitionBy(trace).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    remaining = F.greatest(F.lit(budget) - F.col("spent_before"), F.lit(0.0))
    out = spend.withColumn("spent_before", before).withColumn("remaining", remaining)
    return out.withColumn("status", F.when(F.col("remaining") <= 0, "exhausted").when(F.col(amount) > F.col("remaining"), "would_exceed").otherwise("ok"))


def usage_cost(calls: DataFrame, prices: DataFrame, ttl: str = "5m") -> DataFrame:
    """calls (model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens) with what each class of tokens costs (input_usd and so on), usd, cache_hit_ratio and price_version.

    prices: (model, input_per_mtok, output_per_mtok, cache_write_5m_per_mtok, cache_write_1h_per_mtok, cache_read_per_mtok,
    version), a parameter; `ttl` chooses the write rate, or names a column of calls that does, row by row. A model that
    isn't in it is an error, never free. Null counts are 0; the ratio is null without input."""
    chosen = F.col(ttl) if ttl in calls.columns else F.lit(ttl)
    joined = calls.join(F.broadcast(prices), "model", "left").withColumn("cache_write_per_mtok", F.when(chosen == "1h", F.col("cache_write_1h_per_mtok")).otherwise(F.col("cache_write_5m_per_mtok")))
    unknown = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null")))).cast("double")
    parts = {f"{c}_usd": F.when(F.col("input_per_mtok").isNull(), unknown).otherwise(F.coalesce(f"{c}_tokens", F.lit(0)) * F.col(p) / 1e6) for c, p in TOKEN_CLASSES.items()}
    total = sum((F.col(c) for c in list(parts)[1:]), F.col(next(iter(parts))))
    read = F.try_divide(F.col("cache_read_tokens"), F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens"))
    return joined.withColumns(parts).withColumns({"usd": total, "cache_hit_ratio": read, "price_version": F.col("version")}).drop("cache_write_per_mtok", *[c for c in prices.columns if c != "model"])


def request_cost(costed: DataFrame, request: str, *by: str) -> DataFrame:
    """Per request (and columns `by`, a model, say) the sums of its calls from usage_cost: n_calls, tokens by class, usd."""
    return costed.groupBy(request, *by).agg(F.count(F.lit(1)).alias("n_calls"), *[F.sum(F.coalesce(f"{c}_tokens", F.lit(0))).alias(f"{c}_tokens") for c in TOKEN_CLASSES], F.sum("usd").alias("usd"))


def projected_cost(calls: DataFrame, prices: DataFrame, ttl: str = "5m") -> DataFrame:
    """calls (model, input_tokens, cached_tokens, max_output_tokens) with the usd they cost at worst: all output that is allowed, nothing written to a cache."""
    usage = calls.withColumns({"output_tokens": F.col("max_output_tokens"), "cache_read_tokens": F.col("cached_tokens"), "cache_write_tokens": F.lit(0).cast("bigint")})
    return usage_cost(usage, prices, ttl).select(*calls.columns, "usd")


def breakeven_reads(prices: DataFrame) -> DataFrame:
    """(model, reads_5m, reads_1h): reads after which a cached prefix has paid for being written; null where reading saves nothing."""
    saved = F.col("input_per_mtok") - F.col("cache_read_per_mtok")
    return prices.select("model", *[F.when(saved > 0, (F.col(f"cache_write_{t}_per_mtok") - F.col("input_per_mtok")) / saved).alias(f"reads_{t}") for t in ("5m", "1h")])


def least_prefix(model: Column, rules: list[tuple[str, int]], default: int) -> Column:
    """The shortest prefix, in tokens, that can be cached: by the first rule whose text the model's name contains."""
    out = F.lit(default)
    for part, tokens in reversed(rules):
        out = F.when(F.contains(model, F.lit(part)), F.lit(tokens)).otherwise(out)
    return out


def cold_and_warm(requests: DataFrame, prices: DataFrame, rules: list[tuple[str, int]], default: int) -> DataFrame:
    """requests (request_id, model, tokens_in, prefix_tokens, max_output_tokens) with cold_usd, and warm_usd with the prefix read from a cache where it is long enough. Without a model both are 0."""
    asked = requests.filter(F.col("model").isNotNull())
    cacheable = F.col("prefix_tokens") >= least_prefix(F.col("model"), rules, default)
    cached = F.when(cacheable, F.col("prefix_tokens")).otherwise(0)
    cold = projected_cost(asked.select("request_id", "model", F.col("tokens_in").alias("input_tokens"), F.lit(0).cast("bigint").alias("cached_tokens"), "max_output_tokens"), prices)
    warm = projected_cost(asked.select("request_id", "model", (F.col("tokens_in") - cached).alias("input_tokens"), cached.cast("bigint").alias("cached_tokens"), "max_output_tokens"), prices)
    costs = cold.select("request_id", F.col("usd").alias("cold_usd")).join(warm.select("request_id", F.col("usd").alias("warm_usd")), "request_id")
    return requests.join(costs, "request_id", "left").withColumns({c: F.when(F.col("model").isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in ("cold_usd", "warm_usd")})


def ingest_projection(measured: DataFrame, tokens: int, n_chunks: dict[str, int]) -> DataFrame:
    """(label, n_chunks, configuration, per_second, hours): of measurements (configuration, tokens, n, seconds) the fastest at the length that occurs, and what it takes for so many chunks."""
    rate = measured.filter((F.col("tokens") == tokens) & (F.col("seconds") > 0)).select("configuration", (F.col("n") / F.col("seconds")).alias("per_second"))
    best = rate.orderBy(F.desc("per_second"), "configuration").limit(1).select(F.struct("configuration", "per_second").alias("b"))
    wanted = measured.sparkSession.createDataFrame(list(n_chunks.items()), "label string, n_chunks bigint")
    return wanted.withColumn("b", best.scalar()).select("label", "n_chunks", "b.*").withColumn("hours", F.col("n_chunks") / F.col("per_second") / 3600)


def sweep(samples: DataFrame, by: list[str], micros: str) -> DataFrame:
    """latency_percentiles of each configuration of a sweep, and which one is best: the least p95, then the least configuration."""
    p = latency_percentiles(samples, by, micros)
    # a handful of rows, one a configuration
    return p.withColumn("best", F.row_number().over(Window.orderBy("p95_ms", *by)) == 1)


def record_totals(records: DataFrame, key: str, stages: str) -> DataFrame:
    """(key, total_ms, n_stages) of an array of (name, micros) per record. Stages that are sums of others (named ..._total) don't count again."""
    own = F.filter(stages, lambda x: ~F.coalesce(x["name"].endswith("_total"), F.lit(False)))
    total = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["micros"], F.lit(0)))
    return records.select(key, F.coalesce(total / 1000, F.lit(0.0)).alias("total_ms"), F.coalesce(F.size(own), F.lit(0)).alias("n_stages"))


def record_attributes(records: DataFrame, key: str) -> DataFrame:
    """(key, attributes): a request record (tenant, route_tier, cache_outcome, cache_similarity, usd, degraded, candidates, tokens by class, price_version, model) as the map of strings that goes with its span; nulls are left out."""
    fields = {
        "tenant": F.col("tenant"), "route_tier": F.col("route_tier").cast("string"), "cache_outcome": F.col("cache_outcome"), "cost_usd": F.format_string("%.6f", F.coalesce("usd", F.lit(0.0))), "degraded": F.col("degraded").cast("string"),
        "candidates": F.col("candidates").cast("string"), "cache_similarity": F.when(F.col("cache_similarity").isNotNull(), F.format_string("%.4f", F.col("cache_similarity").cast("double"))),
        **{f"{c}_tokens": F.coalesce(f"{c}_tokens", F.lit(0)).cast("string") for c in TOKEN_CLASSES}, "price_version": F.col("price_version"), "model": F.col("model"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]), lambda e: e["value"].isNotNull())
    return records.select(key, F.map_from_entries(entries).alias("attributes"))


#: Columns by which every measure can be cut.
LABELS = ["tenant", "route_tier", "cache_outcome", "degraded"]


def observations(records: DataFrame) -> DataFrame:
    """(metric, tenant, route_tier, cache_outcome, degraded, label, value): what request records measure, one row an observation.

    stage_seconds of each of stages (name, micros), label its name; request_usd, without label; tokens of each class that
    isn't 0, label the class. histogram by (metric, labels, label) with LATENCY_BOUNDS or COST_BOUNDS makes the sink's table."""
    seconds = F.transform("stages", lambda x: F.struct(F.lit("stage_seconds").alias("metric"), x["name"].alias("label"), (x["micros"] / 1e6).alias("value")))
    cost = F.array(F.struct(F.lit("request_usd").alias("metric"), F.lit(None).cast("string").alias("label"), F.coalesce("usd", F.lit(0.0)).alias("value")))
    tokens = F.filter(F.array(*[F.struct(F.lit("tokens").alias("metric"), F.lit(c).alias("label"), F.coalesce(f"{c}_tokens", F.lit(0)).cast("double").alias("value")) for c in TOKEN_CLASSES]), lambda x: x["value"] != 0)
    rows = records.select(*LABELS, F.explode(F.concat(F.coalesce(seconds, F.array().cast("array<struct<metric:string,label:string,value:double>>")), cost, tokens)).alias("o"))
    return rows.select("o.metric", *LABELS, "o.label", "o.value")


def tokens_per_second(output_tokens: Column, total_ms: Column, first_ms: Column) -> Column:
    """Decode rate after the first token; 0 if no time passed."""
    seconds = (total_ms - first_ms) / 1000
    return F.when(seconds > 0, output_tokens / seconds).otherwise(F.lit(0.0))


def affordable(remaining: Column, fixed: Column, each: Column, most: int = 513) -> Column:
    """How many items of one cost fit beside a fixed cost, at most `most`; 0 if the fixed cost alone doesn't fit."""
    room = F.greatest(remaining - fixed, F.lit(0.0))
    return F.when(each <= 0, F.lit(most)).otherwise(F.least(F.floor(room / F.nullif(each, F.lit(0.0))), F.lit(most))).cast("int")


def trim_to_budget(ranked: DataFrame, group: str, rank: str, cost: str, budget: float) -> DataFrame:
    """Rows of each group, best first, as long as their running cost keeps the budget; the first row always stays."""
    running = F.sum(cost).over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(group).orderBy(rank)) == 1
    return ranked.withColumn("running_cost", running).withColumn("_first", first).filter((F.col("running_cost") <= budget) | F.col("_first")).drop("_first")


def sensitivity(costs: DataFrame, by: list[str], value: str, factors: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2)) -> DataFrame:
    """(by, factor, p95): the 95th percentile if every value were multiplied by a factor."""
    p95 = nearest_rank(costs, by, value, (0.95,))
    return p95.select(*by, F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"), F.col("p95").alias("_p")).select(*by, "factor", F.round(F.col("_p") * F.col("factor"), 6).alias("p95"))

"""Usage pings: hourly, half-day and latest summaries in batch and as streams, and ledger ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import round_half_up
from ..registry import query
from ..sources.driver_tables import Graph


def hourly(pings: DataFrame) -> DataFrame:
    """Runs by hour and language; of buckets the last in text order."""
    rows = pings.groupBy(F.window("ts", "1 hour").alias("w"), "lang")
    return rows.agg(F.count("*").alias("runs"), F.max("file_bucket").alias("max_bucket"), F.sum("has_byok").alias("byok")).select(F.col("w.start").alias("hour"), "lang", "runs", "max_bucket", "byok")


def hourly_stream(pings: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream; pings later than ``late`` are left out."""
    return hourly(pings.withWatermark("ts", late))


@query("telemetry_hourly", "pings", "select date_trunc('hour', ts) as hour, lang, count(*) as runs, max(file_bucket) as max_bucket, sum(has_byok) as byok from pings group by 1, 2")
def _hourly(g: Graph) -> DataFrame:
    return hourly(g.pings)


@query("telemetry_last_hour", "pings", "select lang, count(*) as runs, max(file_bucket) as max_bucket, sum(has_byok) as byok from pings where ts > (select max(ts) from pings) - interval 1 hour group by lang")
def _last_hour(g: Graph) -> DataFrame:
    """What the newest ping's last hour has, by language."""
    now = g.pings.agg(F.max("ts").alias("now"))
    rows = g.pings.crossJoin(F.broadcast(now)).where("ts > now - interval 1 hour")  # one row beside
    return rows.groupBy("lang").agg(F.count("*").alias("runs"), F.max("file_bucket").alias("max_bucket"), F.sum("has_byok").alias("byok"))


@query("telemetry_12h", "pings", "select time_bucket(interval 12 hours, ts, timestamp '1970-01-01') as start, lang, count(*) as runs, sum(has_byok) as byok, floor(avg(duration) + 0.5) as avg_duration, max(duration) as max_duration, count(distinct version) as versions from pings group by 1, 2")
def _half_day(g: Graph) -> DataFrame:
    rows = g.pings.groupBy(F.window("ts", "12 hours").alias("w"), "lang").agg(F.count("*").alias("runs"), F.sum("has_byok").alias("byok"), round_half_up(F.avg("duration")).alias("avg_duration"), F.max("duration").alias("max_duration"), F.countDistinct("version").alias("versions"))
    return rows.select(F.col("w.start").alias("start"), "lang", "runs", "byok", "avg_duration", "max_duration", "versions")


@query("telemetry_latest", "pings", "select lang, arg_max(version, (ts, id)) as version, max(ts) as ts from pings group by lang")
def _latest(g: Graph) -> DataFrame:
    return g.pings.groupBy("lang").agg(F.max_by("version", F.struct("ts", "id")).alias("version"), F.max("ts").alias("ts"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and the median of its finite values: the middle one, or the mean of the middle two rounded to a whole
    number; null for none. Values are counted first, so a key's values are never gathered."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & ~F.abs(F.col(value)).eqNullSafe(F.lit(float("inf"))))
    counted = finite.groupBy(key, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = counted.groupBy(key).agg(F.sum("n").alias("total"))
    placed = counted.withColumn("upto", upto).join(total, key)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    found = placed.groupBy(key, "total").agg(at(low).alias("low"), at(high).alias("high"))
    middle = found.select(key, F.when(F.col("total") % 2 == 0, round_half_up((F.col("low") + F.col("high")) / 2)).otherwise(F.col("low")).alias("median"))
    return rows.select(key).distinct().join(middle, key, "left")


@query("duration_median", "pings", "select version, case when n % 2 = 0 then floor((list_sort(v)[n // 2] + list_sort(v)[n // 2 + 1]) / 2 + 0.5) else list_sort(v)[n // 2 + 1] end as median from (select version, list(duration) as v, count(*) as n from (select version || case when id % 5 < 2 then 'a' else 'b' end as version, duration from pings) y group by version) x")
def _median(g: Graph) -> DataFrame:
    rows = g.pings.select(F.concat("version", F.when(F.col("id") % 5 < 2, "a").otherwise("b")).alias("version"), "duration")
    return medians(rows, "version", "duration")


@query("blocker_groups", "ledger", "select category, count(*) as n, list(target_id order by idx) filter (k <= 5) as targets, arg_min(target_id, idx) as representative, min(idx) as first from (select *, status as category, row_number() over (partition by status order by idx) as k from ledger where status in ('unproven', 'generated_unverifiable')) x group by category order by n desc, first")
def _blockers(g: Graph) -> DataFrame:
    """Blocked attempts by category: how many, the first five targets and the first of all; most first."""
    rows = g.ledger.where("status in ('unproven', 'generated_unverifiable')").select(F.col("status").alias("category"), "target_id", "idx")
    place = F.row_number().over(Window.partitionBy("category").orderBy("idx"))  # limited before the shuffle, too
    first = rows.withColumn("k", place).where("k <= 5").groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "target_id"))), lambda x: x["target_id"]).alias("targets"))
    counts = rows.groupBy("category").agg(F.count("*").alias("n"), F.min_by("target_id", "idx").alias("representative"), F.min("idx").alias("first"))
    return counts.join(first, "category").orderBy(F.desc("n"), "first")


@query("dominant_blocker", "ledger", "select status as category, count(*) as n from ledger where status in ('unproven', 'generated_unverifiable') group by status order by count(*) desc, min(idx) limit 1")
def _dominant(g: Graph) -> DataFrame:
    rows = g.ledger.where("status in ('unproven', 'generated_unverifiable')").groupBy(F.col("status").alias("category")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(1).select("category", "n")


@query("corpus_scope", "symbols", "select dir, count(distinct file) as files, floor(100.0 * count(distinct file) / (select count(distinct file) from symbols) * 10 + 0.5) / 10 as share_pct from symbols group by dir")
def _scope(g: Graph) -> DataFrame:
    files = g.symbols.select("dir", "file").distinct()
    total = files.agg(F.count("*").alias("all"))
    return files.groupBy("dir").agg(F.count("*").alias("files")).crossJoin(F.broadcast(total)).select("dir", "files", round_half_up(100.0 * F.col("files") / F.col("all"), 1).alias("share_pct"))  # one row beside


def distinct_runs(ledger: DataFrame, late: str = "1 hour") -> DataFrame:
    """A ledger stream without runs that were sent twice within the watermark."""
    return ledger.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"])

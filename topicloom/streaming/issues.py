"""The issue log: streams of append-only events, and batch twins of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.session import cut

EVENTS = "event_id bigint, issue_id string, action string, created_at timestamp"
HISTORY, RETRY_SECONDS, STAGGER_MS = 50, 60, 250
#: What raises an issue's version, and after how many micro-batches their states are merged.
EDITS, COMPACT = ("edited",), 50


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, late: str = "1 hour", files: int = 100) -> DataFrame:
    """Events as they arrive in Parquet files; an event that is delivered again within the watermark counts once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])


def activity(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(window_start, action, n) for tumbling windows; in a stream, in append mode."""
    return events.groupBy(F.window("created_at", width), "action").count().select(F.col("window.start").alias("window_start"), "action", F.col("count").alias("n"))


def state(events: DataFrame, edits: tuple[str, ...] = EDITS) -> DataFrame:
    """The current state of each issue: its last event by time, and its version, 1 and one more for each edit (a change of status raises no version, so versions don't order events)."""
    last = F.max_by(F.struct("action", "created_at", "event_id"), F.struct("created_at", "event_id"))
    own = events.groupBy("issue_id").agg(last.alias("s"), F.count("*").alias("n_events"), F.count_if(F.col("action").isin(*edits)).alias("n_edits"), F.min("created_at").alias("opened_at"))
    return own.select("issue_id", F.col("s.action").alias("status"), F.col("s.created_at").alias("updated_at"), F.col("s.event_id").alias("last_event_id"), "n_events", (F.col("n_edits") + 1).alias("version"), "opened_at")


def _merged(parts: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "updated_at", "last_event_id"), F.struct("updated_at", "last_event_id"))
    own = parts.groupBy("issue_id").agg(last.alias("s"), F.sum("n_events").alias("n_events"), (F.sum("version") - F.count("*") + 1).alias("version"), F.min("opened_at").alias("opened_at"))
    return own.select("issue_id", "s.*", "n_events", "version", "opened_at")


def upsert_state(path: str, edits: tuple[str, ...] = EDITS, compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each micro-batch's states are kept under its own id, so a batch that runs again replaces itself. Every `compact` batches those before are merged into one, so that at most `compact` and
    one are read; merged folders are named by their last batch and read instead of what they hold."""

    def write(batch: DataFrame, batch_id: int) -> None:
        state(batch, edits).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id and batch_id % compact == 0:
            read_state(batch.sparkSession, path, below=batch_id).write.mode("overwrite").parquet(f"{path}/upto={batch_id - 1}")

    return write


def read_state(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The issues' states over all micro-batches (or those below a number), the same rows as state() over all their events: the last merged folder that is complete, and the batches after it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    number = lambda kind: [n for x in done if x.startswith(kind) and ((n := int(x.split("=")[1])) < below if below is not None else (n := int(x.split("=")[1])) >= 0)]
    merged = max(number("upto="), default=-1)
    paths = [f"{path}/batch={n}" for n in sorted(number("batch=")) if n > merged] + ([f"{path}/upto={merged}"] if merged >= 0 else [])
    return _merged(spark.read.parquet(*paths))


def retry_due(issues: DataFrame, now: Column) -> DataFrame:
    """issues(queue, issue_id, remote_status, attempt_at string) that are due, staggered by rank in their queue: pending or failed, or sending without a valid attempt, or with one older than a minute."""
    attempt = F.try_to_timestamp("attempt_at")
    old = attempt.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(attempt) > RETRY_SECONDS)
    due = issues.where(F.col("remote_status").isin("pending", "failed") | ((F.col("remote_status") == "sending") & old))
    return due.withColumn("delay_ms", (F.row_number().over(Window.partitionBy("queue").orderBy("issue_id")) - 1) * STAGGER_MS)


def history(events: DataFrame, newest: int = HISTORY) -> DataFrame:
    """Each issue's newest events, numbered from the newest."""
    by = Window.partitionBy("issue_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= newest)


def import_history(events: DataFrame, issues: DataFrame) -> DataFrame:
    """Events, and one imported event for each issue that has none."""
    bare = issues.join(events.select("issue_id"), "issue_id", "left_anti")
    return events.select("issue_id", "action", "created_at").union(bare.select("issue_id", F.lit("imported"), "created_at"))


def queue(issues: DataFrame, show: str = "all") -> DataFrame:
    """Issues that are shown, newest first."""
    keep = {"all": F.lit(True), "open": F.col("status") != "resolved", "resolved": F.col("status") == "resolved"}[show]
    return issues.where(keep).orderBy(F.desc("updated_at"), "issue_id")


def migrate_routes(issues: DataFrame, resolved: DataFrame) -> DataFrame:
    """issues(issue_id, domain_id, node_id, remote_status) at the places of resolved(key, domain_id, node_id), with their page hash; a missing remote status is pending."""
    to = resolved.select(F.col("key").alias("issue_id"), F.col("domain_id").alias("_d"), F.col("node_id").alias("_n"))
    at = issues.join(to, "issue_id").select("issue_id", F.col("_d").alias("domain_id"), F.col("_n").alias("node_id"), F.coalesce("remote_status", F.lit("pending")).alias("remote_status"))
    return at.withColumn("page_hash", F.concat(F.lit("#/"), "domain_id", F.lit("/"), F.coalesce("node_id", F.lit(""))))


#: Bytes of encoded issues that a packet is filled to; an issue of more is a packet of its own.
PACKET_BYTES = 4 << 20


def review_packets(issues: DataFrame, events: DataFrame, packet_bytes: int = PACKET_BYTES) -> DataFrame:
    """(packet, issues, document): JSON documents for reviewers, each with the summary of all issues, a run of issues by id, and their newest events.

    Running sums of the encoded bytes decide the packets, so that they grow in number with the data and not in size. Issues are dealt into ranges of ids; each range sums its own, after those before it."""
    told = history(events).groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "action"))).alias("history"))
    each = issues.select("issue_id", "status").join(told, "issue_id", "left").select("issue_id", F.to_json(F.struct("issue_id", "status", F.coalesce("history", F.array().cast(dict(told.dtypes)["history"])).alias("history"))).alias("doc"))
    ranged = cut(each.withColumn("bytes", F.octet_length("doc").cast("long")).repartitionByRange("issue_id").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("bytes").alias("_sum"))  # a row a range
    before = cut(sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before")))
    running = F.sum("bytes").over(Window.partitionBy("_range").orderBy("issue_id")) - F.col("bytes") + F.col("_before")
    at = ranged.join(F.broadcast(before), "_range").withColumn("packet", F.floor(running / packet_bytes))
    done = F.col("status").eqNullSafe("resolved")
    summary = issues.agg(F.count("*").alias("total"), F.count_if(~done).alias("open"), F.count_if(done).alias("resolved")).join(events.agg(F.count("*").alias("history_events")))  # one row each
    packets = at.groupBy("packet").agg(F.count("*").alias("issues"), F.array_join(F.array_sort(F.collect_list("doc")), ",").alias("docs")).join(F.broadcast(summary))
    head = F.to_json(F.struct(F.struct("total", "open", "resolved", "history_events").alias("summary"), "packet"))
    return packets.select("packet", "issues", F.concat(F.substring_index(head, "}", 2), F.lit(',"issues":['), "docs", F.lit("]}")).alias("document"))


def write_packets(packets: DataFrame, path: str) -> None:
    """A JSON document a packet, in a folder of its name."""
    packets.select(F.concat(F.lit("packet-"), F.lpad(F.col("packet").cast("string"), 6, "0"), F.lit(".json")).alias("name"), "document").write.partitionBy("name").text(path)

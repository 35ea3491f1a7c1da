"""The embedding pipeline: a job queue as pure transitions on a DataFrame, and its Structured Streaming driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions.semantics import InvalidParameter
from tidemill.operators.ai import embed_column
from tidemill.operators.change_feed import current_version, publish, read_current
from tidemill.operators.chunk import check, chunk_column
from tidemill.session import cut

MAX_ATTEMPTS = 5
LEASE_SECONDS = 60
DEAD_LETTERS = 1000


@dataclass
class Vectorizer:
    """A registered pipeline from a source column to embedded chunks, or in place without a chunk strategy."""

    id: int
    pk: str
    content: str
    dims: int
    embed: Callable[[list[str]], list[list[float]]]
    chunk_strategy: str | None = None
    chunk_size: int = 512
    chunk_overlap: int = 64

    def __post_init__(self) -> None:
        if self.dims <= 0:
            raise InvalidParameter("dims must be positive")
        if self.chunk_strategy is not None:
            check(self.chunk_strategy, self.chunk_size, self.chunk_overlap)


def coalesce_jobs(queue: DataFrame, seq: str = "job_id") -> DataFrame:
    """At most one pending job a (vectorizer_id, source_pk): the last operation wins, the place in the queue stays.

    A job delivered more than once is one job; of deliveries that spell its operation differently the
    alphabetically last spelling counts (after white space and letter case are made alike).
    """
    pending = queue.where("state = 'pending'").withColumn("op", F.lower(F.trim("op")))
    return pending.groupBy("vectorizer_id", "source_pk").agg(
        F.min(seq).alias(seq), F.max_by("op", F.when(F.col("op").isNotNull(), F.struct(seq, "op"))).alias("op"), F.min("enqueued_at").alias("enqueued_at"), F.max("attempts").alias("attempts")
    )


def backoff_seconds(attempts: Column) -> Column:
    """min(2^min(attempts, 12), 300)."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(12))), F.lit(300.0))


def claimable(now: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Pending past its backoff, or processing with an expired lease, and not out of attempts."""
    waiting = (F.col("state") == "pending") & (F.col("lease_deadline").isNull() | (F.col("lease_deadline") <= now))
    expired = (F.col("state") == "processing") & (F.col("lease_deadline") < now)
    return F.coalesce((waiting | expired) & (F.coalesce("attempts", F.lit(0)) < max_attempts), F.lit(False))


def seconds(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def claim(queue: DataFrame, owner: str, now: Column, limit: int, lease: int = LEASE_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The queue after ``owner`` took the first ``limit`` claimable jobs; each counts one more attempt."""
    picked = queue.where(claimable(now, max_attempts)).orderBy("job_id").limit(limit).select("job_id", F.lit(True).alias("__hit"))
    hit = F.coalesce("__hit", F.lit(False))
    return queue.join(picked, "job_id", "left").select(
        *[
            F.when(hit, value).otherwise(F.col(c)).alias(c) if value is not None else F.col(c)
            for c, value in ((c, {"state": F.lit("processing"), "owner": F.lit(owner), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "lease_deadline": now + seconds(F.lit(lease))}.get(c)) for c in queue.columns)
        ]
    )


def finish(queue: DataFrame, owner: str, job_ids: list[int]) -> DataFrame:
    """Remove done jobs that ``owner`` still holds."""
    mine = (F.col("owner") == owner) & (F.col("state") == "processing") & F.col("job_id").isin(job_ids)
    return queue.where(~F.coalesce(mine, F.lit(False)))


def fail(queue: DataFrame, owner: str, job_ids: list[int], error: str, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed jobs that ``owner`` holds wait for their backoff, or fail for good after the last attempt."""
    mine = F.coalesce((F.col("owner") == owner) & (F.col("state") == "processing") & F.col("job_id").isin(job_ids), F.lit(False))
    final = F.col("attempts") >= max_attempts
    changes = {
        "state": F.when(final, F.lit("failed")).otherwise(F.lit("pending")), "lease_deadline": F.when(~final, now + seconds(backoff_seconds(F.col("attempts")))), "owner": F.lit(None).cast("string"), "last_error": F.lit(error),
    }
    return queue.select(*[F.when(mine, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in queue.columns])


def renew(queue: DataFrame, owner: str, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    mine = F.coalesce((F.col("owner") == owner) & (F.col("state") == "processing"), F.lit(False))
    return queue.withColumn("lease_deadline", F.when(mine, now + seconds(F.lit(lease))).otherwise(F.col("lease_deadline")))


def reap(queue: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs whose lease ran out on their last attempt fail for good."""
    dead = F.coalesce((F.col("state") == "processing") & (F.col("lease_deadline") < now) & (F.col("attempts") >= max_attempts), F.lit(False))
    return queue.withColumn("last_error", F.when(dead, F.lit("lease expired")).otherwise(F.col("last_error"))).withColumn("state", F.when(dead, F.lit("failed")).otherwise(F.col("state")))


def purge(queue: DataFrame, keep: int = DEAD_LETTERS) -> DataFrame:
    """Only the ``keep`` newest failed jobs stay."""
    kept = queue.where("state = 'failed'").orderBy(F.desc("job_id")).limit(keep)
    return queue.where("state is null or state <> 'failed'").unionByName(kept)


def stats(queue: DataFrame) -> DataFrame:
    """Jobs by vectorizer and state, with the oldest waiting one."""
    return queue.groupBy("vectorizer_id", "state").agg(F.count(F.lit(1)).alias("jobs"), F.min("enqueued_at").alias("oldest"))


def embed_jobs(v: Vectorizer, jobs: DataFrame) -> DataFrame:
    """(source_pk, chunk_index, chunk_text, embedding) of the rows to set; one model call per Arrow batch."""
    text = F.col(v.content)
    pieces = F.array(text) if v.chunk_strategy is None else chunk_column(text, v.chunk_strategy, v.chunk_size, v.chunk_overlap)
    rows = jobs.where("op <> 'delete'").select(F.col(v.pk).cast("string").alias("source_pk"), F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return rows.withColumn("embedding", embed_column(F.col("chunk_text"), v.embed, v.dims))


def last_changes(batch: DataFrame, pk: str, seq: str) -> DataFrame:
    """The last change of each key of a micro-batch; rows without a key or sequence number change nothing."""
    w = Window.partitionBy(pk).orderBy(F.desc(seq))
    return batch.where(F.col(pk).isNotNull() & F.col(seq).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


#: Parts of a target; a micro-batch reads and rewrites only those its keys fall into.
BUCKETS = 64
TARGET = "source_pk string, seq long, deleted boolean, chunk_index int, chunk_text string, embedding array<float>"


class Target:
    """The chunks of a vectorizer in buckets of keys, each key with the sequence number of its last change.

    A version is a small table of the folder of each bucket. A commit writes the touched buckets to new
    folders and publishes the next version, so readers see a micro-batch as a whole or not at all. A row
    with chunk_index -1 holds a key's sequence number and whether it is deleted.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def folders(self) -> dict[int, str]:
        """Bucket to folder; empty only where nothing was ever published."""
        if current_version(self.spark, self.root) is None:
            return {}
        return {r.bucket: r.folder for r in read_current(self.spark, self.root).collect()}

    def rows(self, only: set[int] | None = None) -> DataFrame:
        held = [f for b, f in self.folders().items() if only is None or b in only]
        return self.spark.read.schema(TARGET).parquet(*held) if held else self.spark.createDataFrame([], TARGET)

    def read(self) -> DataFrame:
        """(source_pk, chunk_index, chunk_text, embedding, seq) of all current chunks."""
        return self.rows().where("chunk_index >= 0").select("source_pk", "chunk_index", "chunk_text", "embedding", "seq")

    def apply(self, v: Vectorizer, jobs: DataFrame, seq: str) -> int:
        """Apply the last change of each key where it is newer than what is stored; returns the buckets rewritten."""
        bucket = F.pmod(F.xxhash64("source_pk"), F.lit(self.buckets)).cast("int")
        keyed = jobs.withColumn("source_pk", F.col(v.pk).cast("string"))
        touched = {r.b for r in keyed.select(bucket.alias("b")).distinct().collect()}
        if not touched:
            return 0
        old = self.rows(touched)
        stored = old.groupBy("source_pk").agg(F.max("seq").alias("__stored"))
        newer = cut(keyed.join(stored, "source_pk", "left").where(F.col("__stored").isNull() | (F.col(seq) > F.col("__stored"))))
        marks = newer.select("source_pk", F.col(seq).cast("long").alias("seq"), (F.col("op") == "delete").alias("deleted"))
        fresh = embed_jobs(v, newer).join(marks, "source_pk")
        holders = marks.select("*", F.lit(-1).alias("chunk_index"), F.lit(None).cast("string").alias("chunk_text"), F.lit(None).cast("array<float>").alias("embedding"))
        now = old.join(marks.select("source_pk"), "source_pk", "left_anti").unionByName(fresh).unionByName(holders)
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        now.select("source_pk", "seq", "deleted", "chunk_index", "chunk_text", "embedding", bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(data)
        held = self.folders() | {b: f"{data}/bucket={b}" for b in touched}
        publish(self.spark.createDataFrame(sorted(held.items()), "bucket int, folder string").coalesce(1), self.root)
        return len(touched)


def run_vectorizer(spark: SparkSession, v: Vectorizer, source_dir: str, schema: str, target: str, checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Process all changes that arrived in ``source_dir`` (Parquet files with op and ``seq``) and keep ``target`` current.

    The streaming checkpoint takes the place of leases: a micro-batch that was lost with its executors runs
    again. A change is applied only where its ``seq`` is above the key's stored one, deletes included, so
    repeated and late changes do no harm. A target that cannot be read stops the query. Read the result with
    ``Target(spark, target).read()``.
    """
    held = Target(spark, target)

    def process(batch: DataFrame, batch_id: int) -> None:
        jobs = last_changes(batch, v.pk, seq).persist()
        try:
            held.apply(v, jobs, seq)
        finally:
            jobs.unpersist()

    changes = spark.readStream.schema(schema).parquet(source_dir)
    return changes.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class VectorizerRegistry:
    """Registered vectorizers by id; the callable that embeds is given again when a registry is opened."""

    def __init__(self) -> None:
        self._held: dict[int, Vectorizer] = {}

    def create(self, pk: str, content: str, dims: int, embed, chunk_strategy: str | None = None, chunk_size: int = 512, chunk_overlap: int = 64) -> int:
        """Register a vectorizer under the next id."""
        number = max(self._held, default=0) + 1
        self._held[number] = Vectorizer(number, pk, content, dims, embed, chunk_strategy, chunk_size, chunk_overlap)
        return number

    def get(self, number: int) -> Vectorizer:
        if number not in self._held:
            raise InvalidParameter(f"unknown vectorizer {number}")
        return self._held[number]

    def drop(self, number: int) -> bool:
        return self._held.pop(number, None) is not None

    def save(self, spark: SparkSession, root: str) -> None:
        rows = [(v.id, v.pk, v.content, v.dims, v.chunk_strategy, v.chunk_size, v.chunk_overlap) for v in self._held.values()]
        publish(spark.createDataFrame(rows, "id int, pk string, content string, dims int, chunk_strategy string, chunk_size int, chunk_overlap int").coalesce(1), root)

    @classmethod
    def open(cls, spark: SparkSession, root: str, embed) -> "VectorizerRegistry":
        registry = cls()
        for r in read_current(spark, root).collect():
            registry._held[r.id] = Vectorizer(r.id, r.pk, r.content, r.dims, embed, r.chunk_strategy, r.chunk_size, r.chunk_overlap)
        return registry


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling event-time counts; on a stream, rows later than the watermark are dropped, on a table none is."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("__ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows of each key."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    return rows.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), key, "n")

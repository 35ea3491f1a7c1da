"""Applying a feed of inserts, updates and deletes to rebuild the current rows of tables.

Changes are first reduced within each input partition to the last one of each key, so that a key with any
share of the feed reaches its bucket as a few rows. A bucket is a hash range of keys. In each bucket an
embedded DuckDB table holds the state; batches are upserted with a conflict clause that compares the stored
sequence number, so order and repetition of deliveries do not matter, and deletes stay as tombstones. The
bucket results form one DataFrame; ``publish`` writes them as a new version and switches a pointer file in
one rename, so readers see all buckets or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys a bucket holds on average; its DuckDB table stays in memory.
BUCKET_ROWS = 200_000
SETS = ["insert", "update", "upsert"]
DELETE = "delete"
BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def upsert_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of one bucket after all its changes, tombstones included."""
    import duckdb

    # nothing is spilled to a folder of the machine: a bucket that does not fit is an error that asks for more buckets
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute("CREATE TABLE state (owner BIGINT, pk VARCHAR, seq BIGINT, deleted BOOLEAN, payload VARCHAR, PRIMARY KEY (owner, pk))")
    for batch in batches:
        if len(batch):
            con.register("incoming", pa.Table.from_batches([batch]))
            con.execute(
                """INSERT INTO state
                SELECT owner, pk, seq, deleted, payload FROM incoming QUALIFY row_number() OVER (PARTITION BY owner, pk ORDER BY seq DESC) = 1
                ON CONFLICT (owner, pk) DO UPDATE SET seq = excluded.seq, deleted = excluded.deleted, payload = excluded.payload WHERE excluded.seq > state.seq"""
            )
            con.unregister("incoming")
    out = con.sql("SELECT owner, pk, seq, deleted, payload FROM state").to_arrow_table()
    con.close()
    yield from out.to_batches(max_chunksize=10_000)


def apply_changes(changes: DataFrame, owner: str, pk: str, op: str, seq: str, payload: str | None = None, state: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows after all changes in the order of ``seq``, as (owner, pk, seq, deleted, payload).

    A row is identified by owner and pk, the latter without surrounding white space. ``op`` without
    surrounding white space and in any letter case is insert, update or upsert, which set the row whether
    it exists or not, or delete, which leaves a tombstone. Any other op and a null op, owner, pk or seq
    changes nothing; an empty pk is a key. A sequence number delivered again is one change. ``state`` is an
    earlier result to go on from, with its tombstones. Empty feeds give the state or no rows.
    """
    kind = F.lower(F.regexp_replace(op, BLANK, ""))
    clean = changes.select(
        F.col(owner).cast("long").alias("owner"), F.regexp_replace(F.col(pk).cast("string"), BLANK, "").alias("pk"), F.col(seq).cast("long").alias("seq"),
        kind.alias("kind"), (F.col(payload).cast("string") if payload else F.lit(None).cast("string")).alias("payload"),
    ).where(F.col("kind").isin(*SETS, DELETE) & F.col("owner").isNotNull() & F.col("pk").isNotNull() & F.col("seq").isNotNull())
    rows = clean.select("owner", "pk", "seq", (F.col("kind") == DELETE).alias("deleted"), F.when(F.col("kind") != DELETE, F.col("payload")).alias("payload"))
    if state is not None:
        rows = rows.unionByName(state.select("owner", "pk", "seq", "deleted", "payload"))
    spark = changes.sparkSession
    held = changes.count() + (state.count() if state is not None else 0)  # of a scan this reads footers only
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // bucket_rows))
    return rows.mapInArrow(last_of_each, rows.schema).repartition(buckets, "owner", "pk").mapInArrow(upsert_bucket, rows.schema)


def last_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per input partition, the last change of each key of every stretch of batches of up to 200,000 rows."""

    def reduced(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([("owner", "ascending"), ("pk", "ascending"), ("seq", "descending")])
        own, pk = table["owner"].combine_chunks(), table["pk"].combine_chunks()
        if len(table) > 1:
            same = pc.and_(pc.equal(own[1:], own[:-1]), pc.equal(pk[1:], pk[:-1]))
            table = table.filter(pa.chunked_array([pa.array([True]), pc.invert(same)]))
        yield from table.to_batches(max_chunksize=10_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= 200_000:
            yield from reduced(held)
            held, n = [], 0
    if n:
        yield from reduced(held)


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` current under ``root`` in one atomic rename."""
    staged, fs = file_system(spark, f"{root}/.current-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(path(f"{root}/CURRENT")), overwrite)


def publish(df: DataFrame | dict[str, DataFrame], root: str, partition_by: str | None = None) -> str:
    """Write ``df`` as a new version under ``root`` and make it current in one atomic rename; returns its path.

    Several named tables become visible together. ``partition_by`` lays the files out by that column.
    """
    version = f"version-{uuid.uuid4().hex}"
    parts = df if isinstance(df, dict) else {"": df}
    for name, part in parts.items():
        part.write.parquet(f"{root}/{version}/{name}".rstrip("/"), partitionBy=partition_by if partition_by in part.columns else None)
    switch(part.sparkSession, root, version)
    return f"{root}/{version}"


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the current version, or None where nothing was ever published; a failing read is an error."""
    pointer, fs = file_system(spark, f"{root}/CURRENT")
    return spark.read.text(f"{root}/CURRENT").first()[0] if fs.exists(pointer) else None


def read_current(spark: SparkSession, root: str, name: str = "") -> DataFrame:
    """The version that ``publish`` made current last, or one of its tables."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing was published under {root}")
    return spark.read.parquet(f"{root}/{version}/{name}".rstrip("/"))


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove all versions but the current one, once no reader holds an older one; returns how many."""
    keep = current_version(spark, root)
    folder, fs = file_system(spark, root)
    old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("version-") and f.getPath().getName() != keep]
    return sum(fs.delete(p, True) for p in old)

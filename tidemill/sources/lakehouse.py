"""Parquet in and out, snapshots of relations with a catalog, and import of vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter
from tidemill.operators.change_feed import current_version, publish, read_current


class NoSnapshot(LookupError):
    """The relation has no snapshot (SQLSTATE P0002)."""


def row_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a row, null fields kept."""
    df = spark.read.parquet(path)
    return df.select(row_json(df).alias("row"))


def write_parquet(df: DataFrame, root: str) -> int:
    """Write all rows and switch readers over at once; returns the number of rows.

    The relation stays a directory with as many files as tasks; a single file would put it through one.
    """
    publish(df, root)
    return read_current(df.sparkSession, root).count()


def insert_rows(df: DataFrame, root: str) -> int:
    """Append rows to the relation under ``root``, which is made if it is not there; returns how many.

    The rows go to a folder of their own, and the next version of the list of folders makes them visible at
    once, so readers see all of an insert or none and a job that fails leaves nothing to read.
    """
    spark = df.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    before = [] if current_version(spark, root) is None else [r.folder for r in read_current(spark, root).collect()]
    publish(spark.createDataFrame([(f,) for f in [*before, folder]], "folder string").coalesce(1), root)
    return spark.read.parquet(folder).count()


def read_inserted(spark: SparkSession, root: str) -> DataFrame:
    """All rows inserted so far; columns that came later are null in earlier rows."""
    return spark.read.option("mergeSchema", "true").parquet(*[r.folder for r in read_current(spark, root).collect()])


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Projected and filtered scan; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def min_max_count(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(min, max, n) of a column, from the statistics in the footers alone where the type has them there.

    The relation is read by the reader that pushes aggregates down; strings and timestamps are scanned.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get("spark.sql.sources.useV1SourceList", None)
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList") if before is None else spark.conf.set("spark.sql.sources.useV1SourceList", before)
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.count(F.lit(1)).alias("n"))


def row_groups(spark: SparkSession, path: str, column: str, low, high) -> DataFrame:
    """(file, scanned, skipped): row groups whose statistics allow a value from ``low`` to ``high``, and the others. Read from footers, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanned, skipped = [], []
            for uri in batch.column(0).to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == column)
                groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                live = [s is None or not s.has_min_max or (s.max >= low and s.min <= high) for s in groups]
                scanned.append(sum(live))
                skipped.append(len(live) - sum(live))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scanned, pa.int32()), pa.array(skipped, pa.int32())], names=["file", "scanned", "skipped"])

    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "file string, scanned int, skipped int")


def olap(df: DataFrame, category: str = "category", amount: str = "amount") -> DataFrame:
    """(category, c, a): rows and average of each category, rounded to four places."""
    return df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("c"), F.round(F.avg(amount), 4).alias("a"))


class SnapshotCatalog:
    """Snapshots of relations under one folder; the catalog itself is a small published table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: dict[str, tuple[str, datetime]] = {}

    def _note(self, relation: str, path: str) -> datetime:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.entries[relation] = (path, now)
        rows = [(r, p, t) for r, (p, t) in sorted(self.entries.items())]
        publish(self.spark.createDataFrame(rows, "relation string, path string, refreshed_at timestamp_ntz"), f"{self.root}/catalog")
        return now

    def open(self) -> "SnapshotCatalog":
        """Read the entries that another session published."""
        self.entries = {r.relation: (r.path, r.refreshed_at) for r in read_current(self.spark, f"{self.root}/catalog").collect()}
        return self

    def refresh(self, relation: str, df: DataFrame) -> datetime:
        """Write a new snapshot; readers of the old one keep it."""
        return self._note(relation, publish(df, f"{self.root}/{relation}"))

    def register(self, relation: str, path: str) -> datetime:
        if not path or not path.strip():
            raise InvalidParameter("the path must not be blank")
        return self._note(relation, path)

    def read(self, relation: str) -> DataFrame:
        if relation not in self.entries:
            raise NoSnapshot(relation)
        return self.spark.read.parquet(self.entries[relation][0])

    def olap(self, relation: str, category: str = "category", amount: str = "amount") -> DataFrame:
        return olap(self.read(relation), category, amount)

    def freshness(self, relation: str) -> DataFrame:
        """The age of the snapshot as an interval."""
        if relation not in self.entries:
            raise NoSnapshot(relation)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        return self.spark.createDataFrame([(self.entries[relation][1], now)], "a timestamp_ntz, b timestamp_ntz").select((F.col("b") - F.col("a")).alias("freshness"))


class ColumnCache:
    """Columns of relations kept in memory, by version; a new version drops the old one, at most ``limit`` entries stay."""

    def __init__(self, limit: int = 16):
        self.limit, self._held = limit, {}

    def columnarize(self, name: str, df: DataFrame, columns: list[str], version: int = 0) -> DataFrame:
        old = self._held.get(name)
        if old and old[0] == (version, tuple(columns)):
            return old[1]
        self.drop(name)
        while len(self._held) >= self.limit:
            self.drop(next(iter(self._held)))
        self._held[name] = ((version, tuple(columns)), df.select(*columns).persist())
        return self._held[name][1]

    def drop(self, name: str) -> None:
        if name in self._held:
            self._held.pop(name)[1].unpersist()


def parse_vectors(df: DataFrame, json_col: str) -> DataFrame:
    """(id, embedding, metadata) of JSON arrays of ``{id, values, metadata?}``; a missing id or values is an error, ids become text, metadata defaults to {}."""
    items = F.from_json(json_col, "array<struct<id:string,values:array<float>,metadata:string>>")
    rows = df.select(F.explode(items).alias("v"))
    bad = F.col("v.id").isNull() | F.col("v.values").isNull()
    return rows.select(F.when(~bad, F.col("v.id")).otherwise(F.raise_error(F.lit("a vector needs id and values")).cast("string")).alias("id"), F.col("v.values").alias("embedding"), F.coalesce("v.metadata", F.lit("{}")).alias("metadata"))


def import_vectors(df: DataFrame, json_col: str, target: str) -> int:
    """Append all vectors to the target, all or none; returns how many."""
    rows = parse_vectors(df, json_col).persist()
    try:
        n = rows.count()
        rows.write.mode("append").parquet(target)
        return n
    finally:
        rows.unpersist()


def import_vectors_chunked(df: DataFrame, json_col: str, target: str, chunk_size: int = 1000) -> int:
    """Append in commits of about ``chunk_size`` vectors; what is committed before an error stays."""
    if chunk_size <= 0:
        raise InvalidParameter("chunk_size must be positive")
    rows = parse_vectors(df, json_col).withColumn("__part", F.floor(F.monotonically_increasing_id() / chunk_size)).persist()
    try:
        parts = [r[0] for r in rows.select("__part").distinct().orderBy("__part").collect()]
        for p in parts:
            rows.where(F.col("__part") == p).drop("__part").write.mode("append").parquet(target)
        return rows.count()
    finally:
        rows.unpersist()

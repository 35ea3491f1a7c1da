"""Session settings and the shared folder that operators use to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out by ``scratch_path`` that ``clean_scratch`` removes.
_scratch: list[str] = []


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent and all work is on one machine (tests) a temporary folder is made,
    which goes when the process ends; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and read it from there: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def clean_scratch(spark: SparkSession) -> int:
    """Remove all scratch paths made so far, once nothing reads them any more; returns how many."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    done = 0
    while _scratch:
        p = path(_scratch.pop())
        done += p.getFileSystem(conf).delete(p, True)
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table for work that is heavy a row: fewer partitions than cores (few files) are dealt out to all cores.

    For plain scans only, whose partitions are known without running anything. With many files nothing is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)

"""Session helpers: a local session for tests, checkpoints, partition spread."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "8g", app: str = "kestrel") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; without it a local one of our own, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "kestrel-checkpoints")
    return where


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below the shared one; it is deleted when the application ends."""
    sc = spark.sparkContext
    where = f"{shared_dir(spark).rstrip('/')}/kestrel-{sc.applicationId}"
    if getattr(sc, "_kestrel_scratch", None) != where:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._kestrel_scratch = where
    return where


def each_once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key, any of those that repeat it.  Only keys are counted and shuffled; rows that no other repeats stay where they are.

    The repeated keys are a table of their own, so Spark broadcasts them where
    they are few; where they aren't, rows are shuffled to them.  Rows with a
    null in their key are left out.
    """
    many = materialized(df.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("n_")).where("n_ > 1").select(*keys), "repeated")
    some = df.dropna(subset=list(keys))
    return some.join(many, [*keys], "left_anti").unionByName(some.join(many, [*keys], "left_semi").dropDuplicates([*keys])).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: few large input files are dealt out once, many are left alone."""
    sc = df.sparkSession.sparkContext
    n = df.rdd.getNumPartitions()
    return df.repartition(sc.defaultParallelism) if n < sc.defaultParallelism else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_kestrel_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="kestrel-")) / "kestrel-package.zip"  # Spark serves this file while the application lives
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(name))
    sc._kestrel_shipped = True


#: Rows of one Arrow batch between the JVM and a Python worker where rows are whole texts, and bytes a worker works on at a time.
TEXT_BATCH_ROWS, TEXT_BYTES = 64, 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small.  Spark reads this when a plan is run, so it stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def by_bytes(batches, limit: int = TEXT_BYTES):
    """The same rows in Arrow batches of at most ``limit`` bytes; a longer row goes alone."""
    for b in batches:
        todo = [b]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > limit:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
            else:
                yield x


def materialized(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it is computed once, and lost executors cost nothing."""
    spark = df.sparkSession
    where = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition) if partition else df.write).parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.kestrel_path = where
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kestrel_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Sessions and lineage cuts."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or by the context. Only a local session may have one of its own, as executors
    elsewhere wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="archloom-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def own_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Makes Spark delete a finished execution's shuffle files.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there; survives lost executors. The shuffle files that
    led to them are deleted, as nothing reads them again. Columns of ids and hashes take much less room than in a checkpoint."""
    spark = frame.sparkSession
    folder, before = own_folder(spark, "cut"), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        frame.select("*").write.parquet(folder)  # a frame of its own, which no other action runs
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(frame.schema).parquet(folder)


def cut_counted(frame: DataFrame, *counts: Column) -> tuple[DataFrame, tuple[int, ...]]:
    """`cut`, with aggregates of the rows taken while they are written, so that counting them needs no job of its own. Tasks
    that run again count once, as the rows are counted in the writing stage itself."""
    seen, names = Observation(), [f"n{i}" for i in range(len(counts))]
    out = cut(frame.observe(seen, *(c.alias(n) for c, n in zip(counts, names, strict=True))))
    got = seen.get
    if not got:  # the rows were known to be none before any task ran
        return out, tuple(out.agg(*counts).first())
    return out, tuple(got[n] for n in names)

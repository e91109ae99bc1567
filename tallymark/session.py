"""Session defaults for local runs and tests; on a cluster the submitted configuration wins."""
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app="tallymark", cpus=None, shuffle_partitions=8, memory="8g"):
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark):
    """The shared checkpoint folder the session names. Only in local mode, where it names none, is a folder made: executors on
    other machines could not see it."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="tallymark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def settle(df):
    """The rows as computed once: a Parquet table below the shared checkpoint folder. It cuts the lineage and survives lost executors, and
    Spark knows its true size: a checkpoint keeps the estimate of its origin, by which large tables were broadcast."""
    return written(df, "settled")


def work_dir(spark, name):
    """A new folder for written intermediates below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name):
    """The rows as a Parquet table below the checkpoint folder. The plan forgets everything about its origin, so that loops don't drag
    the constraints of all their rounds along."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

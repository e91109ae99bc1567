"""Running a stream to its end: replayed inputs, file sinks, small complete results."""
import uuid

from pyspark.sql import functions as F

from ..session import work_dir, written


ROWS_PER_FILE = 1_000_000


def replay(df, order, slices=4, flush=None):
    """A batch table as a stream of `slices` micro-batches in the order of a numeric column: written slice by slice into a new
    folder and read back one slice per trigger. Slices hold about equally many rows and are written as the same number of
    files, one per million rows. `flush` rows (same schema, or a function that takes them from the table) come last, to move the
    watermark past the end. The table is stored first, because slices, cuts and flush rows read it again and again. On a real
    deployment the source is a topic or a landing folder; everything after it is the same."""
    spark = df.sparkSession
    df = written(df, "staged")
    path = work_dir(spark, "replay")
    cuts = F.percentile_approx(order, F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(10000))
    total, edges = df.agg(F.count(F.lit(1)), cuts).first()
    files = max(1, total // (slices * ROWS_PER_FILE))
    edges = [None, *(edges or []), None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = F.lit(True) if lo is None else F.col(order) > lo
        inside = inside if hi is None else inside & (F.col(order) <= hi)
        part = df.filter(inside | F.col(order).isNull() if lo is None else inside)       # rows without an order come first
        part.repartition(files).write.mode("append").parquet(path)
    if flush is not None:
        flush = flush(df) if callable(flush) else flush
        flush.select(*df.columns).coalesce(1).write.mode("append").parquet(path)     # one row
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream, name="stream"):
    """Run an append-mode stream until its input is used up, into an exactly-once parquet sink; returns the written table."""
    spark = stream.sparkSession
    out = work_dir(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_small(stream, name="small"):
    """Run a complete-mode aggregation whose result has a fixed small number of rows; returns the final result."""
    spark = stream.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    q = (stream.writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", f"{work_dir(spark, name)}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(table)

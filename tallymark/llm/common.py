"""Shared helpers: words, stored intermediates, size-checked broadcasts."""
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.vectors import let
from ..session import work_dir

SPACE = " \t\n\x0b\x0c\r"                  # the blanks between words (fixed values)
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20

# Parquet options (fixed names): sorted hashes as packed differences; columns of repeated 64-bit words as dictionaries
PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
LOOKED_UP = {"parquet.dictionary.page.size": str(16 << 20)}
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

__all__ = ["BROADCAST_BYTES", "LOOKED_UP", "PACKED", "SPACE", "WORD", "dropped", "let", "no_clash", "small_side", "stored", "text_of", "words"]


def text_of(col):
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text):
    """Array of the words of a non-null text: maximal runs without the six ASCII blanks."""
    return let(F.btrim(text, F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def stored(df, name, by=None, options=None):
    """The rows written as Parquet below the shared folder and read back: cuts lineage and survives lost executors. Shuffles
    that the write needed are deleted when it ends, because nothing reads them again. `by` names a column of few values to lay
    the files out by, `options` are the writer's."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with _shuffles_end(spark):
        write = df.write.options(**(options or {}))
        (write.partitionBy(by) if by else write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def _shuffles_end(spark):
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)


def dropped(*tables):
    """Deletes tables made by `stored` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df, row_bytes, limit=BROADCAST_BYTES):
    """Marks `df` for broadcast where its counted rows times `row_bytes`, an upper bound of a row, stay within `limit`;
    otherwise the join shuffles. `df` should be stored or cheap, as it is counted here."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def no_clash(df, *names):
    """Drops columns whose names the operator is about to add."""
    return df.drop(*[c for c in names if c in df.columns])


@lru_cache(maxsize=8)
def tokenizer_path(name):
    """Place of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)

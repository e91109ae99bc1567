"""Frozen suites and multi-table sinks."""
from pyspark.sql import functions as F

from ..operators.curate import row_digest
from ..session import work_dir

SPLITS = ("train", "calibration", "development", "test")


def _manifest(df, spark, questions):
    """Per-split record and question counts with order-free digests; empty splits are listed too."""
    d = row_digest(df, [c for c in df.columns if c != "split"], name="_d")
    num = F.conv(F.substring("_d", 1, 12), 16, 10).cast("bigint")
    tail = F.conv(F.substring("_d", 13, 12), 16, 10).cast("bigint")
    got = d.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum(questions).cast("bigint").alias("questions"),
                                 F.sum(num.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor(tail).alias("digest_xor"))
    every = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(got, "split", "left").select(
        "split", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("questions", F.lit(0)).alias("questions"),
        F.coalesce("digest_sum", F.lit("0")).alias("digest_sum"), F.coalesce("digest_xor", F.lit(0)).alias("digest_xor"))


def freeze_suite(df, out, meta=None, questions=None):
    """Write all splits and their manifest; refuses to overwrite. Returns the manifest table."""
    spark = df.sparkSession
    bad = df.filter(~F.col("split").isin(*SPLITS) | F.col("split").isNull())
    if not bad.isEmpty():
        raise ValueError("rows outside the known splits")
    df.write.mode("errorifexists").partitionBy("split").parquet(f"{out}/data")
    written = spark.read.schema(df.schema).parquet(f"{out}/data")
    q = questions if questions is not None else F.lit(1)
    m = _manifest(written, spark, q)
    attrs = F.create_map(*[F.lit(x) for kv in (meta or {}).items() for x in kv]) if meta else F.create_map().cast("map<string,string>")
    m.withColumn("attributes", attrs).coalesce(1).write.mode("errorifexists").parquet(f"{out}/manifest")   # four rows
    return spark.read.parquet(f"{out}/manifest")


def load_split(spark, suite, split, allow_test=False, schema=None):
    """One partition of a frozen suite, checked against its manifest. Only that partition's files are read."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    if split == "test" and not allow_test:
        raise ValueError("the test split is locked; pass allow_test")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(f"{suite}/data").filter(F.col("split") == split)
    want = spark.read.parquet(f"{suite}/manifest").filter(F.col("split") == split).first()
    got = _manifest(df, spark, F.lit(1)).filter(F.col("split") == split).first()
    if (got["records"], got["digest_sum"], got["digest_xor"]) != (want["records"], want["digest_sum"], want["digest_xor"]):
        raise ValueError(f"suite content differs from its manifest: {split}")
    return df


def write_native_corpus(ledger, views, out):
    """The full ledger, the observations (view events, no labels) and the labels (targets only) as separate tables, so
    that labels never sit beside evidence. Observations and labels are projected from the written ledger."""
    spark = ledger.sparkSession
    ledger.write.mode("errorifexists").partitionBy("split").parquet(f"{out}/ledger")
    back = spark.read.parquet(f"{out}/ledger")
    views.write.mode("errorifexists").parquet(f"{out}/observations")
    back.select("episode_id", "group_id", "split", "origin").distinct().write.mode("errorifexists").parquet(f"{out}/labels")
    obs = spark.read.parquet(f"{out}/observations")
    leaked = {"origin", "group_id", "regime"} & set(obs.columns)
    if leaked:
        raise ValueError(f"labels beside evidence: {leaked}")
    labels = spark.read.parquet(f"{out}/labels")
    return obs.join(labels, "episode_id").groupBy("split", "origin", "profile").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("episode_id").alias("episodes"))


def write_scored(scored, report, out, allowed=("too_long",)):
    """Prediction rows, the rejected list and the summary as separate tables. The rows are scored once, into a staging table in
    the shared work folder; a rejection for any other reason aborts before a result is written. `report` makes the one-row
    summary from the staged rows."""
    spark = scored.sparkSession
    staging = work_dir(spark, "scored-staging")
    scored.write.parquet(staging)
    staged = spark.read.schema(scored.schema).parquet(staging)
    bad = staged.filter(F.col("reject_reason").isNotNull() & ~F.col("reject_reason").isin(*allowed))
    if not bad.isEmpty():
        raise ValueError("scoring failed for a reason other than size; no partial report")
    staged.filter(F.col("reject_reason").isNull()).drop("reject_reason").write.mode("errorifexists").parquet(f"{out}/rows")
    staged.filter(F.col("reject_reason").isNotNull()).select("id", "question", "reject_reason").write.mode("errorifexists").parquet(f"{out}/rejected")
    report(staged).coalesce(1).write.mode("errorifexists").parquet(f"{out}/summary")   # a one-row summary
    return spark.read.parquet(f"{out}/rows"), spark.read.parquet(f"{out}/rejected"), spark.read.parquet(f"{out}/summary")

"""Threshold-scaled sketches: keep every shingle hash below a fixed fraction of the hash range. JVM side only.

The kept hashes of a union are the union of the kept hashes, so sketches merge by set union and estimate containment between
texts of very different length. The LEAST smallest hashes of a text stay in any case, which merges as well (`merge`): texts of
fewer shingles are known whole. A sketch therefore tells up to which hash it is complete, and two sketches are compared only
below what both are complete to. Words of more than LONG_WORD code points (languages without blanks, encoded data) count as
their code points, so that such texts have shingles as well.
"""
import json
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import let, text_of, words

SHINGLE = 5
LIMIT = "8"          # hex digits below it: half of all hashes
LEAST = 32           # so many smallest hashes stay, whatever they are
DIGITS = 16          # 64 bits of the md5 are kept
LONG_WORD = 24
ROWS_PER_BUCKET = 4096


def _kept(hashes):
    def least(h):
        return F.slice(F.array_sort(F.array_distinct(h)), 1, LEAST)
    return let(hashes, lambda h: let(F.array_distinct(F.filter(h, lambda x: x < LIMIT)), lambda low: F.when(F.size(low) >= LEAST, F.array_sort(low)).otherwise(least(h))))


def _units(w):
    """The words, long ones as their code points."""
    def is_long(x):
        return F.char_length(x) > LONG_WORD
    return F.when(F.exists(w, is_long), F.flatten(F.transform(w, lambda x: F.when(is_long(x), F.split(x, "")).otherwise(F.array(x))))).otherwise(w)


def sketch(text, shingle=SHINGLE):
    """Sorted distinct kept hashes (array of 16 hex digits) of the word shingles of a non-null text. Fewer words than
    `shingle` are one shingle; a text without words has an empty sketch."""
    def hashes(w):
        last = F.greatest(F.size(w) - shingle + 1, F.lit(1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, shingle), " ").cast("binary")), 1, DIGITS))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(each)
    return _kept(let(let(words(text), _units), hashes))


def merge(a, b):
    """Sketch of the union of the two shingle sets."""
    return _kept(F.array_union(a, b))


def _until(s):
    """The greatest hash up to which a sketch holds all; fewer than LEAST hashes are all there are."""
    return F.when(F.size(s) < LEAST, F.lit("g")).otherwise(F.greatest(F.lit(LIMIT), F.element_at(s, -1)))


def likeness(a, b):
    """Share of the smaller set's hashes that the other has, over the hashes that both sketches are complete to: an estimate of
    containment, 0 to 1, and exact where both texts have fewer than LEAST shingles. Two empty sketches are alike (1). An empty and
    a filled one are not (0), nor are two of which one shows no hash in that range."""
    def shared(x, y):
        least = F.least(F.size(x), F.size(y))
        return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return let(F.least(_until(a), _until(b)), lambda end: let(F.filter(a, lambda x: x <= end), lambda x: let(F.filter(b, lambda y: y <= end), lambda y: shared(x, y))))


def as_text(s):
    """The sketch as one string: its hashes in order, 16 hex digits each."""
    return F.array_join(s, "")


def _ranges(docs, order, rows_per_bucket):
    """(bucket, at_edge) columns: which range of about `rows_per_bucket` rows a key lies in, and whether it begins one. The edges
    are every other key of a sample by hash. A key is searched in two steps, among the first edges of runs and then in its run,
    so its cost grows with the root of the number of ranges."""
    key = F.col(order)
    sample = docs.filter(key.isNotNull()).select(key).distinct().filter(F.pmod(F.xxhash64(key), F.lit(max(1, rows_per_bucket // 2))) == 0)
    edges = sorted(r[0] for r in sample.collect())[1::2]
    if not edges:
        return F.lit(0), F.lit(False), 0
    run, kind = math.isqrt(len(edges) - 1) + 1, docs.schema[order].dataType.simpleString()
    heads = F.from_json(F.lit(json.dumps(edges[::run])), f"array<{kind}>")
    runs = F.from_json(F.lit(json.dumps([edges[i:i + run] for i in range(0, len(edges), run)])), f"array<array<{kind}>>")
    at = F.size(F.filter(heads, lambda e: e <= key))
    own = F.element_at(runs, at)
    bucket = F.when(key.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * run + F.size(F.filter(own, lambda e: e <= key)))
    return bucket, F.when(key.isNull() | (at == 0), F.lit(False)).otherwise(F.array_contains(own, key)), len(edges)


def with_next(docs, order, carry, rows_per_bucket=ROWS_PER_BUCKET):
    """Adds next_<c> for every column in `carry`: its value in the next row by `order` (an integer or string column, nulls first),
    after the last row that of the first. Rows are cut into key ranges of about equal size, as many as the rows need; the first
    row of each range is handed on to the range before it, so no task sorts more than a range. The driver holds one key of
    every `rows_per_bucket` / 2 rows. Equal keys are put in order by the carried values and share a range."""
    shape = docs.agg(F.count(F.lit(1)).alias("n"), F.count(order).alias("keys"), F.min(order).alias("least")).first()
    key = F.col(order)
    bucket, at_edge, last = _ranges(docs, order, rows_per_bucket)
    first = key.isNull() if shape["keys"] < shape["n"] else key == F.lit(shape["least"])
    own = F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("guest"))
    before = F.struct((bucket - 1).cast("int").alias("b"), F.lit(1).alias("guest"))
    round_ = F.struct(F.lit(last).cast("int").alias("b"), F.lit(1).alias("guest"))
    none = F.array().cast("array<struct<b:int,guest:int>>")
    places = F.concat(F.array(own), F.when(at_edge, F.array(before)).otherwise(none), F.when(F.coalesce(first, F.lit(False)), F.array(round_)).otherwise(none))
    placed = docs.withColumn("_at", F.explode(places))
    w = Window.partitionBy("_at.b").orderBy(F.col("_at.guest"), key.asc_nulls_first(), *carry)
    ahead = placed.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return ahead.filter(F.col("_at.guest") == 0).drop("_at")


def fingerprint_edits(docs):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document. The edited
    text has its last quarter replaced by the start of the next document's text. Null texts count as empty; a lone document
    is its own next; rows with equal doc_id follow each other in text order. Other columns are ignored; an empty table gives none."""
    own = docs.select("doc_id", text_of("text").alias("text"))
    pairs = with_next(own, "doc_id", ["text"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("sketch"), sketch(F.col("next_text")).alias("next_sketch"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
                      likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))

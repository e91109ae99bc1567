"""URL filter: host-suffix and path-prefix expressions joined to a rule list on short hash prefixes.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's. Each distinct URL is expanded into the expressions a rule could equal; expressions and rules meet on the first 32
bits of a sha256, the whole digest confirms, and the longest rule decides (equal length: longer host, then block).
"""
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, no_clash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def url_parts(url):
    """(host, path) Columns of a URL column; both empty where it is null or has no '://'."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression):
    return F.sha2(expression, 256)


def _rule_table(rules):
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    rule = F.concat(host, path)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return rules.select(rule.alias("rule"), F.col("verdict"), F.length(host).alias("host_len"), F.length(path).alias("path_len"), slashes.alias("slashes"),
                        F.size(F.split(host, r"\.")).alias("labels"), path.endswith("/").alias("closed"), _digest(rule).alias("digest")).filter("verdict is not null")


def judge_urls(pages, rules, url="url", default="allow"):
    """Adds host, path, rule and verdict to every row of `pages`; columns of these names are replaced.

    Null URLs and URLs without '://' have empty host and path, no rule and the default verdict. An empty path starts with no
    rule path but the empty one. Repeated URLs are judged once and each row keeps its own answer; rules with a null verdict
    are ignored, repeated ones count once. An empty rule table leaves every row at the default. Expressions reach only as
    many labels and slashes as the longest rule has, and of rule paths not ending in '/', only the lengths that occur."""
    table = _rule_table(rules)
    shape = table.agg(F.max("labels").alias("labels"), F.max(F.when(F.col("closed"), F.col("slashes"))).alias("slashes"), F.count(F.lit(1)).alias("n"),
                      F.sum(F.length("rule") + 200).alias("bytes"), F.sort_array(F.collect_set(F.when(~F.col("closed"), F.col("path_len")))).alias("open_lengths")).first()
    host, path = url_parts(F.col(url))
    base = no_clash(pages, "host", "path", "rule", "verdict")
    base = base.select("*", host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    host, path = url_parts(F.col("_u"))
    urls = pages.select(F.col(url).alias("_u")).filter(F.col("_u").contains("://")).distinct().select("_u", F.split(host, r"\.").alias("_labels"), path.alias("_path"))
    n = F.size("_labels")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - shape["labels"] + 1), n), lambda i: F.array_join(F.slice("_labels", i, n), "."))
    slashes = F.least(F.length("_path") - F.length(F.replace("_path", F.lit("/"), F.lit(""))), F.lit(shape["slashes"] or 0))
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda k: F.concat(F.call_function("substring_index", F.col("_path"), F.lit("/"), k), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    if shape["open_lengths"]:
        lengths = F.filter(F.array(*[F.lit(x) for x in shape["open_lengths"]]), lambda x: x <= F.length("_path"))
        prefixes = F.array_distinct(F.concat(prefixes, F.transform(lengths, lambda x: F.substring(F.col("_path"), F.lit(1), x))))
    expressions = urls.select("_u", F.explode(suffixes).alias("_s"), prefixes.alias("_p")).select("_u", "_s", F.explode("_p").alias("_e")).select("_u", _digest(F.concat("_s", "_e")).alias("_d"))
    expressions = expressions.withColumn("_k", F.substring("_d", 1, PREFIX_DIGITS))

    table = table.withColumn("_k", F.substring("digest", 1, PREFIX_DIGITS))
    if shape["bytes"] <= BROADCAST_BYTES:
        table = F.broadcast(table)
    hits = expressions.join(table, "_k").filter(F.col("_d") == F.col("digest"))
    best = hits.groupBy("_u").agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("_b"))
    return base.join(best, F.col(url) == F.col("_u"), "left").select(*[base[c] for c in base.columns], F.col("_b.rule").alias("rule"), F.coalesce("_b.verdict", F.lit(default)).alias("verdict"))

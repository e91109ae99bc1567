"""Preference pairs: two conversations of a pair share their longest common turn prefix as the prompt, rendered once, and give
one completion each, with the spans of it that training scores.

Turns are placed by rank inside their pair, compared place by place in a join, and put together in chunks of CHUNK turns
first, so a long conversation is never sorted or joined up by one task before its chunks are text.
"""
from pyspark.sql import functions as F

from ..functions.spread import join_keys, running_totals, spread_rank
from .common import stored
from .fingerprint import with_next

CHUNK = 64
TRAINED = "assistant"
SIDES = ("chosen", "rejected")


def render(role, text):
    """(header, whole piece) of a turn: '<|role|>', line feed, text, line feed. The opening '<|' inside roles and texts is set
    apart, so that no text can pose as a header."""
    def plain(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))
    header = F.concat(F.lit("<|"), plain(role), F.lit("|>\n"))
    return header, F.concat(header, plain(text), F.lit("\n"))


def _placed(turns):
    """(pair_id, side, role, text, pos): turns of each side of a pair in order; equal turn numbers in order of role and text, null
    turn numbers first, repeated rows once."""
    rows = turns.filter("pair_id is not null").select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    bucket = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))
    return spread_rank(rows, ["pair_id", "side"], [F.col("turn").asc_nulls_first(), "role", "text"], bucket, "pos").drop("turn")


def _common(placed):
    """(pair_id, n_common): turns are compared by digest, place by place."""
    digest = F.sha2(F.concat_ws("\0", F.sha2("role", 256), "text"), 256)
    places = placed.select("pair_id", "pos", "side", digest.alias("d")).groupBy("pair_id", "pos").agg(*[F.max(F.when(F.col("side") == s, F.col("d"))).alias(s) for s in SIDES])
    differ = F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("pos"))
    return places.groupBy("pair_id").agg(F.coalesce(F.min(differ) - 1, F.max("pos")).cast("bigint").alias("n_common"))


def preference_examples(chosen, rejected):
    """One row per pair_id of either table of turns (pair_id, turn, role, text): n_common, prompt, chosen, rejected and the masks
    chosen_mask and rejected_mask, arrays of (start, end) character spans of the completion that an assistant wrote, the line
    feed behind each included.

    Pairs without turns on one side have an empty common prefix and an empty completion there; equal conversations have
    empty completions and masks. Null pair ids are left out, null roles and texts count as empty, extra columns are ignored."""
    columns = ["pair_id", "turn", "role", "text"]
    both = chosen.select(*columns, F.lit("chosen").alias("side")).unionByName(rejected.select(*columns, F.lit("rejected").alias("side")))
    placed = stored(_placed(both), "placed-turns")
    common = stored(_common(placed), "common-prefixes")
    part = F.when(F.col("pos") > F.col("n_common"), F.col("side")).when(F.col("side") == "chosen", F.lit("prompt"))
    header, piece = render(F.col("role"), F.col("text"))
    rows = join_keys(placed, common, ["pair_id"]).withColumn("part", part).filter("part is not null")
    rows = rows.select("pair_id", "part", "pos", piece.alias("piece"), F.char_length(header).cast("bigint").alias("_head"), F.char_length(piece).cast("bigint").alias("_len"),
                       ((F.col("role") == TRAINED) & (F.col("part") != "prompt")).alias("_train"))
    chunk = F.floor((F.col("pos") - 1) / CHUNK)
    rows = running_totals(rows, ["pair_id", "part"], "pos", chunk, ["_len"])
    span = F.when(F.col("_train"), F.struct((F.col("cum__len") - F.col("_len") + F.col("_head")).alias("start"), F.col("cum__len").alias("end")))
    chunks = rows.groupBy("pair_id", "part", chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_p"), F.sort_array(F.collect_list(span)).alias("_s"))
    chunks = chunks.select("pair_id", "part", F.struct("_chunk", F.array_join(F.col("_p.piece"), "").alias("text"), F.col("_s").alias("spans")).alias("_c"))
    whole = chunks.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, F.col("_c")))).alias(p) for p in ("prompt", *SIDES)])
    out = common.join(whole, "pair_id", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("pair_id", "n_common", *[F.coalesce(F.array_join(F.col(f"{p}.text"), ""), F.lit("")).alias(p) for p in ("prompt", *SIDES)],
                      *[F.coalesce(F.flatten(F.col(f"{p}.spans")), none).alias(f"{p}_mask") for p in SIDES])


def swapped_answers(turns):
    """(chosen, rejected) tables of turns: every conversation, and the same with its last turn's text taken from the next
    conversation's last turn (by conv_id, after the last the first). A plain source of pairs for tables that have none."""
    turns = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))).alias("_last")).select("conv_id", F.col("_last.turn").alias("_turn"), F.col("_last.role").alias("_role"), F.col("_last.text").alias("_text"))
    ahead = with_next(last, "conv_id", ["_text"])
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    kept = turns.join(ahead, "conv_id")
    at_end = F.col("turn").eqNullSafe(F.col("_turn")) & F.col("role").eqNullSafe(F.col("_role"))
    rejected = kept.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(at_end, F.col("next__text")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected


def spans_text(mask):
    """Spans as 'start-end' joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

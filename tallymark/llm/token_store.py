"""Token ids in directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; a bit per entry says whether the
id goes on, and its further chunks stand in the next level at the rank of that bit. A directory of ranks every 512 bits
makes the position of any id's chunks one lookup per level, so a token or a range is read without decoding what lies before.

A store is a Parquet folder of segments in document order: `segment` (ascending), the documents' ids and token counts, and
`codes`, the bytes described above.
"""
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions.spread import running_totals
from .common import small_side, text_of, tokenizer_path
from .units import UnitTable, grouped, word_slices

MAGIC = b"DAC1"
CHUNK_BITS, BLOCK_BITS = 8, 512
SEGMENT_TOKENS = 1 << 18
END_ID = 1
ORDINAL_BITS = 32           # segments of one partition
SEGMENT_SCHEMA = "segment bigint, doc_ids array<bigint>, counts array<bigint>, n_tokens bigint, codes binary"


def pack(ids):
    """Bytes of an array of ids below 2**32."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        blocks = -(-len(rest) // BLOCK_BITS)
        counts = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK_BITS), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        assert len(ranks) == blocks + 1
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits + ranks.tobytes())
        if not goes_on.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = more[goes_on]


class Codes:
    """Random access to packed ids."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("these bytes are no packed ids")
        n_levels, at = struct.unpack_from("<I", data, 4)[0], 8
        self.levels = []
        for _ in range(n_levels):
            n = struct.unpack_from("<I", data, at)[0]
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 4 + n)
            blocks = -(-n // BLOCK_BITS) + 1
            ranks = np.frombuffer(data, "<u4", blocks, at + 4 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + len(bits) + 4 * blocks
        self.n = len(self.levels[0][0])

    def __len__(self):
        return self.n

    @staticmethod
    def _rank(level, i):
        """Set bits before position i."""
        _, bits, ranks = level
        block = i // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        inside = int(np.bitwise_count(bits[first:i // 8]).sum())
        if i % 8:
            inside += int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count()
        return int(ranks[block]) + inside

    def range(self, lo, hi):
        """Ids at positions lo .. hi - 1."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi, self.n))
        out = np.zeros(hi - lo, np.uint32)
        where = slice(None)
        for k, level in enumerate(self.levels):
            chunks, bits, _ = level
            part = chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            out[where] |= part
            flags = np.unpackbits(bits[lo // 8:-(-hi // 8)], bitorder="little")[lo % 8:lo % 8 + hi - lo].astype(bool)
            if not flags.any():
                break
            where = np.flatnonzero(flags) if k == 0 else where[flags]
            lo, hi = self._rank(level, lo), self._rank(level, hi)
        return out

    def __getitem__(self, i):
        return int(self.range(i, i + 1)[0])


PLAIN = re.compile(rb"[a-z]+")
TAIL = re.compile(rb"(.*[A-Za-z0-9])([,.!?;:|]+)\Z", re.S)


def _word_and_tail(word):
    """(word, punctuation behind it), which the pre-tokenizer always separates: a letter or digit from what follows. ASCII words
    are lower-cased, as the tokenizer does; words that may hold a special token are left whole."""
    if b"<|" in word:
        return word, b""
    match = TAIL.match(word)
    core = match[1] if match else word
    return core.lower() if core.isascii() else core, match[2] if match else b""


@lru_cache(maxsize=4)
def word_coder(definition):
    """Unit table of a lower-casing tokenizer whose pre-tokens never cross an ASCII blank or a word's end, by its JSON text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(definition)

    @lru_cache(maxsize=10_000)
    def tail_ids(tail):
        return tokenizer.encode(tail.decode(), add_special_tokens=False).ids

    def encode(parts):
        split = [_word_and_tail(p) for p in parts]
        plain = [PLAIN.fullmatch(core) is not None for core, _ in split]     # normal form, one pre-token, bytes that stand for themselves
        rest = iter(tokenizer.encode_batch_fast([core.decode() for (core, _), is_plain in zip(split, plain) if not is_plain], add_special_tokens=False))
        model = tokenizer.model
        return [([t.id for t in model.tokenize(core.decode())] if is_plain else next(rest).ids) + (tail_ids(tail) if tail else []) for (core, tail), is_plain in zip(split, plain)]
    return UnitTable(encode)


def _segments(definition, end_id, segment_tokens):
    def run(batches):
        coder, part, ordinal = word_coder(definition.value), TaskContext.get().partitionId(), 0
        docs, counts, ids, held = [], [], [], 0

        def flush():
            nonlocal docs, counts, ids, held, ordinal
            row = pa.RecordBatch.from_arrays([pa.array([(part << ORDINAL_BITS) | ordinal]), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                                              pa.array([held]), pa.array([pack(np.concatenate(ids))], pa.binary())], ["segment", "doc_ids", "counts", "n_tokens", "codes"])
            docs, counts, ids, held, ordinal = [], [], [], 0, ordinal + 1
            return row
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in grouped(texts):
                flat, ends = coder.encode_all(*word_slices(texts[lo:hi]))
                start = 0
                for name, end in zip(names[lo:hi], ends.tolist()):
                    docs.append(name)
                    counts.append(end - start + 1)
                    ids.append(np.append(flat[start:end], np.uint32(end_id)))
                    held += end - start + 1
                    start = end
                    if held >= segment_tokens:
                        yield flush()
        if docs:
            yield flush()
    return run


def write_tokens(docs, path, tokenizer=None, end_id=END_ID, segment_tokens=SEGMENT_TOKENS):
    """Writes the ids of every whole text, each followed by `end_id`, as a store at `path`, in ascending doc_id order (nulls
    first; rows with one doc_id follow each other in text order). Null texts count as empty. `tokenizer` is the place of a tokenizers
    JSON file, on the driver. Documents are dealt out by doc_id range; a task holds a batch and one segment at a time."""
    with open(tokenizer or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    ordered = docs.select("doc_id", text_of("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(definition, end_id, segment_tokens), SEGMENT_SCHEMA).write.parquet(path)


def _documents(with_ids):
    def run(batches):
        for batch in batches:
            for segment, docs, counts, codes in zip(batch.column("segment").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("counts").to_pylist(), batch.column("codes")):
                data = Codes(memoryview(codes.as_buffer()))
                ends = np.cumsum(counts)
                starts = ends - counts
                ids = [data.range(a, b).astype("<u4") for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array([segment] * len(docs)), pa.array(starts), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["doc_id", "segment", "_local", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def read_tokens(spark, path, with_ids=False):
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and,
    on request, the ids of every document in a store. Each document's ids are fetched by position from its segment."""
    store = spark.read.parquet(path)
    totals = running_totals(store.select("segment", "n_tokens"), [], "segment", F.shiftright("segment", ORDINAL_BITS), ["n_tokens"])
    first = small_side(totals.select("segment", (F.col("cum_n_tokens") - F.col("n_tokens")).alias("_before")), 64)
    schema = "doc_id bigint, segment bigint, _local bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    docs = store.select("segment", "doc_ids", "counts", "codes").mapInArrow(_documents(with_ids), schema)
    return docs.join(first, "segment").select("doc_id", (F.col("_before") + F.col("_local")).alias("start"), *docs.columns[3:])

"""Token store, piece codec and edit-aware counts: exact against the tokenizer libraries and brute force."""
import base64
import random
import signal
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import edit_counts, piece_codec, queries, token_store
from tallymark.llm.units import UnitTable, word_slices
from tallymark.session import work_dir

TEXTS = ["Hello, World! don't", None, "", " \t\n", "a\x00b \x1c x\x85y", "日本語 テキスト", "e\u0301 É I\u0307 ΣΑΣ ﬁ", "<|endoftext|> A<|ENDOFTEXT|>b,", "foo), bar:; 12,34 ..", "w" * 3000, "many   blanks \n\n x", "▁ marked ▁▁x",
         "a-very-long-word-beyond-twenty-three-bytes, again a-very-long-word-beyond-twenty-three-bytes.", "😀👩‍👩‍👧 ok"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1400), st.randoms())
def test_codes_give_back_any_range(ids, rng):
    codes = token_store.Codes(token_store.pack(np.array(ids, np.uint32)))
    lo = rng.randint(0, len(ids))
    hi = rng.randint(lo, len(ids))
    assert codes.range(lo, hi).tolist() == ids[lo:hi] and len(codes) == len(ids)
    if ids:
        k = rng.randrange(len(ids))
        assert codes[k] == ids[k]


def test_codes_refuse_other_bytes_and_places():
    with pytest.raises(ValueError):
        token_store.Codes(b"none of that")
    with pytest.raises(IndexError):
        token_store.Codes(token_store.pack(np.arange(3, dtype=np.uint32))).range(1, 4)


def test_store_matches_the_library(spark):
    rng = random.Random(1)
    rows = [(i, t, "x") for i, t in zip(rng.sample(range(-9, 999), len(TEXTS)), TEXTS)]
    path = work_dir(spark, "store")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, codes string").repartition(4), path, segment_tokens=50)
    got = {r["doc_id"]: r for r in token_store.read_tokens(spark, path, with_ids=True).collect()}
    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for i, t, _ in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        r = got.pop(i)
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(ids), ids), t
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not got
    empty = work_dir(spark, "store")
    token_store.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), empty)
    assert token_store.read_tokens(spark, empty).count() == 0


def test_store_query_on_the_test_table(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op6_token_store"](spark, "/root/testdata/sf0.001").collect()}
    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_unit_table_forgets_without_changing_results():
    table = UnitTable(lambda units: [[len(u), u[0]] for u in units], most=20, slots=64)
    rng = random.Random(6)
    for _ in range(60):
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 15))]
        ids, ends = table.encode_all(*word_slices([" ".join(words).encode(), b"", b" zz "]))
        assert ids.tolist() == [x for w in words for x in (len(w), ord(w[0]))] + [2, ord("z")] and ends.tolist() == [2 * len(words), 2 * len(words), 2 * len(words) + 2]


def test_unit_table_holds_a_bounded_number_of_bytes():
    table = UnitTable(lambda units: [list(u[:3]) for u in units], long_bytes=10_000)
    rng = random.Random(9)
    for _ in range(200):
        words = [bytes(rng.choices(b"xyz", k=rng.choice([3, 40, 900]))) for _ in range(8)] + [b"again-and-again-and-again-1"] * 2
        ids, _ = table.encode_all(*word_slices([b" ".join(words)]))
        assert ids.tolist() == [x for w in words for x in w[:3]]
        assert table.held == sum(map(len, table.long)) <= 10_000
    whole = b"q" * 50_000                                       # more than the bound in one call
    assert table.encode_all(*word_slices([whole + b" ab"]))[0].tolist() == [113, 113, 113, 97, 98]
    table.encode_all(*word_slices([b"p" * 30]))
    assert table.held == 30


@pytest.mark.parametrize("slots, most", [(64, 20), (64, 64)])
def test_one_text_of_more_distinct_units_than_slots(slots, most):
    def stop(*_):
        raise TimeoutError("the lookup does not end")
    table = UnitTable(lambda units: [[len(u), *u[:2]] for u in units], most=most, slots=slots)
    many = [b"%d" % i for i in range(1000)] + [b"long-" * 5 + b"%d" % i for i in range(100)]
    texts = [b"", b" ".join(many), b"a b", b" ".join(many[::-1] + many), b""]
    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(20)
    try:
        flat, ends = table.encode_all(*word_slices(texts))
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    start = 0
    for t, end in zip(texts, ends.tolist()):
        assert flat[start:end].tolist() == [x for u in t.split() for x in [len(u), *u[:2]]]
        start = end
    assert start == len(flat) and table.count <= slots // 2


def best_score(v, unit, table):
    s = unit.decode()
    best = [0.0] + [None] * len(s)
    for e in range(1, len(s) + 1):
        options = [best[b] + (v.scores[table[s[b:e].encode()]] if s[b:e].encode() in table else v.unknown_score) for b in range(max(0, e - 20), e) if best[b] is not None and (s[b:e].encode() in table or e - b == 1)]
        best[e] = max(options)
    return best[-1]


def test_pieces_are_the_best_segmentation_and_decode_exactly(spark):
    v, _ = piece_codec.vocabulary(open(P.path("piece_bpe_32k.model"), "rb").read())
    table = {v.pieces[i]: i for i in v.bytes_of if not (v.pieces[i].startswith(b"<0x") and len(v.pieces[i]) == 6)}
    texts = [t.encode() for t in TEXTS if t] + [r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(15).collect()]
    raw, starts, ends, per = piece_codec.unit_slices(texts)
    units = sorted({raw[a:b].replace(b" ", piece_codec.MARK) for a, b in zip(starts, ends)})
    for unit, ids in zip(units, v.viterbi(units)):
        score, k = 0.0, 0
        while k < len(ids):
            if ids[k] in table.values() or v.pieces[ids[k]] in table:
                score, k = score + v.scores[ids[k]], k + 1
            else:                                  # the bytes of one character
                first = v.bytes_of[ids[k]][0]
                score, k = score + v.unknown_score, k + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
        assert np.isclose(score, best_score(v, unit, table)), unit
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)]
    out = piece_codec.encode_decode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    assert out.columns == ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded"]
    for r in out.collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["decoded"] == text.replace("▁", " ") and r["n_pieces"] == len(r["ids"])
        assert v.decode(r["ids"]).decode() == r["decoded"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert piece_codec.encode_decode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("stretch", [7, 100, 1 << 16])
def test_long_units_are_solved_alike_alone_and_together(monkeypatch, stretch):
    monkeypatch.setattr(piece_codec, "STRETCH", stretch)
    v, _ = piece_codec.vocabulary(open(P.path("piece_bpe_32k.model"), "rb").read())
    rng = random.Random(stretch)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABab01+/=", "漢字仮名のはをéß", "a", " ", "😀\U00010380\x00x", "the is and of ing"]
    units = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 5, 300, 3000]))).encode().replace(b" ", piece_codec.MARK) for _ in range(40)]
    for u in units:
        out = [None]
        v._solve([u], [0], out)
        assert v._solve_long(u) == out[0]


def test_a_long_text_without_blanks_is_encoded_in_seconds(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000)), "".join(rng.choices("漢字仮名交じり文の", k=300_000))]
    before = time.time()
    rows = piece_codec.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).select("doc_id", "decoded").collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == dict(enumerate(texts)) and time.time() - before < 60


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(2)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))) for _ in range(800)})
    t = piece_codec.DoubleArray(keys, range(len(keys)))

    def look(key):
        s = 0
        for b in key:
            n = int(t.base[s]) + b
            if n <= 0 or t.check[n] != s:
                return -1
            s = n
        return int(t.value[s])
    assert [look(k) for k in keys] == list(range(len(keys)))
    for _ in range(2000):
        k = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 6)))
        assert look(k) == (keys.index(k) if k in keys else -1)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "ab '\n\t12!?re'll's éß日"


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=900), st.lists(st.tuples(st.integers(-3, 950), st.integers(0, 60), st.text(ALPHABET, max_size=30)), max_size=5))
def test_edits_leave_the_tree_of_the_edited_text(encoding, text, edits):
    find, counts = edit_counts.counter(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    tree = edit_counts.build(text, find, counts)
    for start, length, insert in edits:
        text, anew = edit_counts.apply_edit(text, tree, start, length, insert, find, counts)
        assert tree.tokens == len(encoding.encode_ordinary(text)) and tree.chars == len(text)
        assert tree.pack() == edit_counts.build(text, find, counts).pack()
    assert edit_counts.TokenTree.unpack(tree.pack()).tokens == tree.tokens


def test_small_edits_encode_little():
    find, counts = edit_counts.counter(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    text = "some words that go on " * 5000
    tree = edit_counts.build(text, find, counts)
    _, anew = edit_counts.apply_edit(text, tree, 50_000, 3, "xyz", find, counts)
    assert anew < 10


def test_edit_counts_over_rows_and_rounds(spark, encoding):
    changes = [[(2, 3, "new "), None, (10**9, 5, " end"), (None, None, None)], [], None]
    rows = [(i, t, changes[i % 3], "old") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, edits {edit_counts.EDIT_TYPE}, tree string")
    out = edit_counts.count_edits(docs, with_state=True)
    assert out.columns == ["doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_encoded_anew", "edited", "tree"]
    got = out.collect()
    for r in got:
        text = TEXTS[r["doc_id"]] or ""
        want = text[:2] + "new " + text[5:] + " end" if r["doc_id"] % 3 == 0 else text
        assert r["edited"] == want and r["n_tokens"] == len(encoding.encode_ordinary(text)) and r["n_tokens_edited"] == len(encoding.encode_ordinary(want))
    again = out.select("doc_id", "edited", "tree").withColumn("edits", F.expr("array(named_struct('start', 0L, 'length', 1L, 'insert', 'Z '))"))
    for r in edit_counts.count_edits(again, text="edited", tree="tree").collect():
        before = next(x["edited"] for x in got if x["doc_id"] == r["doc_id"])
        assert r["n_tokens"] == len(encoding.encode_ordinary(before)) and r["n_tokens_edited"] == len(encoding.encode_ordinary("Z " + before[1:]))
    assert edit_counts.count_edits(docs.limit(0)).count() == 0

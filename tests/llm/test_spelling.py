"""Spelling variants against edit distances of all pairs; states stepped over; nulls, long words, empty tables."""
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallymark.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute(vocab, share=5):
    out, form = [], {}
    for w, n in vocab.items():
        around = [x for x in vocab if near(w, x)]
        best = min(around, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= share * n else None
        out.append([w, form[w], None, n, len(around), vocab[form[w]] if form[w] else None])
    for r in out:
        r[2] = r[0]
        while form[r[2]] is not None:
            r[2] = form[r[2]]
    return sorted(map(tuple, out))


def vocabulary(n, seed=2):
    rng = random.Random(seed)
    words = {"aaaaaa": 40, "aaaaaaa": 8, "aaaaaaaa": 1, "abaaaa": 8, "baaaaa": 8, "aaaaab": 8, "é" * 6: 3, "é" * 7: 300, "": 2, "a": 10, "b": 50, "ab": 250}
    while len(words) < n:
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(3, 9)))
        words[w] = rng.choice([5, 6, 25, 30, 150, 800])
    return words


@pytest.mark.parametrize("limits", [{}, {"most_words": 20}, {"most_chars": 30}])
def test_variants_against_all_pairs(spark, limits):
    vocab = vocabulary(400)
    rows = spark.createDataFrame(list(vocab.items()), "word string, n bigint").withColumns({c: F.lit("x") for c in ("stem", "k", "form", "rest")})
    got = spelling.spelling_variants(rows, **limits)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(vocab), key=str)


def test_acceptor_is_minimal_and_composes():
    words = sorted(vocabulary(600, 7))
    a = spelling.Acceptor(words)
    assert len({(f, tuple(sorted(x.items()))) for f, x in zip(a.final, a.arcs)}) == len(a.arcs)
    pairs = [tuple(sorted(p)) for p in spelling.near_pairs(words)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for i, x in enumerate(words) for y in words[i + 1:] if near(x, y)}


def test_very_long_words(spark):
    """Words of 200,000 code points meet in states that are stepped over, so no acceptor of that size is built."""
    long = "ab" * 100_000
    vocab = {long: 100, long[:5] + "c" + long[6:]: 10, long[:100_001] + long[100_002:]: 10, long + "x": 400, "y" + long: 1, "other": 5, "othe": 1}
    rows = spark.createDataFrame(list(vocab.items()), "word string, n bigint")
    got = spelling.spelling_variants(rows, most_chars=10_000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(vocab), key=str)


def test_texts_with_planted_errors(spark):
    rng = random.Random(3)
    words = [f"{a}{b}ung" for a in ("Straß", "ÜBER", "weiter", "été", "rechn") for b in ("en", "er", "et", "a", "o×")]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "1", "\n"]) for _ in range(300)) for _ in range(30)] + [None, "", "123", "a" * 5000]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    count = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            crc = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and crc % 7 == 0:
                run = run[:crc % len(run)] + run[crc % len(run) + 1:]
            count[run] = count.get(run, 0) + 1
    want = brute({w: n for w, n in count.items() if len(w) >= 6 and n >= 5})
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("run", F.lit(1)).withColumn("word", F.lit(2))
    got = spelling.variants_of_texts(table, divisor=7)
    assert len(want) > 20 and any(r[1] for r in want)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert spelling.variants_of_texts(table.limit(0)).collect() == []


def test_null_and_repeated_words(spark):
    rows = spark.createDataFrame([("house", 3), ("house", 2), (None, 9), ("mouse", None), ("houses", 25)], "word string, n bigint")
    assert sorted(map(tuple, spelling.spelling_variants(rows).collect())) == [("house", "houses", "houses", 5, 1, 25), ("houses", None, "houses", 25, 1, None)]

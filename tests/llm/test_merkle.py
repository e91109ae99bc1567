"""The Merkle manifest against a tree built level by level; appends in parts; nulls, repeated rows, empty tables."""
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallymark.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(r, text=0):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"] if text == 0 else text]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, at):
    """(root, siblings as [before, after] per level) of the node at place `at`."""
    path = []
    while len(nodes) > 1:
        lo = at // 3 * 3
        run = nodes[lo:lo + 3]
        path.append((run[:at - lo], run[at - lo + 1:]))
        nodes, at = [h("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)], at // 3
    return nodes[0], path


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: [leaf(r) for r in sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))] for s in sources}
    subroots = [climb(trees[s], 0)[0] for s in sources]
    out = []
    for r in rows:
        own, s = leaf(r), r["source"]
        subroot, low = climb(trees[s], trees[s].index(own))
        root, high = climb(subroots, sources.index(s))
        changed = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        folded = leaf(r, r["text"].replace("\n", "")) if changed else own
        for before, after in low + high:
            folded = h("".join([*before, folded, *after]))
        proof = h("".join("".join(b + a) for b, a in low + high))
        out.append((r["doc_id"], own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "one line", "two\nlines", "é\n\n" * 50, "x" * 20000, "\n"]
    return [{"doc_id": k, "text": rng.choice(texts), "lang": rng.choice([None, "de"]), "source": rng.choice(sources), "n_chars": rng.choice([None, k])} for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)


def verified(docs, *more, **how):
    m = merkle.append(docs, changed=merkle.without_newlines(docs), **how)
    for d in more:
        m = merkle.append(d, m, changed=merkle.without_newlines(d))
    return sorted(map(tuple, merkle.verify(m).collect()), key=str)


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (60, ["a", "b", None, "", "é"]), (300, ["a"] * 5 + [f"s{i}" for i in range(40)])])
def test_against_level_by_level(spark, n, sources):
    rows = rows_of(n, sources)
    assert verified(table(spark, rows)) == brute(rows)


def test_blocks_and_appends(spark):
    """Small blocks: four groups of them; three appends give what one gives."""
    rows = rows_of(100, ["a", "a", "a", "b", None])
    want = brute(rows)
    assert verified(table(spark, rows), block_levels=1) == want
    assert verified(table(spark, rows[:37]), table(spark, rows[37:40]), table(spark, []), table(spark, rows[40:]), block_levels=2) == want


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = rows_of(12, ["a", "b"])
    rows += [dict(rows[3])] * 3 + [dict(rows[0], doc_id=None), dict(rows[1], doc_id=None, text="n\n")]
    docs = table(spark, rows).withColumns({c: F.lit(1) for c in ("pos", "digest", "n", "block", "leaf", "_at")})
    got, want = verified(docs), brute(rows)
    assert [r[:4] for r in got] == [r[:4] for r in want] and {r for r in got} >= {r for r in want}      # equal rows stand side by side, each with its own proof
    assert verified(table(spark, [])) == []


def test_a_witness_proves_only_its_own_leaf(spark):
    rows = rows_of(30, ["a", "b"])
    for w in merkle.witnesses(merkle.append(table(spark, rows))).collect():
        top = merkle.fold(merkle.fold(w["digest"], w["pos"], w["n"], w["witness"]), w["source_pos"], w["n_sources"], w["source_witness"])
        assert top == w["root"] and merkle.fold(b"\0" * 32, w["pos"], w["n"], w["witness"]) != w["subroot"]

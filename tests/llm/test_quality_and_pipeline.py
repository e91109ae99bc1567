"""Kneser-Ney model, preference pairs and the corpus pipeline against brute force; edge tables."""
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import mixing, ngram_quality, preference, word_model
from tallymark.llm.common import WORD
from tests.llm.test_near_dup import brute
from tests.llm.test_urls_and_rules import measured

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


class Plain:
    """The same model over dictionaries."""

    def __init__(self, texts):
        self.tri = Counter(g for t in texts if t for g in self.grams(t))
        self.bi = Counter(g[1:] for g in self.tri)
        self.uni = Counter(g[1:] for g in self.bi)
        self.d = [self.discounts(c) for c in (self.tri, self.bi, self.uni)]
        self.context = [defaultdict(list) for _ in range(3)]
        for k, table in enumerate((self.tri, self.bi, self.uni)):
            for g, n in table.items():
                self.context[k][g[:-1]].append(n)

    @staticmethod
    def grams(text):
        p = ["<", "<", *text, "end"]
        return list(zip(p, p[1:], p[2:]))

    @staticmethod
    def discounts(table):
        n = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]

    def p(self, g, k=0):
        if k == 3:
            return 1 / (len(self.uni) + 1)
        table = (self.tri, self.bi, self.uni)[k]
        context = self.context[k].get(g[:-1])
        if not context:
            return self.p(g[1:], k + 1)
        cut = lambda n: self.d[k][min(n, 3) - 1]
        seen = max(table[g] - cut(table[g]), 0) if g in table else 0.0
        return (seen + sum(map(cut, context)) * self.p(g[1:], k + 1)) / sum(context)


def test_model_matches_dictionaries(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcde é\n😀") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "b" * 4000]
    frame = lambda ts: spark.createDataFrame([(i, t, "en") for i, t in enumerate(ts)], "doc_id bigint, text string, lang string")
    model = ngram_quality.KneserNey(ngram_quality.trigram_counts(frame(texts).repartition(3)))
    plain = Plain(texts)
    probes = texts + ["zzz", "a", "QQ ab", "\x00", "ab" * 700]
    for r in ngram_quality.score(frame(probes).repartition(2), model).collect():
        t = probes[r["doc_id"]] or ""
        assert r["n_chars"] == len(t) and math.isclose(r["log_prob"], sum(math.log(plain.p(g)) for g in plain.grams(t)), rel_tol=1e-9, abs_tol=1e-9), t[:30]


def test_quality_separates_and_keeps(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["the", "of", "tion", "water", "under", "light"]) for _ in range(60))
    rows = [(i, clean(), "en" if i % 3 else "de") for i in range(240)] + [(1000 + i, " ".join(rng.choice(["XQ!!", "$$$", "ZZ|", "@@"]) for _ in range(60)), "en") for i in range(20)]
    rows += [(2000, None, None), (2001, "", "en"), (2002, clean(), None), (2003, clean(), "xx"), (5, rows[5][1], "en")]
    labels = [(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (1001, 1, 1), (7, 1, 0), (9, 0, 0), (None, 1, 0), (99999, 1, 0), (11, None, 0)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id bigint, text string, lang string, kept string")
    tags = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = ngram_quality.quality(docs, tags).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & set(range(1000, 1020)) and 2000 not in kept and 2001 not in kept and {2002, 2003} <= kept
    assert len(kept & set(range(240))) >= 238
    out = ngram_quality.keep_quality(docs, tags)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    none = ngram_quality.quality(docs, tags.limit(0)).collect()
    assert all(r["perplexity"] is None and r["kept"] == (r["n_chars"] > 0) for r in none) and len(none) == len(rows)
    assert ngram_quality.quality(docs.limit(0), tags).count() == 0


def test_word_model_matches_dictionaries(spark):
    rng = random.Random(12)
    vocabulary = ["a", "the", "é", "😀ü", "of", "w" * 40, "x" * 23, "y" * 24, "tion"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", " ", "the " * 900]
    frame = lambda ts: spark.createDataFrame([(i, t, "en") for i, t in enumerate(ts)], "doc_id bigint, text string, lang string")
    characters = ngram_quality.KneserNey(ngram_quality.trigram_counts(frame(texts)))
    model = word_model.WordModel(word_model.word_trigram_counts(frame(texts).repartition(3)), characters)
    spelling, plain = Plain(texts), Plain([])
    plain.tri = Counter(g for t in texts if t for g in Plain.grams(re.findall(WORD, t)))
    plain.bi = Counter(g[1:] for g in plain.tri)
    plain.uni = Counter(g[1:] for g in plain.bi)
    tables = (plain.tri, plain.bi, plain.uni)
    plain.d = [plain.discounts(c) for c in tables]
    for k, table in enumerate(tables):
        for g, n in table.items():
            plain.context[k][g[:-1]].append(n)

    def p(g, spelled, k=0):
        if k == 3:
            return math.exp(spelled)
        context = plain.context[k].get(g[:-1])
        if not context:
            return p(g[1:], spelled, k + 1)
        cut = lambda n: plain.d[k][min(n, 3) - 1]
        return (max(tables[k][g] - cut(tables[k][g]), 0) + sum(map(cut, context)) * p(g[1:], spelled, k + 1)) / sum(context) if g in tables[k] else sum(map(cut, context)) / sum(context) * p(g[1:], spelled, k + 1)
    probes = texts + ["unknown words here", "the the é", "\x00", "the of é of the", "  é\n"]
    for r in word_model.score(frame(probes).repartition(2), model).collect():
        t = probes[r["doc_id"]] or ""
        logs = [math.log(spelling.p(g)) for g in spelling.grams(t)]
        spans = [m.span() for m in re.finditer(WORD, t)]
        spelled = [sum(logs[lo:hi + 1]) for lo, hi in spans] + [logs[-1]]
        want = sum(math.log(p(g, s)) for g, s in zip(plain.grams([t[lo:hi] for lo, hi in spans]), spelled))
        assert r["n_chars"] == len(t) and math.isclose(r["log_prob"], want, rel_tol=1e-9, abs_tol=1e-9), t[:30]


def test_quality_refuses_unknown_words_of_ordinary_letters(spark):
    rng = random.Random(4)
    parts = ["an", "er", "in", "on", "th", "re"]
    every = ["".join(w) for w in itertools.product(parts, repeat=4)]
    rng.shuffle(every)
    known, other = every[:300], every[300:]
    rows = [(i, " ".join(rng.choice(known) for _ in range(80)), "en") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(other) for _ in range(80)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    tags = spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"] for r in ngram_quality.quality(docs, tags).collect() if r["kept"]}
    assert not kept & set(range(1000, 1020)) and len(kept) >= 195


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.1')", reason="test tables not present")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    judged = ngram_quality.quality(docs, train).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    good, bad = (judged.filter(f"quality = {q}").agg(F.avg(F.col("kept").cast("double"))).first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.2


def rendered(role, text):
    head = "<|" + role.replace("<|", "< |") + "|>\n"
    return len(head), head + text.replace("<|", "< |") + "\n"


def paired(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    out = [n, "".join(rendered(*t)[1] for t in a[:n])]
    masks = []
    for side in (a, b):
        text, mask = "", []
        for role, body in side[n:]:
            head, piece = rendered(role, body)
            if role == "assistant":
                mask.append((len(text) + head, len(text) + len(piece)))
            text += piece
        out.append(text)
        masks.append(mask)
    return (*out, *masks)


def test_preferences_against_brute_force(spark):
    rng = random.Random(3)
    pairs, rows = {}, {"chosen": [], "rejected": []}
    for k in range(60):
        turns = [(rng.choice(["user", "assistant", "system", ""]), rng.choice(["hi", "<|user|> x", "", "é😀", "long " * 50])) for _ in range(rng.choice([0, 1, 2, 5, 200]))]
        other = list(turns)
        if other and k % 4:
            other[rng.randrange(len(other))] = ("assistant", "changed")
        other = other[:len(other) - k % 2]
        pairs[k] = (turns, other)
        for name, side in zip(rows, (turns, other)):
            rows[name] += [(k, i, r or None, t or None, "x") for i, (r, t) in enumerate(side)] * (2 if k % 7 == 0 else 1)
    schema = "pair_id bigint, turn bigint, role string, text string, prompt string"
    frames = [spark.createDataFrame(rng.sample(r, len(r)) + [(None, 0, "user", "lost", "x")], schema) for r in rows.values()]
    got = {r["pair_id"]: r for r in preference.preference_examples(*frames).collect()}
    assert set(got) == {k for k, (a, b) in pairs.items() if a or b}
    for k, r in got.items():
        n, prompt, chosen, rejected, cm, rm = paired(*pairs[k])
        assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (n, prompt, chosen, rejected), k
        assert [tuple(s) for s in r["chosen_mask"]] == cm and [tuple(s) for s in r["rejected_mask"]] == rm
    empty = spark.createDataFrame([], schema)
    assert preference.preference_examples(empty, empty).count() == 0
    assert all(r["rejected"] == "" and r["n_common"] == 0 for r in preference.preference_examples(frames[0], empty).collect())


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        yield name, before, docs


def test_pipeline_stages_against_brute_force(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, before, after in stages(spark, SF):
        rows = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in before.collect()]
        if name != "pieces":
            out = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in after.collect()]
            assert after.columns == corpus_pipeline.COLUMNS and set(out) <= set(rows)
        ids = {r[0] for r in out}
        if name == "quality rules":
            def good(t):
                m = measured(t)
                return not (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 100 * m["n_symbols"] > 40 * m["n_words"] or 2 * m["n_dup_lines"] > m["n_lines"]
                            or 100 * m["n_upper"] > 60 * m["word_chars"] or m["word_chars"] > 30 * m["n_words"])
            assert ids == {r[0] for r in rows if good(r[1])} and len(out) == len(ids)
        elif name == "quality classifier":
            clean = {r[0] for r in rows if r[0] in labels and labels[r[0]]["quality"] == 1}
            assert len(clean & ids) >= 0.97 * len(clean)
        elif name == "near dedup":
            assert ids == {c for _, _, c in brute([(r[0], r[1]) for r in rows], 5)}
        elif name == "source mix":
            plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(before).collect()}
            assert Counter(r[0] for r in out) == Counter({k: n for k, n in plan.items() if n})
        else:
            for r in after.select("doc_id", "decoded", "n_pieces").collect():
                text = next(x[1] for x in rows if x[0] == r["doc_id"])
                assert r["decoded"] == text.replace("▁", " ") and r["n_pieces"] > 0
            assert after.count() == len(rows)


def test_pipeline_runs_as_a_whole_and_on_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    text = "some clean words " + " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " z", None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, "x " * 90_000, "en", "c", 1), (6, text + " tail", "xx", None, 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} <= {None, 1, 6} and got.count() > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_query_texts_need_no_subset():
    source = re.sub(r"\s", "", open(corpus_pipeline.__file__).read())
    assert ".limit(" not in source and ".sample(" not in source

"""Copies, ties, nested values, late rows and raw numbers: nothing is cut, merged, rounded or shown that should not be."""
import pytest
from pyspark.sql import functions as F

from tallymark.operators import curate as D
from tallymark.operators import events as B
from tallymark.operators import rules as RU
from tallymark.operators import scoring as M
from tallymark.operators import validate as VA
from tallymark.session import work_dir
from tallymark.sources import labelled as L
from tallymark.sources import suites as S
from tallymark.streaming import core


def test_every_question_id_of_a_state_stays_however_many_copies(spark):
    rows = [(i, "same", "quality", "q", i) for i in range(5)] + [(9, "same", "toxic", "t", 1), (7, "same", "spam", "s", 0), (8, "same", "lang", "l", 2)]
    got = L.merge_questions_by_state(spark.createDataFrame(rows, "id bigint, state string, qid string, instructions string, label int")).collect()
    assert len(got) == 1 and got[0]["n_questions"] == 4 and got[0]["id"] == 0
    assert {q["qid"]: q["label"] for q in got[0]["questions"]} == {"quality": 4, "toxic": 1, "spam": 0, "lang": 2}


def test_record_ids_differ_between_files(spark):
    path = work_dir(spark, "several")
    line = '{"state":"s","questions":{"a":{"type":"noul","instructions":"i","label":true}}}'
    spark.range(6).select(F.lit(line).alias("value")).repartition(3).write.text(path)
    good, bad = L.read_labelled_jsonl(spark, path, "src")
    assert bad.isEmpty() and good.select("id").distinct().count() == 6 and good.select("group_id").distinct().count() == 6


def test_select_unique_takes_n_rows_of_equal_digests(spark):
    rows = [(i, "a", "k1", "d", True) for i in range(3)] + [(5, "a", "k2", "d", True), (6, "b", "k1", "d", True), (7, "b", "k3", "e", True)]
    got, report = D.select_unique(spark.createDataFrame(rows, "id bigint, source string, skey string, row_sha string, fits boolean"), 2)
    assert sorted(r["id"] for r in got.collect()) == [0, 5, 7]
    assert {r["source"]: (r["considered"], r["duplicate_state"], r["accepted"]) for r in report.collect()} == {"a": (4, 2, 2), "b": (2, 1, 1)}


def test_select_unique_orders_long_and_textual_ids(spark):
    """Equal digests: ids of more than forty characters stay whole, numbers count by value."""
    ids = [f"customer_support_questions/{k:012d}/{k}" for k in range(5)]
    rows = [(i, "a", f"k{k}", "d", True) for k, i in enumerate(ids)]
    got, report = D.select_unique(spark.createDataFrame(rows, "id string, source string, skey string, row_sha string, fits boolean"), 2)
    assert sorted(r["id"] for r in got.collect()) == ids[:2]
    assert [(r["considered"], r["accepted"], r["short"]) for r in report.collect()] == [(2, 2, False)]
    numbers = [(i, "a", f"k{i}", "d", True) for i in (10, 9, -3, 2**62)]
    got, _ = D.select_unique(spark.createDataFrame(numbers, "id bigint, source string, skey string, row_sha string, fits boolean"), 2)
    assert sorted(r["id"] for r in got.collect()) == [-3, 9]


def test_merged_questions_take_the_last_row_in_number_order(spark):
    rows = [(i, "s", "q", i, 0) for i in ("a/9", "a/10", "a/2", "a/10b")] + [("b/1", "t", "q", "first", 0), ("b/0", "t", "q", "second", 1)]
    rows = spark.createDataFrame(rows, "id string, state string, qid string, instructions string, label int").withColumn("line", F.when(F.col("id") == "b/1", 2).otherwise(1))
    got = {r["state"]: (r["id"], r["questions"][0]["instructions"]) for r in L.merge_questions_by_state(rows).collect()}
    assert got == {"s": ("a/2", "a/10b"), "t": ("b/0", "first")}
    got = {r["state"]: r["questions"][0]["instructions"] for r in L.merge_questions_by_state(rows.filter("state = 't'").withColumn("line", F.when(F.col("id") == "b/1", 1).otherwise(2)), "line").collect()}
    assert got == {"t": "second"}


def test_confidence_is_not_rounded(spark):
    rows = [(1, "choice", [0.8999996, 0.1000004], 1), (2, "choice", [0.9, 0.1], 1)]
    got = M.row_scores(spark.createDataFrame(rows, "id int, type string, p array<double>, label int")).select("id", "conf", "confident_error").collect()
    assert {r["id"]: (r["conf"], r["confident_error"]) for r in got} == {1: (0.8999996, False), 2: (0.9, True)}


def test_long_artifact_names_stay_apart(spark):
    a = "/artifacts/" + "x" * 150
    rows = [("e", f"{a}1", "w", "r1", "PUT", 200, 0, 5, 1), ("e", f"{a}2", "r", "r2", "GET", 200, 10, 15, 2), ("e", f"{a}1", "r", "r3", "GET", 200, 20, 25, 3)]
    tx = spark.createDataFrame(rows, "episode_id string, path string, actor_id string, request_id string, method string, status int, start_ms bigint, completed_ms bigint, event_id bigint")
    assert [(r["read_request"], r["write_request"]) for r in B.discover_handoffs(tx).collect()] == [("r3", "r1")]


HEX_ID = "0123456789abcdef01234567"


@pytest.mark.parametrize("body,want", [
    ('{"documents":[{"id":"x","secret":"s3cr3t"},{"secret":1}],"value":{"version":2,"inner":{"id":1}},"zz":1}', '{"documents":[{"id":"x"},{}],"value":{"version":2}}'),
    (f'{{"version":1,"id":"{HEX_ID}","{HEX_ID}":{{"token":"t","value":[1,[{{"key":2}}]]}}}}', f'{{"{HEX_ID}":{{"value":[1,[{{}}]]}},"id":"{HEX_ID}","version":1}}'),
    ("[]", "[]"), ("{}", "{}"), ('"text"', '"text"'), ('{"id":null}', '{"id":null}')])
def test_bodies_are_filtered_at_every_depth(spark, body, want):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(B.shown_body(F.col("b")).alias("t")).first()["t"] == want
    if body.startswith("{"):
        shown = df.select(VA.observation_body("b").alias("m")).first()["m"]
        assert "secret" not in str(shown) and "token" not in str(shown)


def test_scoring_runs_once_for_all_sinks(spark):
    calls = spark.sparkContext.accumulator(0)

    def predict(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(question="q", p=[[0.5, 0.5]] * len(pdf), reject_reason=["too_long" if i % 10 == 0 else None for i in pdf["id"]])
    scored = spark.range(100).mapInPandas(predict, "id bigint, question string, p array<double>, reject_reason string")
    rows, rejected, summary = S.write_scored(scored, lambda d: d.agg(F.count(F.lit(1)).alias("n")), work_dir(spark, "out"))
    assert (rows.count(), rejected.count(), summary.first()["n"], calls.value) == (90, 10, 100, 100)
    out = work_dir(spark, "refused")
    with pytest.raises(ValueError):
        S.write_scored(scored, lambda d: d.agg(F.count(F.lit(1))), out, allowed=("other",))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{out}/rejected").count()


def test_replay_keeps_rows_without_an_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, 9), (5, None), (6, 7)], "id int, at bigint")
    assert core.drain(core.replay(df, "at", 3)).count() == 6


def test_structure_keys_follow_the_definition():
    k = RU._structure_keys
    assert k('["and",["or",0,1],2]') == k('["and",5,["or",7,3]]')
    assert k('["and",0,1]')[0] != k('["and",0,0]')[0] and k('["if",0,1,2]')[0] != k('["if",1,0,["not",2]]')[0]
    assert k('["not",["and",0,1]]')[1] == k('["or",["not",0],["not",1]]')[1] and k('["unless",0,1]')[1] == k('["and",0,["not",1]]')[1]
    assert k('["not",["not",["if",0,1,2]]]')[1] == k('["if",0,1,2]')[1] and k('["not",["if",0,1,2]]')[1] != k('["if",0,1,2]')[1]


def test_structure_keys_keep_the_order_of_children_of_one_shape():
    k = RU._structure_keys
    assert k('["or",["and",0,1],["and",1,0]]')[0] != k('["or",["and",0,1],["and",0,1]]')[0]
    assert k('["or",["and",0,1],["and",1,0]]') == k('["or",["and",7,3],["and",3,7]]')
    assert k('["or",["and",0,1],["not",2]]') == k('["or",["not",2],["and",1,0]]')
    assert k('["or",["and",0,1],0]') == k('["or",0,["and",0,1]]')


def test_instructions_are_structured_for_a_share(spark):
    import json
    from pyspark.sql import functions as F
    from tallymark.operators import perturb as A
    rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 100 == 1, "").otherwise('Say "which" \u00e9\nfits').alias("instr"))
    got = rows.withColumn("now", A.vary_instructions("instr", "s", F.col("id").cast("string"))).collect()
    changed = [r for r in got if r["now"] != r["instr"]]
    assert all(r["now"] is None for r in got if r["instr"] is None) and 0.11 < len(changed) / len(got) < 0.19
    assert all(json.loads(r["now"])["question"] == r["instr"] for r in changed) and {json.loads(r["now"])["focus"] for r in changed} == set(A.FOCUS)
    assert rows.limit(0).withColumn("now", A.vary_instructions("instr", "s")).count() == 0


def test_empty_populations_and_other_suites_are_refused(spark):
    from tallymark.operators import calibrate as C
    rows = spark.createDataFrame([(1, "unknowable", "clean", "t", "choice", [0.5, 0.5], 0)], "id int, source string, variant string, task string, type string, p array<double>, label int")
    with pytest.raises(ValueError):
        M.summarize(rows)
    with pytest.raises(ValueError):
        M.metrics(M.row_scores(rows.limit(0)), [])
    with pytest.raises(ValueError):
        C.compare_deltas(rows, rows, "a", "b")


def sequential(pairs):
    used, kept = set(), []
    for o, a, b in sorted(pairs):
        if a not in used and b not in used:
            kept.append(o)
            used |= {a, b}
    return kept


def test_unique_pairs_without_a_limit(spark, monkeypatch):
    """Random pairs, a hash that a third of them share, equal hashes, and a chain of 3,000 pairs, which takes few rounds."""
    import random
    rng = random.Random(8)
    mixed = [(o, f"h{rng.randint(0, 150)}", f"h{rng.randint(0, 150)}") for o in range(400)] + [(1000 + o, "hot", f"x{rng.randint(0, 90)}") for o in range(200)] + [(5000, "e", "e"), (5001, "e", "z")]
    chain = [(10_000 + o, f"c{o}", f"c{o + 1}") for o in range(3_000)]
    rows = spark.createDataFrame([("f", *p) for p in mixed + chain], "family string, ord bigint, h1 string, h2 string")
    rounds, decided = [], D._decided
    monkeypatch.setattr(D, "_decided", lambda live: rounds.append(1) or decided(live))
    assert sorted(r["ord"] for r in D.unique_pairs_by_family(rows).select("ord").collect()) == sequential(mixed + chain)
    assert len(rounds) <= 12
    assert D.unique_pairs_by_family(rows.limit(0)).collect() == []


def test_suites_are_refused_and_parents_watched(spark):
    from tallymark.operators import splits as P
    frame = lambda rows: spark.createDataFrame(rows, "id int, source string, skey string, split string, group_id string")
    public, inherited = frame([(1, "p", "a", "train", "g1"), (2, "p", "b", "calibration", "g2")]), frame([(3, "t", "c", "test", "g3"), (4, "t", "x", "train", "g4")])
    arms = {"one": frame([(5, "n", "d", "train", "g5")]), "two": frame([(6, "n", "e", "train", "g6")])}
    assert sorted(r["id"] for r in P.checked_suite(public, arms, inherited).collect()) == [1, 2, 3, 5, 6]
    for bad, code in (({**arms, "two": frame([(6, "n", "c", "train", "g6")])}, "reserved_state"), ({**arms, "two": frame([(6, "n", "d", "train", "g5")])}, "shared_state"),
                      ({**arms, "two": frame([(6, "n", "e", "train", "g6"), (7, "n", "f", "train", "g7")])}, "unequal_arms"), ({**arms, "two": frame([(5, "n", "e", "train", "g6")])}, "repeated_id")):
        with pytest.raises(Exception, match=f"suite refused: {code}"):
            P.checked_suite(public, bad, inherited).collect()
    lineage = P.suite_lineage({"public": public, "inherited": inherited})
    assert P.changed_parents(lineage, {"public": public, "inherited": inherited}).collect() == []
    assert [tuple(r) for r in P.changed_parents(lineage, {"public": public.withColumn("id", F.col("id") + 1), "inherited": inherited}).orderBy("split").collect()] == [("public", "calibration"), ("public", "train")]

"""Budget windows over chunk and block borders, stream twins, masks and as-of links."""
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import audits as AU
from tallymark.operators import events as B
from tallymark.plans.streaming_queries import StreamedOrders
from tallymark.session import work_dir
from tallymark.sources.fixtures import Tables
from tallymark.streaming import core, jobs


def greedy(sizes, budget):
    out, used, w = [], 0, 0
    for s in sizes:
        if used and used + s > budget:
            w, used = w + 1, 0
        used += s
        out.append(w)
    return out


@pytest.mark.parametrize("budget,chunk,block", [(10, 12, 3), (7, 7, 2), (25, 40, 1000)])
def test_windows_over_chunks_match_sequential_fold(spark, budget, chunk, block):
    rng = random.Random(budget)
    views = {"long": [rng.randint(1, budget) for _ in range(900)], "ones": [1] * 400, "short": [3, budget, 1], "one": [budget]}
    rows = [(v, "full", i, s) for v, sizes in views.items() for i, s in enumerate(sizes)]
    w = B.budget_windows(spark.createDataFrame(rows, "episode_id string, profile string, pos bigint, size bigint"), budget, chunk=chunk, block=block)
    got = {}
    for r in w.orderBy("episode_id", "pos").collect():
        got.setdefault(r["episode_id"], []).append(r["window"])
    assert got == {v: greedy(s, budget) for v, s in views.items()}


def test_over_budget_line_is_an_error(spark):
    d = spark.createDataFrame([("v", "full", 0, 11)], "episode_id string, profile string, pos bigint, size bigint")
    assert B.over_budget(d, 10).count() == 1
    with pytest.raises(Exception, match="exceeds"):
        B.budget_windows(d, 10).collect()


def late_lines(spark, seed=5, n=60):
    """Lines whose arrival lags by up to many gaps, so that later ordinals often arrive first."""
    rng = random.Random(seed)
    rows = [(f"e{k}", f"r{k}-{i}", i, rng.randint(1, 9), T0 + i * 1000, T0 + i * 1000 + rng.randint(0, 9000)) for k in range(3) for i in range(n)]
    d = spark.createDataFrame(rows, "episode_id string, request_id string, ordinal bigint, size bigint, occurred_ms bigint, arrival_ms bigint")
    return d, spark.createDataFrame([("flush", "flush", 0, 1, T0 * 2, T0 * 2)], d.schema)


T0 = 1_700_000_000_000


def test_stream_windows_equal_batch_when_lines_arrive_out_of_order(spark):
    d, flush = late_lines(spark)
    out = core.drain(jobs.budget_windows_stream(core.replay(d, "arrival_ms", slices=20, flush=flush), 20, "10 seconds")).filter("episode_id <> 'flush'")
    batch = B.budget_windows(d.withColumn("pos", F.col("ordinal")), 20, by=("episode_id",)).join(d.select("episode_id", F.col("ordinal").alias("pos"), "request_id"), ["episode_id", "pos"])
    key = lambda x: {(r["request_id"], r["window"]) for r in x.select("request_id", "window").collect()}
    assert key(out) == key(batch) and out.count() == 180


def test_replay_reads_its_table_once(spark):
    """Slices, cuts and flush rows come from the stored table; the steps behind it run once per row."""
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    d = spark.range(100).mapInPandas(tick, "id bigint")
    out = core.drain(core.replay(d, "id", slices=5, flush=lambda df: df.orderBy(F.col("id").desc()).limit(1).select((F.col("id") + 1000).alias("id"))))
    assert sorted(r["id"] for r in out.collect()) == [*range(100), 1099]
    assert seen.value == 100


def test_episodes_share_states(spark):
    """Many short episodes are kept in a bounded number of states, and each still has windows of its own."""
    rows = [(f"e{k}", f"r{k}-{i}", i, 7, T0 + 1000 * i + k, T0 + 1000 * i + k) for k in range(300) for i in range(4)]
    d = spark.createDataFrame(rows, "episode_id string, request_id string, ordinal bigint, size bigint, occurred_ms bigint, arrival_ms bigint")
    flush = spark.createDataFrame([("flush", "flush", 0, 1, T0 * 2, T0 * 2)], d.schema)
    stream = jobs.budget_windows_stream(core.replay(d, "arrival_ms", slices=3, flush=flush), 14, "10 seconds", idle_ms=10 ** 14, buckets=16)
    path = work_dir(spark, "shared")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 16
    got = {(r["request_id"], r["window"]) for r in spark.read.parquet(f"{path}/out").collect() if r["episode_id"] != "flush"}
    assert got == {(f"r{k}-{i}", i // 2) for k in range(300) for i in range(4)}


def test_monitor_keeps_episodes_of_one_state_apart(spark):
    cols = "episode_id string, request_id string, ordinal bigint, actor_id string, start_ms bigint, service_ms bigint, completed_ms bigint, status bigint, before_hash string, after_hash string, occurred_ms bigint, arrival_ms bigint"
    ok = lambda e, i, t, a, b: (e, f"{e}{i}", i, "x", t, t + 1, t + 2, 200, a, b, t, t)
    rows = [ok("a", 0, T0, "h0", "h1"), ok("b", 0, T0 + 1000, "g0", "g1"), ok("a", 1, T0 + 2000, "h1", "h1"), ok("b", 1, T0 + 3000, "g9", "g9"), ok(None, 0, T0 + 4000, "n", "n")]
    d = spark.createDataFrame(rows, cols)
    flush = spark.createDataFrame([ok("flush", 0, T0 * 2, "f", "f")], cols)
    out = core.drain(jobs.order_monitor(core.replay(d, "arrival_ms", slices=2, flush=flush), "1 second", buckets=1))
    assert [tuple(r) for r in out.collect()] == [("b", "b1", "broken_state_chain")]


def test_idle_episodes_leave_the_state(spark):
    d, flush = late_lines(spark, n=20)
    stream = jobs.budget_windows_stream(core.replay(d, "arrival_ms", slices=4, flush=flush.union(flush.withColumn("occurred_ms", F.col("occurred_ms") * 2))), 20, "10 seconds", idle_ms=60_000)
    path = work_dir(spark, "idle")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1          # the flush row itself may still wait


def test_monitor_in_order_and_with_any_actor_id(spark):
    actors = ["a|b", "c,d", "e"]
    rows, h = [], 0
    for i in range(40):
        rows.append(("ep", f"r{i}", i, actors[i % 3], T0 + i * 1000, T0 + i * 1000 + 10, T0 + i * 1000 + (3500 if i == 10 else 20), 200, f"h{h}", f"h{h + 1}" if i != 20 else "odd", T0 + i * 1000, T0 + i * 1000 + (i * 7919) % 9000))
        h += 1
    d = spark.createDataFrame(rows, "episode_id string, request_id string, ordinal bigint, actor_id string, start_ms bigint, service_ms bigint, completed_ms bigint, status bigint, before_hash string, after_hash string, occurred_ms bigint, arrival_ms bigint")
    flush = d.limit(1).withColumn("episode_id", F.lit("flush")).withColumn("occurred_ms", F.lit(T0 * 2)).withColumn("arrival_ms", F.lit(T0 * 2))
    out = core.drain(jobs.order_monitor(core.replay(d, "arrival_ms", slices=20, flush=flush), "10 seconds")).filter("episode_id <> 'flush'")
    assert {(r["request_id"], r["code"]) for r in out.collect()} == {("r11", "service_order"), ("r13", "actor_overlap"), ("r21", "broken_state_chain")}


def ledger(spark, rows):
    return spark.createDataFrame(rows, "episode_id string, actor_id string, request_id string, ordinal bigint, start_ms bigint, service_ms bigint, completed_ms bigint")


@pytest.mark.parametrize("change,codes", [({}, set()), ({"start_ms": 5}, {"request_order", "actor_overlap"}), ({"service_ms": 190}, {"response_before_cause", "service_order", "x"} - {"x"}), ({"completed_ms": 230}, {"response_before_cause"})])
def test_order_findings(spark, change, codes):
    rows = [dict(episode_id="e", actor_id="a", request_id=f"r{i}", ordinal=i, start_ms=100 * i, service_ms=100 * i + 30, completed_ms=100 * i + 50) for i in range(4)]
    rows[2].update(change)
    if "service_ms" in change:
        rows[1]["completed_ms"] = 195
    found = {r["code"] for r in AU.audit_order(ledger(spark, [tuple(r.values()) for r in rows])).collect()}
    assert found == codes


def test_masks_do_not_depend_on_the_actor(spark):
    d = spark.createDataFrame([(f"e{o}", "g", i) for o in "hsa" for i in range(30)], "episode_id string, group_id string, ordinal bigint")
    m = B.masked(d)
    assert AU.audit_mask_independence(m).count() == 0
    assert m.filter("profile = 'prefix_loss' and not kept").count() == 6


def test_handoff_takes_the_latest_other_writer(spark):
    day = 86_400_000
    rows = [("w", "PUT", 0), ("v", "PUT", 3 * day), ("w", "PUT", 5 * day), ("w", "GET", 6 * day), ("x", "GET", 7 * day), ("x", "POST", 9 * day)]
    d = spark.createDataFrame([("e", a, f"r{i}", m, "/exports" if m == "POST" else "/artifacts/q", 200, at, at + 10, i) for i, (a, m, at) in enumerate(rows)],
                              "episode_id string, actor_id string, request_id string, method string, path string, status int, start_ms bigint, completed_ms bigint, event_id bigint")
    got = {r["read_request"]: (r["write_request"], r["export_request"]) for r in B.discover_handoffs(d).collect()}
    assert got == {"r3": ("r1", None), "r4": ("r2", "r5")}


def test_features_survive_renaming_and_clock_shift(spark):
    rows = [("e", f"a{i % 2}", i, 1000 * i, 1000 * i + 40 + i) for i in range(20)]
    mk = lambda rs: spark.createDataFrame(rs, "episode_id string, actor_id string, event_id bigint, start_ms bigint, completed_ms bigint")
    val = lambda d: sorted(map(tuple, B.timing_features(d).drop("episode_id").collect()))
    base = val(mk(rows))
    moved = val(mk([("e", "z" + a, i, s + 7 * 86_400_000, c + 7 * 86_400_000) for _, a, i, s, c in rows]))
    assert base == moved


def test_questions_of_streamed_orders(spark, tmp_path):
    """the parts of a stream were counted before it ran."""
    rows = [(i, i % 7, f"{i % 5 + 1}-P", "FOP"[i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    drained = core.drain_small(jobs.running_calibration(StreamedOrders(t).decisions("A")))
    batch = jobs.running_calibration(t.decisions("A"))
    kept = lambda df: sorted((r["task"], r["bin"], r["n"], r["correct"], round(r["s_conf"], 9), r["confident_errors"]) for r in df.collect())
    assert kept(drained) == kept(batch) and sum(r[2] for r in kept(drained)) == 180

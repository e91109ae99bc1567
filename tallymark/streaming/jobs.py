"""Structured Streaming forms of the event and metric operators (W). Each equals its batch twin once the stream is drained."""
import pickle

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import scoring as M
from ..operators.events import route_class


def timed(df, column, name="event_time"):
    return df.withColumn(name, F.timestamp_millis(F.col(column)))


def ingest_events(events, delay_ms):
    """Event time is occurred_at; the watermark allows `delay_ms` for collection; rows collected later are flagged."""
    e = timed(events, "occurred_at").withWatermark("event_time", f"{delay_ms} milliseconds")
    return e.withColumn("late", (F.col("collected_at") - F.col("occurred_at")) > delay_ms)


def late_counts(ingested):
    """Rows by kind and lateness (a handful of rows, kept complete)."""
    return ingested.groupBy("kind", "late").agg(F.count(F.lit(1)).alias("n"))


def dedup_events(events, delay="10 minutes"):
    """One row per event id; the id is remembered until the watermark has passed it."""
    return timed(events, "occurred_at").withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_uid"])


def pair_request_response(requests, responses, within="10 seconds", delay="1 minute"):
    """Responses joined to their request within an interval; unmatched requests come out once the watermark has passed."""
    q = timed(requests, "occurred_at", "q_time").withWatermark("q_time", delay).select("event_uid", "episode_id", "request_id", "actor_id", F.col("occurred_at").alias("requested_at"), "q_time")
    p = timed(responses, "occurred_at", "p_time").withWatermark("p_time", delay).select("parent_event", F.col("occurred_at").alias("responded_at"), "status", "p_time")
    cond = (F.col("event_uid") == F.col("parent_event")) & (F.col("p_time") >= F.col("q_time")) & (F.col("p_time") <= F.col("q_time") + F.expr(f"INTERVAL {within}"))
    return q.join(p, cond, "leftOuter").select("episode_id", "request_id", "actor_id", "requested_at", "responded_at", "status", "q_time")


def _activity(g):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return g.agg(F.count(F.lit(1)).alias("requests"), *[n(F.col("method") == m).alias(f"method_{m}") for m in ("GET", "POST", "PUT")], n(F.col("status") >= 400).alias("failed"),
                 *[n(route_class() == r).alias(f"route_{r}") for r in ("documents", "document_item", "exports", "session", "artifact_item")])


def activity_windows(tx, length, slide=None, delay="10 minutes"):
    """Request counts per actor in tumbling or sliding windows."""
    t = timed(tx, "start_ms").withWatermark("event_time", delay)
    a = _activity(t.groupBy("actor_id", F.window("event_time", length, slide or length)))
    return a.withColumn("window_start", F.unix_millis("window.start")).withColumn("window_end", F.unix_millis("window.end")).drop("window")


def activity_sessions(tx, gap, delay="10 minutes"):
    """Request counts per actor in sessions separated by a gap."""
    t = timed(tx, "start_ms").withWatermark("event_time", delay)
    a = _activity(t.groupBy("actor_id", F.session_window("event_time", gap)))
    return a.withColumn("window_start", F.unix_millis("session_window.start")).withColumn("window_end", F.unix_millis("session_window.end")).drop("session_window")


# ---- ordered state -------------------------------------------------------------------------------------------------
ROWS_PER_BUCKET = 20_000


def buckets_for(rows):
    """How many buckets of keys a stream of about `rows` rows is dealt to; fixed for the life of the stream."""
    return max(256, rows // ROWS_PER_BUCKET)


def _ordered_state(df, key, columns, order, process, schema, idle_ms, buckets):
    """Rows of every key in `order`, which must not run against event time: a row is held until the watermark has passed its event
    time - no earlier row of the key can come after that - and then handed to `process`, with what the key remembers. A call
    of Python costs more than the few rows that a key has in a batch, so keys share `buckets` states by hash. A bucket remembers per key
    its last event time and the processor's own values, and the rows still waiting (those of one watermark delay). A key with
    nothing waiting is forgotten once the watermark is `idle_ms` past its last row."""
    width = 2 + len(columns)
    places = [2 + columns.index(o) for o in order]

    def run(_, batches, state):
        memory, held = pickle.loads(state.get[0]) if state.exists else ({}, [])
        mark = state.getCurrentWatermarkMs()
        for pdf in () if state.hasTimedOut else batches:
            new = list(zip(*(pdf[c].tolist() for c in (key, "occurred_ms", *columns))))
            for r in new:
                last, values = memory.get(r[0], (0, None))
                memory[r[0]] = max(last, int(r[1])), values
            held += new
        ready, waiting = {}, []
        for r in held:
            if r[1] <= mark:
                ready.setdefault(r[0], []).append(r)
            else:
                waiting.append(r)
        out = []
        for k, rows in ready.items():
            last, values = memory[k]
            memory[k] = last, process(k, values, [r[2:width] for r in sorted(rows, key=lambda r: [r[i] for i in places])], out)
        busy = {r[0] for r in waiting}
        memory = {k: m for k, m in memory.items() if k in busy or mark <= m[0] + idle_ms}
        if memory:
            state.update((pickle.dumps((memory, waiting)),))
            state.setTimeoutTimestamp(max(mark + 1, int(min([r[1] for r in waiting] + [m[0] + idle_ms for k, m in memory.items() if k not in busy]))))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [field.split()[0] for field in schema.split(", ")]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(run, schema, "memory binary", "append", GroupStateTimeout.EventTimeTimeout)


IDLE_MS = 14 * 24 * 3600 * 1000


def budget_windows_stream(lines, budget, delay="10 minutes", idle_ms=IDLE_MS, buckets=256):
    """Greedy budget windows with the open window carried in state. lines = (episode_id, request_id, ordinal, size,
    occurred_ms), ordinals rising with event time. A line larger than the budget stops the job. Lines later than `delay` are dropped; an episode
    silent for `idle_ms` of event time is forgotten, and a line after that would open its windows at 0 again."""
    def process(key, memory, rows, out):
        window, used = memory or (0, 0)
        for request, _, size in rows:
            if size > budget or size < 1:
                raise ValueError("one complete line exceeds the budget or is empty")
            if used and used + size > budget:
                window, used = window + 1, 0
            used += size
            out.append((key, request, window))
        return int(window), int(used)
    t = timed(lines, "occurred_ms").withWatermark("event_time", delay)
    return _ordered_state(t, "episode_id", ["request_id", "ordinal", "size"], ["ordinal"], process, "episode_id string, request_id string, window bigint", idle_ms, buckets)


def order_monitor(tx, delay="10 minutes", idle_ms=IDLE_MS, buckets=256):
    """Order and state-chain findings per episode from the last start, completion and hash, and each actor's last
    completion. `occurred_ms` is the event time that rises with the ordinals; late and idle rows as in W5."""
    def process(key, memory, rows, out):
        start, done, state_hash, ends = memory or (-1, -1, "", {})
        for request, _, actor, started, service, completed, status, before, after in rows:
            found = []
            if start >= 0:
                found += ["request_order"] * (started < start) + ["service_order"] * (service < done) + ["broken_state_chain"] * (before != state_hash)
            if started < ends.get(actor, -1):
                found.append("actor_overlap")
            if status >= 400 and before != after:
                found.append("failed_request_mutates_state")
            out += [(key, request, c) for c in found]
            start, done, state_hash = started, completed, after
            ends[actor] = completed
        return int(start), int(done), state_hash, {a: int(v) for a, v in ends.items()}
    cols = ["request_id", "ordinal", "actor_id", "start_ms", "service_ms", "completed_ms", "status", "before_hash", "after_hash"]
    t = timed(tx, "occurred_ms").withWatermark("event_time", delay)
    return _ordered_state(t, "episode_id", cols, ["ordinal"], process, "episode_id string, request_id string, code string", idle_ms, buckets)


def running_calibration(rows):
    """Counts, hits, confidence sums and confident errors per (task, bin), kept up to date as prediction rows arrive.
    Tasks x bins rows."""
    s = M.row_scores(rows)
    return s.groupBy("task", M.ece_bin("conf").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("double")).alias("correct"), F.sum("conf").alias("s_conf"), F.sum(F.col("confident_error").cast("bigint")).alias("confident_errors"))

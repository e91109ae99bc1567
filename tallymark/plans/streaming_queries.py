"""W queries: drained streams next to the SQL of their batch twins."""
from pyspark.sql import functions as F

from ..functions.text import h32
from ..functions.vectors import r6
from ..operators import audits as AU
from ..operators import events as B
from ..session import settle
from ..sources.fixtures import Tables
from ..streaming import core, jobs
from .events_queries import CD, codes_sql
from .oracle import h, r6 as R, sql
from .registry import query
from .scoring_queries import EDGE

FAR = 10 ** 10   # ms added to the flush row, so that the watermark passes every real row


def flush_row(df, column):
    """One row far in the future (ids made unusable) that moves the watermark past all real rows."""
    last = df.orderBy(F.col(column).desc()).limit(1)
    for name, kind in df.dtypes:
        if name.endswith(("_ms", "_at")):
            last = last.withColumn(name, F.col(name) + FAR)
        elif name in ("event_uid", "parent_event", "request_id", "episode_id", "actor_id"):
            last = last.withColumn(name, F.lit("flush"))
    return last


def last_row(column):
    """The flush row of the table that is replayed."""
    return lambda df: flush_row(df, column)


def event_rows(t):
    return B.explode_events(t.tx().withColumn("ordinal", F.col("event_id")))


@query("W1_late_counts", sql("select 'request' as kind, request_collected_ms-start_ms>300 as late, count(*) as n from tx group by 2 union all select 'response', response_collected_ms-completed_ms>300, count(*) from tx group by 2", "tx"))
def _(t):
    s = core.replay(event_rows(t), "occurred_at")
    return core.drain_small(jobs.late_counts(jobs.ingest_events(s, 300)), "late")


@query("W2_dedup_events", sql("select request_id, kind from tx cross join (values ('request'),('response')) v(kind)", "tx"))
def _(t):
    e = event_rows(t)
    twice = e.unionByName(e.filter(h32("twice", F.col("event_uid")) % 5 == 0))
    return core.drain(jobs.dedup_events(core.replay(twice, "occurred_at")), "dedup").select("request_id", "kind")


@query("W3_pair_request_response", sql(f"select request_id, start_ms as requested_at, case when {h(repr('lost'), 'request_id')}%20<>0 then completed_ms end as responded_at, case when {h(repr('lost'), 'request_id')}%20<>0 then status end as status from tx", "tx"))
def _(t):
    e = settle(event_rows(t))
    q, p = e.filter("kind = 'request'"), e.filter((F.col("kind") == "response") & (h32("lost", F.col("request_id")) % 20 != 0))
    qs, ps = core.replay(q, "occurred_at", flush=last_row("occurred_at")), core.replay(p, "occurred_at", flush=last_row("occurred_at"))
    out = core.drain(jobs.pair_request_response(qs, ps), "pairs").filter("request_id <> 'flush'")
    return out.select("request_id", "requested_at", "responded_at", F.col("status").cast("bigint").alias("status"))


P0 = "string_split(path,'?')[1]"
ACTV = f"""count(*) as requests, count(case when method='GET' then 1 end) as "method_GET", count(case when method='POST' then 1 end) as "method_POST", count(case when method='PUT' then 1 end) as "method_PUT", count(case when status>=400 then 1 end) as failed,
 count(case when {P0}='/documents' then 1 end) as route_documents, count(case when {P0} like '/documents/%' then 1 end) as route_document_item, count(case when {P0}='/exports' then 1 end) as route_exports, count(case when {P0}='/session' then 1 end) as route_session,
 count(case when {P0} like '/artifacts/%' then 1 end) as route_artifact_item"""
HOUR = 3600000


def tx_stream(t):
    tx = t.tx().select("actor_id", "method", "path", "status", "start_ms")
    return core.replay(tx, "start_ms", flush=last_row("start_ms"))


@query("W4_tumbling_windows", sql(f"select actor_id, start_ms//{6 * HOUR}*{6 * HOUR} as window_start, start_ms//{6 * HOUR}*{6 * HOUR}+{6 * HOUR} as window_end, {ACTV} from tx group by 1,2,3", "tx"))
def _(t):
    return core.drain(jobs.activity_windows(tx_stream(t), "6 hours"), "tumbling").filter("actor_id <> 'flush'")


@query("W4_sliding_windows", sql(f"select actor_id, w as window_start, w+{12 * HOUR} as window_end, {ACTV} from (select *, unnest([start_ms//{6 * HOUR}*{6 * HOUR}, start_ms//{6 * HOUR}*{6 * HOUR}-{6 * HOUR}]) as w from tx) group by 1,2,3", "tx"))
def _(t):
    return core.drain(jobs.activity_windows(tx_stream(t), "12 hours", "6 hours"), "sliding").filter("actor_id <> 'flush'")


@query("W4_session_windows", sql(f"""select actor_id, min(start_ms) as window_start, max(start_ms)+{12 * HOUR} as window_end, {ACTV} from (select *, sum(new) over (partition by actor_id order by start_ms, event_id) as sid from (
 select *, case when start_ms-lag(start_ms) over (partition by actor_id order by start_ms, event_id)<{12 * HOUR} then 0 else 1 end as new from tx)) group by actor_id, sid""", "tx"))
def _(t):
    return core.drain(jobs.activity_sessions(tx_stream(t), "12 hours"), "sessions").filter("actor_id <> 'flush'")


BUDGET = 400


@query("W5_budget_windows_stream", sql("""select episode_id, request_id, win as "window" from g""", "txo", s="select episode_id, request_id, ordinal as pos, 60+length(path)+length(request_body)+length(response_body) as size from txo",
                                       g=f"""select episode_id, request_id, pos, size as used, 0 as win from s where pos=0 union all select s.episode_id, s.request_id, s.pos, case when g.used+s.size>{BUDGET} then s.size else g.used+s.size end,
 case when g.used+s.size>{BUDGET} then g.win+1 else g.win end from g join s on s.episode_id=g.episode_id and s.pos=g.pos+1"""))
def _(t):
    tx = t.tx_ordered()
    lines = tx.select("episode_id", "request_id", "ordinal", (60 + F.length("path") + F.length("request_body") + F.length("response_body")).cast("bigint").alias("size"), F.col("start_ms").alias("occurred_ms"), F.col("response_collected_ms").alias("arrival_ms"))
    s = core.replay(lines, "arrival_ms", slices=20, flush=last_row("occurred_ms"))
    return core.drain(jobs.budget_windows_stream(s, BUDGET, buckets=jobs.buckets_for(t.events.count())), "windows").filter("episode_id <> 'flush'")


def monitored(t):
    c = AU.seed_chain_defects(t.tx_chain())
    x = h32("mdef", F.col("event_id")) % 50
    c = c.withColumn("occurred_ms", F.col("start_ms"))
    c = c.withColumn("service_ms", F.when(x == 0, F.col("service_ms") - 90000000).otherwise(F.col("service_ms"))).withColumn("start_ms", F.when(x == 1, F.col("start_ms") - 90000000).otherwise(F.col("start_ms")))
    return c.select("episode_id", "request_id", "ordinal", "actor_id", "start_ms", "service_ms", "completed_ms", F.col("status").cast("bigint").alias("status"), "before_hash", "after_hash", "occurred_ms", F.col("response_collected_ms").alias("arrival_ms"))


@query("W6_order_monitor", sql("select episode_id, subject as request_id, code from (" + codes_sql("l", [("request_order", "ps is null or start_ms>=ps"), ("service_order", "pc is null or service_ms>=pc"), ("actor_overlap", "pa is null or start_ms>=pa"), ("broken_state_chain", "ph is null or before_hash=ph"),
                                                    ("failed_request_mutates_state", "status<400 or before_hash=after_hash")]) + ")", "txc", cd=CD,
                               md=f"select * replace(case when m=0 then service_ms-90000000 else service_ms end as service_ms, case when m=1 then start_ms-90000000 else start_ms end as start_ms) from (select *, {h(repr('mdef'), 'event_id::varchar')}%50 as m from cd)",
                               l="select *, lag(start_ms) over w as ps, lag(completed_ms) over w as pc, lag(after_hash) over w as ph, lag(completed_ms) over (partition by episode_id, actor_id order by ordinal) as pa from md window w as (partition by episode_id order by ordinal)"))
def _(t):
    m = monitored(t)
    s = core.replay(m, "arrival_ms", slices=20, flush=last_row("occurred_ms"))
    return core.drain(jobs.order_monitor(s, buckets=jobs.buckets_for(t.events.count())), "monitor").filter("episode_id <> 'flush'")


class StreamedOrders(Tables):
    """The derived prediction rows over orders that arrive as a stream."""

    def __init__(self, batch):
        super().__init__(batch.spark, batch.dir)
        self._orders = core.replay(batch.orders, "o_orderkey")

    @property
    def orders(self):
        return self._orders


@query("W7_running_calibration", sql(f"select task, {EDGE} as bin, count(*) as n, sum(ok::int)::double as correct, {R('sum(conf)')} as s_conf, sum((conf>=0.9e0 and not ok)::int)::bigint as confident_errors from scA group by task, bin", "scA"))
def _(t):
    c = core.drain_small(jobs.running_calibration(StreamedOrders(t).decisions("A")), "calibration")
    return c.select("task", "bin", "n", "correct", r6("s_conf", "s_conf"), "confident_errors")

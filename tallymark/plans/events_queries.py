"""B queries: event-log projections, windows, features and audits."""
from pyspark.sql import functions as F

from ..functions.text import h32
from ..operators import audits as AU
from ..operators import events as B
from ..session import settle
from .oracle import h, r6 as R, sql
from .registry import query
from .scoring_queries import rounded


@query("B1_project_http", sql("select request_id, method, path, status, start_ms, request_collected_ms, sha256(request_body||response_body) as body_sha, retry_after_ms from tx", "tx"))
def _(t):
    p = B.project_http(t.tx())
    return p.select("request_id", "method", "path", "status", "start_ms", "request_collected_ms", F.sha2(F.concat("request_body", "response_body"), 256).alias("body_sha"), "retry_after_ms")


@query("B1_projection_parity", sql("select request_id, unnest(['extra','missing']) as side from tx where event_id%97=0", "tx"))
def _(t):
    tx = t.tx()
    broken = B.project_network(tx.withColumn("status", F.when(F.col("event_id") % 97 == 0, F.col("status") + 1).otherwise(F.col("status"))))
    return B.projection_parity(tx, broken, B.WIRE).select("request_id", "side")


@query("B2_explode_events", sql("""select request_id, ordinal*2 as event_ordinal, 'request' as kind, null::varchar as parent_event, start_ms as occurred_at, null::bigint as status from txo
 union all select request_id, ordinal*2+1, 'response', request_id||'-q', completed_ms, status from txo""", "txo"))
def _(t):
    return B.explode_events(t.tx_ordered()).select("request_id", "event_ordinal", "kind", "parent_event", "occurred_at", F.col("status").cast("bigint").alias("status"))


@query("B3_apply_masks", sql("select request_id, profile, ordinal from views", "views"))
def _(t):
    return B.apply_masks(t.tx_ordered()).select("request_id", "profile", "ordinal")


VD = f"""select episode_id, profile, case when d=0 then ordinal+5000 else ordinal end as ordinal, request_id, rn as seq, case when d=1 then not omitted else omitted end as omitted, case when d=2 then 'edited' else request_id end as content, d from (
 select *, row_number() over (partition by episode_id, profile, omitted order by case when {h(repr('swap'), 'event_id::varchar')}%50=0 then ordinal-1.5 else ordinal end) as rn from (
 select txo.*, p.profile, not (p.profile='full' or (p.profile='prefix_loss' and ordinal>=2) or (p.profile='sampled_loss' and {h(repr('mask'), 'group_id', 'ordinal::varchar')}/4294967296e0<0.8e0)) as omitted, {h(repr('vdef'), 'p.profile', 'event_id::varchar')}%80 as d
 from txo cross join (values ('full'),('prefix_loss'),('sampled_loss')) p(profile)))"""


def damaged_views(t):
    from pyspark.sql import Window
    v = B.masked(t.tx_ordered()).withColumn("omitted", ~F.col("kept")).withColumn("d", h32("vdef", F.col("profile"), F.col("event_id")) % 80)
    at = F.when(h32("swap", F.col("event_id")) % 50 == 0, F.col("ordinal") - 1.5).otherwise(F.col("ordinal").cast("double"))
    from ..functions import spread
    v = spread.spread_rank(v.withColumn("_at", at), ["episode_id", "profile", "omitted"], ["_at"], F.floor(F.col("_at") / 4096), "seq")
    d = F.col("d")
    return v.select("episode_id", "profile", F.when(d == 0, F.col("ordinal") + 5000).otherwise(F.col("ordinal")).alias("ordinal"), "request_id", "seq", F.when(d == 1, ~F.col("omitted")).otherwise(F.col("omitted")).alias("omitted"),
                    F.when(d == 2, "edited").otherwise(F.col("request_id")).alias("content"))


@query("B4_audit_views", sql("""select episode_id, subject, unnest(codes) as code from (select episode_id, profile||'/'||ordinal as subject, list_filter([case when not (s+o=1 and want is not null) then 'export_coverage' end, case when s>0 and content is distinct from want then 'export_content' end,
  case when profile='full' and o>0 then 'full_view_omits_events' end, case when profile='prefix_loss' and (o>0)<>(ordinal<2) then 'prefix_mask' end], lambda x: x is not null) as codes from (
  select coalesce(w.episode_id,g.episode_id) as episode_id, coalesce(w.profile,g.profile) as profile, coalesce(w.ordinal,g.ordinal) as ordinal, w.request_id as want, coalesce(s,0) as s, coalesce(o,0) as o, content from
  (select episode_id, ordinal, request_id, p.profile from txo cross join (values ('full'),('prefix_loss'),('sampled_loss')) p(profile)) w full join
  (select episode_id, profile, ordinal, sum((not omitted)::int) as s, sum(omitted::int) as o, max(case when not omitted then content end) as content from vd group by episode_id, profile, ordinal) g on w.episode_id=g.episode_id and w.profile=g.profile and w.ordinal=g.ordinal))
 union all select episode_id, profile||'/'||ordinal, 'export_order' from (select *, lag(ordinal) over (partition by episode_id, profile, omitted order by seq, ordinal) as po from vd) where po>=ordinal""", "txo", vd=VD))
def _(t):
    tx = t.tx_ordered().withColumn("content", F.col("request_id"))
    return AU.audit_views(tx, damaged_views(t))


@query("B4_empty_views", sql("select profile, count(*) as empty_views from (select e.episode_id, p.profile from (select distinct episode_id from txo) e cross join (values ('full'),('prefix_loss'),('sampled_loss')) p(profile)) x where not exists (select 1 from views v where v.episode_id=x.episode_id and v.profile=x.profile) group by profile", "views"))
def _(t):
    tx = t.tx_ordered()
    v = B.masked(tx).withColumn("omitted", ~F.col("kept"))
    return AU.empty_views(tx, v)


@query("B5_audit_mask_independence", sql(f"""select group_id, profile, ordinal, 'origin_dependent_observation_mask' as code from (select txo.group_id, ordinal, p.profile, (p.profile='full' or (p.profile='prefix_loss' and ordinal>=2) or (p.profile='sampled_loss' and {h(repr('mask'), 'group_id', 'ordinal::varchar')}/4294967296e0<0.8e0))
 <> (event_id%41=0) as kept from txo cross join (values ('full'),('prefix_loss'),('sampled_loss')) p(profile)) group by group_id, profile, ordinal having min(kept::int)<>max(kept::int)""", "txo"))
def _(t):
    m = B.masked(t.tx_ordered())
    return AU.audit_mask_independence(m.withColumn("kept", F.col("kept") != (F.col("event_id") % 41 == 0)))


OBS = r"""select *, case when method='GET' then '{}' else '{"if_version":'||version||',"value":'||k||'}' end as req, case when event_type='error' then '{"error":"busy","retry_after_ms":'||k*10||'}' else '{"id":"'||resource_id||'","value":'||k||',"version":'||version||'}' end as resp from views"""
TOK = r"""select episode_id, profile, rid, row_number() over (partition by episode_id, profile order by min(ordinal*100+p))-1 as n from (
 select episode_id, profile, ordinal, unnest(ids) as rid, generate_subscripts(ids,1) as p from (select *, list_concat(regexp_extract_all(path,'[0-9a-f]{24}'), list_concat(regexp_extract_all(req,'"([0-9a-f]{24})"',1), regexp_extract_all(resp,'"([0-9a-f]{24})"',1))) as ids from obs)) group by episode_id, profile, rid"""
ACT = "select episode_id, profile, actor_id, 'u'||(row_number() over (partition by episode_id, profile order by min(ordinal))-1) as actor from obs group by episode_id, profile, actor_id"
AL = r"""select o.*, a.actor, case when regexp_extract(path,'[0-9a-f]{24}')<>'' then replace(path, regexp_extract(path,'[0-9a-f]{24}'), 'r'||(select n from tok x where x.episode_id=o.episode_id and x.profile=o.profile and x.rid=regexp_extract(o.path,'[0-9a-f]{24}'))) else path end as path2,
 case when resource_id is not null and resp like '{"id"%' then replace(resp, resource_id, 'r'||(select n from tok x where x.episode_id=o.episode_id and x.profile=o.profile and x.rid=o.resource_id)) else resp end as resp2 from obs o join act a using(episode_id, profile, actor_id)"""
ALIAS = {"obs": OBS, "tok": TOK, "act": ACT, "al": AL}


@query("B6_alias_ids", sql("select request_id, profile, actor, path2 as path, req, resp2 as resp from al", "views", **ALIAS))
def _(t):
    return B.alias_ids(B.apply_masks(B.with_shown_bodies(t.tx_ordered()))).select("request_id", "profile", "actor", "path", "req", "resp")


LINE = "start_ms||'..'||completed_ms||'ms '||actor||' '||method||' '||path2||' '||status||' '||request_bytes||'/'||response_bytes||'B req='||req||' resp='||resp2||case when coalesce(retry_after_ms,0)>0 then ' retry_after='||retry_after_ms||'ms' else '' end"


@query("B7_observation_lines", sql(f"select request_id, profile, {LINE} as line from al", "views", **ALIAS))
def _(t):
    return B.observation_lines(B.alias_ids(B.apply_masks(B.with_shown_bodies(t.tx_ordered())))).select("request_id", "profile", "line")


BUDGET = 400
SIZED = "select episode_id, profile, request_id, ordinal, row_number() over (partition by episode_id, profile order by ordinal)-1 as pos, 60+length(path)+length(request_body)+length(response_body) as size from views"
GREEDY = f"""select episode_id, profile, pos, size, size as used, 0 as win from sized where pos=0
 union all select s.episode_id, s.profile, s.pos, s.size, case when g.used+s.size>{BUDGET} then s.size else g.used+s.size end, case when g.used+s.size>{BUDGET} then g.win+1 else g.win end
 from greedy g join sized s on s.episode_id=g.episode_id and s.profile=g.profile and s.pos=g.pos+1"""


def sized_lines(t):
    from ..functions import spread
    size = (60 + F.length("path") + F.length("request_body") + F.length("response_body")).cast("bigint")
    v = B.apply_masks(t.tx_ordered(size=size))
    v = spread.spread_rank(v, ["episode_id", "profile"], ["ordinal"], F.floor(F.col("ordinal") / 4096), "pos").withColumn("pos", F.col("pos") - 1)
    return v.select("episode_id", "profile", "request_id", "ordinal", "pos", "size")


@query("B8_budget_windows", sql('select episode_id, profile, pos, size, win as "window" from greedy', "views", sized=SIZED, greedy=GREEDY))
def _(t):
    return B.budget_windows(sized_lines(t), BUDGET)


@query("B9_window_records", sql("""select sha_id as window_id, win as "window", max(win) over (partition by episode_id, profile)+1 as window_count, n, used, request_ids from (
 select episode_id, profile, win, substr(sha256(episode_id||':'||profile||':'||win),1,24) as sha_id, count(*) as n, sum(g.size)::bigint as used, string_agg(request_id, ',' order by pos) as request_ids from greedy g join sized using(episode_id, profile, pos) group by episode_id, profile, win)""",
                                "views", sized=SIZED, greedy=GREEDY))
def _(t):
    lines = settle(sized_lines(t))
    r = B.window_records(B.budget_windows(lines, BUDGET), lines)
    return r.select("window_id", "window", "window_count", "n", "used", F.array_join("request_ids", ",").alias("request_ids"))


@query("B9_window_coverage", sql("select profile, 0 as broken from (values ('full'),('prefix_loss'),('sampled_loss')) v(profile)"))
def _(t):
    lines = settle(sized_lines(t))
    f = B.window_coverage_findings(B.window_records(B.budget_windows(lines, BUDGET), lines), lines)
    every = t.spark.createDataFrame([(p,) for p in B.PROFILES], "profile string")
    return every.join(f.groupBy("profile").agg(F.count(F.lit(1)).alias("n")), "profile", "left").select("profile", F.coalesce("n", F.lit(0)).alias("broken"))


MEAS = """select episode_id, 'start_gap_ms' as measure, (start_ms-lag(start_ms) over (partition by episode_id order by start_ms,event_id))::double as value from tx
 union all select episode_id, 'response_ms', completed_ms-start_ms from tx union all select episode_id, 'actor_start_gap_ms', start_ms-lag(start_ms) over (partition by episode_id, actor_id order by start_ms,event_id) from tx
 union all select episode_id, 'actor_idle_ms', start_ms-lag(completed_ms) over (partition by episode_id, actor_id order by start_ms,event_id) from tx"""
TIMING = f"""select e.episode_id, duration_ms, measure, {','.join(f'round(coalesce({x},0)+1.2e-9,3) as {n}' for n, x in (('mean', 'mean'), ('std', 'std'), ('min', 'mn'), ('p25', 'p25'), ('median', 'p50'), ('p75', 'p75'), ('max', 'mx')))} from
 (select episode_id, (max(completed_ms)-min(start_ms))::double as duration_ms, unnest(['start_gap_ms','response_ms','actor_start_gap_ms','actor_idle_ms']) as measure from tx group by episode_id) e left join
 (select episode_id, measure, avg(value) as mean, stddev_pop(value) as std, min(value) as mn, quantile_cont(value,0.25) as p25, quantile_cont(value,0.5) as p50, quantile_cont(value,0.75) as p75, max(value) as mx from meas where value is not null group by episode_id, measure) m using(episode_id, measure)"""


@query("B10_timing_features", sql(TIMING, "tx", meas=MEAS))
def _(t):
    f = B.timing_features(t.tx())
    return f.select("episode_id", "duration_ms", "measure", *[F.round(F.col(c) + F.lit(1.2e-9), 3).alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])


P0 = "string_split(path,'?')[1]"
ROUTE = f"case when {P0} in ('/documents','/exports','/session') then substr({P0},2) when {P0} like '/documents/%' then 'document_item' when {P0} like '/artifacts/%' then 'artifact_item' else 'other' end"
cnt = lambda c: f"count(case when {c} then 1 end)"
STRUCT = f"""select episode_id, count(*) as requests, count(distinct actor_id) as observed_actors, count(distinct {P0}) as distinct_resources, count(*)-count(distinct (method,{P0})) as repeat_method_resource,
 {','.join(cnt(f"method='{m}'") + f' as "method_{m}"' for m in B.METHODS)}, {cnt("method not in ('GET','POST','PUT','DELETE','PATCH')")} as method_other, {','.join(cnt(f'status={s}') + f' as status_{s}' for s in B.STATUSES)},
 {','.join(cnt(f'status//100={b}') + f' as status_{b}xx' for b in (2, 3, 4, 5))}, {','.join(cnt(f"{ROUTE}='{r}'") + f' as route_{r}' for r in B.ROUTES)} from tx group by episode_id"""


@query("B11_structural_features", sql(STRUCT, "tx"))
def _(t):
    return B.structural_features(t.tx())


@query("B12_fit_baselines")
def _(t):
    f = B.feature_table(t.tx())
    structural = [c for c in f.columns if c.startswith(("method_", "status_", "route_"))] + ["requests", "observed_actors", "distinct_resources", "repeat_method_resource"]
    return B.fit_baselines(settle(f), structural)


PRED = "select *, keys[list_position(p,list_max(p))] as prediction, keys[label+1] as origin from winA where view='full'"
CLS = ("human", "script", "agent")
tp = lambda k: f"count(case when origin='{k}' and prediction='{k}' then 1 end)"
oc = lambda k: f"count(case when origin='{k}' then 1 end)"
pc = lambda k: f"count(case when prediction='{k}' then 1 end)"


@query("B13_classification_metrics", sql(f"""select split, cr as cohort_regime, count(*) as episodes, {R('avg((origin=prediction)::int)')} as accuracy, {R('(' + '+'.join(f'coalesce({tp(k)}/nullif({oc(k)},0),0)' for k in CLS) + ')/3')} as balanced_accuracy,
 {R('(' + '+'.join(f'coalesce(2*{tp(k)}/nullif({oc(k)}+{pc(k)},0),0)' for k in CLS) + ')/3')} as macro_f1, {','.join(R(f'coalesce({tp(k)}/nullif({oc(k)},0),0)') + f' as recall_{k}' for k in CLS)}, {','.join(f'{oc(k)} as count_{k}' for k in CLS)}
 from (select *, unnest(['all',regime]) as cr from pr where split<>'test') group by split, cr""", "winA", pr=PRED))
def _(t):
    from ..functions import vectors as V
    w = t.window_rows("A").filter(F.col("view") == "full")
    w = w.withColumn("prediction", V.at("keys", V.argmax0("p"))).withColumn("origin", V.at("keys", "label"))
    return rounded(B.classification_metrics(B.cohorts(w), ["split", "cohort_regime"]))


@query("B13_confusion", sql("select split, origin as label, prediction as predicted, count(*) as n from pr where split<>'test' group by split, origin, prediction", "winA", pr=PRED))
def _(t):
    from ..functions import vectors as V
    w = t.window_rows("A").filter((F.col("view") == "full") & (F.col("split") != "test"))
    return B.confusion(w.withColumn("prediction", V.at("keys", V.argmax0("p"))).withColumn("origin", V.at("keys", "label")), ["split"])


@query("B14_reconcile_population", sql("""select split, coalesce(e,0) as episodes, coalesce(g,0) as groups, r as registered, case when split='test' then 0 else coalesce(e,0) end as scored, e is not distinct from r as agrees from (
 select split, count(distinct episode_id) as e, count(distinct group_id) as g, count(distinct episode_id)+(split='development')::int as r from tx group by split)""", "tx"))
def _(t):
    e = t.tx().select("episode_id", "group_id", "split").distinct()
    manifest = e.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", (F.col("n") + (F.col("split") == "development").cast("int")).alias("registered"))
    return B.reconcile_population(e, manifest)


TD = f"""select * replace(case when x=0 then start_ms-5 when x=15 then null else service_ms end as service_ms, case when x=1 then service_ms else completed_ms end as completed_ms, case when x=2 then start_ms-7200000 else start_ms end as start_ms,
 case when x=3 then start_ms-1 else request_collected_ms end as request_collected_ms, case when x=4 then completed_ms-1 else response_collected_ms end as response_collected_ms, case when x=5 then '300.1.2.3' else src_ip end as src_ip,
 case when x=6 then 0 else src_port end as src_port, case when x=7 then 'BREW' else method end as method, case when x=8 then 'documents' else path end as path, case when x=9 then 99 else status end as status,
 case when x=10 then request_bytes+1 else request_bytes end as request_bytes, case when x=11 then response_bytes+1 else response_bytes end as response_bytes, case when x=12 then version+1 else version end as version,
 case when x=13 then 'dup' else request_id end as request_id, case when x=14 then 'ghost' else actor_id end as actor_id) from (select *, {h(repr('tdef'), 'event_id::varchar')}%60 as x from txo)"""


def codes_sql(src, checks, subject="request_id", episode="episode_id"):
    arr = ",".join(f"case when not coalesce({ok},false) then '{code}' end" for code, ok in checks)
    return f"select {episode} as episode_id, {subject} as subject, unnest(list_filter([{arr}], lambda x: x is not null)) as code from {src}"


@query("B15_audit_order", sql(codes_sql("l", [("invalid_time", "start_ms>=0 and service_ms>=0 and completed_ms>=0"), ("response_before_cause", "start_ms<=service_ms and service_ms<completed_ms"), ("request_order", "ps is null or start_ms>=ps"),
                                              ("service_order", "pc is null or service_ms>=pc"), ("actor_overlap", "pa is null or start_ms>=pa")]), "txo", td=TD,
                              l="select *, lag(start_ms) over (partition by episode_id order by ordinal) as ps, lag(completed_ms) over (partition by episode_id order by ordinal) as pc, lag(completed_ms) over (partition by episode_id, actor_id order by ordinal) as pa from td"))
def _(t):
    return AU.audit_order(AU.seed_defects(t.tx_ordered()))


@query("B16_audit_collection", sql(codes_sql("td", [("request_collected_early", "request_collected_ms>=start_ms"), ("response_collected_early", "response_collected_ms>=completed_ms")]), "txo", td=TD))
def _(t):
    return AU.audit_collection(AU.seed_defects(t.tx_ordered()))


@query("B17_audit_fields", sql(codes_sql("td", [("invalid_network_tuple", "src_ip<>'300.1.2.3' and src_port between 1 and 65535"), ("invalid_http_request", "method in ('GET','POST','PUT','DELETE') and path like '/%'"), ("invalid_http_status", "status between 100 and 599"),
                                                ("unknown_actor", "actor_id<>'ghost'")]) + " union all select episode_id, request_id, 'duplicate_request' from td group by episode_id, request_id having count(*)>1", "txo", td=TD))
def _(t):
    tx = t.tx_ordered()
    return AU.audit_fields(AU.seed_defects(tx), tx.select("episode_id", "actor_id"))


@query("B18_audit_payload_bytes", sql(codes_sql("td", [("request_bytes", "request_bytes=octet_length(encode(request_body))"), ("response_bytes", "response_bytes=octet_length(encode(response_body))"), ("resource_version_mismatch", "event_type='error' or x<>12")]), "txo", td=TD))
def _(t):
    return AU.audit_payload_bytes(AU.seed_defects(t.tx_ordered()))


CD = f"""select * replace(case when x=0 then sha256('broken') else before_hash end as before_hash, case when x=1 then not state_change else state_change end as state_change, case when x=2 then 'zz' else after_hash end as after_hash, case when x=3 then 500 else status end as status)
 from (select *, {h(repr('cdef'), 'event_id::varchar')}%40 as x from txc)"""


@query("B19_audit_state_chain", sql(codes_sql("l", [("invalid_state_hash", "length(before_hash)=64 and length(after_hash)=64"), ("broken_state_chain", "pa is null or before_hash=pa"), ("state_change_mismatch", "state_change=(before_hash<>after_hash)"),
                                                    ("failed_request_mutates_state", "status<400 or before_hash=after_hash")]), "txc", cd=CD, l="select *, lag(after_hash) over (partition by episode_id order by ordinal) as pa from cd"))
def _(t):
    return AU.audit_state_chain(AU.seed_chain_defects(t.tx_chain()))


@query("B20_audit_dependencies", sql("""select d.episode_id, d.request_id as subject, 'undelivered_decision_dependency' as code from (select *, unnest(depends_on) as dep from txl) d left join txl p on p.episode_id=d.episode_id and p.request_id=d.dep
 where not coalesce(p.ordinal<d.ordinal and p.completed_ms<=d.start_ms, false)""", "txl"))
def _(t):
    return AU.audit_dependencies(t.tx_links())


def consumed(t):
    """Each transaction after the first consumes the previous response; some claims are damaged by digest."""
    tx = t.tx_links()
    x = h32("use", F.col("event_id")) % 30
    res = F.struct(F.col("prev_request_id").alias("producer_request_id"), F.col("prev_resource_id").alias("resource_id"), F.col("dep_version").alias("version"),
                   F.when(x == 0, F.col("prev_completed_ms") + 1).otherwise(F.col("prev_completed_ms")).alias("produced_at_ms"), F.when(x == 1, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("prev_response_body", 256)).alias("content_sha256"),
                   F.when(F.col("event_id") % 2 == 0, "artifact").otherwise("state").alias("kind"))
    none = F.col("prev_request_id").isNull()
    tx = tx.withColumn("_r", F.array(res))
    tx = tx.withColumn("consumed_resources", F.when(none, F.slice("_r", 1, 0)).otherwise(F.col("_r"))).drop("_r")
    tx = tx.withColumn("state_dependencies", F.when(none | (x == 2), F.array().cast("array<string>")).otherwise(F.array("prev_request_id")))
    return tx.withColumn("consumed_artifacts", F.filter("consumed_resources", lambda r: r["kind"] == "artifact"))


USE = f"select *, {h(repr('use'), 'event_id::varchar')}%30 as x from txl where prev_request_id is not null"


@query("B21_audit_resources", sql("""select episode_id, request_id as subject, 'future_state_dependency' as code from u where not prev_completed_ms<=service_ms
 union all select episode_id, request_id, 'resource_version_mismatch' from u where x in (0,1) or dep_version is distinct from prev_version union all select episode_id, request_id, 'resource_dependency_projection' from u where x=2""", "txl", u=USE))
def _(t):
    return AU.audit_resources(consumed(t))


HL = """select r.episode_id, r.artifact, r.actor_id as reader, r.request_id as read_request, r.completed_ms as read_done, w.request_id as write_request, w.actor_id as writer, w.completed_ms as write_done,
 (select arg_min(x.request_id, (x.start_ms, x.event_id)) from tx x where x.episode_id=r.episode_id and x.actor_id=r.actor_id and x.method='POST' and x.path='/exports' and x.start_ms>=r.completed_ms) as export_request
 from (select *, substr(path,12) as artifact from tx where path like '/artifacts/%' and method='GET') r, lateral (select * from tx w where w.episode_id=r.episode_id and w.path=r.path and w.method='PUT' and w.completed_ms<=r.start_ms and w.actor_id<>r.actor_id
 order by w.completed_ms desc, w.event_id desc limit 1) w"""


@query("B23_discover_handoffs", sql("select episode_id, artifact, reader, read_request, read_done, write_request, writer, write_done, export_request from hl", "tx", hl=HL))
def _(t):
    return B.discover_handoffs(t.tx()).select("episode_id", "artifact", "reader", "read_request", "read_done", "write_request", "writer", "write_done", "export_request")


@query("B22_audit_coordination", sql(codes_sql("""(select c.*, w.status as ws, w.completed_ms as wc, w.version as wv, r.status as rs, r.start_ms as rst, r.completed_ms as rc, r.version as rv, e.status as es, e.start_ms as est, e.actor_id as ea, r.actor_id as ra, w.actor_id as wa, w.method as wm, e.path as ep, e.request_id is not null as there
 from cl c left join txc w on w.request_id=c.write_request left join txc r on r.request_id=c.read_request left join txc e on e.request_id=c.export_request)""", [
    ("coordination_missing_request", "there"), ("coordination_routes", "not there or (wm='PUT' and wa<>ra)"), ("coordination_failed_operation", "not there or (ws between 200 and 299 and rs between 200 and 299 and es between 200 and 299)"),
    ("coordination_causality", "not there or (wc<=rst and rc<=est)"), ("coordination_delivery", "not there or rv=wv"), ("coordination_no_effect", "not there or (ep='/exports' and ea=ra and delivered_version=wv)")], subject="read_request"), "tx", "txc", hl=HL,
    cl=f"""select hl.episode_id, artifact, case when x=0 then read_request else hl.write_request end as write_request, read_request, export_request, case when x=1 then w.version+1 else w.version end as delivered_version from (select *, {h(repr('co'), 'read_request')}%9 as x from hl) hl join tx w on w.request_id=hl.write_request"""))
def _(t):
    tx = t.tx_chain()
    links = settle(B.discover_handoffs(t.tx()))
    v = tx.select(F.col("request_id").alias("write_request"), F.col("version").alias("delivered_version"))
    x = h32("co", F.col("read_request")) % 9
    links = links.join(v, "write_request").withColumn("delivered_version", F.when(x == 1, F.col("delivered_version") + 1).otherwise(F.col("delivered_version"))).withColumn("write_request", F.when(x == 0, F.col("read_request")).otherwise(F.col("write_request")))
    return AU.audit_coordination(links, tx)


RT = """select *, case when ps in (429,503) and pm=method and pp=path then 1 else 0 end as again from (select *, row_number() over w as pos, lag(method) over w as pm, lag(path) over w as pp, lag(status) over w as ps, lag(completed_ms) over w as pc, lag(retry_after_ms) over w as pr from tx
 window w as (partition by episode_id, actor_id order by start_ms,event_id))"""


@query("B24_retry_chains", sql("""select episode_id, actor_id, request_id, pos-st as retry_no, start_ms-pc as delay_ms, start_ms-pc>=coalesce(pr,0) as honored, pos-st>=3 and status in (429,503) as gave_up from (
 select *, max(case when again=0 then pos end) over (partition by episode_id, actor_id order by pos) as st from rt) where again=1""", "tx", rt=RT))
def _(t):
    return B.retry_chains(t.tx())


def episode_table(t):
    """Episodes with metadata (one per episode of the ledger); some carry a defect by digest."""
    e = t.tx().groupBy("episode_id").agg(*[F.max(c).alias(c) for c in ("group_id", "split", "family", "regime", "origin", "week")], F.min("actor_id").alias("target_actor"))
    x = h32("edef", F.col("episode_id")) % 25
    fold = F.conv(F.substring("group_id", 1, 8), 16, 10).cast("bigint") % 5
    e = e.withColumn("seed", F.when(x == 0, F.lit(None).cast("bigint")).otherwise(F.col("week"))).withColumn("fold", F.when(x == 1, (fold + 1) % 5).otherwise(fold))
    e = e.withColumn("split", F.when(x == 2, "holdout").otherwise(F.col("split"))).withColumn("regime", F.when(x == 3, "other").otherwise(F.col("regime"))).withColumn("target_actor", F.when(x == 4, "nobody").otherwise(F.col("target_actor")))
    e = e.withColumn("origin", F.when(x == 5, "robot").otherwise(F.col("origin"))).withColumn("family", F.when(x == 7, "").otherwise(F.col("family")))
    prov = F.create_map(F.lit("kind"), F.when(x == 6, "captured").otherwise("executed_simulation"), F.lit("network_capture"), F.lit("false"), F.lit("clock"), F.lit("logical_ms"), F.lit("live_llm"), F.lit("false"))
    return e.withColumn("provenance", prov).withColumn("version", F.concat(F.lit("v"), (F.col("week") % 2).cast("string")))


def actor_table(t):
    a = t.tx().groupBy("episode_id", "actor_id").agg(F.max("origin").alias("intended_origin"))
    return a.withColumn("controller_kind", F.when(h32("adef", F.col("actor_id")) % 31 == 0, "human").otherwise("simulated_policy"))


ET = f"""select *, case when x=0 then null else week end as seed, case when x=1 then (f+1)%5 else f end as fold, case when x=2 then 'holdout' else split0 end as split, case when x=3 then 'other' else regime0 end as regime, case when x=4 then 'nobody' else ta end as target_actor,
 case when x=5 then 'robot' else origin0 end as origin, case when x=7 then '' else family0 end as family, 'v'||(week%2) as version from (select episode_id, max(group_id) as group_id, max(split) as split0, max(family) as family0, max(regime) as regime0, max(origin) as origin0, max(week) as week, min(actor_id) as ta,
 {h(repr('edef'), 'episode_id')}%25 as x, ('0x'||substr(max(group_id),1,8))::bigint%5 as f from tx group by episode_id)"""


@query("B25_audit_episode_metadata", sql(codes_sql("et", [("partition_metadata", "x not in (2,7)"), ("evaluation_regime", "x<>3"), ("simulation_provenance", "x<>6"), ("missing_target_actor", "x<>4"), ("target_origin_basis", "x<>5"), ("missing_environment_seed", "x<>0"), ("calibration_fold", "x<>1")], subject="episode_id")
                                         + f" union all select episode_id, actor_id, 'actor_provenance' from (select distinct episode_id, actor_id from tx) where {h(repr('adef'), 'actor_id')}%31=0", "tx", et=ET))
def _(t):
    return AU.audit_episode_metadata(episode_table(t), actor_table(t))


@query("B26_audit_groups", sql("""select '' as episode_id, group_id as subject, 'group_metadata_mismatch' as code from et group by group_id having count(distinct (split, family, coalesce(seed,-1), fold, regime, version))>1
 union all select '', group_id, 'missing_matched_origin' from et group by group_id having not (count(*)=3 and count(distinct origin)=3 and sum((origin='robot')::int)=0)
 union all select '', case when seed is null then family else family||'/'||seed end, 'latent_task_multiple_groups' from et group by family, seed having min(group_id)<>max(group_id)
 union all select episode_id, episode_id, 'heldout_task_leakage' from et where regime='heldout_task' and (family in (select family from et where split='train') or split not in ('development','test'))
 union all select episode_id, episode_id, 'heldout_controller_leakage' from et where regime='heldout_task' and version in (select version from et where split='train')""", "tx", et=ET))
def _(t):
    return AU.audit_groups(settle(episode_table(t)))


@query("B27_audit_report", sql("""select code, count(*) as n from (select 'request_collected_early' as code from td where not request_collected_ms>=start_ms union all select 'response_collected_early' from td where not response_collected_ms>=completed_ms
 union all select 'request_bytes' from td where x=10 union all select 'response_bytes' from td where x=11 union all select 'resource_version_mismatch' from td where x=12 and event_type<>'error') group by code""", "txo", td=TD))
def _(t):
    d = AU.seed_defects(t.tx_ordered())
    return AU.audit_report(AU.audit_collection(d), AU.audit_payload_bytes(d))


@query("B27_role_counts", sql("""select 'registered' as stage, origin, count(*) as n from (select episode_id, actor_id, max(origin) as origin from tx group by 1,2) group by origin
 union all select 'target', origin, count(*) from (select episode_id, max(origin) as origin from tx group by 1) group by origin union all select 'executed', origin, count(*) from tx group by origin union all select 'selected', origin, count(*) from views group by origin""", "tx", "views"))
def _(t):
    tx = t.tx_ordered()
    eps = tx.groupBy("episode_id").agg(F.max("origin").alias("origin"))
    return AU.role_counts(actor_table(t), eps, tx, B.apply_masks(tx))


@query("B28_corpus_statistics", sql("""select split, origin, count(distinct group_id) as groups, count(distinct episode_id) as episodes, count(*) as interactions, count(*)*2 as events from tx group by split, origin
 union all select split, 'ALL', count(distinct group_id), count(distinct episode_id), count(*), count(*)*2 from tx group by split""", "tx"))
def _(t):
    return B.corpus_statistics(t.tx())

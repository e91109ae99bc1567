"""M queries: scoring and metrics."""
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import h32, sha, word_count
from ..functions.vectors import r6
from ..operators import scoring as M
from ..sources.fixtures import lit_array
from .oracle import SCORES, collapse, h, r6 as R, softmax, sql
from .registry import query

CURVE = "select *, sum(n) over w as cum, sum(errors) over w as cume, sum(n) over (partition by {by}) as tot from hist window w as (partition by {by} order by conf desc)"
HIST = "select {by}, conf, count(*) as n, sum(case when ok then 0 else 1 end) as errors, sum(nll) as s_nll, sum(brier) as s_brier, sum(mae) as s_mae, sum(rps) as s_rps, count(mae) as n_score from {src} group by {by}, conf"
EDGE = "(" + "+".join(f"case when conf>={i}*0.1e0 then 1 else 0 end" for i in range(1, 10)) + ")"


def rounded(df, *keep):
    """Doubles rounded to six decimals for comparison; everything else as is."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def metrics_sql(by, src="scA", needs=None, **more):
    top = []
    for t in ("9", "95", "99"):
        top.append(f"sum(case when conf>=0.{t}e0 then n else 0 end)::bigint as top_{t}_n, sum(case when conf>=0.{t}e0 then errors else 0 end)::bigint as top_{t}_errors,"
                   f"{R(f'sum(case when conf>=0.{t}e0 then errors end)/sum(case when conf>=0.{t}e0 then n end)')} as top_{t}_rate")
    sel = []
    for tag, f in (("50", "0.5e0"), ("80", "0.8e0")):
        c = f"cum-n < greatest(ceil(tot*{f}),1)"
        sel.append(f"{R(f'sum(case when {c} then n end)/max(tot)')} as coverage_{tag}, {R(f'sum(case when {c} then n-errors end)/sum(case when {c} then n end)')} as accuracy_{tag},"
                   f"{R(f'min(case when {c} then conf end)')} as cutoff_{tag}")
    main = f"""
 select {by}, sum(n)::bigint as n, {R('sum(s_nll)/sum(n)')} as nll, {R('1-sum(errors)/sum(n)')} as acc, {R('sum(s_brier)/sum(n)')} as brier, {R('sum(conf*n)/sum(n)')} as mean_conf,
 {R('sum(case when conf>=0.9e0 then errors else 0 end)/sum(n)')} as confident_error_rate, {R('sum(case when conf>=0.9e0 then n else 0 end)/sum(n)')} as coverage_at_0_9,
 {R('sum(case when conf>=0.9e0 then n-errors end)/sum(case when conf>=0.9e0 then n end)')} as accuracy_at_0_9, {R('sum(case when conf>=0.9e0 then errors end)/sum(case when conf>=0.9e0 then n end)')} as error_rate_at_0_9,
 {R('coalesce(max(case when cume<=0.05e0*cum then cum end),0)/max(tot)')} as coverage_at_5pct_error, {R('coalesce(max(case when cume<=0.01e0*cum then cum end),0)/max(tot)')} as coverage_at_1pct_error,
 {R('sum(n*cume/cum)/max(tot)')} as aurc, {R('sum(conf*n)/sum(n)-(1-sum(errors)/sum(n))')} as confidence_bias,
 {R('sum(s_mae)/nullif(sum(n_score),0)')} as score_mae, {R('sum(s_rps)/nullif(sum(n_score),0)')} as rps, {','.join(top)}, {','.join(sel)} from curve group by {by}"""
    e = f"select {by}, {R('sum(abs(c-s))/sum(n)')} as ece from (select {by}, {EDGE} as bin, count(*) as n, sum(case when ok then 1e0 else 0e0 end) as c, sum(conf) as s from {src} group by all) group by {by}"
    return sql(f"select * from main join e using({by})", *(needs or (("scA",) if more else (src,))), **more, hist=HIST.format(by=by, src=src), curve=CURVE.format(by=by), main=main, e=e)


@query("M1_score_batch", sql(f"""
 select count(*) as requested, count(case when tokens<=9 then 1 end) as evaluated, count(case when tokens>9 then 1 end) as rejected, sum(tokens)::bigint as tokens,
 {R("quantile_cont(case when tokens<=9 then (tokens*3%17)::double end, 0.5)")} as median_ms, {R("quantile_cont(case when tokens<=9 then (tokens*3%17)::double end, 0.95)")} as p95_ms
 from (select len(keys)+length(id::varchar) as tokens from questions)""", "questions"))
def _(t):
    q = t.questions().withColumn("question", F.col("task")).select("id", "question", F.transform("keys", lambda k: k).alias("keys"), "label")
    scored = M.score_batch(q, M.hash_predictor("A", 1.2, max_tokens=9))
    return rounded(M.coverage_counters(scored))


@query("M2_prediction_rows", sql(f"""
 select id, task as question, case when {h("'miss'", 'id::varchar', 'task')}%50=0 then 'missing_answer' when {h("'bad'", 'id::varchar', 'task')}%40=0 then 'sum_off' end as reason,
 case when {h("'miss'", 'id::varchar', 'task')}%50<>0 and {h("'bad'", 'id::varchar', 'task')}%40<>0 then {R('p[label+1]/list_sum(p)')} end as p_label, id as parent from decA""", "decA"))
def _(t):
    d = t.decisions("A")
    recs = t.questions().withColumn("question", F.col("task")).withColumn("variant", F.lit("clean")).withColumn("parent_id", F.lit(None).cast("bigint"))
    scale = F.when(h32("bad", F.col("id"), F.col("task")) % 40 == 0, 0.5).otherwise(1.0)
    ans = d.filter(h32("miss", F.col("id"), F.col("task")) % 50 != 0).select(
        "id", "question", F.map_from_arrays(F.reverse("keys"), F.reverse(F.transform("p", lambda x: x * scale))).alias("answer"))
    out = M.prediction_rows(recs, ans)
    return out.select("id", "question", "reason", r6(V.at("p", "label"), "p_label"), "parent")


@query("M3_normalize_answers", sql(f"select id, task, {R('p[1]')} as p_first, {R('p[len(p)]')} as p_last from decA", "decA"))
def _(t):
    d = t.decisions("A").withColumn("noul", F.when(F.col("type") == "noul", V.at("p", F.lit(1))))
    d = d.withColumn("probabilities", F.when(F.col("type") != "noul", F.map_from_arrays("keys", "p")))
    a = M.normalize_answers(d.select("id", "task", "type", "keys", "noul", "probabilities"))
    return a.select("id", "task", r6(F.element_at(F.col("answer"), F.element_at("keys", 1)), "p_first"), r6(F.element_at(F.col("answer"), F.element_at("keys", -1)), "p_last"))


@query("M4_answers", sql("""
 select id, task, round_even(case type when 'noul' then p[2] when 'score' then list_sum(list_transform(range(len(p)), lambda i: p[i+1]*i)) end,4)+0.0 as value,
 round_even(case type when 'choice' then (list_max(p)-1e0/len(p))/(1-1e0/len(p))
   when 'score' then 1-list_sum(list_transform(range(len(p)), lambda i: p[i+1]*abs(i-(list_position(p,list_max(p))-1))))/(len(p)-1) end,4)+0.0 as confidence,
 case when type='choice' then keys[list_position(p,list_max(p))] end as choice from decA""", "decA"))
def _(t):
    return M.answers(t.decisions("A")).select("id", "task", (F.col("value") + F.lit(0.0)).alias("value"), (F.col("confidence") + F.lit(0.0)).alias("confidence"), "choice")


@query("M5_tempered_rows", sql(f"""
 select id, task, {R('pt[label+1]')} as p_label, {R('ps[label+1]')} as p_restored, 1.7e0 as inference_temperature from (
 select *, {softmax('zt')} as pt, {softmax('logits')} as ps from (select *, list_transform(logits, lambda x: (x-list_max(logits))/1.7e0) as zt from decA))""", "decA"))
def _(t):
    hot = M.temper(t.decisions("A"), 1.7)
    both = hot.withColumn("p_t", F.col("p")).withColumn("served", F.col("inference_temperature"))
    back = M.raw(both)
    return back.select("id", "task", r6(V.at("p_t", "label"), "p_label"), r6(V.at("p", "label"), "p_restored"), F.col("served").alias("inference_temperature"))


@query("M6_row_scores", sql(f"""select id, task, ok, conf, {R('nll')} as nll, {R('brier')} as brier, {R('mae')} as mae, {R('rps')} as rps,
 conf>=0.9e0 and not ok as confident_error from scA""", "scA"))
def _(t):
    return M.row_scores(t.decisions("A")).select("id", "task", "ok", "conf", r6("nll", "nll"), r6("brier", "brier"), r6("mae", "mae"), r6("rps", "rps"), "confident_error")


@query("M7_ece_by_task", sql(f"select task, {R('sum(abs(c-s))/sum(n)')} as ece from (select task, {EDGE} as bin, count(*) as n, sum(case when ok then 1e0 else 0e0 end) as c, sum(conf) as s from scA group by all) group by task", "scA"))
def _(t):
    return rounded(M.ece(M.row_scores(t.decisions("A")), ["task"]))


@query("M8_metrics_by_task", metrics_sql("task"))
def _(t):
    return rounded(M.metrics(M.row_scores(M.scored_rows(t.decisions("A"))), ["task"]))


@query("M8_metrics_by_source", metrics_sql("source"))
def _(t):
    return rounded(M.metrics(M.row_scores(M.scored_rows(t.decisions("A"))), ["source"]))


@query("M9_selective", sql(f"""select task, {R('sum(case when cum-n<ceil(tot*0.5e0) then n end)/max(tot)')} as coverage_half,
 {R('sum(case when cum-n<ceil(tot*0.5e0) then n-errors end)/sum(case when cum-n<ceil(tot*0.5e0) then n end)')} as accuracy_half, {R('min(case when cum-n<ceil(tot*0.5e0) then conf end)')} as cutoff_half
 from curve group by task""", "scA", hist=HIST.format(by="task", src="scA"), curve=CURVE.format(by="task")))
def _(t):
    return rounded(M.selective(M.row_scores(t.decisions("A")), ["task"], {"half": 0.5}))


@query("M10_risk_coverage_curve", sql(f"select task, {R('conf')} as threshold, cum::bigint as accepted, cume::bigint as errors, {R('cum/tot')} as coverage, {R('cume/cum')} as risk from curve",
                                      "scA", hist=HIST.format(by="task", src="scA"), curve=CURVE.format(by="task")))
def _(t):
    c = M.risk_curve(M.row_scores(t.decisions("A")), ["task"])
    return rounded(c.select("task", "threshold", "accepted", F.col("cum_err").alias("errors"), "coverage", "risk"))


@query("M11_coverage_and_aurc", sql(f"""select source, {R('coalesce(max(case when cume<=0.3e0*cum then cum end),0)/max(tot)')} as coverage_at_30pct, {R('sum(n*cume/cum)/max(tot)')} as aurc
 from curve group by source""", "scA", hist=HIST.format(by="source", src="scA"), curve=CURVE.format(by="source")))
def _(t):
    c = M.risk_curve(M.row_scores(t.decisions("A")), ["source"])
    return rounded(c.groupBy("source").agg(M.coverage_expr(0.3).alias("coverage_at_30pct"), M.aurc_expr().alias("aurc")))


@query("M12_threshold_transfer", sql(f"""select task, max(cut) as cut, count(*) as n, sum(case when conf>=cut then 1 else 0 end)::bigint as accepted, sum(case when conf>=cut and not ok then 1 else 0 end)::bigint as errors,
 {R('sum(case when conf>=cut then 1 else 0 end)/count(*)')} as coverage, {R('sum(case when conf>=cut and not ok then 1 else 0 end)/nullif(sum(case when conf>=cut then 1 else 0 end),0)')} as risk
 from scB join cuts using(task) group by task""", "scA", "scB", hist=HIST.format(by="task", src="scA"), curve=CURVE.format(by="task"),
                                     cuts="select task, min(case when cume<=0.2e0*cum and cum>=20 then conf end) as cut from curve group by task"))
def _(t):
    cuts = M.select_threshold(M.row_scores(t.decisions("A")), ["task"], 0.2, min_accepted=20)
    return rounded(M.apply_threshold(M.row_scores(t.decisions("B")), ["task"], cuts))


@query("M13_input_guards", sql(f"""select * from (select id, task, case when c is null or isnan(c) or c<0 or c>1 then 'confidence' when ok not in (0,1) then 'correctness' when b<0 or b>1 then 'budget' end as reason from (
 select id, task, case when g%30=0 then 'nan'::double when g%30=1 then conf+1 else conf end as c, case when g%30=2 then 2 else ok::int end as ok, case when g%30=3 then 1.5e0 else 0.05e0 end as b
 from (select *, {h("'guard'", 'id::varchar', 'task')} as g from scA))) where reason is not null""", "scA"))
def _(t):
    g = h32("guard", F.col("id"), F.col("task")) % 30
    s = M.row_scores(t.decisions("A")).withColumn("g", g)
    s = s.select("id", "task", F.when(F.col("g") == 0, float("nan")).when(F.col("g") == 1, F.col("conf") + 1).otherwise(F.col("conf")).alias("confidence"),
                 F.when(F.col("g") == 2, 2).otherwise(F.col("ok").cast("int")).alias("correct"), F.when(F.col("g") == 3, 1.5).otherwise(0.05).alias("budget"))
    return M.input_guards(s).select("id", "task", "reason")


@query("M14_summary_objective", sql(f"select {R('-avg(nll)')} as objective, count(*) as tasks from (select task, avg(nll) as nll from scA group by task)", "scA"))
def _(t):
    return rounded(M.objective(M.row_scores(t.decisions("A"))))


def summary(t):
    a, p = t.decisions("A"), t.permuted("A")
    return M.summarize(a.unionByName(p.select(*[c if c in p.columns else F.lit(1.0).alias(c) for c in a.columns])), 0.8, ("1-URGENT", "5-LOW"))


@query("M14_summary_variants", metrics_sql("variant", "both_", ("scA", "permA"), scP=SCORES.format(src="permA"), both_="select * from scA union all by name select * from scP"))
def _(t):
    return rounded(summary(t)["variants"])


@query("M14_summary_heldout_tasks", metrics_sql("task", "held", held="select * from scA where source in ('1-URGENT','5-LOW')"))
def _(t):
    return rounded(summary(t)["heldout_tasks"])


@query("M14_summary_calibrated", metrics_sql("task", "cal", cal=SCORES.format(src="(select * replace('all' as task, " + softmax("zt") + " as p, zt as logits) from (select *, list_transform(logits, lambda x: (x-list_max(logits))/0.8e0) as zt from decA))"), needs=("decA",)))
def _(t):
    return rounded(summary(t)["calibrated_clean"].withColumn("task", F.lit("all")))


@query("M15_permutation_stability", sql(f"""select count(*) as n, {R('avg(list_max(list_transform(range(len(cp)), lambda i: abs(cp[i+1]-al[i+1]))))')} as mean_max_delta,
 {R('avg(case when list_position(al,list_max(al))<>list_position(cp,list_max(cp)) then 1e0 else 0e0 end)')} as flip_rate from (
 select c.p as cp, list_transform(c.keys, lambda k: q.p[list_position(q.keys,k)]) as al from decA c join permA q using(id,task) where q.type='choice')""", "decA", "permA"))
def _(t):
    return rounded(M.permutation_stability(t.decisions("A"), t.permuted("A")))


def order_runs(t, n=3):
    """The three questions under n option orders: fresh logits per order, options permuted by digest (order 0 as given)."""
    q = t.questions().withColumn("question", F.col("task")).withColumn("truth", V.at("keys", "label"))
    q = q.withColumn("order_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("canon", F.col("keys"))
    perm = F.transform(F.array_sort(F.transform("keys", lambda k: F.struct(sha(F.col("id"), F.col("order_no"), k).alias("o"), k.alias("k")))), lambda s: s["k"])
    q = q.withColumn("keys", F.when(F.col("order_no") == 0, F.col("canon")).otherwise(perm))
    z = F.transform("keys", lambda k: (h32(F.lit("ord"), F.col("order_no"), F.col("id"), F.col("task"), k) % 1000) / F.lit(1000.0)
                    + (h32(F.lit("A"), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0))
    return q.withColumn("logits", z).withColumn("p", V.softmax("logits"))


@query("M16_order_stability", sql(f"""select task, count(*) as n, {R('quantile_cont(gap,0.9)')} as p90_spread, {R('avg(case when mn<>mx then 1e0 else 0e0 end)')} as flip_rate, {R('avg(gap)')} as mean_spread from (
 select task, id, max(p[list_position(ks,truth)])-min(p[list_position(ks,truth)]) as gap, min(ks[list_position(p,list_max(p))]) as mn, max(ks[list_position(p,list_max(p))]) as mx from (
 select *, {softmax('z')} as p from (select *, list_transform(ks, lambda k: ({h("'ord'", 'o::varchar', 'id::varchar', 'task', 'k')}%1000)/1000e0 + ({h("'A'", 'id::varchar', 'task', 'k')}%6000)/1000e0) as z from (
   select *, keys[label+1] as truth, case when o=0 then keys else list_transform(list_sort(list_transform(keys, lambda k: sha256(id||':'||o||':'||k)||k)), lambda s: s[65:]) end as ks
   from questions cross join (values (0),(1),(2)) v(o)))) group by task,id) group by task""", "questions"))
def _(t):
    return rounded(M.order_stability(order_runs(t)))


def rotation_runs(t):
    q = t.questions().filter(F.col("type") == "choice")
    q = q.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(2))))
    q = q.withColumn("keys", F.concat(F.slice("keys", F.col("rotation") + 1, F.size("keys") - F.col("rotation")), F.slice("keys", F.lit(1), F.col("rotation"))))
    return q.withColumn("logits", F.transform("keys", lambda k: (h32(F.lit("rot"), F.col("rotation"), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0)))


@query("M17_rotation_average", sql(f"""select id, task, 3::bigint as rotations, {R('p[1]')} as p_1, {R('p[2]')} as p_2, {R('p[3]')} as p_3 from (
 select *, {softmax('z')} as p from (select id, task, list_transform(keys, lambda k: ({'+'.join('(' + h("'rot'", repr(str(r)), 'id::varchar', 'task', 'k') + '%6000)/1000e0' for r in range(3))})/3) as z
 from (select * replace(list_sort(keys) as keys) from questions where type='choice')))""", "questions"))
def _(t):
    a = M.rotation_average(rotation_runs(t))
    return a.select("id", "task", "rotations", *[r6(V.at("p", F.lit(i)), f"p_{i + 1}") for i in range(3)])


@query("M18_paired_flip", sql(f"""select task as question, sum(case when na<>1 or nb<>1 then 1 else 0 end)::bigint as errors, sum(case when g and ta<>tb then 1 else 0 end)::bigint as pairs,
 {R('avg(case when g and ta<>tb then (pa<>pb)::int::double end)')} as flip_rate, {R('avg(case when g and ta<>tb then (pa=ta and pb=tb)::int::double end)')} as both_correct_rate,
 sum(case when g and ta=tb then 1 else 0 end)::bigint as invariant_pairs, {R('avg(case when g and ta=tb then (pa=pb)::int::double end)')} as invariance_rate,
 {R('avg(case when g and ta=tb then (pa=ta and pb=tb)::int::double end)')} as invariant_both_correct_rate from (
 select *, na=1 and nb=1 as g from (select pair_id, task, sum((sibling='a')::int) as na, sum((sibling='b')::int) as nb, max(case when sibling='a' then pr end) as pa, max(case when sibling='b' then pr end) as pb,
  max(case when sibling='a' then tr end) as ta, max(case when sibling='b' then tr end) as tb from (select *, keys[list_position(p,list_max(p))] as pr, keys[label+1] as tr from decA join pairs using(id)) group by pair_id, task)) group by task""",
                                 "decA", "pairs"))
def _(t):
    return rounded(M.paired_flip(t.paired("A")))


@query("M19_unknowable_report", sql(f"""
 select task, count(*) as n, {R('avg(u.m)')} as mean_max_p, {R('avg((u.m>=0.9e0)::int::double)')} as share_at_0_9, {R('avg(c.m-u.m)')} as paired_confidence_drop, {R('avg((u.m<c.m)::int::double)')} as share_less_confident,
 {R('avg(c.m)')} as control_mean_max_p, {R('avg((c.m>=0.9e0)::int::double)')} as control_share_at_0_9, {R('avg(c.ok::int::double)')} as control_acc
 from u join c using(id,task) group by task""", "unkA", u="select id, task, list_max(p) as m from unkA where source='unknowable'",
                                       c="select id, task, list_max(p) as m, list_position(p,list_max(p))-1=label as ok from unkA where source='unknowable_control'"))
def _(t):
    return rounded(M.unknowable_report(t.unknowable("A")))


def none_rows(t):
    """The status question with a none-option: once wrong (true option present), once right (true option removed)."""
    q = t.questions().filter(F.col("type") == "choice").withColumn("question", F.col("task")).withColumn("truth", V.at("keys", "label"))
    q = q.withColumn("variant", F.explode(lit_array(("none_present", "none_absent"))))
    kept = F.when(F.col("variant") == "none_present", F.col("keys")).otherwise(F.array_remove("keys", F.col("truth")))
    q = q.withColumn("keys", F.concat(kept, lit_array(("none_of_these",))))
    q = q.withColumn("label", (F.array_position("keys", F.when(F.col("variant") == "none_present", F.col("truth")).otherwise("none_of_these")) - 1).cast("int"))
    z = F.transform("keys", lambda k, i: (h32(F.lit("none"), F.col("variant"), F.col("id"), k) % 6000) / F.lit(1000.0) + F.when(i == F.col("label"), 1.2).otherwise(0.0))
    return q.withColumn("logits", z).withColumn("p", V.softmax("logits"))


@query("M20_none_diagnostics", sql(f"""select variant, count(*) as n, {R('avg(pn)')} as mean_p_none, {R('avg((pn>0.5e0)::int::double)')} as p_none_above_half, {R('avg((pick=tr)::int::double)')} as acc,
 {R("avg((pick='none_of_these')::int::double)")} as picks_none_rate from (select variant, ks[list_position(p,list_max(p))] as pick, tr, p[len(p)] as pn from (
 select *, {softmax('z')} as p from (select *, list_transform(ks, lambda k: ({h("'none'", 'variant', 'id::varchar', 'k')}%6000)/1000e0 + case when k=tr then 1.2e0 else 0e0 end) as z from (
 select id, variant, case when variant='none_present' then keys else list_filter(keys, lambda k: k<>keys[label+1]) end || ['none_of_these'] as ks, case when variant='none_present' then keys[label+1] else 'none_of_these' end as tr
 from questions cross join (values ('none_present'),('none_absent')) v(variant) where type='choice')))) group by variant""", "questions"))
def _(t):
    return rounded(M.none_diagnostics(none_rows(t)))


@query("M21_iia_shift", sql(f"""select count(*) as n, {R('quantile_cont(abs(s),0.9)')} as p90_abs_shift, {R('avg(abs(s))')} as mean_abs_shift, {R('avg(s)')} as mean_shift from (
 select (ln(greatest(p1[ia],1e-6))-ln(greatest(p1[ib],1e-6)))-(ln(greatest(p[ia],1e-6))-ln(greatest(p[ib],1e-6))) as s from (
 select *, o[1].i as ia, o[2].i as ib, {softmax('z1')} as p1 from (
 select *, list_sort(list_transform(range(len(p)), lambda i: {{'s': -p[i+1], 'i': i+1}})) as o, list_transform(keys||['zz'], lambda k: ({h("'Aext'", 'id::varchar', 'task', 'k')}%6000)/1000e0) as z1 from decA where type='choice')))""", "decA"))
def _(t):
    base = t.decisions("A").filter(F.col("type") == "choice")
    ext = base.withColumn("keys", F.concat("keys", lit_array(("zz",))))
    ext = ext.withColumn("logits", F.transform("keys", lambda k: (h32(F.lit("Aext"), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0))).withColumn("p", V.softmax("logits"))
    return rounded(M.iia_shift(base, ext))


@query("M22_isolation_deltas", sql(f"""select cond as comparison, count(*) as n, {R('max(d)')} as max_delta, sum(flip::int)::bigint as argmax_flips, max(d)<0.001e0 as passed from (
 select cond, list_max(list_transform(range(len(p)), lambda i: abs(p[i+1]-q[i+1]))) as d, list_position(p,list_max(p))<>list_position(q,list_max(q)) as flip from (
 select *, {softmax('zq')} as q from (select *, list_transform(range(len(keys)), lambda i: logits[i+1] + case cond when 'repeated' then 0 when 'packed' then ({h("'iso'", 'cond', 'id::varchar', 'keys[i+1]')}%100)/100000e0 else ({h("'iso'", 'cond', 'id::varchar', 'keys[i+1]')}%100)/10000e0 end) as zq
 from decA cross join (values ('packed'),('sibling'),('repeated')) v(cond)))) group by cond""", "decA"))
def _(t):
    d = t.decisions("A").withColumn("condition", F.explode(lit_array(("alone", "packed", "sibling", "repeated"))))
    step = F.when(F.col("condition") == "packed", 100000.0).otherwise(10000.0)
    eps = F.transform("keys", lambda k: F.when(F.col("condition").isin("alone", "repeated"), 0.0).otherwise((h32("iso", F.col("condition"), F.col("id"), k) % 100) / step))
    d = d.withColumn("logits", F.zip_with("logits", eps, lambda a, b: a + b)).withColumn("p", V.softmax("logits"))
    return rounded(M.isolation_deltas(d))


@query("M22_probe_by_condition", sql(f"""select v as condition, {R('avg(p[2])')} as mean_p, {R('min(p[2])')} as min_p, {R('max(p[2])')} as max_p from (
 select *, case {h("'cond'", 'id::varchar')}%3 when 0 then 'secret_in_state' when 1 then 'secret_in_sibling' else 'absent' end as v from decA where type='noul') group by v""", "decA"))
def _(t):
    c = h32("cond", F.col("id")) % 3
    d = t.decisions("A").filter(F.col("type") == "noul").withColumn("condition", F.when(c == 0, "secret_in_state").when(c == 1, "secret_in_sibling").otherwise("absent"))
    return rounded(M.probe_summary(d, "true"))


@query("M23_nll_floor_sensitivity", sql(f"select floor, {R('avg(x)')} as nll from (select task, floor, avg(-ln(greatest(p[label+1],floor))) as x from decA cross join (values (1e-3),(1e-6),(1e-9)) f(floor) group by task, floor) group by floor", "decA"))
def _(t):
    return M.nll_floor_sensitivity(t.decisions("A")).select("floor", r6("nll", "nll"))


KL = "list_sum(list_transform(range(len(p)), lambda i: {a}[i+1]*(ln({a}[i+1])-ln({b}[i+1]))))"


@query("M24_loss_columns", sql(f"""select id, task, {R('ce')} as ce, {R('0.9e0*ce+0.1e0*ml')} as smoothed, {R('ce+brier')} as ce_brier, {R('pow(1-exp(-ce),2)*ce')} as focal,
 {R("ce+coalesce(rps,0)")} as ordinal, {R('soft')} as soft, {R('kl')} as anchor_kl, {R('sym')} as permutation_kl from (
 select *, -ln(p[label+1]) as ce, -list_sum(list_transform(p, lambda x: ln(x)))/len(p) as ml, -list_sum(list_transform(range(len(p)), lambda i: q[i+1]*ln(p[i+1]))) as soft, {KL.format(a='tt', b='p')} as kl,
 0.5e0*({KL.format(a='p', b='al')}+{KL.format(a='al', b='p')}) as sym from (
 select *, list_transform(tc, lambda x: x/list_sum(tc)) as tt from (select a.*, b.p as q, list_transform(b.p, lambda x: greatest(x,1e-6)) as tc, list_transform(a.keys, lambda k: pm.p[list_position(pm.keys,k)]) as al
 from scA a join decB b using(id,task) join permA pm using(id,task))))""", "scA", "decB", "permA"))
def _(t):
    b = t.decisions("B").select("id", "task", F.col("p").alias("teacher"), F.col("keys").alias("teacher_keys"))
    pm = t.permuted("A").select("id", "task", F.col("p").alias("q"), F.col("keys").alias("qk"))
    d = t.decisions("A").join(b, ["id", "task"]).join(pm, ["id", "task"])
    d = d.withColumn("perm_p", V.realign("q", "qk", "keys")).withColumn("target", F.col("teacher"))
    return M.loss_columns(d).select("id", "task", *[r6(c, c) for c in ("ce", "smoothed", "ce_brier", "focal", "ordinal", "soft", "anchor_kl", "permutation_kl")])


@query("M25_equal_case_agreement", sql(f"""
 select 'evaluated' as population, sum(na)::bigint as rows, count(case when na>0 then 1 end) as cases, {R('avg(a1)')} as agreement, {R('avg(t1)')} as tvd from c
 union all select 'all_rows', sum(n)::bigint, count(*), {R('avg(a2)')}, {R('avg(t2)')} from c""", "decA", "decB",
                                          j=f"""select a.group_id as g, case when {h("'ans'", 'a.id::varchar')}%9<>0 then (list_position(a.p,list_max(a.p))=list_position(b.p,list_max(b.p)))::int::double end as ag,
  case when {h("'ans'", 'a.id::varchar')}%9<>0 then list_sum(list_transform(range(len(a.p)), lambda i: abs(a.p[i+1]-b.p[i+1])))/2 end as tv from decA a join decB b using(id,task) where a.type='choice'""",
                                          c="select g, count(*) as n, count(ag) as na, avg(ag) as a1, avg(tv) as t1, avg(coalesce(ag,0)) as a2, avg(coalesce(tv,1)) as t2 from j group by g"))
def _(t):
    recs = t.decisions("B").filter(F.col("type") == "choice").select("id", F.col("group_id").alias("case_id"), F.col("p").alias("target"))
    rows = t.decisions("A").filter((F.col("type") == "choice") & (h32("ans", F.col("id")) % 9 != 0))
    return rounded(M.equal_case_agreement(recs, rows))


BUCKETS = ((0, 50), (50, 200), (200, 1000), (1000, 100000))


@query("M26_accuracy_by_length", sql(f"""select case when s<50 then '0-50' when s<200 then '50-200' when s<1000 then '200-1000' else '1000-100000' end as bucket, count(*) as n, {R('avg(ok::int::double)')} as acc from (
 select case when {collapse('state')}='' then 0 else len(string_split({collapse('state')},' ')) end as s, {h("'guess'", 'id::varchar', 'qid')}%2=label as ok from labelled) where s<100000 group by 1""", "labelled"))
def _(t):
    d = t.labelled(size=word_count("text")).withColumn("ok", h32("guess", F.col("id"), F.col("qid")) % 2 == F.col("label"))
    return rounded(M.accuracy_by_length(d, BUCKETS))


@query("M27_tie_and_zero_audit", sql(f"""select task, max(n)::bigint as largest_tie, sum(z)::bigint as zero_probabilities, sum(ce)::bigint as confident_errors, {R('coalesce(max(case when cume<=0.05e0*cum then cum end),0)/max(tot)')} as whole_tie_coverage,
 {R("coalesce(max(case when cume-errors<=0.05e0*(cum-errors) then cum-errors+greatest(least(floor(((cum-errors)*0.05e0-(cume-errors))/0.95e0+1e-9),errors),0) end),0)/max(tot)")} as best_order_coverage
 from curve group by task""", "scA", hist="select task, conf, count(*) as n, sum((not ok)::int) as errors, sum(len(list_filter(p, lambda x: x=0))) as z, sum((conf>=0.9e0 and not ok)::int) as ce from scA group by all", curve=CURVE.format(by="task")))
def _(t):
    return rounded(M.tie_and_zero_audit(M.row_scores(t.decisions("A"))))


FP = f"""select id, task, kind, len(keys) as k, row_number() over (partition by task, len(keys), kind order by sha256('audit:'||id||':'||task)) as rn, sha256('audit:'||id||':'||task) as o, keys[label+1] as label, keys[list_position(p,list_max(p))] as prediction
 from (select *, case when ok then 'matched_correct' else 'confident_error' end as kind from scA where conf>=0.9e0)"""


@query("M28_failure_packet", sql("""select substr(sha256('case:'||o),1,12) as "case", kind, id, task as question, task, label, prediction from fp
 where kind='confident_error' or (task,k,rn) in (select (task,k,rn) from fp where kind='confident_error')""", "scA", fp=FP))
def _(t):
    return M.failure_packet(M.row_scores(t.decisions("A")))[1]


@query("M29_top_errors", sql("select id, task, conf, keys[label+1] as truth, keys[list_position(p,list_max(p))] as prediction from scA where not ok order by conf desc, id, task limit 60", "scA"))
def _(t):
    e = M.top_errors(M.row_scores(t.decisions("A")), 60)
    return e.select("id", "task", "conf", V.at("keys", "label").alias("truth"), V.at("keys", V.argmax0("p")).alias("prediction"))


@query("M30_accuracy_by_source", sql(f"""select scope, sum(n)::bigint as n, {R('sum(c)/sum(n)')} as acc, {R('sum(abs(c-s))/sum(n)')} as ece, {R('sum(l)/sum(n)')} as nll, {R('sum(s)/sum(n)')} as mean_conf, {R('sum(m)/nullif(sum(nm),0)')} as score_mae from (
 select scope, {EDGE} as bin, count(*) as n, sum(case when ok then 1e0 else 0e0 end) as c, sum(conf) as s, sum(nll) as l, sum(mae) as m, count(mae) as nm from (select *, unnest([source,'ALL']) as scope from scA) group by all) group by scope""", "scA"))
def _(t):
    return rounded(M.accuracy_by_source(M.row_scores(t.decisions("A"))))

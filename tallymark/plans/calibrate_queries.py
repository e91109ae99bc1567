"""C queries: temperature fits, folds, bootstrap intervals, episode-weighted panels."""
from pyspark.sql import functions as F

from ..functions.text import h32
from ..functions.vectors import r6
from ..operators import calibrate as C
from ..operators import scoring as M
from ..session import settle
from .oracle import SCORES, h, h60, r6 as R, softmax, sql
from .registry import query
from .scoring_queries import EDGE, rounded
from .splits_queries import FOLDS

SAMPLES = 1000


def grid_sql(points):
    return f"select i as ti, exp(ln(0.25e0)+i*(ln(4e0)-ln(0.25e0))/{points - 1}) as t from range({points}) g(i)"


NLL_T = "ln(list_sum(list_transform(logits, lambda x: exp((x-list_max(logits))/t))))-(logits[label+1]-list_max(logits))/t"


@query("C1_fit_temperature_micro", sql(f"select {R('arg_min(t,loss)')} as temperature, {R('min(loss)')} as loss from (select t, avg({NLL_T}) as loss from decA cross join g group by t)", "decA", g=grid_sql(121)))
def _(t):
    return rounded(C.fit_temperature(t.decisions("A"), "micro", 121).drop("w"))


@query("C1_fit_temperature_macro", sql(f"select {R('arg_min(t,loss)')} as temperature, {R('min(loss)')} as loss from (select t, avg(l) as loss from (select task, t, avg({NLL_T}) as l from decA cross join g group by task, t) group by t)", "decA", g=grid_sql(81)))
def _(t):
    return rounded(C.fit_temperature(t.decisions("A"), "macro", 81).drop("w"))


@query("C1_even_odd_report", sql(f"""select arm, any_value(n) as n, any_value({R('nll')}) as nll, {R('sum(abs(c-s))/sum(bn)')} as ece, any_value({R('(select t from best)')}) as temperature from (
 select arm, {EDGE} as bin, count(*) as bn, sum(ok::int::double) as c, sum(conf) as s, sum(count(*)) over (partition by arm) as n, sum(sum(nll)) over (partition by arm)/sum(count(*)) over (partition by arm) as nll from held group by arm, bin) group by arm""",
                                 "decA", g=grid_sql(81), best=f"select arg_min(t,loss) as t from (select t, avg({NLL_T}) as loss from (select * from decA where id%2=0) cross join g group by t)",
                                 held=f"select arm, list_position(q,list_max(q))-1=label as ok, list_max(q) as conf, {NLL_T} as nll from (select *, {softmax('list_transform(logits, lambda x: x/t)')} as q from (select decA.*, v.arm, case when arm='before' then 1e0 else (select t from best) end as t from decA cross join (values ('before'),('after')) v(arm) where id%2=1))"))
def _(t):
    return rounded(C.even_odd_report(t.decisions("A"), 81))


@query("C2_temperature_by_group", sql(f"select type, k, {R('arg_min(t,loss)')} as temperature, max(n) as n from (select type, least(len(keys),6) as k, t, avg({NLL_T}) as loss, count(*) as n from decA cross join g group by type, k, t) group by type, k", "decA", g=grid_sql(81)))
def _(t):
    return rounded(C.fit_temperature_by_group(t.decisions("A"), 81))


CV = {"f": FOLDS, "g": grid_sql(81), "per": f"select fold, ti, t, sum({NLL_T}) as loss, count(*) as n from decA join f using(source, group_id) cross join g group by fold, ti, t",
      "temps": "select fold, arg_min(t, l) as t from (select a.fold, t.t, (t.loss-a.loss)/(t.n-a.n) as l from per a join (select ti, t, sum(loss) as loss, sum(n) as n from per group by ti, t) t using(ti)) group by fold",
      "oof": f"select *, {softmax('z')} as q from (select d.*, t.t, list_transform(logits, lambda x: (x-list_max(logits))/t.t) as z from decA d join f using(source, group_id) join temps t using(fold))"}


@query("C3_out_of_fold", sql(f"select id, task, {R('q[label+1]')} as p_label from oof", "decA", **CV))
def _(t):
    oof, _temps = C.out_of_fold(settle(t.decisions("A")), 5, "cv", "micro", 81)
    from ..functions import vectors as V
    return oof.select("id", "task", r6(V.at("p", "label"), "p_label"))


def mix_sql(x):
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def picks_sql(units, stratum, samples):
    """Multiplicities (s, stratum, unit, m) by the counter hash of the draws; `units` has k, the stratum's 60-bit digest."""
    c = f"select *, {mix_sql('((k >> 28) + s) & 4294967295')} as c from {units} cross join range({samples}) r(s)"
    d = f"select *, {mix_sql('xor(k & 268435455, c)')} as d from ({c})"
    e = f"select *, {mix_sql('xor(c, unit)')} as hi, {mix_sql('(d + unit) & 4294967295')} as lo from ({d})"
    return f"select s, {stratum}, pick as unit, count(*) as m from (select s, {stratum}, (hi * 268435456 + (lo & 268435455)) % units + 1 as pick from ({e})) group by all"


def boot_ctes(seed, samples, src="questions"):
    return {"units": f"select source, group_id, row_number() over (partition by source order by sha256('{seed}:'||source||':'||group_id)) as unit, count(*) over (partition by source) as units, {h60(repr(seed), 'source')} as k from (select distinct source, group_id from {src})",
            "draws": picks_sql("units", "source", samples)}


def boot_sql(metric, part, seed="boot", a="scA", b="scB", needs=("scA", "scB"), samples=None, **more):
    samples = samples or SAMPLES
    both = f"select source, group_id, {part} as part, 'c' as arm, ok, conf, nll, brier from {a} union all select source, group_id, {part}, 'r', ok, conf, nll, brier from {b}"
    ctes = {"both_": both, **boot_ctes(seed, samples), "one": "select -1 as s, source, unit, 1 as m from units", "alld": "select * from draws union all select * from one"}
    if metric in ("acc", "nll", "brier"):
        x = "ok::int::double" if metric == "acc" else metric
        ctes["sums"] = f"select source, group_id, arm, part, sum({x}) as x, count(*) as n from both_ group by all"
        ctes["st"] = "select s, arm, part, sum(x*m)/sum(n*m) as v from sums join units using(source, group_id) join alld using(source, unit) group by s, arm, part"
    elif metric == "ece":
        ctes["sums"] = f"select source, group_id, arm, part, {EDGE} as bin, sum(ok::int-conf) as x, count(*) as n from both_ group by all"
        ctes["bn"] = "select s, arm, part, bin, sum(x*m) as x, sum(n*m) as n from sums join units using(source, group_id) join alld using(source, unit) group by s, arm, part, bin"
        ctes["st"] = "select s, arm, part, sum(abs(x))/sum(n) as v from bn group by s, arm, part"
    else:
        ctes["sums"] = "select source, group_id, arm, part, conf, sum((not ok)::int) as x, count(*) as n from both_ group by all"
        ctes["hs"] = "select s, arm, part, conf, sum(x*m) as e, sum(n*m) as n from sums join units using(source, group_id) join alld using(source, unit) group by s, arm, part, conf"
        ctes["cu"] = "select *, sum(n) over w as cum, sum(e) over w as cume, sum(n) over (partition by s, arm, part) as tot from hs window w as (partition by s, arm, part order by conf desc)"
        v = "sum(n*cume/cum)/max(tot)" if metric == "aurc" else "coalesce(max(case when cume<=0.05e0*cum then cum end),0)/max(tot)"
        ctes["st"] = f"select s, arm, part, {v} as v from cu group by s, arm, part"
    ctes["dl"] = "select s, avg(d) as d from (select s, part, max(case when arm='c' then v end)-max(case when arm='r' then v end) as d from st group by s, part) group by s"
    agg = "macro" if part == "task" else "micro"
    return sql(f"""select '{metric}' as metric, '{agg}' as aggregation, {R('(select d from dl where s=-1)')} as delta, {R('quantile_cont(d,0.025)')} as lo, {R('quantile_cont(d,0.975)')} as hi, count(*) as samples,
 (select count(*) from units) as groups from dl where s>=0""", *needs, **more, **ctes)


def _boot(metric, aggregation):
    @query(f"C6_bootstrap_{metric}_{aggregation}", boot_sql(metric, "task" if aggregation == "macro" else "'all'"))
    def _(t):
        return rounded(C.paired_bootstrap(t.decisions("A"), t.decisions("B"), metric, aggregation, SAMPLES, "boot"))


for _metric, _aggregation in (("nll", "macro"), ("acc", "micro"), ("ece", "micro"), ("aurc", "micro"), ("coverage_at_5pct_error", "macro")):
    _boot(_metric, _aggregation)


@query("C6_pairing_violations", sql(f"""select id, task as question, case {h(repr('pv'), 'id::varchar', 'task')}%40 when 0 then 'missing' when 1 then 'duplicate' when 2 then 'labels_differ' when 3 then 'metadata_differs' end as reason from questions where {h(repr('pv'), 'id::varchar', 'task')}%40<4""", "questions"))
def _(t):
    a, b = t.decisions("A"), t.decisions("B").withColumn("x", h32("pv", F.col("id"), F.col("task")) % 40)
    b = b.filter("x <> 0").withColumn("label", F.when(F.col("x") == 2, F.col("label") + 1).otherwise(F.col("label"))).withColumn("group_id", F.when(F.col("x") == 3, -1).otherwise(F.col("group_id")))
    b = b.unionByName(b.filter("x = 1")).drop("x")
    return C.pairing_violations(a, b)


@query("C4_cross_validated_blocks", sql(f"""select arm, {R('avg(nll)')} as nll, {R('avg(brier)')} as brier, {R('avg(conf)')} as mean_conf, {R('avg((conf>=0.9e0 and not ok)::int::double)')} as confident_error_rate from (
 select 'raw' as arm, nll, brier, conf, ok from scA union all select 'out_of_fold', nll, brier, conf, ok from sco) group by arm""", "scA", **CV, oof2="select * replace(q as p, z as logits) from oof", sco=SCORES.format(src="oof2")))
def _(t):
    block = C.cross_validated_temperature(settle(t.decisions("A")), 5, "cv", SAMPLES, "micro", 81)["blocks"]
    return rounded(block.select("arm", "nll", "brier", "mean_conf", "confident_error_rate"))


@query("C4_ece_interval", sql(f"""select {','.join(f"{R(f'quantile_cont({c},{q})')} as {n}_{tag}" for c, n in (('raw', 'raw'), ('oof', 'out_of_fold'), ('oof-raw', 'delta')) for tag, q in (('lo', 0.025), ('hi', 0.975)))},
 quantile_cont(oof-raw,0.975)<0 or quantile_cont(oof-raw,0.025)>0 as separated from (select s, max(case when arm='raw' then v end) as raw, max(case when arm='oof' then v end) as oof from st group by s)""", "scA", **CV,
                              oof2="select * replace(q as p, z as logits) from oof", sco=SCORES.format(src="oof2"), **boot_ctes("cv", SAMPLES),
                              sums=f"select source, group_id, arm, {EDGE} as bin, sum(ok::int-conf) as x, count(*) as n from (select source, group_id, 'raw' as arm, ok, conf from scA union all select source, group_id, 'oof', ok, conf from sco) group by all",
                              bn="select s, arm, bin, sum(x*m) as x, sum(n*m) as n from sums join units using(source, group_id) join draws using(source, unit) group by s, arm, bin", st="select s, arm, sum(abs(x))/sum(n) as v from bn group by s, arm"))
def _(t):
    return rounded(C.cross_validated_temperature(settle(t.decisions("A")), 5, "cv", SAMPLES, "micro", 81)["interval"])


WORK = {"fit": f"select arg_min(t,loss) as t from (select t, avg({NLL_T}) as loss from decA cross join g group by t)",
        "arms": f"""select 'raw' as arm, task, type, label, keys, logits, {softmax('logits')} as p from decA union all select 'shipped', task, type, label, keys, z, {softmax('z')} from (select *, list_transform(logits, lambda x: (x-list_max(logits))/0.8e0) as z from decA)
 union all select 'workload', task, type, label, keys, z, {softmax('z')} from (select *, list_transform(logits, lambda x: x/fit.t) as z from decA cross join fit) union all select 'workload_oof', task, type, label, keys, z, q from oof"""}


@query("C5_workload_report", sql(f"""select arm, count(*) as n, {R('avg(ok::int::double)')} as acc, {R('avg(nll)')} as nll, {R('avg(brier)')} as brier, {R('avg(conf)')} as mean_conf, {R('avg((conf>=0.9e0 and not ok)::int::double)')} as confident_error_rate, false as accuracy_changed
 from sw group by arm""", "decA", **CV, **WORK, sw=SCORES.format(src="arms")))
def _(t):
    shipped = settle(M.temper(t.decisions("A"), 0.8))
    r = C.workload_report(C.workload_arms(shipped, 5, "cv", 81))
    return rounded(r.select("arm", "n", "acc", "nll", "brier", "mean_conf", "confident_error_rate", "accuracy_changed"))


def union_sql(parts):
    return " union all ".join(f"select * from ({p})" for p in parts)


OOF_ARMS = dict(a="scw_", b="scs_", needs=("decA",), samples=SAMPLES, **CV, oof2="select * replace(q as p, z as logits) from oof",
                ship=f"select * replace({softmax('z')} as p, z as logits) from (select *, list_transform(logits, lambda x: (x-list_max(logits))/0.8e0) as z from decA)", scw_=SCORES.format(src="oof2"), scs_=SCORES.format(src="ship"))


@query("C5_workload_intervals", union_sql([boot_sql(m, "'all'", "cv", **OOF_ARMS) for m in ("ece", "brier", "coverage_at_5pct_error", "aurc")]))
def _(t):
    shipped = settle(M.temper(t.decisions("A"), 0.8))
    return rounded(C.workload_intervals(settle(C.workload_arms(shipped, 5, "cv", 81)), SAMPLES, "cv"))


@query("C7_episode_weights", sql(f"select id, {R('1e0/count(*) over (partition by view, parent)')} as weight from winA", "winA"))
def _(t):
    return C.episode_weights(t.window_rows("A"), ["view"]).select("id", r6("weight", "weight"))


WGT = "select *, 1e0/count(*) over (partition by parent) as w from scwA where view='full'"


@query("C8_group_sufficient_stats", sql(f"""select group_id, {R('sum(w)')} as w, {R('sum(w*ok::int)')} as acc, {R('sum(w*nll)')} as nll, {R('sum(w*brier)')} as brier, {','.join(R(f'sum(case when {EDGE}={i} then w*(ok::int-conf) else 0 end)') + f' as b{i}' for i in range(10))} from wg group by group_id""", "scwA", wg=WGT))
def _(t):
    s = C.episode_weights(M.row_scores(t.window_rows("A").filter(F.col("view") == "full")))
    return rounded(C.group_sufficient_stats(s, ["group_id"]))


PANEL = """select x.*, unnest(['all', regime]) as pr from (select y.*, unnest(['all', case when n_requests<=2 then 'transactions_1_2' else 'transactions_3_plus' end]) as pl from {src} y) x"""
PANELS = {f"pan{m}": f"select *, view||'/'||pr||'/'||pl as panel, 1e0/count(*) over (partition by view, pr, pl, parent) as w from ({PANEL.format(src='scw' + m)})" for m in "AB"}
P_STATS = f"select panel, group_id, arm, sum(w) as w, sum(w*ok::int) as acc, sum(w*nll) as nll, sum(w*brier) as brier, {','.join(f'sum(case when {EDGE}={i} then w*(ok::int-conf) else 0 end) as b{i}' for i in range(10))} from (select *, 'p' as arm from panA union all select *, 'c' from panB) group by panel, group_id, arm"
TOT = "select {by}, sum(acc*m)/sum(w*m) as acc, sum(nll*m)/sum(w*m) as nll, sum(brier*m)/sum(w*m) as brier, (" + "+".join(f"abs(sum(b{i}*m))" for i in range(10)) + ")/sum(w*m) as ece from {src} group by {by}"


@query("C9_paired_panels", sql(f"""select panel, metric, {R('any_value(p0)')} as parent, {R('any_value(c0)')} as candidate, {R('any_value(c0-p0)')} as delta,
 {','.join(f"{R(f'quantile_cont({c},{q})')} as {n}_{tag}" for c, n in (('p', 'parent'), ('c', 'candidate'), ('c-p', 'delta')) for tag, q in (('lo', 0.025), ('hi', 0.975)))}
 from (select panel, metric, s, max(case when arm='p' then v end) as p, max(case when arm='c' then v end) as c from bl group by panel, metric, s) join
 (select panel, metric, max(case when arm='p' then v end) as p0, max(case when arm='c' then v end) as c0 from pl_ group by panel, metric) using(panel, metric) group by panel, metric""", "scwA", "scwB", **PANELS, st=P_STATS,
                               un=f"select panel, group_id, row_number() over (partition by panel order by sha256('panel:'||panel||':'||group_id)) as unit, count(*) over (partition by panel) as units, {h60(repr('panel'), 'panel')} as k from (select distinct panel, group_id from panA)",
                               dr=picks_sql("un", "panel", SAMPLES),
                               jb="select st.*, s, m from st join un using(panel, group_id) join dr using(panel, unit)", bt=TOT.format(by="s, panel, arm", src="jb"), pt=TOT.format(by="panel, arm", src="(select *, 1 as m from st)"),
                               bl="select s, panel, arm, u.metric, u.v from bt, lateral (values ('acc',acc),('nll',nll),('brier',brier),('ece',ece)) u(metric,v)",
                               pl_="select panel, arm, u.metric, u.v from pt, lateral (values ('acc',acc),('nll',nll),('brier',brier),('ece',ece)) u(metric,v)"))
def _(t):
    return rounded(C.paired_panels(M.row_scores(t.window_rows("A")), M.row_scores(t.window_rows("B")), SAMPLES, "panel"))


@query("C9_panel_counts", sql("select panel, count(*) as windows, count(distinct parent) as episodes, count(distinct group_id) as groups from panA group by panel", "scwA", panA=PANELS["panA"]))
def _(t):
    return C.panel_counts(t.window_rows("A"))[0]


@query("C9_transaction_histogram", sql("select panel, n_requests, count(*) as n from panA group by panel, n_requests", "scwA", panA=PANELS["panA"]))
def _(t):
    return C.panel_counts(t.window_rows("A"))[1]


CALF = "select *, 1e0/count(*) over (partition by parent) as w from winA where split='calibration' and variant='clean'"
EPT = f"select arg_min(t,loss) as t, min(loss) as loss from (select t, sum(w*({NLL_T}))/sum(w) as loss from calf cross join g group by t)"


@query("C10_episode_temperature", sql(f"select {R('t')} as temperature, {R('loss')} as loss from ept", "winA", g=grid_sql(121), calf=CALF, ept=EPT))
def _(t):
    return rounded(C.episode_temperature(t.window_rows("A"), 121).select("temperature", "loss"))


@query("C11_calibration_by_source", sql(f"""select arm, source, {R('sum(w*ok::int)/sum(w)')} as acc, {R('sum(w*nll)/sum(w)')} as nll, {R('sum(w*brier)/sum(w)')} as brier, {R('(' + '+'.join(f'abs(sum(case when {EDGE}={i} then w*(ok::int-conf) else 0 end))' for i in range(10)) + ')/sum(w)')} as ece,
 count(*) as windows, count(distinct parent) as episodes, count(distinct group_id) as groups, sum(('0x'||substr(sha256(id),1,8))::bigint)::bigint as ids_digest from sc_ group by arm, source""", "winA", g=grid_sql(121), calf=CALF, ept=EPT,
                                       arms=f"select * replace(z as logits, {softmax('z')} as p) from (select calf.*, arm, list_transform(logits, lambda x: x/case when arm='raw' then 1e0 else ept.t end) as z from calf cross join ept cross join (values ('raw'),('calibrated')) v(arm))", sc_=SCORES.format(src="arms")))
def _(t):
    w = t.window_rows("A")
    m, _excluded = C.calibration_by_source(w, C.episode_temperature(w, 121))
    return rounded(m)


EVIDENCE = {"calf": CALF, "g": grid_sql(121),
            "f": "select group_id, (row_number() over (order by sha256('calibration:all:'||group_id))-1)%5 as fold from (select distinct group_id from calf)",
            "per": f"select fold, ti, t, sum(w*({NLL_T})) as loss, sum(w) as n from calf join f using(group_id) cross join g group by fold, ti, t",
            "temps": "select fold, arg_min(t, (l, ti)) as t from (select a.fold, a.ti, a.t, (tt.loss-a.loss)/(tt.n-a.n) as l from per a join (select ti, sum(loss) as loss, sum(n) as n from per group by ti) tt using(ti)) group by fold",
            "arms": f"select calf.*, 'raw' as arm from calf union all select * exclude(z) replace({softmax('z')} as p, z as logits) from (select calf.*, 'out_of_fold' as arm, list_transform(logits, lambda x: x/t) as z from calf join f using(group_id) join temps using(fold))",
            "sc_": SCORES.format(src="arms")}


@query("C11_folds_and_temperatures", sql(f"select group_id, fold, {R('t')} as temperature from f join temps using(fold)", "winA", **EVIDENCE))
def _(t):
    folds, temperatures, _blocks, _interval = C.calibration_evidence(settle(t.window_rows("A")), samples=1)
    return folds.join(temperatures, "fold").select("group_id", "fold", r6("temperature", "temperature"))


@query("C11_out_of_fold_blocks", sql(union_sql([f"""select arm, '{name}' as weighting, {R(f'sum({w}*ok::int)/sum({w})')} as acc, {R(f'sum({w}*nll)/sum({w})')} as nll, {R(f'sum({w}*brier)/sum({w})')} as brier,
 {R('(' + '+'.join(f'abs(sum(case when {EDGE}={i} then {w}*(ok::int-conf) else 0 end))' for i in range(10)) + f')/sum({w})')} as ece from sc_ group by arm""" for name, w in (("windows", "1e0"), ("episodes", "w"))]), "winA", **EVIDENCE))
def _(t):
    return rounded(C.calibration_evidence(settle(t.window_rows("A")), samples=1)[2])


@query("C11_ece_interval", sql(f"""select {','.join(f"{R(f'quantile_cont({c},{q})')} as {n}_{tag}" for c, n in (('raw', 'raw'), ('oof', 'out_of_fold'), ('oof-raw', 'delta')) for tag, q in (('lo', 0.025), ('hi', 0.975)))},
 quantile_cont(oof-raw,0.975)<0 or quantile_cont(oof-raw,0.025)>0 as separated from (select s, max(case when arm='raw' then v end) as raw, max(case when arm='out_of_fold' then v end) as oof from st group by s)""", "winA", **EVIDENCE,
                              units=f"select source, group_id, row_number() over (order by sha256('calibration:all:'||group_id)) as unit, count(*) over () as units, {h60(repr('calibration'), repr('all'))} as k from (select distinct 'all' as source, group_id from calf)", draws=picks_sql("units", "source", SAMPLES),
                              sums=f"select group_id, arm, {EDGE} as bin, sum(ok::int-conf) as x, count(*) as n from sc_ group by all", bn="select s, arm, bin, sum(x*m) as x, sum(n*m) as n from sums join units using(group_id) join draws using(unit) group by s, arm, bin",
                              st="select s, arm, sum(abs(x))/sum(n) as v from bn group by s, arm"))
def _(t):
    return rounded(C.calibration_evidence(settle(t.window_rows("A")), samples=SAMPLES)[3])


@query("C11_excluded_views", sql("select variant, count(*) as n from winA where split='calibration' and variant<>'clean' group by variant", "winA"))
def _(t):
    w = t.window_rows("A")
    return C.calibration_by_source(w, t.spark.createDataFrame([(1.0,)], "temperature double"))[1]


@query("C12_join_predictions", sql(f"""select id, case x when 0 then 'missing' when 1 then 'duplicate' when 2 then 'labels' when 3 then 'lineage' when 4 then 'shape' when 5 then 'distribution' when 6 then 'logits_disagree' end as reason, {R('case when x>6 then p[label+1] end')} as p_label
 from (select *, {h(repr('jp'), 'id')}%30 as x from winA) union all select 'extra-'||id, 'unexpected', null from winA where {h(repr('jp'), 'id')}%30=7""", "winA"))
def _(t):
    from ..functions import vectors as V
    w = t.window_rows("A")
    r = w.withColumn("x", h32("jp", F.col("id")) % 30).filter("x <> 0")
    x = F.col("x")
    r = r.withColumn("label", F.when(x == 2, (F.col("label") + 1) % 3).otherwise(F.col("label"))).withColumn("group_id", F.when(x == 3, "g").otherwise(F.col("group_id")))
    r = r.withColumn("p", F.when(x == 4, F.slice("p", 1, 2)).when(x == 5, F.transform("p", lambda v: v * 0.9)).when(x == 6, F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).otherwise(F.col("p")))
    extra = r.filter("x = 7").withColumn("id", F.concat(F.lit("extra-"), "id"))
    j = C.join_predictions(w, r.unionByName(r.filter("x = 1")).unionByName(extra).drop("x"))
    lab = w.select("id", "label")
    return j.join(lab, "id", "left").select("id", "reason", r6(F.when(F.col("reason").isNull(), V.at("p", "label")), "p_label"))


@query("C13_episode_lineage_audit", sql(f"""select id as subject, 'duplicate_id' as code from w2 group by id having count(*)>1 union all select group_id, 'group_crosses_splits' from w2 group by group_id having min(split)<>max(split)
 union all select parent, 'episode_lineage' from w2 group by parent having count(distinct (split, group_id, regime, label))>1 union all select id, 'unknown_view' from w2 where variant='other' union all select id, 'no_requests' from w2 where n_requests<1""", "winA",
                                       w2=f"""select case when x=0 then 'dup' else id end as id, parent, group_id, case when x=1 then 'test' else split end as split, regime, case when x=2 then (label+1)%3 else label end as label, case when x=3 then 'other' else variant end as variant, case when x=4 then 0 else n_requests end as n_requests
 from (select *, {h(repr('el'), 'id')}%60 as x from winA)"""))
def _(t):
    w = t.window_rows("A").withColumn("x", h32("el", F.col("id")) % 60)
    x = F.col("x")
    w = w.withColumn("split", F.when(x == 1, "test").otherwise(F.col("split"))).withColumn("label", F.when(x == 2, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    w = w.withColumn("variant", F.when(x == 3, "other").otherwise(F.col("variant"))).withColumn("n_requests", F.when(x == 4, 0).otherwise(F.col("n_requests"))).withColumn("id", F.when(x == 0, "dup").otherwise(F.col("id")))
    return C.episode_lineage_audit(w)


@query("C14_paired_deltas", union_sql([boot_sql(m, "task") for m in ("nll", "acc", "brier")]))
def _(t):
    return rounded(C.compare_deltas(t.decisions("A"), t.decisions("B"), "suite", "suite", SAMPLES))


@query("C14_compare_runs", sql(f"select task, {','.join(R(f'avg({s}.{e})') + f' as {n}_{tag}' for tag, s in (('a', 'a'), ('b', 'b')) for n, e in (('acc', 'ok::int'), ('nll', 'nll'), ('brier', 'brier')))} from scA a join scB b using(id, task) group by task", "scA", "scB"))
def _(t):
    return rounded(C.compare_runs(t.decisions("A"), t.decisions("B"), "suite", "suite"))

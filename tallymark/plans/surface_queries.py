"""U queries: the user-function surface."""
from pyspark.sql import functions as F

from ..functions.bodies import json_leaves
from ..functions.python_side import regex_counter
from ..functions.vectors import r6
from ..operators import calibrate as C
from ..operators import rules as RU
from ..operators import scoring as M
from .calibrate_queries import SAMPLES, boot_ctes
from .oracle import r6 as R, softmax, sql
from .perturb_queries import AT, ATOMS, FACTS, RC, rule_cases
from .registry import query
from .scoring_queries import rounded


@query("U1_predictor", sql(f"select id, task as question, {R('ps[label+1]')} as p_label from (select *, {softmax('logits')} as ps from decA)", "decA"))
def _(t):
    q = t.questions().withColumn("question", F.col("task"))
    s = M.score_batch(q.select("id", "question", "keys", "label"), M.hash_predictor("A", 1.2))
    j = s.join(q.select("id", "question", "label"), ["id", "question"])
    return j.select("id", "question", r6(F.element_at("p", F.col("label") + 1), "p_label"))


@query("U2_size_counter", sql("select doc_id as id, len(regexp_extract_all(text,'[A-Za-z0-9]+')) as size from documents"))
def _(t):
    return t.documents.select(F.col("doc_id").alias("id"), regex_counter()("text").alias("size"))


@query("U3_bootstrap_metric", sql(f"""select {R('max(case when s=-1 then d end)')} as delta, {R('quantile_cont(case when s>=0 then d end,0.025)')} as lo, {R('quantile_cont(case when s>=0 then d end,0.975)')} as hi from (
 select s, max(case when arm='c' then v end)-max(case when arm='r' then v end) as d from (select s, arm, sum(x)/sum(n) as v from sums join units using(source, group_id) join (select s, source, unit, m from draws union all select -1, source, unit, 1 from units) using(source, unit), lateral (select x0*m as x, n0*m as n) group by s, arm) group by s)""",
                                  "scA", "scB", **boot_ctes("u3", SAMPLES), sums="select source, group_id, arm, sum((conf>=0.8e0)::int) as x0, count(*) as n0 from (select source, group_id, 'c' as arm, conf from scA union all select source, group_id, 'r', conf from scB) group by source, group_id, arm"))
def _(t):
    C.register_metric("coverage_at_0_8", "additive", lambda: (F.col("conf") >= 0.8).cast("double"))
    return rounded(C.paired_bootstrap(t.decisions("A"), t.decisions("B"), "coverage_at_0_8", "micro", SAMPLES, "u3").select("delta", "lo", "hi"))


@query("U4_rule_compiler", sql("select case_id, a0 and not a3 as unless_rule, not (a0 or a2) as negated from at_", "cases", rc=RC, at_=AT))
def _(t):
    f = {x: F.col(x) for x in FACTS}
    return rule_cases(t).select("case_id", RU.eval_rule(["unless", 0, 3], ATOMS, f).alias("unless_rule"), RU.eval_rule(["not", ["or", 0, 2]], ATOMS, f).alias("negated"))


@query("U5_json_leaves", sql("select event_id, u.path, u.value from events, lateral (values ('props.k', regexp_extract(props,'([0-9]+)',1)), ('tags[0]', event_type), ('tags[1]', 'x')) u(path,value)"))
def _(t):
    d = t.events.select("event_id", F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"tags":["'), F.col("event_type"), F.lit('","x"],"none":{}}')).alias("body"))
    return json_leaves(d, "body").select("event_id", "path", "value")

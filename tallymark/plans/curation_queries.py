"""S, V and D queries: reading, validating, mapping and deduplicating labelled records."""
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.bodies import json_leaves
from ..functions.python_side import builtin_counter
from ..functions.text import h32, sha, state_key, word_count
from ..functions.vectors import r6
from ..operators import curate as D
from ..operators import scoring as M
from ..operators import validate as VA
from ..session import work_dir
from ..sources import labelled as L
from ..sources import suites as S
from ..sources.fixtures import lit_array
from .oracle import collapse, h, norm, r6 as R, sql, words as W
from .registry import query
from .scoring_queries import rounded

SPLIT_SQL = "case when {x}%10<6 then 'train' when {x}%10=6 then 'calibration' when {x}%10=7 then 'development' else 'test' end"


def split_of(*parts):
    x = h32(*parts) % 10
    return F.when(x < 6, "train").when(x == 6, "calibration").when(x == 7, "development").otherwise("test")


# ---- sources -------------------------------------------------------------------------------------------------------
def labelled_lines(t):
    """Labelled documents as JSON lines, one seeded defect per line by digest (0..10; larger values are clean)."""
    d = t.documents.select("doc_id", "text", "lang").join(t.labels, "doc_id").withColumn("x", h32("jdef", F.col("doc_id")) % 16)
    x = F.col("x")
    quoted = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    state = F.when(x == 2, F.lit('"state":"",')).when(x == 3, F.lit("")).otherwise(F.concat(F.lit('"state":'), quoted, F.lit(",")))
    yes = F.when(F.col("toxic") == 1, "true").otherwise("false")
    toxic = F.concat(F.lit('"toxic":{"type":"'), F.when(x == 7, "maybe").otherwise("noul"), F.lit('","instructions":"'), F.when(x == 10, "").otherwise("Is it toxic?"),
                     F.lit('","label":'), F.when(x == 4, F.concat(F.lit('"'), yes, F.lit('"'))).otherwise(yes),
                     F.when(x == 8, ',"target":{"perhaps":1.0}').otherwise(',"target":{"true":0.25,"false":0.75}'), F.lit("}"))
    lang = F.concat(F.lit('"lang":{"type":"choice","instructions":"Which language?","criteria":{"fr":null,"en":"English","de":null,"es":null},"label":"'),
                    F.when(x == 5, "xx").otherwise(F.col("lang")), F.lit('"}'))
    quality = F.concat(F.lit('"quality":{"type":"score","instructions":"How good?","criteria":["low","high"],"label":'), F.when(x == 6, F.lit("2")).otherwise(F.col("quality").cast("string")), F.lit("}"))
    qs = F.when(x == 9, F.lit("")).otherwise(F.concat_ws(",", toxic, lang, quality))
    line = F.concat(F.lit("{"), state, F.lit('"questions":{'), qs, F.lit("}}"))
    return d.select(F.when(x == 0, '{"state": ').when(x == 1, "").otherwise(line).alias("value"))


JL = f"select *, {h(chr(39) + 'jdef' + chr(39), 'doc_id::varchar')}%16 as x from documents join labels using(doc_id)"


@query("S1_read_jsonl_records", sql(f"select sha256({norm('text')}) as text_sha256, 3::bigint as n_questions, count(*) as n from jl where x>10 group by 1", jl=JL))
def _(t):
    path = work_dir(t.spark, "labelled")
    labelled_lines(t).write.text(path)
    good, _bad = L.read_labelled_jsonl(t.spark, path, "docs")
    return good.groupBy("text_sha256", F.size("questions").cast("bigint").alias("n_questions")).agg(F.count(F.lit(1)).alias("n"))


@query("S1_read_jsonl_problems", sql("""select case x when 0 then 'not_json' when 2 then 'state_empty' when 3 then 'state_missing' when 4 then 'toxic:noul_label' when 5 then 'lang:choice_label'
 when 6 then 'quality:score_label' when 7 then 'toxic:unknown_type' when 8 then 'toxic:target' when 9 then 'questions_missing' when 10 then 'toxic:instructions_missing' end as problem, count(*) as n
 from jl where x<11 and x<>1 group by 1""", jl=JL))
def _(t):
    path = work_dir(t.spark, "labelled")
    labelled_lines(t).write.text(path)
    _good, bad = L.read_labelled_jsonl(t.spark, path, "docs")
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("S1_distinct_ids", sql("select count(*) as records, count(*) as ids, true as several_files from jl where x>10", jl=JL))
def _(t):
    path = work_dir(t.spark, "labelled")
    labelled_lines(t).repartition(3).write.text(path)
    good, _bad = L.read_labelled_jsonl(t.spark, path, "docs")
    return good.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("ids"), F.lit(len(t.spark.read.text(path).inputFiles()) > 1).alias("several_files"))


@query("S1_line_numbers", sql("select count(*) as lines, count(*) as numbered from jl", jl=JL))
def _(t):
    path = work_dir(t.spark, "labelled")
    labelled_lines(t).write.text(path)
    n = L.number_lines(t.spark.read.text(path))
    per = n.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("m"), F.min("line").alias("lo"), F.countDistinct("line").alias("d"))
    return per.agg(F.sum("n").alias("lines"), F.sum(F.when((F.col("n") == F.col("m")) & (F.col("lo") == 1) & (F.col("d") == F.col("n")), F.col("n")).otherwise(0)).alias("numbered"))


EXP = f"select doc_id, case when {h(repr('xs'), 'doc_id::varchar')}%4=0 then '' else source end as source, case when {h(repr('xl'), 'doc_id::varchar')}%4=0 then '' else lang end as lang, text from documents"


def export_rows(t):
    d = t.documents
    return d.select("doc_id", F.when(h32("xs", F.col("doc_id")) % 4 == 0, "").otherwise(F.col("source")).alias("source"),
                    F.when(h32("xl", F.col("doc_id")) % 4 == 0, "").otherwise(F.col("lang")).alias("lang"), "text")


@query("S2_export_csv", sql("""select case when source='' and lang='' then null when source='' then '{"lang":"'||lang||'"}' when lang='' then '{"source":"'||source||'"}'
 else '{"source":"'||source||'","lang":"'||lang||'"}' end as state, doc_id::varchar as which, case when source='' and lang='' then 'empty state' end as reason from e""", e=EXP))
def _(t):
    path = work_dir(t.spark, "export")
    export_rows(t).drop("text").write.csv(path, header=True, sep="\t", emptyValue="", quote='"', escape='"')
    return L.read_export(t.spark, path, "tsv", ["source", "lang"], {"which": "doc_id"})


@query("S2_export_comma", sql("select case when source='' then null else source end as state, doc_id::varchar as which, lang as language, case when source='' then 'empty state' end as reason from e", e=EXP))
def _(t):
    path = work_dir(t.spark, "export")
    export_rows(t).select(F.concat(F.lit('"'), F.replace("source", F.lit('"'), F.lit('""')), F.lit('"')).alias("s"), "doc_id", "lang").select(F.concat_ws(",", "s", "doc_id", "lang").alias("value")) \
        .withColumn("g", F.substring("value", -1, 1)).groupBy("g").agg(F.concat(F.lit("source,doc_id,lang\n"), F.array_join(F.collect_list("value"), "\n")).alias("value")).write.partitionBy("g").text(path)
    out = L.read_export(t.spark, path, "csv", ["source"], {"which": "doc_id", "language": "lang"})
    return out.select(F.when(F.col("state") != "", F.col("state")).alias("state"), "which", F.coalesce("language", F.lit("")).alias("language"), "reason")


@query("S2_export_json_array", sql("select sha256(text) as state_sha, lang as language, null::varchar as reason from e where text<>''", e=EXP))
def _(t):
    path = work_dir(t.spark, "export")
    rows = export_rows(t).select((F.col("doc_id") % 16).alias("g"), F.to_json(F.struct(F.struct("text").alias("body"), F.struct("lang").alias("meta"))).alias("j"))
    rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("g").text(path)      # sixteen array files
    out = L.read_export(t.spark, path, "json", ["body.text"], {"language": "meta.lang"})
    return out.select(F.sha2("state", 256).alias("state_sha"), "language", "reason")


@query("S2_export_jsonl", sql("select sha256(text) as state_sha, lang as language, null::varchar as reason from e where text<>''", e=EXP))
def _(t):
    path = work_dir(t.spark, "export")
    d = export_rows(t)
    d.select(F.to_json(F.struct(F.struct("text").alias("body"), F.struct("lang").alias("meta"))).alias("value")).write.text(path)
    out = L.read_export(t.spark, path, "jsonl", ["body.text"], {"language": "meta.lang"})
    return out.select(F.sha2("state", 256).alias("state_sha"), "language", "reason")


@query("S3_adapt_source", sql(f"""
 select doc_id as row_id, sha256(array_to_string({W("replace(text,'<br />',' ')")}[1:200],' ')) as state_sha, u.qid, u.label from d, lateral (values ('tier',(['low_tier','high_tier'])[q+1]),
   ('is_'||pick, case when pick=(['low_tier','high_tier'])[q+1] then 'true' else 'false' end), ('good', case when q>=1 then 'true' else 'false' end)) u(qid,label)""",
                              d=f"""select *, case when {h(repr('neg'), 'doc_id::varchar')}%10=0 then -1 else quality end as q,
 case when sha256(doc_id||':low_tier')<sha256(doc_id||':high_tier') then 'low_tier' else 'high_tier' end as pick from documents join labels using(doc_id) where {h(repr('neg'), 'doc_id::varchar')}%10<>0"""))
def _(t):
    d = t.documents.join(t.labels, "doc_id").withColumn("q", F.when(h32("neg", F.col("doc_id")) % 10 == 0, -1).otherwise(F.col("quality")))
    spec = dict(id="doc_id", source="docs", text="text", label="q", words=200, strip_breaks=True, labels=("Low tier", "High tier"), per_option=1,
                question=dict(qid="tier", type="choice", instructions="Which tier?"), threshold=("good", "Is it good?", 1))
    return L.adapt_source(d, spec).select("row_id", F.sha2("state", 256).alias("state_sha"), "qid", "label")


@query("S4_adapt_eval_rows", sql(f"""select case when pert='none' then id::varchar else id||'/'||pert end as id, case when pert<>'none' then id::varchar end as parent_id,
 case when pert='none' then 'clean' else pert end as variant, keys[label+1] as label_key, len(keys) as n_options, {R('p[label+1]')} as target_p, {R('q[label+1]')} as published_b from (
 select a.*, b.p as q, (['none','shuffled','typo'])[{h(repr('pert'), 'a.id::varchar', 'a.task')}%3+1] as pert from decA a join decB b using(id,task))""", "decA", "decB"))
def _(t):
    b = t.decisions("B").select("id", "task", F.col("p").alias("q"))
    d = t.decisions("A").join(b, ["id", "task"])
    rows = d.select(F.col("id").cast("string").alias("row_id"), F.element_at(lit_array(("none", "shuffled", "typo")), (h32("pert", F.col("id"), F.col("task")) % 3 + 1).cast("int")).alias("perturbation"),
                    F.col("task").alias("state"), F.col("keys").alias("option_ids"), F.transform("keys", lambda k: F.concat(F.lit("option "), k)).alias("option_texts"),
                    F.col("label").alias("label_idx"), F.col("p").alias("target"), F.create_map(F.lit("A"), F.col("p"), F.lit("B"), F.col("q")).alias("published"))
    a = L.adapt_eval_rows(rows)
    return a.select("id", "parent_id", "variant", "label_key", F.size("options").cast("bigint").alias("n_options"), r6(F.col("target")[F.col("label_key")], "target_p"),
                    r6(F.col("published")["B"][F.col("label_key")], "published_b"))


@query("S5_merge_questions_by_state", sql("""select min(id) as id, sha256(state) as state_sha, count(*) as n_questions, string_agg(qid||'='||label, ',' order by qid) as questions from (
 select state, qid, min(id) as id, arg_max(label, id) as label from labelled group by state, qid) group by state""", "labelled"))
def _(t):
    m = L.merge_questions_by_state(t.labelled())
    return m.select("id", F.sha2("state", 256).alias("state_sha"), "n_questions", F.array_join(F.transform("questions", lambda q: F.concat_ws("=", q["qid"], q["label"].cast("string"))), ",").alias("questions"))


FROZEN = f"select *, {SPLIT_SQL.format(x='(' + h(repr('fz'), 'skey') + ')')} as split from states"


@query("S6_load_split", sql("select id, source, skey from f where split='development'", "states", f=FROZEN))
def _(t):
    path = work_dir(t.spark, "suite")
    S.freeze_suite(t.states().withColumn("split", split_of("fz", F.col("skey"))), path, {"name": "docs"})
    return S.load_split(t.spark, path, "development").select("id", "source", "skey")


@query("S7_freeze_suite", sql("select v.split, count(f.split) as records, count(f.split) as questions from (values ('train'),('calibration'),('development'),('test')) v(split) left join f using(split) group by 1", "states", f=FROZEN))
def _(t):
    path = work_dir(t.spark, "suite")
    return S.freeze_suite(t.states().withColumn("split", split_of("fz", F.col("skey"))), path, {"name": "docs"}).select("split", "records", "questions")


@query("S8_write_native_corpus", sql(f"""select split, origin, profile, count(*) as events, count(distinct episode_id) as episodes from (
 select txo.*, v.profile from txo cross join (values ('full'),('prefix_loss'),('sampled_loss')) v(profile) where v.profile='full' or (v.profile='prefix_loss' and ordinal>=2)
   or (v.profile='sampled_loss' and {h(repr('mask'), 'group_id', 'ordinal::varchar')}/4294967296e0<0.8e0)) group by all""", "txo"))
def _(t):
    from ..operators import events as B
    tx = t.tx_ordered()
    views = B.apply_masks(tx).select("episode_id", "profile", "request_id", "method", "path", "status", "start_ms", "completed_ms")
    return S.write_native_corpus(tx, views, work_dir(t.spark, "corpus"))


@query("S9_write_scored", sql("select case when len(keys)+length(id::varchar)>9 then 'rejected' else 'rows' end as part, count(*) as n from questions group by 1 union all select 'summary', 1", "questions"))
def _(t):
    q = t.questions().withColumn("question", F.col("task")).select("id", "question", "keys", "label")
    scored = M.score_batch(q, M.hash_predictor("A", 1.2, max_tokens=9))
    rows, rejected, summary = S.write_scored(scored, M.coverage_counters, work_dir(t.spark, "scored"))
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return one(rows, "rows").unionByName(one(rejected, "rejected")).unionByName(one(summary, "summary"))


@query("S10_training_log", sql("""select file, line, epoch, step, loss, line=max(line) over (partition by file, epoch) as is_last from (
 select 'run'||(o_custkey%10) as file, o_orderkey as line, o_orderkey//2000 as epoch, o_orderkey%2000 as step, (floor(o_totalprice)::bigint%1000)/1000e0 as loss from orders where o_orderkey%7<>0)"""))
def _(t):
    k = F.col("o_orderkey")
    loss = F.format_string("%.3f", (F.floor("o_totalprice") % 1000) / F.lit(1000.0))
    line = F.format_string("[train] epoch %d step %d loss=%s", F.floor(k / 2000), k % 2000, loss)
    d = t.orders.select(F.concat(F.lit("run"), (F.col("o_custkey") % 10).cast("string")).alias("file"), k.alias("line"), F.when(k % 7 == 0, "saving checkpoint").otherwise(line).alias("value"))
    return L.training_log_to_table(d)


# ---- validation ----------------------------------------------------------------------------------------------------
@query("V1_check_records", sql("select doc_id as id, case x when 4 then 'toxic:noul_label' when 5 then 'lang:choice_label' when 6 then 'quality:score_label' when 7 then 'toxic:unknown_type' when 8 then 'toxic:target' when 10 then 'toxic:instructions_missing' end as problem from jl where x in (4,5,6,7,8,10)", jl=JL))
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").withColumn("x", h32("jdef", F.col("doc_id")) % 16)
    x = F.col("x")
    yes = F.col("toxic") == 1
    tox = F.struct(F.when(x == 7, "maybe").otherwise("noul").alias("type"), F.when(x == 10, "").otherwise("Is it toxic?").alias("instructions"), F.lit(None).cast("string").alias("criteria"),
                   F.parse_json(F.when(x == 4, F.lit('"true"')).otherwise(F.when(yes, "true").otherwise("false"))).alias("label"), F.when(x == 8, '{"perhaps":1}').otherwise('{"true":0.25}').alias("target"))
    lang = F.struct(F.lit("choice").alias("type"), F.lit("Which language?").alias("instructions"), F.lit('{"fr":null,"en":null,"de":null,"es":null}').alias("criteria"),
                    F.parse_json(F.concat(F.lit('"'), F.when(x == 5, "xx").otherwise(F.col("lang")), F.lit('"'))).alias("label"), F.lit(None).cast("string").alias("target"))
    qual = F.struct(F.lit("score").alias("type"), F.lit("How good?").alias("instructions"), F.lit('["low","high"]').alias("criteria"),
                    F.parse_json(F.when(x == 6, F.lit("2")).otherwise(F.col("quality").cast("string"))).alias("label"), F.lit(None).cast("string").alias("target"))
    probs = F.concat(L.question_problems(F.lit("toxic"), tox), L.question_problems(F.lit("lang"), lang), L.question_problems(F.lit("quality"), qual))
    return d.select(F.col("doc_id").alias("id"), F.explode(probs).alias("problem"))


# raw label spellings and what they must become (fixed values of the check)
YN = ((" Yes", "true", None), ("TRUE", "true", None), ("n", "false", None), ("0", "false", None), ("maybe", None, "not a yes/no value"), ("  ", None, "empty label"), ("affirmative", "true", None))
CH = (("refund", "refund", None), ("REFUND", "refund", None), ("shipping issue", "ship", None), ("other", None, "not an option"), ("", None, "empty label"), ("pkg", "ship", None))
SC = (("1", "0", None), ("3.0", "2", None), ("9", None, "level outside"), ("Good", "1", None), ("great", "2", None), ("zzz", None, "not a level"))


def pick(values, *parts):
    return F.element_at(lit_array([v[0] for v in values]), (h32(*parts) % len(values) + 1).cast("int"))


def pick_sql(values, i, tag):
    q = lambda v: "null" if v is None else "'" + v + "'"
    return f"([{','.join(q(v[i]) for v in values)}])[{h(repr(tag), 'o_orderkey::varchar')}%{len(values)}+1]"


@query("V2_map_labels", sql(" union all ".join(f"select o_orderkey as id, '{n}' as question, {pick_sql(v, 1, n)} as label, {pick_sql(v, 2, n)} as reason from orders" for n, v in (("yn", YN), ("ch", CH), ("sc", SC)))))
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"))
    yn = VA.map_labels(o.withColumn("value", pick(YN, "yn", F.col("id"))), dict(type="noul"), {"affirmative": "yes"})
    ch = VA.map_labels(o.withColumn("value", pick(CH, "ch", F.col("id"))), dict(type="choice", options=(("refund", "Money back"), ("ship", "Shipping issue"))), {"pkg": "ship"})
    sc = VA.map_labels(o.withColumn("value", pick(SC, "sc", F.col("id"))), dict(type="score", options=(("0", "bad"), ("1", "good"), ("2", "great: all fine"))), {}, score_offset=1)
    tag = lambda d, n: d.select("id", F.lit(n).alias("question"), "label", "reason")
    return tag(yn, "yn").unionByName(tag(ch, "ch")).unionByName(tag(sc, "sc"))


GEN = (("noul", "True", "true", None), ("noul", "yes", None, "unusable label"), ("choice", "REFUND", "refund", None), ("choice", "ship", "ship", None), ("choice", "x", None, "unusable label"),
       ("score", "1", "1", None), ("score", "2.0", "2", None), ("score", "2.5", None, "unusable label"), ("score", "7", None, "unusable label"), ("noul", "", None, "missing label"))


@query("V3_coerce_generated_labels", sql(f"select o_orderkey as id, {pick_sql([(g[2],) for g in GEN], 0, 'gen')} as label, {pick_sql([(g[3],) for g in GEN], 0, 'gen')} as reason from orders"))
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("id")).withColumn("i", (h32("gen", F.col("id")) % len(GEN) + 1).cast("int"))
    o = o.withColumn("type", F.element_at(lit_array([g[0] for g in GEN]), F.col("i"))).withColumn("value", F.element_at(lit_array([g[1] for g in GEN]), F.col("i")))
    o = o.withColumn("keys", F.when(F.col("type") == "choice", lit_array(("refund", "ship"))).when(F.col("type") == "score", lit_array(("0", "1", "2"))).otherwise(lit_array(("false", "true"))))
    return VA.coerce_generated_labels(o).select("id", "label", "reason")


@query("V4_materialize", sql(f"""select id, task as qid, label::bigint as label, case when type='noul' then 'no' else keys[1]||case when type='choice' then ': first' else '' end end as first_text,
 {R(f"case when {h(repr('soft'), 'id::varchar', 'task')}%3=0 then (case when label=0 then 0.75e0 else 0e0 end) else 1e0 end")} as target_label,
 {R(f"case when {h(repr('soft'), 'id::varchar', 'task')}%3=0 then 0.75e0 else (case when label=0 then 1e0 else 0e0 end) end")} as target_first from questions""".replace(
    "then (case when label=0 then 0.75e0 else 0e0 end)", "then (case when label=0 then 0.75e0 when label=1 then 0.25e0 else 0e0 end)"), "questions"))
def _(t):
    q = t.questions()
    opts = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.when((F.col("type") == "choice") & (i == 0), "first").alias("desc")))
    soft = F.when(h32("soft", F.col("id"), F.col("task")) % 3 == 0, F.map_from_arrays(F.slice("keys", 1, 2), F.array(F.lit(3.0), F.lit(1.0))))
    rec = q.select("id", F.array(F.struct(F.col("task").alias("qid"), "type", F.lit("?").alias("instructions"), opts.alias("options"), V.at("keys", "label").alias("label_key"), soft.alias("target"))).alias("questions"))
    m = VA.materialize(rec)
    return m.select("id", F.col("q.qid").alias("qid"), F.col("label").cast("bigint").alias("label"), F.element_at("option_texts", 1).alias("first_text"),
                    r6(V.at("target", "label"), "target_label"), r6(F.element_at("target", 1), "target_first"))


@query("V5_request_projection", sql("select id, sha256(state) as state_sha, qid, instructions from labelled", "labelled"))
def _(t):
    d = t.labelled().withColumn("type", F.lit("noul"))
    return VA.request_projection(d, ("id", "state", "qid", "instructions")).withColumn("state_sha", F.sha2("state", 256)).drop("state")


@query("V6_validate_distribution", sql(f"""select id, task, case when x=0 then 'keys_differ' when x=1 then 'out_of_range' when x=2 then 'sum_off' end as reason, {R('case when x>2 then p[label+1]/list_sum(p) end')} as p_label,
 case when x=3 then 1 else 0 end::bigint as zero_count from (select *, {h(repr('vd'), 'id::varchar', 'task')}%12 as x from (select * replace(case when {h(repr('vd'), 'id::varchar', 'task')}%12=3 then zp else p end as p) from (
 select *, list_transform(range(len(p)), lambda i: case when i=0 then 0e0 else least(p[i+1]/(1-p[1]),1e0) end) as zp from decA)))""", "decA"))
def _(t):
    d = t.decisions("A").withColumn("x", h32("vd", F.col("id"), F.col("task")) % 12)
    x = F.col("x")
    zp = F.transform("p", lambda v, i: F.when(i == 0, 0.0).otherwise(F.least(v / (1 - F.element_at("p", 1)), F.lit(1.0))))
    base = F.when(x == 3, zp).otherwise(F.col("p"))
    vals = F.transform(base, lambda v, i: F.when((x == 1) & (i == 0), -v).when(x == 2, v * 0.9).when(x == 4, v * 1.000001).otherwise(v))
    keys = F.transform("keys", lambda k, i: F.when((x == 0) & (i == 0), "other").otherwise(k))
    v = M.validate_distribution(d.withColumn("answer", F.map_from_arrays(keys, vals)).drop("p"))
    return v.select("id", "task", "reason", r6(V.at("p", "label"), "p_label"), "zero_count")


@query("V7_admit_by_size", sql(f"""select id, case when w>384 then 'words:state' when w+b+64>1024 then 'words:branch' when a>384 then 'pieces:state' when a+2*b+64>1024 then 'pieces:branch' end as reject_reason from (
 select *, case when {collapse('state')}='' then 0 else len(string_split({collapse('state')},' ')) end as w, len(regexp_extract_all(state,'[A-Za-z0-9]+')) as a, 4 as b from states)""", "states"))
def _(t):
    d = t.states().withColumn("branch", F.lit("is it toxic? yes")).withColumn("variant", F.lit("clean"))
    out = VA.admit_by_size(d, {"words": word_count, "pieces": builtin_counter()})
    return out.select("id", "reject_reason")


@query("V8_partition_size_report", sql(f"""
 select split, count(*) as records, sum((w>200)::int)::bigint as over_limit, max(w)::bigint as max_size, {R('avg(q)')} as mean_questions, (list_sort(list(w))[count(*)//2+1])::double as median_size,
 (select string_agg(id::varchar, ',' order by id) from (select id from d x where x.split=d.split and w>200 order by id limit 20)) as over_ids from d group by split""", "states",
                                       d=f"select *, case when {collapse('state')}='' then 0 else len(string_split({collapse('state')},' ')) end as w, {SPLIT_SQL.format(x='(' + h(repr('fz'), 'skey') + ')')} as split, (id%3+1)::double as q from states"))
def _(t):
    d = t.states().withColumn("size", word_count("state")).withColumn("split", split_of("fz", F.col("skey"))).withColumn("n_questions", F.col("id") % 3 + 1)
    return rounded(VA.partition_size_report(d, 200))


@query("V9_validate_training", sql("select id, case when source in ('src3','src7') then 'source' else 'held_out_family' end as reason from (select *, (['a','b','c','d'])[id%4+1] as family from (select * replace(case when id%9=0 then 'compositional' else source end as source) from states)) where source in ('src3','src7') or (source='compositional' and family='c')", "states"))
def _(t):
    d = t.states().withColumn("source", F.when(F.col("id") % 9 == 0, "compositional").otherwise(F.col("source")))
    d = d.withColumn("family", F.element_at(lit_array(("a", "b", "c", "d")), (F.col("id") % 4 + 1).cast("int")))
    return VA.validate_training(d, dict(forbidden=["src3", "src7"], held_families=["c"])).select("id", "reason")


@query("V10_scored_rows", sql("select task, source, count(*) as n from decA group by all union all select task, source, count(*) from unkA where source<>'unknowable' group by all", "decA", "unkA"))
def _(t):
    cols = ["id", "task", "source", "variant"]
    u = t.decisions("A").select(*cols).unionByName(t.permuted("A").select(*cols)).unionByName(t.unknowable("A").select(*cols))
    return M.scored_rows(u).groupBy("task", "source").agg(F.count(F.lit(1)).alias("n"))


@query("V11_label_table", sql(f"select qid, {SPLIT_SQL.format(x='(' + h(repr('fz'), 'skey') + ')')} as split, label::bigint as label, count(*) as n from labelled group by all", "labelled"))
def _(t):
    d = t.labelled().withColumn("split", split_of("fz", F.col("skey")))
    return VA.label_table(d, ("split", "qid")).withColumn("label", F.col("label").cast("bigint"))


@query("V12_label_warnings", sql("""select qid, label::varchar as label, 'rare_label' as warning, n from (select qid, label, count(*) as n, sum(count(*)) over (partition by qid) as tot from labelled group by qid, label) where n/tot<0.2
 union all select 'toxic', '2', 'never_correct', 0 union all select qid, null, 'long_state', count(*) from labelled where length(state)>1400 group by qid""", "labelled"))
def _(t):
    expected = t.spark.createDataFrame([("toxic", 0), ("toxic", 1), ("toxic", 2), ("quality", 0), ("quality", 1)], "qid string, label int")
    return VA.label_warnings(t.labelled(), expected, min_share=0.2)


@query("V13_mix_training", sql("""select id, 1::bigint as copy, 'public' as part from pub where rn<=round_even(tot*0.25e0,0) union all select id, c.n, 'synthetic' from s cross join (values (1),(2),(3)) c(n) where source in ('src1','src2')
 union all select id, 1, 'replay' from rep where rn<=50""", "states", s="select * from states where source<>'src0'",
                               pub="select *, row_number() over (order by sha256('mix:'||id)) as rn, count(*) over () as tot from s where source not in ('src1','src2')",
                               rep="select *, row_number() over (order by sha256('mix:'||id)) as rn from states where source='src0'"))
def _(t):
    s = t.states()
    srcs = [f"src{i}" for i in range(1, 20)]
    m = VA.mix_training(s.filter(F.col("source").isin(*srcs)), s.filter(F.col("source") == "src0"), public_frac=0.25, sources=srcs, repeat=3, replay_n=50, synthetic=("src1", "src2"))
    return m.select("id", F.col("copy").cast("bigint").alias("copy"), "part")


@query("V14_leak_scan", sql("""select event_id, code, path from (
 select event_id, 'hidden_key' as code, 'meta.policy_id' as path from o where x=0 union all select event_id, 'empty_id', 'items[0].session_id' from o where x=1
 union all select event_id, 'label_marker', 'items[0].session_id' from o where x=2)""", o=f"select event_id, {h(repr('leak'), 'event_id::varchar')}%9 as x from events"))
def _(t):
    x = h32("leak", F.col("event_id")) % 9
    sid = F.when(x == 1, "").when(x == 2, "run-agent-7").otherwise("s-1")
    body = F.concat(F.lit('{"meta":{"'), F.when(x == 0, "policy_id").otherwise("page"), F.lit('":"p1"},"items":[{"session_id":"'), sid, F.lit('","value":3}],"note":null}'))
    leaves = json_leaves(t.events.select("event_id", body.alias("body")), "body").drop("body")
    return VA.leak_scan(leaves).select("event_id", "code", "path")


@query("V15_observation_projection", sql("""select request_id, case when method='GET' then '' else 'if_version='||version||',value='||k end as request_fields,
 case when event_type='error' then 'error=busy,retry_after_ms='||k*10 else 'id='||resource_id||',value='||k||',version='||version end as response_fields from tx""", "tx"))
def _(t):
    p = VA.observation_projection(t.tx())
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return p.select("request_id", text("request_fields").alias("request_fields"), text("response_fields").alias("response_fields"))


# ---- fingerprints and duplicates -----------------------------------------------------------------------------------
@query("D1_state_key", sql("select id, skey from states", "states"))
def _(t):
    return t.states().select("id", "skey")


@query("D2_row_digest", sql("""select o_orderkey as id, sha256('{"o_custkey":'||o_custkey||',"o_orderkey":'||o_orderkey||',"o_orderstatus":"'||o_orderstatus||'"}') as canonical,
 sha256('{"o_orderstatus":"'||o_orderstatus||'","o_orderkey":'||o_orderkey||',"o_custkey":'||o_custkey||'}') as ordered from orders"""))
def _(t):
    cols = ["o_orderstatus", "o_orderkey", "o_custkey"]
    d = D.row_digest(D.row_digest(t.orders, cols, True, "canonical"), cols, False, "ordered")
    return d.select(F.col("o_orderkey").alias("id"), "canonical", "ordered")


@query("D3_semantic_hash", sql("""select conv_id, turn, sha256(role||'|'||array_to_string(list_sort(list_transform(string_split(text,'. '), lambda s: regexp_replace(s,'\\.+$',''))),'|')) as semantic from conversations"""))
def _(t):
    return D.semantic_hash(t.conversations, "role", "text").select("conv_id", "turn", "semantic")


@query("D4_longest_leaf", sql(f"select doc_id as id, sha256({norm('case when length(text)>length(source) then text else source end')}) as fingerprint from documents"))
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.to_json(F.struct("source", F.struct("text", F.array("lang").alias("langs")).alias("body"))).alias("state"))
    leaves = json_leaves(d, "state").filter("is_text").select("id", "pos", "value")
    return D.longest_leaf(leaves).select("id", "fingerprint")


@query("D5_drop_exact_duplicates", sql("select min(doc_id) as id, sha256(text) as fp from documents group by text"))
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fp"))
    return D.drop_exact_duplicates(d, "fp", "id").select("id", "fp")


@query("D6_drop_label_conflicts", sql("select id, qid from l2 where skey not in (select skey from l2 group by skey,qid,instructions having count(distinct label)>1)", "labelled",
                                      l2="select * replace(case when id%2=0 then 1-label else label end as label) from labelled"))
def _(t):
    d = t.labelled().withColumn("label", F.when(F.col("id") % 2 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return D.drop_label_conflicts(d).select("id", "qid")


FITS = f"(case when {collapse('state')}='' then 0 else len(string_split({collapse('state')},' ')) end)<=1000"
DOC = f"select *, sha256('row:'||id||':'||state) as row_sha, {FITS} as fits from states"
SRC = [f"src{i}" for i in range(20)]
ORDERED = sorted(SRC)


def _d7_ctes(n):
    out, prev = {"doc": DOC}, "select null::varchar as skey where false"
    for i, s in enumerate(ORDERED):
        seen = f"(select skey from sel{i - 1}_seen)" if i else f"({prev})"
        out[f"sel{i}"] = (f"select *, row_number() over (order by o) as rn from (select skey, min(row_sha) as o from doc where source='{s}' and fits and skey not in {seen} group by skey) qualify row_number() over (order by o)<={n}")
        out[f"sel{i}_seen"] = f"select skey from sel{i}" + (f" union select skey from sel{i - 1}_seen" if i else "")
    out["acc"] = " union all ".join(f"select '{s}' as source, {i} as rnk, skey, o from sel{i}" for i, s in enumerate(ORDERED))
    out["ends"] = f"select source, max(o) as last, count(*) as accepted from acc group by source"
    out["ranks"] = "select * from (values " + ",".join(f"('{s}',{i})" for i, s in enumerate(ORDERED)) + ") r(source,rnk)"
    return out


@query("D7_select_unique_rows", sql("select d.id, d.source from doc d join acc a on d.source=a.source and d.row_sha=a.o", "states", **_d7_ctes(6)))
def _(t):
    rows, _report = D.select_unique(doc_rows(t), 6)
    return rows.select("id", "source")


@query("D7_select_unique_report", sql("""select source, count(*) as considered, sum(dup::int)::bigint as duplicate_state, sum((not dup and not fits)::int)::bigint as context_rejected, max(accepted) as accepted, max(accepted)<6 as short from (
 select d.*, e.accepted, exists(select 1 from acc a where a.skey=d.skey and (a.rnk<r.rnk or (a.rnk=r.rnk and a.o<d.row_sha))) as dup from doc d join ranks r using(source) join ends e using(source)
 where e.accepted<6 or d.row_sha<=e.last) group by source""", "states", **_d7_ctes(6)))
def _(t):
    _rows, report = D.select_unique(doc_rows(t), 6)
    return report


def doc_rows(t):
    return t.states().withColumn("row_sha", sha("row", F.col("id"), F.col("state"))).withColumn("fits", word_count("state") <= 1000)


RESERVED = f"select skey from states where {h(repr('res'), 'id::varchar')}%7=0 union select sha256({norm('text')}) from benchmark"


@query("D8_exclude_states", sql("select id, source from states where skey not in (select skey from r)", "states", r=RESERVED))
def _(t):
    return D.exclude_states(t.states(), reserved(t))[0].select("id", "source")


@query("D8_leaked_states", sql("select id, source from states where skey in (select skey from r)", "states", r=RESERVED))
def _(t):
    return D.exclude_states(t.states(), reserved(t))[1].select("id", "source")


def reserved(t):
    docs = t.states().filter(h32("res", F.col("id")) % 7 == 0).select("skey")
    return docs.unionByName(t.benchmark.select(state_key("text").alias("skey")))


@query("D9_admit_fresh", sql(f"""select id, case when skey in (select skey from states where id%5=0) then 'state_reserved' when (source, id) in (select (source, id+1) from states where id%5=0) then 'origin_reserved' end as reason from states where id%5<>0""", "states"))
def _(t):
    s = t.states()
    old = s.filter(F.col("id") % 5 == 0)
    fp, origin = D.reserve(old.select(F.col("skey").alias("fp"), F.col("source").alias("repo"), F.lit("x").alias("split"), (F.col("id") + 1).alias("row")))
    cand = s.filter(F.col("id") % 5 != 0).select("id", F.col("skey").alias("fp"), F.col("source").alias("repo"), F.lit("x").alias("split"), F.col("id").alias("row"))
    return D.admit_fresh(cand, fp, origin).select("id", "reason")


@query("D9_reservation_digest", sql("""select count(*) as n, sum(('0x'||substr(hh,1,12))::bigint::decimal(38,0))::varchar as digest_sum, bit_xor(('0x'||substr(hh,13,12))::bigint) as digest_xor from (select sha256(skey) as hh from (select distinct skey from r))""", "states", r=RESERVED))
def _(t):
    return D.set_digest(reserved(t).distinct(), "skey")


GRP = f"select *, source||'/'||(id//4) as group_id, lang as family, {FITS} as fits from states"


@query("D10_admit_groups", sql("""select id, group_id from g join ok using(family, group_id)""", "states", g=GRP, r=RESERVED,
                               ok="select family, group_id from (select family, group_id, row_number() over (partition by family order by sha256(group_id)) as rn from g group by family, group_id having bool_and(fits) and not bool_or(skey in (select skey from r))) where rn<=25"))
def _(t):
    d = t.states().withColumn("group_id", F.concat_ws("/", "source", F.floor(F.col("id") / 4).cast("string"))).withColumn("family", F.col("lang")).withColumn("size", word_count("state"))
    return D.admit_groups(d, reserved(t), 25, max_size=1000).select("id", "group_id")


@query("D11_overlap", sql("select distinct skey from states where id%2=0 and skey in (select skey from states where id%2=1)", "states"))
def _(t):
    s = t.states()
    return D.overlap(s.filter(F.col("id") % 2 == 0), s.filter(F.col("id") % 2 == 1))


PAIRS_N = 12


def _d12_ctes(rounds, most=PAIRS_N):
    """The sequential rule as a fixed point: the kept set of each round is computed from the one before."""
    out = {"pr": "select a.lang as family, a.id as ord, a.skey as h1, b.skey as h2 from states a join states b on b.id=a.id+1 where a.id%2=0", "k0": "select * from pr where false"}
    for i in range(1, rounds + 1):
        out[f"f{i}"] = f"select h, min(ord) as m from (select unnest([h1,h2]) as h, ord from k{i - 1}) group by h"
        out[f"k{i}"] = (f"select family,ord,h1,h2 from (select pr.*, row_number() over (partition by family order by ord) as rn from pr left join f{i} x on x.h=h1 left join f{i} y on y.h=h2 "
                        f"where not coalesce(least(x.m,y.m)<ord,false)) where rn<={most}")
    return out


@query("D12_unique_pairs_by_family", sql("select family, ord from k6", "states", **_d12_ctes(6)))
def _(t):
    return D.unique_pairs_by_family(state_pairs(t), PAIRS_N).select("family", "ord")


def state_pairs(t):
    s = t.states().select("id", "skey", "lang")
    b = s.select((F.col("id") - 1).alias("id"), F.col("skey").alias("h2"))
    return s.filter(F.col("id") % 2 == 0).join(b, "id").select(F.col("lang").alias("family"), F.col("id").alias("ord"), F.col("skey").alias("h1"), "h2")


@query("D12_unique_pairs_without_limit", sql("select family, ord from k8", "states", **_d12_ctes(8, 10**12)))
def _(t):
    return D.unique_pairs_by_family(state_pairs(t)).select("family", "ord")

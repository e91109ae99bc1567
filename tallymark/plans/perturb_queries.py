"""A and R queries: perturbed records and rule labels."""
import math

from pyspark.sql import functions as F

from ..functions.text import h32
from ..operators import perturb as A
from ..operators import rules as RU
from ..session import settle
from ..sources.fixtures import TIERS, lit_array
from .oracle import cat, h, sql
from .registry import query

U = lambda *p: f"({h(*p)}/4294967296e0)"


def perm_sql(list_expr, *salt):
    """Elements of a list of keys in the order of their salted digests."""
    return f"list_transform(list_sort(list_transform({list_expr}, lambda k: sha256({cat(*salt, 'k')})||k)), lambda s: s[65:])"


def option_questions(t, soft=False):
    """The three order questions with option structs; the first option of a choice is described."""
    q = t.questions()
    opts = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.when(i == 0, "first pick").cast("string").alias("desc")))
    target = F.when(h32("softq", F.col("id")) % 5 == 0, F.map_from_arrays("keys", F.transform("keys", lambda k: F.lit(1.0)))) if soft else F.lit(None).cast("map<string,double>")
    return q.select("id", "group_id", "source", F.col("task").alias("qid"), "type", opts.alias("options"), F.element_at("keys", F.col("label") + 1).alias("label_key"), target.alias("target"),
                    F.when(F.col("task") == "urgent", "Is this urgent?").otherwise("Which?").alias("instructions"))


joined = lambda opts: F.array_join(A.keys_of(opts), ",")


@query("A1_render_states", sql(r"""select conv_id, count(*) as parts, sha256(string_agg('- role: '||role||e'\n  text: '||coalesce(text,''), e'\n' order by turn)) as state_sha from conversations group by conv_id"""))
def _(t):
    out = A.render_states(t.conversations, "conv_id", "turn", ["role", "text"])
    return out.select("conv_id", "parts", F.sha2("state", 256).alias("state_sha"))


@query("A1_render_object", sql(r"""select o_orderkey as id, 'status: '||o_orderstatus||e'\npriority: '||o_orderpriority||e'\nnote: '||case when o_orderkey%3=0 then '' else 'n'||o_orderkey end as state from orders"""))
def _(t):
    note = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("n"), F.col("o_orderkey").cast("string")))
    return t.orders.select(F.col("o_orderkey").alias("id"), A.render_object({"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "note": note}).alias("state"))


@query("A1_render_nested", sql(r"""select conv_id, sha256('conversation: '||conv_id||e'\nopen: '||case when conv_id%2=0 then 'True' else 'False' end||e'\nturns:\n'||
 string_agg(e'  - place:\n      - '||turn||e'\n      - \n    said:\n      role: '||role||e'\n      text: '||coalesce(text,''), e'\n' order by turn)) as state_sha from conversations group by conv_id"""))
def _(t):
    turn = F.struct("turn", F.to_json(F.struct(F.array(F.col("turn").cast("bigint"), F.lit(None).cast("bigint")).alias("place"), F.struct("role", "text").alias("said")), {"ignoreNullFields": "false"}).alias("json"))
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    state = F.concat(F.lit('{"conversation": '), F.col("conv_id").cast("string"), F.lit(', "open":'), (F.col("conv_id") % 2 == 0).cast("string"), F.lit(', "turns": ['), F.array_join(F.transform("turns", lambda x: x["json"]), " , "), F.lit("]}"))
    return c.select("conv_id", F.sha2(A.render_json(state), 256).alias("state_sha"))


LONG = "strftime({d}, '%B %-d, %Y')"


def dated_text(t):
    c = t.cases()
    iso = F.date_format("ship_date", "yyyy-MM-dd")
    long = F.date_format("order_date", "MMMM d, yyyy")
    text = F.concat(F.lit("Ordered on "), long, F.lit(". Shipped "), iso, F.lit(", billed "), iso, F.lit("; ignore February 31, 2020 and 2020-13-01."))
    return c.select("case_id", "order_date", "ship_date", text.alias("text"))


DF = """case when days=0 then s||' is the same day as '||o||'.' else s||' is '||abs(days)||case when abs(days)=1 then ' day ' else ' days ' end||case when days>0 then 'after ' else 'before ' end||o||'.' end"""
DATED = "select case_id, days, strftime(order_date,'%B %-d, %Y') as o, strftime(ship_date,'%Y-%m-%d') as s from cases"


@query("A2_date_facts", sql(f"select case_id, {DF} as facts from d", "cases", d=DATED))
def _(t):
    return dated_text(t).select("case_id", A.date_facts("text").alias("facts"))


@query("A3_relational_day_count", sql("""select case_id, 'The '||case when days>=0 then 'delivery' else 'purchase' end||' date was '||abs(days)||case when abs(days)=1 then ' day' else ' days' end||' after the '||case when days>=0 then 'purchase' else 'delivery' end||' date.' as sentence from cases""", "cases"))
def _(t):
    return t.cases().select("case_id", A.relational_day_count({"purchase": F.col("order_date"), "delivered": F.col("ship_date")}).alias("sentence"))


def _free_sql(pairs, *salt):
    rows = ",".join(f"('{k}',{'null' if d is None else chr(39) + d + chr(39)})" for k, d in pairs)
    return f"(select first(k order by sha256({cat(*salt, 'k', chr(39) * 2 + '||coalesce(d,' + chr(39) * 2 + ')')})) from (values {rows}) o(k,d))"


NONE_ROWS = ",".join(f"('{k}','{d or ''}')" for k, d in A.NONE_OPTIONS)
DIST_ROWS = ",".join(f"('{k}','{d or ''}')" for k, d in A.DISTRACTORS)
AUG = f"""select id, qid, keys, keys[label+1] as lk, {U("'aug'", "'band'", 'id::varchar', 'qid')} as r, type='choice' and not soft as plain, type,
 (select arg_min(k, sha256('aug:none:'||id||':'||qid||':'||k||':'||d)) from (values {NONE_ROWS}) o(k,d)) as nk, (select arg_min(k, sha256('aug:extra:'||id||':'||qid||':'||k||':'||d)) from (values {DIST_ROWS}) o(k,d)) as dk
 from (select *, task as qid, {h("'softq'", 'id::varchar')}%5=0 as soft from questions)"""


@query("A4_augment_options", sql(f"""select id, qid, action, case when action='swap' then nk else lk end as label_key, array_to_string(case when type='choice' then {perm_sql('ks', "'aug'", "'order'", 'id::varchar', 'qid')} else ks end, ',') as keys from (
 select *, case action when 'swap' then list_filter(keys, lambda k: k<>lk)||[nk] when 'none' then keys||[nk] when 'distract' then keys||[dk] else keys end as ks from (
 select *, case when plain and len(keys)>2 and r<0.1e0 then 'swap' when plain and r>=0.1e0 and r<0.22e0 then 'none' when plain and r>=0.22e0 and r<0.37e0 then 'distract' else 'keep' end as action from a))""", "questions", a=AUG))
def _(t):
    d = A.augment_options(option_questions(t, soft=True), "aug")
    return d.select("id", "qid", "action", "label_key", joined(F.col("options")).alias("keys"))


NP = f"select *, {perm_sql(f'keys||[{chr(39)}none_of_these{chr(39)}]', chr(39) + 'np' + chr(39), 'id::varchar', 'task')} as ks, keys[label+1] as lk from questions where type='choice'"


VARIED = f"""select *, {perm_sql("keys||[nk]", "'np'", "id::varchar", "task")} as ks, keys[label+1] as lk from (
 select *, (select arg_min(k, sha256('np:none:'||id||':'||task||':'||k||':'||d)) from (values {NONE_ROWS}) o(k,d)) as nk from questions where type='choice')"""


@query("A5_none_pair", sql("""select id, side, case when side='absent' then nk else lk end as label_key, array_to_string(case when side='absent' then list_filter(ks, lambda k: k<>lk) else ks end, ',') as keys
 from n cross join (values ('present'),('absent')) v(side)""", "questions", n=VARIED))
def _(t):
    return A.none_pair(option_questions(t), "np").select("id", "side", "label_key", joined(F.col("options")).alias("keys"))


@query("A6_contrast_variants", sql(f"""select n.id||'/'||v as id, n.id::varchar as parent_id, v as variant, case when v='none_absent' then 'none_of_these' else lk end as label_key,
 array_to_string(case v when 'none_absent' then list_filter(ks, lambda k: k<>lk) when 'none_present' then ks else {perm_sql('keys', "'np'", 'n.id::varchar', 'task')} end, ',') as keys
 from (select *, row_number() over (partition by id%2, source order by id) as rn from n) n cross join (values ('none_present'),('none_absent'),('permuted')) v(v) where rn<=12""", "questions", n=NP))
def _(t):
    d = option_questions(t).withColumn("split", F.when(F.col("id") % 2 == 0, "development").otherwise("test"))
    return A.contrast_variants(d, "np").select("id", "parent_id", "variant", "label_key", joined(F.col("options")).alias("keys"))


@query("A7_rotations", sql("select id, task as qid, r::bigint as rotation, array_to_string(keys[r+1:]||keys[1:r], ',') as keys from questions cross join (values (0),(1)) v(r) where r=0 or type='choice'", "questions"))
def _(t):
    d = A.rotations(option_questions(t), 2)
    return d.select("id", "qid", F.col("rotation").cast("bigint").alias("rotation"), joined(F.col("options")).alias("keys"))


@query("A8_option_permutations", sql(f"select id, o::bigint as order_no, array_to_string(case when o=0 then keys else {perm_sql('keys', chr(39) + 'op' + chr(39), 'id::varchar', 'task', 'o::varchar')} end, ',') as keys from questions cross join range(4) v(o) where type='choice'", "questions"))
def _(t):
    d = A.option_permutations(option_questions(t), 4, "op")
    return d.select("id", F.col("order_no").cast("bigint").alias("order_no"), joined(F.col("options")).alias("keys"))


BURY_SRC = ("src0", "src1", "src2", "src3")


@query("A9_bury_state", sql(f"""select 'buried/'||id as id, id as parent_id, source as parent_source, slot+1 as primary_record, sha256(array_to_string(list_concat(list_concat(b[:slot],[state]),b[slot+1:]),'|')) as records_sha from (
 select m.*, {h("'bury'", "'slot'", 'm.id::varchar')}%4 as slot, [(select state from p x where x.source=m.source and x.rn=(m.rn-1+1)%m.pool+1),(select state from p x where x.source=m.source and x.rn=(m.rn-1+2)%m.pool+1),
 (select state from p x where x.source=m.source and x.rn=(m.rn-1+3)%m.pool+1)] as b from p m where m.rn<={math.ceil(22 / 4)} and pool>=4) order by parent_source, sha256('bury:'||parent_id) limit 22""", "states",
                                 p="select *, row_number() over (partition by source order by sha256('bury:'||id)) as rn, count(*) over (partition by source) as pool from states where source in ('src0','src1','src2','src3')"))
def _(t):
    b = A.bury_state(t.states(), 22, "bury", BURY_SRC)
    return b.select("id", "parent_id", "parent_source", F.col("primary_record").cast("bigint").alias("primary_record"), F.sha2(F.array_join("records", "|"), 256).alias("records_sha"))


def case_label(family, tiers=TIERS):
    """Label of a case from its facts; the measure is null when a needed fact is."""
    def fn(facts):
        days = F.datediff(facts["ship_date"], facts["order_date"]).cast("bigint")
        return RU.tier_expr(tiers, family, F.when(family == "quantity_limit", facts["quantity"]).otherwise(days))
    return fn


EVIDENCE = ["quantity", "order_date", "ship_date"]
LAB = "select c.*, t.label from cases c join tiers t on t.family=c.family and c.measure>=t.lo and c.measure<t.hi"


@query("A10_ablate_evidence", sql("""select 'unknowable/'||case_id as id, 'unknowable_control/'||case_id as control_id, case when family='quantity_limit' then 'quantity' else 'order_date' end as dropped, label as intact_label,
 family='quantity_limit' as quantity_gone, 0.5e0 as target_first from l
 union all select 'unknowable_control/'||case_id, null, case when family='quantity_limit' then 'quantity' else 'order_date' end, label, false, null from l""", "cases", "tiers", l=LAB))
def _(t):
    out = A.ablate_evidence(t.cases(), EVIDENCE, case_label(F.col("family")), uniform_target=2)
    return out.select("id", "control_id", "dropped", "intact_label", F.col("quantity").isNull().alias("quantity_gone"), F.get("target", F.lit(0)).alias("target_first"))


@query("A11_assertion_rewrites", sql(f"""select id, qid, answer, statement from (
 select id, task as qid, case when type='choice' then (k=lk)::varchar else lk end as answer, case when type='noul' then 'This is urgent.' else replace((['This text is about %s.','The right category for this is %s.','This should be filed under %s.','The topic here is %s.'])[{h("'as'", "'tpl'", 'id::varchar', 'task')}%4+1],'%s',case when k=keys[1] then 'first pick' else k end) end as statement
 from (select *, case when {U("'as'", "'truth'", 'id::varchar', 'task')}<0.5e0 then lk else {perm_sql('list_filter(keys, lambda k: k<>lk)', "'as'", "'wrong'", 'id::varchar', 'task')}[1] end as k from (select *, keys[label+1] as lk from questions where type<>'score')))
 order by sha256('as:take:'||id||':'||qid) limit 500""", "questions"))
def _(t):
    d = A.assertion_rewrites(option_questions(t), 500, "as", {"Is this urgent?": "This is urgent."})
    return d.select("id", "qid", "answer", "statement")


@query("A12_wrap_states", sql(f"""select id, case when r<0.15e0 then 'document' when r<0.25e0 then 'ticket' when r<0.32e0 then 'messages' else 'text' end as wrapping, case when r>=0.32e0 then sha256(state) end as text_sha
 from (select *, {U("'wr'", "'wrap'", 'id::varchar')} as r from states)""", "states"))
def _(t):
    d = A.wrap_states(t.states(), "wr")
    return d.select("id", "wrapping", F.when(F.col("wrapping") == "text", F.sha2("state", 256)).alias("text_sha"))


@query("A12_vary_descriptions", sql(f"""select id, task as qid, array_to_string(list_transform(keys, lambda k: case when u(k)<0.3e0 then '-' when u(k)<0.4e0 then '{{"what":"d '||k||'"}}' else 'd '||k end), '|') as descs from questions""".replace(
    "u(k)", U("'wr'", "'desc'", "id::varchar", "k")), "questions"))
def _(t):
    q = t.questions().withColumn("options", F.transform("keys", lambda k: F.struct(k.alias("key"), F.concat(F.lit("d "), k).alias("desc"))))
    v = A.vary_descriptions(F.col("options"), "wr", F.col("id").cast("string"))
    return q.select("id", F.col("task").alias("qid"), F.array_join(F.transform(v, lambda o: F.coalesce(o["desc"], F.lit("-"))), "|").alias("descs"))


@query("A12_vary_instructions", sql(f"""select id, task as qid, case when {U("'wr'", "'instr'", 'id::varchar', 'task')} < 0.15e0 then '{{"question":"Judge '||task||'.","focus":"'||
  list_extract(['Use only the information given.', 'Pick the single best fit.', 'Consider the whole message.'], ({h("'wr'", "'focus'", 'id::varchar', 'task')} % 3 + 1)::int)||'"}}' else 'Judge '||task||'.' end as instruction from questions""", "questions"))
def _(t):
    q = t.questions().select("id", F.col("task").alias("qid"), F.concat(F.lit("Judge "), F.col("task"), F.lit(".")).alias("instruction"))
    return q.withColumn("instruction", A.vary_instructions("instruction", "wr", F.col("id").cast("string"), F.col("qid")))


@query("A13_reshape_mcq", sql(f"select id, 'opt_'||list_position(ks, keys[label+1]) as label_key, array_to_string(list_transform(ks, lambda k: 'text '||k), ',') as texts from (select *, {perm_sql('keys', chr(39) + 'mcq' + chr(39), 'id::varchar')} as ks from questions where type='choice')", "questions"))
def _(t):
    q = t.questions().filter(F.col("type") == "choice")
    d = A.reshape_mcq(q.select("id", F.col("keys").alias("labels"), F.transform("keys", lambda k: F.concat(F.lit("text "), k)).alias("texts"), F.element_at("keys", F.col("label") + 1).alias("answer")), "mcq")
    return d.select("id", "label_key", F.array_join(F.transform("options", lambda o: o["desc"]), ",").alias("texts"))


@query("A14_escape_control_tokens", sql(r"""select doc_id as id, sha256(regexp_replace('<|'||source||'|> '||text||' <|end of text|>', '<\|([A-Za-z0-9_]+)\|>', '<¦\1¦>', 'g')) as sha from documents"""))
def _(t):
    c = F.concat(F.lit("<|"), F.col("source"), F.lit("|> "), F.col("text"), F.lit(" <|end of text|>"))
    return t.documents.select(F.col("doc_id").alias("id"), F.sha2(A.escape_control_tokens(c), 256).alias("sha"))


# ---- rules ---------------------------------------------------------------------------------------------------------
def tier_table(t):
    return t.spark.createDataFrame(TIERS, "family string, lo bigint, hi bigint, label string")


@query("R1_tier_label", sql("select case_id, family, label from l", "cases", "tiers", l=LAB))
def _(t):
    return RU.tier_label(t.cases(), tier_table(t)).select("case_id", "family", "label")


# every family from its own wording, limits picked by digest
PC = f"""select case_id, days, quantity, cents, {h(repr('policy'), 'case_id')}%11 as fam, {h(repr('limits'), 'case_id')} as l, {h(repr('gone'), 'case_id')}%9=0 as gone, {h(repr('signer'), 'case_id')}%3 as signer, {h(repr('approver'), 'case_id')}%3 as approver from cases"""
PICK = lambda n, *options: f"([{','.join(map(str, options))}])[l%{n}+1]"


def three_levels(measure, low, high, closed=True):
    op = "<=" if closed else "<"
    return f"case when {measure}{op}{low} then '0' when {measure}{op}{high} then '1' else '2' end"


@query("R1_policy_families", sql(f"""select case_id, (['return_window','spend_threshold','authorization','age_eligibility','quantity_limit','deadline','warranty_claim','sla_response','late_fee','volume_discount','shipping_delay'])[fam+1] as family,
 case when gone then 'UNDETERMINED' when fam=0 then (days<={PICK(4, 14, 30, 45, 60)})::varchar when fam=1 then case when cents%5000<={PICK(4, 250, 500, 1000, 2500)} then 'auto_approved' else 'director_signoff' end when fam=2 then (signer=approver)::varchar
 when fam=3 then (quantity>={PICK(4, 16, 18, 21, 25)})::varchar when fam=4 then case when quantity<={PICK(4, 2, 3, 5, 10)} then 'within_limit' when quantity<=2*{PICK(4, 2, 3, 5, 10)} then 'slightly_over' else 'far_over' end
 when fam=5 then {three_levels('(days//4-8)', 0, PICK(3, 3, 7, 14))} when fam=6 then {three_levels('days*9', PICK(3, 90, 180, 365), PICK(3, 365, 730, 1095))} when fam=7 then {three_levels('days', PICK(4, 4, 8, 24, 1), PICK(4, 24, 48, 72, 8))}
 when fam=8 then {three_levels('(days-10)', PICK(3, 5, 10, 15), PICK(3, 30, 60, 45))} when fam=9 then {three_levels('(cents%700)', PICK(4, 10, 25, 5, 100), PICK(4, 50, 100, 20, 500), False)}
 else {three_levels('(days//8-3)', PICK(3, 1, 2, 3), PICK(3, 4, 7, 10))} end as label from pc""", "cases", pc=PC))
def _(t):
    return RU.policy_label(t.policy_cases(), t.policies()).select("case_id", "family", "label")


@query("R2_undetermined_on_missing", sql(f"select case_id, case when {h(repr('mf'), 'case_id')}%5=0 then 'UNDETERMINED' else label end as label from l", "cases", "tiers", l=LAB))
def _(t):
    c = t.cases().withColumn("measure", F.when(h32("mf", F.col("case_id")) % 5 != 0, F.col("measure")))
    return c.select("case_id", RU.undetermined_on_missing(RU.tier_expr(TIERS, F.col("family"), F.col("measure")), F.col("measure")).alias("label"))


SHIFTS = (-400, -30, -5, 5, 30, 400)


def case_edits():
    out = [(f"ship{d}", {"ship_date": F.date_add("ship_date", d), "order_date": F.col("order_date"), "quantity": F.col("quantity")}) for d in SHIFTS]
    return out + [(f"qty{d}", {"ship_date": F.col("ship_date"), "order_date": F.col("order_date"), "quantity": F.col("quantity") + d}) for d in (-20, 20)]


EDITED = """select c.case_id, c.family, e.edit, tl.label as la, te.label as lb, sha256('pairs:'||c.case_id||':'||e.edit) as o from cases c
 cross join (values ('ship-400',-400,0),('ship-30',-30,0),('ship-5',-5,0),('ship5',5,0),('ship30',30,0),('ship400',400,0),('qty-20',0,-20),('qty20',0,20)) e(edit,dd,dq)
 join tiers tl on tl.family=c.family and c.measure>=tl.lo and c.measure<tl.hi
 join tiers te on te.family=c.family and c.measure+(case when c.family='quantity_limit' then dq else dd end)>=te.lo and c.measure+(case when c.family='quantity_limit' then dq else dd end)<te.hi"""


@query("R3_counterfactual_pairs", sql("""select family||'/'||case_id as pair_id, edit, la as label_a, lb as label_b from (select *, row_number() over (partition by family order by sha256('pairs:take:'||case_id)) as rn from (
 select case_id, family, arg_min(edit,o) as edit, first(la) as la, arg_min(lb,o) as lb from e where la<>lb group by case_id, family)) where rn<=200""", "cases", "tiers", e=EDITED))
def _(t):
    pairs, _report = RU.counterfactual_pairs(t.cases(), case_edits(), case_label(F.col("family")), 200)
    return pairs.select("pair_id", "edit", "label_a", "label_b")


@query("R3_rejection_reasons", sql("select family, reason, count(*) as n from (select family, case_id, case when max((la<>lb)::int)=1 then null else 'labels_equal' end as reason from e group by family, case_id) group by family, reason", "cases", "tiers", e=EDITED))
def _(t):
    return RU.counterfactual_pairs(t.cases(), case_edits(), case_label(F.col("family")), 200)[1]


def pair_rows(t):
    """Sibling rows with sentences, evidence flags and drop-one labels; some are damaged by digest."""
    pairs, _report = RU.counterfactual_pairs(t.cases(), case_edits(), case_label(F.col("family")), None)
    s = RU.siblings(pairs).withColumn("x", h32("defect", F.col("pair_id")) % 12)
    x, b = F.col("x"), F.col("sibling") == "b"
    qty = F.col("family") == "quantity_limit"
    m1, m2, m3 = F.concat(F.lit("Quantity "), F.col("quantity").cast("string"), F.when(b & qty, F.concat(F.lit(" then "), F.col("edit"))).otherwise("")), \
        F.concat(F.lit("Ordered "), F.col("order_date").cast("string")), F.concat(F.lit("Shipped "), F.col("ship_date").cast("string"), F.when(b & ~qty, F.concat(F.lit(" moved "), F.col("edit"))).otherwise(""))
    sent = F.array(m1, m2, F.when((x == 1) & b & qty, F.concat(m3, F.lit("!"))).when((x == 1) & b, m3).otherwise(m3), F.when((x == 1) & b, F.lit("filler?")).otherwise(F.lit("filler")))
    ev = F.array(qty & (x != 2), ~qty & (x != 2), ~qty & (x != 2), F.lit(False))
    lab = F.col("label")
    und = F.lit(RU.UNDETERMINED)
    drop = F.array(F.when(qty & (x != 2) & (x != 3), und).otherwise(lab), F.when(~qty & (x != 2) & (x != 3), und).otherwise(lab), F.when(~qty & (x != 2), und).otherwise(lab),
                   F.when(x == 4, F.lit("other")).otherwise(lab))
    s = s.withColumn("label", F.when((x == 0) & b, F.col("label_a")).when((x == 5) & b, und).otherwise(lab))
    return s.withColumn("sentences", sent).withColumn("evidence", ev).withColumn("ablated", drop)


@query("R4_audit_pairs", sql(f"""select pair_id, case x when 5 then 'label_undetermined' when 0 then 'labels_equal' when 1 then 'not_exactly_one_sentence_differs' when 2 then 'no_evidence_sentence' when 3 then 'ablation_failed' when 4 then 'invariance_failed' end as reason
 from (select pair_id, {h(repr('defect'), 'pair_id')}%12 as x from (select distinct family||'/'||case_id as pair_id from e where la<>lb))""", "cases", "tiers", e=EDITED))
def _(t):
    rows = pair_rows(t)
    # damaged rows keep their drop-one labels, so the reason is decided by the first failing check
    return RU.audit_pairs(rows.withColumn("ablated", F.when(F.col("x").isin(0, 5), F.transform("ablated", lambda v: F.when(v == RU.UNDETERMINED, v).otherwise(F.col("label")))).otherwise(F.col("ablated"))))


RULE = ["or", ["if", 0, ["not", 1], 2], ["unless", 3, ["and", 0, 4]]]
ATOMS = [{"kind": "gt", "fields": ["quantity"], "threshold": 25}, {"kind": "elapsed", "fields": ["order_date", "ship_date"], "threshold": 30}, {"kind": "range", "fields": ["cents_k"], "threshold": 20},
         {"kind": "match", "fields": ["signer", "approver"]}, {"kind": "flag", "fields": ["returned"]}]
FACTS = ["quantity", "order_date", "ship_date", "cents_k", "signer", "approver", "returned"]


def rule_cases(t):
    """Cases with every fact missing for one row in nine (an independent digest per fact)."""
    c = t.cases().withColumn("cents_k", F.floor(F.col("cents") / 100000)).withColumn("signer", (F.col("party") % 5).cast("bigint")).withColumn("approver", (F.col("order_id") % 5).cast("bigint")) \
        .withColumn("returned", F.col("flag") == "R").withColumn("route", (F.col("cents") % 900 + 100).cast("bigint"))
    for f in FACTS:
        c = c.withColumn(f, F.when(h32("gap", F.lit(f), F.col("case_id")) % 9 != 0, F.col(f)))
    return c


GAP = lambda f, e: f"case when {h(repr('gap'), repr(f), 'case_id')}%9<>0 then {e} end as {f}"
RC = f"""select case_id, {GAP('quantity', 'quantity')}, {GAP('order_date', 'order_date')}, {GAP('ship_date', 'ship_date')}, {GAP('cents_k', 'cents//100000')}, {GAP('signer', 'party%5')}, {GAP('approver', 'order_id%5')}, {GAP('returned', "flag='R'")}, cents%900+100 as route from cases"""
AT = "select *, quantity>25 as a0, datediff('day',order_date,ship_date)<=30 as a1, cents_k between 20 and 30 as a2, signer=approver as a3, returned as a4 from rc"
EV = "select *, (case when a0 then not a1 when not a0 then a2 when (not a1)=a2 then a2 end) or (a3 and not (a0 and a4)) as verdict from at_"


@query("R5_eval_rule", sql("select case_id, verdict from ev", "cases", rc=RC, at_=AT, ev=EV))
def _(t):
    c = rule_cases(t)
    return c.select("case_id", RU.eval_rule(RULE, ATOMS, {f: F.col(f) for f in FACTS}).alias("verdict"))


def rule_table(t):
    """Rule trees as JSON, put together from the digits of each order."""
    n = F.col("o_orderkey")
    leaf = lambda k: (h32("leaf", F.lit(k), n) % 3).cast("string")
    low = lambda k: F.when(h32("low", F.lit(k), n) % 4 == 0, F.concat(F.lit('["not",'), leaf(k), F.lit("]"))).when(h32("low", F.lit(k), n) % 4 == 1, F.concat(F.lit('["and",'), leaf(k + 4), F.lit(","), leaf(k + 8), F.lit("]"))).otherwise(leaf(k))
    op = F.element_at(lit_array(("and", "or", "unless", "if", "not")), (h32("op", n) % 5 + 1).cast("int"))
    tree = F.when(op == "not", F.concat(F.lit('["not",'), low(0), F.lit("]"))).when(op == "if", F.concat(F.lit('["if",'), low(0), F.lit(","), low(1), F.lit(","), low(2), F.lit("]"))) \
        .otherwise(F.concat(F.lit('["'), op, F.lit('",'), low(0), F.lit(","), low(1), F.lit("]")))
    return t.orders.select(n.alias("ord"), tree.alias("tree"))


@query("R6_canonical_rules")
def _(t):
    held = t.spark.createDataFrame([('["and",["or",0,1],2]',), ('["if",0,["not",1],2]',)], "tree string")
    return RU.canonical_rules(rule_table(t), held).select("ord", "tree")


EDIT_DOMAINS = {"quantity": [10, 40], "cents_k": [5, 25, 60], "signer": [0, 1, 2, 3, 4]}
VERDICT = "((case when ({q})>25 then not a1 when not (({q})>25) then ({c}) between 20 and 30 when (not a1)=(({c}) between 20 and 30) then not a1 end) or ((({s})=approver) and not ((({q})>25) and a4)))"
V_ = lambda q="quantity", c="cents_k", s="signer": VERDICT.format(q=q, c=c, s=s)
CANDS = " union all ".join(
    f"select case_id, '{f}' as field, '{v}' as value, verdict, {V_(**{k: str(v)})} as got, {V_(**{k: 'null::bigint'})} is null as unk from ev where verdict is not null"
    for f, k in (("quantity", "q"), ("cents_k", "c"), ("signer", "s")) for v in EDIT_DOMAINS[f])


@query("R7_decisive_edits", sql("""select case_id as group_id, pair_kind, sibling, field as deciding_field, case when pair_kind='relevant' and sibling='b' then got else verdict end as label from (
 select case_id, arg_min(field,o) as field, first(verdict) as verdict, arg_min(got,o) as got from (select *, sha256('edits:'||case_id||':'||field||':'||value) as o from cand where got<>verdict and unk) group by case_id)
 cross join (values ('relevant','a'),('relevant','b'),('irrelevant','a'),('irrelevant','b')) v(pair_kind,sibling)""", "cases", rc=RC, at_=AT, ev=EV, cand=CANDS))
def _(t):
    d = RU.decisive_edits(rule_cases(t), RULE, ATOMS, FACTS, EDIT_DOMAINS, ("route", (111, 222)))
    return d.select("group_id", "pair_kind", "sibling", "deciding_field", "label")


@query("R8_audit_rule_groups", sql(f"""select group_id, unnest(case x when 0 then ['answer'] when 1 then ['text'] when 2 then ['policy'] when 3 then ['size'] when 4 then ['label','answer','intervention'] end) as code from (
 select distinct case_id as group_id, {h(repr('rg'), 'case_id')}%10 as x from cand where got<>verdict and unk) where x<=4""", "cases", rc=RC, at_=AT, ev=EV, cand=CANDS))
def _(t):
    d = settle(RU.decisive_edits(rule_cases(t), RULE, ATOMS, FACTS, EDIT_DOMAINS, ("route", (111, 222))))
    shown = {**{f: F.col(f) for f in FACTS}, "route": F.col("route")}
    x = h32("rg", F.col("group_id")) % 10
    last = (F.col("pair_kind") == "irrelevant") & (F.col("sibling") == "b")
    d = d.withColumn("x", x).withColumn("answer", F.when(F.col("label"), "accept").otherwise("reject")).withColumn("text", RU.rendered_facts(shown)).withColumn("policy", F.lit("p"))
    d = d.withColumn("answer", F.when((F.col("x") == 0) & last, "none").otherwise(F.col("answer"))).withColumn("text", F.when((F.col("x") == 1) & last, "?").otherwise(F.col("text")))
    d = d.withColumn("policy", F.when((F.col("x") == 2) & last, "q").otherwise(F.col("policy"))).withColumn("label", F.when((F.col("x") == 4) & last, ~F.col("label")).otherwise(F.col("label")))
    extra = d.filter((F.col("x") == 3) & last)
    return RU.audit_rule_groups(d.unionByName(extra), RULE, ATOMS, FACTS, "route")


@query("R9_strata_report", sql("""select case when s=a then 'match_true' when r in (s,a) then 'mismatch_decoy_role' else 'mismatch_clean' end||'/'||case when order_id%3=0 then 'daycount' else 'plain' end as stratum, label, count(*) as n
 from (select *, party%5 as s, order_id%5 as a, quantity%5 as r from l) group by 1,2""", "cases", "tiers", l=LAB))
def _(t):
    c = RU.tier_label(t.cases(), tier_table(t))
    c = c.withColumn("signer", F.col("party") % 5).withColumn("approver", F.col("order_id") % 5).withColumn("reviewer", F.col("quantity") % 5).withColumn("day_count_stated", F.col("order_id") % 3 == 0)
    return RU.strata_report(c)

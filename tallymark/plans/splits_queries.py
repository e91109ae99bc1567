"""P queries: splits, samples, folds and partition audits."""
from pyspark.sql import functions as F

from ..functions.text import h32, sha, word_count
from ..operators import splits as P
from ..session import settle
from .curation_queries import FITS, SPLIT_SQL, split_of
from .oracle import h, sql
from .registry import query

STATE_RANK = "select skey, row_number() over (order by sha256('{seed}:'||skey)) as rn, count(*) over () as n from (select distinct skey from {src})"


@query("P1_split_by_state", sql("select s.id, case when rn<=round_even(n*0.15e0,0) then 'development' when rn<=round_even(n*0.15e0,0)+round_even(n*0.2e0,0) then 'calibration' else 'train' end as split from states s join k using(skey)",
                                "states", k=STATE_RANK.format(seed="seed7", src="states")))
def _(t):
    return P.split_by_state(t.states(), 0.2, 0.15, "seed7").select("id", "split")


@query("P1_empty_partitions", sql("select 'locked' as split"))
def _(t):
    return P.empty_partitions(P.split_by_state(t.states(), 0.2, 0.15, "seed7"), ("train", "calibration", "development", "locked"))


@query("P2_split_with_holdout", sql("""select r.id, case when rn<=round_even(n*0.5e0,0) then 'development' else 'calibration' end as split from real r join k using(skey)
 union all select id, 'train' from states where id%3<>0 and skey not in (select skey from real)""", "states", real="select * from states where id%3=0", k=STATE_RANK.format(seed="ho", src="real")))
def _(t):
    s = t.states()
    return P.split_with_holdout(s.filter(F.col("id") % 3 != 0), s.filter(F.col("id") % 3 == 0), "ho").select("id", "split")


@query("P3_carve_partitions", sql("""select id, source, case when rn<=8 then 'development' when rn<=14 then 'test' when rn<=20 then 'calibration' else 'train' end as split from (
 select *, row_number() over (partition by source order by sha256('row:'||id)) as rn from states) where rn<=14 or source not in ('src2','src5')""", "states"))
def _(t):
    d = t.states().withColumn("row_sha", sha("row", F.col("id")))
    return P.carve_partitions(d, dict(development=8, test=6, calibration=6), holdout=("src2", "src5")).select("id", "source", "split")


def grouped(t):
    """Documents in groups of four neighbours; the language is the family."""
    return t.states().withColumn("group_id", F.floor(F.col("id") / 4)).withColumn("family", F.col("lang")).withColumn("position", F.col("id"))


GR = "select *, id//4 as group_id, lang as family from states"


@query("P4_calibration_groups_per_family", sql("""select g.id, case when c.group_id is not null then 'calibration' else 'train' end as split from g left join (
 select family, group_id from (select family, group_id, row_number() over (partition by family order by min(id), group_id) as rn from g group by family, group_id) where rn<=10) c using(family, group_id)""", "states", g=GR))
def _(t):
    return P.calibration_groups_per_family(grouped(t), 10)[0].select("id", "split")


@query("P5_alternate_pairs", sql("""select pairs.id, task, case when rn%2=1 then 'development' else 'test' end as split from pairs join questions q on q.id=pairs.id join (
 select pair_id, row_number() over (partition by c order by sha256(pair_id)) as rn from (select distinct pair_id, o_orderpriority as c from pairs join orders on id=o_orderkey where sibling='a')) using(pair_id)""", "pairs", "questions"))
def _(t):
    p = t.paired("A").select("id", "task", "pair_id", "sibling", "source")
    first = p.filter(F.col("sibling") == "a").select("pair_id", F.col("source").alias("family"), sha(F.col("pair_id")).alias("o")).distinct()
    return P.alternate_pairs(p.join(first, "pair_id"), ["family"], ["o"], F.substring("o", 1, 3)).select("id", "task", "split")


CLEANG = "select * from (select *, min(family) over (partition by group_id) as f1, max(family) over (partition by group_id) as f2 from g)"


@query("P6_sample_groups_by_family", sql("""select id, group_id from g where group_id in (select group_id from (select group_id, row_number() over (partition by family order by sha256('scr:train:'||family||':'||group_id)) as rn
 from (select group_id, min(family) as family from g group by group_id)) where rn<=15)""", "states", g=GR))
def _(t):
    d = grouped(t).withColumn("split", F.lit("train"))
    return P.sample_groups_by_family(d, "train", 15, "scr")[0].select("id", "group_id")


@query("P6_sampling_problems", sql("""select group_id::varchar as subject, 'straddles_families' as problem from g group by group_id having min(family)<>max(family)
 union all select family, 'underfilled' from (select group_id, min(family) as family from g group by group_id) group by family having count(*)<45""", "states", g=GR))
def _(t):
    return P.sample_groups_by_family(grouped(t).withColumn("split", F.lit("train")), "train", 45, "scr")[1]


@query("P7_sample_replay_groups", sql("""select id, source from u where (source, gid) in (select (source, gid) from (select source, gid, row_number() over (partition by source order by sha256('rep:'||source||':'||gid)) as rn
 from u group by source, gid having bool_and(fits)) where rn<=5)""", "states", u=f"select *, id//2 as gid, {FITS} as fits from states"))
def _(t):
    d = t.states().withColumn("group_id", F.floor(F.col("id") / 2)).withColumn("fits", word_count("state") <= 1000)
    return P.sample_replay_groups(d, 5, "rep")[0].select("id", "source")


@query("P8_first_groups_per_source", sql(f"""select id, split from u where split<>'test' and (split,source,gid) in (select (split,source,gid) from (select split,source,gid,row_number() over (partition by split,source order by min(id), gid) as rn
 from u group by split, source, gid) where rn<=2)""", "states", u=f"select *, id//2 as gid, {SPLIT_SQL.format(x='(' + h(repr('fz'), 'skey') + ')')} as split from states"))
def _(t):
    d = t.states().withColumn("group_id", F.floor(F.col("id") / 2)).withColumn("position", F.col("id")).withColumn("split", split_of("fz", F.col("skey")))
    d = settle(d.select("id", "source", "group_id", "position", "split"))       # every text is read and hashed once, for three readers
    return P.first_groups_per_source(d, 2).select("id", "split")


@query("P9_sample_whole_groups", sql("select o_orderkey as id, o_custkey as group_id from orders where o_custkey in (select o_custkey from (select distinct o_custkey from orders) order by sha256('smp:'||o_custkey) limit 100)"))
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"))
    return P.sample_whole_groups(d, 100, "smp").select("id", "group_id")


FOLDS = "select *, (row_number() over (order by source, sha256('cv:'||source||':'||group_id))-1)%5 as fold from (select distinct source, group_id from questions)"


@query("P10_grouped_folds", sql("select id, task, fold from questions join f using(source, group_id)", "questions", f=FOLDS))
def _(t):
    return P.grouped_folds(t.questions(), 5, "cv").select("id", "task", "fold")


@query("P11_hash_fold", sql("select request_id, (('0x'||substr(group_id,1,8))::bigint)%5 as fold from tx", "tx"))
def _(t):
    return t.tx().select("request_id", P.hash_fold(F.col("group_id"), 5).alias("fold"))


@query("P12_audit_partitions", sql("""select id::varchar as subject, 'duplicate_id' as problem from (select id//1 as id from g2) group by id having count(*)>1
 union all select group_id::varchar, 'group_crosses_splits' from g2 group by group_id having min(split)<>max(split)
 union all select group_id::varchar, 'group_crosses_families' from g2 group by group_id having min(family)<>max(family)
 union all select group_id::varchar, 'group_half_kept' from g2 group by group_id having min(k)<>max(k)""", "states", g=GR,
                                   g2=f"select case when id%40=1 then id-1 else id end as id, group_id, family, id%10<>3 as k, {SPLIT_SQL.format(x='group_id')} as split from g"))
def _(t):
    d = grouped(t)
    x = F.col("group_id") % 10
    d = d.withColumn("split", F.when(x < 6, "train").when(x == 6, "calibration").when(x == 7, "development").otherwise("test"))
    d = d.withColumn("keep", F.col("id") % 10 != 3).withColumn("id", F.when(F.col("id") % 40 == 1, F.col("id") - 1).otherwise(F.col("id")))
    return P.audit_partitions(d, kept="keep")


@query("P13_registered_filter", sql(f"select source, count(distinct id//2) as groups from states where {h(repr('prov'), 'id::varchar')}%4<>0 group by source", "states"))
def _(t):
    s = t.states().withColumn("group_id", F.floor(F.col("id") / 2)).withColumn("ok", h32("prov", F.col("id")) % 4 != 0)
    return P.registered_filter(s, s.groupBy("source").agg(F.count(F.lit(1)).alias("rows")), "ok")[2]


@query("P13_registered_differences", sql("select coalesce(a.source,b.source) as source, got, want from (select source, count(*) as got from states where source<>'src3' group by source) a full join (select source, count(*)+(source='src1')::int as want from states group by source) b using(source) where got is distinct from want", "states"))
def _(t):
    s = t.states()
    expected = s.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", (F.col("n") + (F.col("source") == "src1").cast("int")).alias("rows"))
    d = s.filter(F.col("source") != "src3").withColumn("group_id", F.col("id")).withColumn("ok", F.lit(True))
    return P.registered_filter(d, expected, "ok")[1]


ASM = f"select id, source, {SPLIT_SQL.format(x='(' + h(repr('asm'), 'skey') + ')')} as split, id%4 as arm_no from states"


ASM_STATES = ASM.replace("select ", "select skey, ", 1)


@query("P14_assemble_suite", sql("""select id, split, 'public' as arm from d where arm_no=0 and split in ('train','calibration') union all select id, split, 'rules' from d where arm_no=1
 union all select id, split, 'pairs' from d where arm_no=2 union all select id, split, 'inherited' from d where arm_no=3 and split in ('development','test')""", "states", d=ASM))
def _(t):
    return _assembled(t)[0].select("id", "split", "arm")


@query("P14_unequal_arms", sql("select split, min(n) as lo, max(n) as hi, count(*) as arms from (select split, arm_no, count(*) as n from d where arm_no in (1,2) group by all) group by split having min(n)<>max(n) or count(*)<>2", "states", d=ASM))
def _(t):
    return _assembled(t)[1]


def _parts(t):
    d = t.states().select("id", "source", "skey", split_of("asm", F.col("skey")).alias("split"))
    return [d.filter(F.col("id") % 4 == i) for i in range(4)]


def _assembled(t):
    public, rules, pairs, inherited = _parts(t)
    return P.assemble_suite(public, {"rules": rules, "pairs": pairs}, inherited)


NUM = "('0x'||substr(sha256(split||':'||id||':'||skey),{},12))::bigint"


@query("P14_lineage", sql(f"select (['public','rules','pairs','inherited'])[arm_no+1] as parent, split, count(*) as records, sum({NUM.format(1)}::hugeint)::varchar as digest_sum, bit_xor({NUM.format(13)}) as digest_xor from d group by arm_no, split", "states", d=ASM_STATES))
def _(t):
    return P.suite_lineage(dict(zip(("public", "rules", "pairs", "inherited"), _parts(t))))


@query("P14_changed_parents", sql("select 'rules' as parent, split from d where arm_no=1 and id%10=1 group by split", "states", d=ASM_STATES))
def _(t):
    parents = dict(zip(("public", "rules", "pairs", "inherited"), _parts(t)))
    lineage = P.suite_lineage(parents)
    return P.changed_parents(lineage, {**parents, "rules": parents["rules"].withColumn("skey", F.when(F.col("id") % 10 == 1, F.lit("changed")).otherwise(F.col("skey")))})


# the same states may stand in several arms here, so that every code has subjects
LOOSE = "select id, skey, case arm_no when 0 then 'public' when 1 then 'rules' when 2 then 'pairs' else 'inherited' end as arm, id//8 as group_id from d where (arm_no=0 and id%5<3) or arm_no in (1,2) or (arm_no=3 and id%5>1)"


@query("P14_collisions", sql("""select 'public_leak' as code, skey as subject from s group by skey having max((arm='public')::int)=1 and max((arm='inherited')::int)=1
 union all select 'reserved_state', skey from s group by skey having max((arm in ('rules','pairs'))::int)=1 and max((arm in ('public','inherited'))::int)=1
 union all select 'shared_state', skey from s where arm in ('rules','pairs') group by skey having count(distinct arm||'/'||group_id)>1
 union all select 'repeated_id', id::varchar from s group by id having count(*)>1""", "states", d=ASM_STATES, s0=LOOSE, s="select * from s0 union all select * from s0 where id%50=1"))
def _(t):
    arms = []
    for name, df in zip(("public", "rules", "pairs", "inherited"), _parts(t)):
        arms.append(df.select("id", "skey", F.lit(name).alias("arm"), F.floor(F.col("id") / 8).alias("group_id")))
    arms[0], arms[3] = arms[0].filter("id % 5 < 3"), arms[3].filter("id % 5 > 1")
    rows = arms[0].unionByName(arms[1]).unionByName(arms[2]).unionByName(arms[3])
    return P.suite_collisions(rows.unionByName(rows.filter("id % 50 = 1")))

"""Registered queries of the subpackage and the DuckDB SQL that must give the same rows, where SQL can say it."""
from pyspark.sql import functions as F

from ..session import work_dir
from . import edit_counts, fingerprint, merkle, mixing, near_dup, ngram_quality, piece_codec, preference, rule_ledger, spelling, token_store, url_rules, vector_forest

QUERIES, ORACLES = {}, {}
W = r"'[^\x20\x09-\x0D]+'"
BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op1_url_rules", r"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as rn from pages),
rules(rh, rp, rv) as (values ('net','/','block'), ('example.net','/en/','allow'), ('example.com','/de/','block'), ('org','/fr/','allow')),
hit as (select rn, max_by(rh || rp, length(rh || rp)) as rule, max_by(rv, length(rh || rp)) as verdict from u join rules
  on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rn)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join hit using (rn)""")
def url_rules_query(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


UNITS_SQL = """flatten(list_transform({w}, lambda x: case when length(x) > 24 then regexp_extract_all(x, '(?s).') else [x] end))"""
SKETCH_SQL = """case when len({w}) = 0 then []::varchar[] else list_transform(range(1, greatest(len({w}) - 4, 1) + 1), lambda i: substr(md5(array_to_string({w}[i:i+4], ' ')), 1, 16)) end"""
KEPT_SQL = """case when len(list_distinct(list_filter({h}, lambda x: x < '8'))) >= 32 then list_sort(list_distinct(list_filter({h}, lambda x: x < '8'))) else list_sort(list_distinct({h}))[1:32] end"""
UNTIL_SQL = """case when len({s}) < 32 then 'g' else greatest('8', {s}[len({s})]) end"""
LIKE_SQL = """case when least(len({a}), len({b})) > 0 then len(list_intersect({a}, {b}))::double / least(len({a}), len({b})) when len({whole_a}) + len({whole_b}) = 0 then 1.0::double else 0.0::double end"""


@query("op4_scaled_sketch", f"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
x as (select doc_id, text, n, coalesce(lead(text) over w, first_value(text) over w) as nxt from d window w as (order by doc_id rows between unbounded preceding and unbounded following)),
y as (select doc_id, n, nxt, text, substr(text, 1, n - n // 4) || substr(nxt, 1, n // 4) as edited from x),
v as (select doc_id, n, edited, regexp_extract_all(text, {W}) as w, regexp_extract_all(edited, {W}) as we, regexp_extract_all(nxt, {W}) as wn from y),
z as (select doc_id, n, edited, {UNITS_SQL.format(w='w')} as w, {UNITS_SQL.format(w='we')} as we, {UNITS_SQL.format(w='wn')} as wn from v),
h as (select doc_id, n, edited, {SKETCH_SQL.format(w='w')} as h, {SKETCH_SQL.format(w='we')} as he, {SKETCH_SQL.format(w='wn')} as hn from z),
k as (select doc_id, n, edited, {KEPT_SQL.format(h='h')} as a, {KEPT_SQL.format(h='he')} as b, {KEPT_SQL.format(h='hn')} as c from h),
u as (select *, least({UNTIL_SQL.format(s='a')}, {UNTIL_SQL.format(s='b')}) as ab, least({UNTIL_SQL.format(s='a')}, {UNTIL_SQL.format(s='c')}) as ac from k),
f as (select *, list_filter(a, lambda x: x <= ab) as a1, list_filter(b, lambda x: x <= ab) as b1, list_filter(a, lambda x: x <= ac) as a2, list_filter(c, lambda x: x <= ac) as c2 from u)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, array_to_string(a, '') as fingerprint, array_to_string(b, '') as edited_fingerprint,
  {LIKE_SQL.format(a='a1', b='b1', whole_a='a', whole_b='b')} as near_edited, {LIKE_SQL.format(a='a2', b='c2', whole_a='a', whole_b='c')} as near_next from f""")
def scaled_sketch_query(spark, sf_dir):
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


MIX_SQL = f"""
sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {W})) as size from {{docs}}),
src as (select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight from (select source, sum(size)::bigint as source_size from sized group by source)),
lev as (select *, 2.0e0 * source_size as cap, 2.0e0 * source_size / weight as ratio from src),
cum as (select ratio, (select sum(source_size) from src) * 1.5e0 as budget, sum(sum(cap)) over (order by ratio) as held, (select sum(weight) from src) - sum(sum(weight)) over (order by ratio) as open from lev group by ratio),
cand as (select (budget - held) / open as level, ratio, lead(ratio) over (order by ratio) as next_ratio from cum where open > 0
  union all select any_value(budget) / (select sum(weight) from src), -1, min(ratio) from cum),
level as (select min_by(level, ratio) as level from cand where level < coalesce(next_ratio, 1e300)),
goal as (select source, source_size, least(cap, weight * coalesce((select level from level), 1e300)) as target from lev),
keyed as (select s.*, source_size, target, floor(case when source_size > 0 then target / source_size else 0 end)::bigint as whole, ('0x' || substr(sha256('mix:' || doc_id), 1, 15))::bigint as k
  from sized s join goal g on s.source is not distinct from g.source),
one as (select *, target - whole * source_size as frac, sum(size) over (partition by source order by k rows unbounded preceding) as cum from keyed),
two as (select *, 2 * cum - size <= 2 * frac as inn from one),
three as (select *, max(frac) over (partition by source) - coalesce(sum(case when inn then size end) over (partition by source), 0) as rest from two),
four as (select *, size > 0 and 4 * size <= abs(rest) and (inn = (rest < 0)) as fits from three),
five as (select *, fits and (sum(case when fits then size else 0 end) over (partition by source order by k rows unbounded preceding)) <= abs(rest) as flip from four),
mixed as (select doc_id, source, size, source_size, target, (case when size > 0 then whole + (case when inn <> flip then 1 else 0 end) else 0 end)::bigint as repeats from five)"""


@query("op5_water_filling", "with " + MIX_SQL.format(docs="documents") + " select *, (size * repeats)::bigint as taken from mixed")
def water_filling_query(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


LEDGER_SQL = f"""
words as (select *, regexp_extract_all(coalesce(text, ''), {W}) as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {W})) as l, row_number() over () as rn from {{docs}}),
win as (select rn, i, w[i] as a, w[i+1] as b, w[i+2] as c from (select rn, w, unnest(range(1, len(w) - 1)) as i from words)),
rep as (select rn, count(distinct p) as n from (select rn, unnest([i, i+1, i+2]) as p from (select rn, i, count(*) over (partition by rn, a, b, c) as k from win) where k > 1) group by rn),
measured as (select words.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
  len(regexp_extract_all(coalesce(text, ''), '\\p{{{{Lu}}}}')) as n_upper, coalesce(n, 0) as n_repeat_words from words left join rep using (rn)),
entries as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 100 * n_symbols > 40 * n_words then 4 else 0 end
  + case when 2 * n_dup_lines > n_lines then 8 else 0 end + case when 100 * n_upper > 60 * word_chars then 16 else 0 end + case when word_chars > 30 * n_words then 32 else 0 end)::bigint as failed_bits from measured)"""


@query("op8_rule_ledger", "with " + LEDGER_SQL.format(docs="documents") + """
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_repeat_words, failed_bits, failed_bits & 3 <> 0 as base_failed, failed_bits = 0 as kept from entries""")
def rule_ledger_query(spark, sf_dir):
    entries = rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    judged = rule_ledger.apply_policy(rule_ledger.apply_policy(entries, "v1", "_base"), "v2")
    return judged.withColumn("base_failed", ~F.col("_base")).drop("_base")


@query("op6_token_store")
def token_store_query(spark, sf_dir):
    path = work_dir(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_store.read_tokens(spark, path)


@query("op2_chosen_path", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) end as s from w),
n as (select doc_id, len(s) as n from s), e as (select doc_id, unnest(s) as g from s),
f as (select g, count(*) as df from e group by g), r as (select doc_id, g, row_number() over (partition by doc_id order by df, g) as r from e join f using (g)),
p as (select doc_id, g, n from r join n using (doc_id) where r <= n - ceil(0.8 * n - 1e-9) + 1),
c as (select distinct x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb from p x join p y on x.g = y.g and x.doc_id < y.doc_id and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
l as (select a, b from c join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * len(list_intersect(sa.s, sb.s)) >= 80 * (na + nb - len(list_intersect(sa.s, sb.s)))),
k as (select a, b from l union all select b, a from l), t as (select doc_id as a, doc_id as b from n union select t.a, k.b from t join k on t.b = k.a)
select doc_id, n as n_shingles, least_id as component_id, least_id = doc_id as kept from n join (select a, min(b) as least_id from t group by a) on a = doc_id""")
def chosen_path_query(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op9_piece_codec")
def piece_codec_query(spark, sf_dir):
    coded = piece_codec.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def revision(docs):
    """Three edits of every document: a cut in the first third, its beginning repeated in the middle, a note near the end."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    edits = F.array(F.struct(F.floor(n / 3).alias("start"), F.floor(n / 16).alias("length"), F.lit("").alias("insert")),
                    F.struct(F.floor(n / 2).alias("start"), F.lit(0).cast("bigint").alias("length"), F.substring(F.coalesce("text", F.lit("")), 1, 24).alias("insert")),
                    F.struct(F.floor(n * 3 / 4).alias("start"), F.lit(7).cast("bigint").alias("length"), F.concat(F.lit("'s note "), F.col("doc_id").cast("string")).alias("insert")))
    return docs.select("doc_id", "text", edits.alias("edits"))


@query("op10_edit_counts")
def edit_counts_query(spark, sf_dir):
    return edit_counts.count_edits(revision(table(spark, sf_dir, "documents")))


@query("op7_kneser_ney")
def kneser_ney_query(spark, sf_dir):
    return ngram_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PIECE_SQL = "'<|' || replace({t}.role, '<|', '< |') || '|>' || chr(10) || replace({t}.text, '<|', '< |') || chr(10)"
SIDE_SQL = """{s}_side as (select conv_id, coalesce(string_agg(p, '' order by turn), '') as txt, coalesce(string_agg(case when role = 'assistant' then (cum - len + head)::varchar || '-' || cum::varchar end, ',' order by turn), '') as mask
  from (select *, sum(len) over (partition by conv_id order by turn) as cum from (select conv_id, turn, role, {p} as p, length({p}) as len, length(role) + 5 as head
    from {s} t join common using (conv_id) where pos > n_common)) group by conv_id)"""


@query("op3_preference", f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as pos, count(*) over (partition by conv_id) as n from conversations),
last as (select conv_id, coalesce(lead(text) over (order by conv_id), first_value(text) over (order by conv_id)) as other from t where pos = n),
chosen as (select conv_id, turn, role, text, pos from t), rejected as (select conv_id, turn, role, case when pos = n then other else text end as text, pos from t join last using (conv_id)),
common as (select conv_id, coalesce(min(case when c.text <> r.text then pos end) - 1, max(pos)) as n_common from chosen c join rejected r using (conv_id, pos) group by conv_id),
{SIDE_SQL.format(s='chosen', p=PIECE_SQL.format(t='t'))}, {SIDE_SQL.format(s='rejected', p=PIECE_SQL.format(t='t'))},
prompt as (select conv_id, string_agg({PIECE_SQL.format(t='t')}, '' order by turn) as prompt from chosen t join common using (conv_id) where pos <= n_common group by conv_id)
select conv_id as pair_id, n_common, coalesce(prompt, '') as prompt, coalesce(c.txt, '') as chosen, coalesce(r.txt, '') as rejected, coalesce(c.mask, '') as chosen_mask, coalesce(r.mask, '') as rejected_mask
from common left join prompt using (conv_id) left join chosen_side c using (conv_id) left join rejected_side r using (conv_id)""")
def preference_query(spark, sf_dir):
    out = preference.preference_examples(*preference.swapped_answers(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: preference.spans_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def _merkle_sql(source_levels=10, dataset_levels=6):
    """Level tables of the trees in plain SQL, for up to 3^10 documents a source and 3^6 sources."""
    def field(c):
        return f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"

    def level(name, below, by):
        w = f"(partition by {by}, p // 3 order by p)"
        return (f"{name} as (select *, coalesce(lag(h, 2) over w, '') || coalesce(lag(h) over w, '') as l, coalesce(lead(h) over w, '') || coalesce(lead(h, 2) over w, '') as r from {below} window w as {w})")

    def above(name, below, by):
        return f"{name} as (select {by}, p // 3 as p, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by p)) end as h, (any_value(n) + 2) // 3 as n from {below} group by {by}, p // 3)"
    leaf = "sha256(" + " || ".join(field(c) for c in merkle.FIELDS) + ")"
    later = "sha256(" + " || ".join(field(c if c != "text" else "replace(text, chr(10), '')") for c in merkle.FIELDS) + ")"
    # crc32 of the decimal id, bit by bit over its bytes
    steps = "list_reduce(list_prepend(xor({c}, ord(d[i])), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"select doc_id, d, 1 as i, 4294967295::bigint as c from (select distinct doc_id, doc_id::varchar as d from documents where doc_id is not null) union all select doc_id, d, i + 1, {steps.format(c='c')} from crc where i <= length(d)"
    ctes = [f"crc as ({crc})", "odd as (select doc_id, xor(c, 4294967295) & 1 as bit from crc where i = length(d) + 1)",
            f"leaves as (select d.doc_id, source, {leaf} as h, case when bit = 0 then {later} else {leaf} end as t from documents d left join odd using (doc_id))",
            "n0 as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as p, count(*) over (partition by source) as n from leaves)"]
    ctes += [level("s0", "(select source, p, h, n from n0)", "source")]
    for k in range(1, source_levels + 1):
        ctes += [above(f"a{k}", f"s{k - 1}", "source"), level(f"s{k}", f"a{k}", "source")]
    ctes += [f"roots as (select source, h, row_number() over (order by source nulls first) - 1 as p, count(*) over () as n from s{source_levels})", level("d0", "(select 0 as one, p, h, n from roots)", "one")]
    for k in range(1, dataset_levels + 1):
        ctes += [above(f"b{k}", f"d{k - 1}", "one"), level(f"d{k}", f"b{k}", "one")]
    ctes.append("x0 as (select n0.doc_id, n0.source, n0.h as leaf, n0.p, t, s0.l || s0.r as proof, case when n0.n = 1 then t else sha256(s0.l || t || s0.r) end as f from n0 join s0 on n0.source is not distinct from s0.source and n0.p = s0.p)")
    for k in range(1, source_levels):
        ctes.append(f"x{k} as (select x.* replace (proof || l || r as proof, case when n = 1 then f else sha256(l || f || r) end as f) from x{k - 1} x join s{k} s on x.source is not distinct from s.source and x.p // {3 ** k} = s.p)")
    ctes.append(f"y0 as (select x.* replace (roots.p as p, proof || l || r as proof, case when d0.n = 1 then f else sha256(l || f || r) end as f), roots.h as subroot from x{source_levels - 1} x join roots on x.source is not distinct from roots.source join d0 on roots.p = d0.p)")
    for k in range(1, dataset_levels):
        ctes.append(f"y{k} as (select y.* replace (proof || l || r as proof, case when n = 1 then f else sha256(l || f || r) end as f) from y{k - 1} y join d{k} d on y.p // {3 ** k} = d.p)")
    return "with recursive " + ", ".join(ctes) + f" select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from y{dataset_levels - 1} y, d{dataset_levels} d"


@query("op11_merkle_manifest", _merkle_sql())
def merkle_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.verify(merkle.append(docs, changed=merkle.without_newlines(docs)))


BYTES_SQL = "list_transform(range(1, octet_length(encode({s})) + 1), lambda i: ('0x' || substr(hex(encode({s})), 2 * i - 1, 2))::bigint)"


@query("op13_spelling_variants", rf"""
with recursive crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c from (select unnest(range(256)) as i))),
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (select doc_id, run, count(*) as k from runs group by doc_id, run),
keyed as (select *, xor(list_reduce(list_prepend(4294967295::bigint, {BYTES_SQL.format(s="(doc_id || ':' || run)")}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from counted, crc_table),
spelt as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from keyed),
vocab as (select word, sum(k)::bigint as n from spelt where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from vocab)),
pairs as (select x.word as a, y.word as b from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word union select x.word, y.word from cut x join vocab y on x.rest = y.word union select y.word, x.word from cut x join vocab y on x.rest = y.word),
near as (select a, count(*) as n_near, min_by(struct_pack(w := b, n := n), struct_pack(m := -n, w := b)) as best from pairs join vocab on word = b group by a),
forms as (select vocab.word, vocab.n, coalesce(n_near, 0) as n_near, case when best.n >= 5 * vocab.n then best.w end as form, case when best.n >= 5 * vocab.n then best.n end as form_n from vocab left join near on word = a),
walk as (select word, word as root from forms union all select walk.word, forms.form from walk join forms on walk.root = forms.word where forms.form is not null),
ends as (select walk.word, walk.root from walk join forms on walk.root = forms.word where forms.form is null)
select word, form, root, n, n_near, form_n from forms join ends using (word)""")
def spelling_query(spark, sf_dir):
    return spelling.variants_of_texts(table(spark, sf_dir, "documents"))


@query("op12_vector_forest", """
with recursive v as (select vec_id, label, embedding::double[] as e, row_number() over () as r, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as q, len(embedding) as d, len(list_filter(embedding, lambda x: x is null or not isfinite(x))) as bad from embeddings),
u as (select * from v where label is not null and bad = 0 and q > 0),
links as (select x.r as a, y.r as b from u x join u y on x.label = y.label and x.d = y.d and x.r <> y.r where list_inner_product(x.e, y.e) / (sqrt(x.q) * sqrt(y.q)) >= 0.93),
t as (select r as a, r as b from v union select t.a, links.b from t join links on t.b = links.a),
n as (select a, count(*) as n_links from links group by a), c as (select t.a, min(vec_id) as component_id from t join v on t.b = v.r group by t.a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join c on v.r = c.a left join n on v.r = n.a""")
def vector_forest_query(spark, sf_dir):
    return vector_forest.near_vectors(table(spark, sf_dir, "embeddings"))

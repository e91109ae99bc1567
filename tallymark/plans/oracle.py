"""SQL text of the derived tables, written independently of the DataFrame code, for the side-by-side check."""


def h(*parts):
    return f"('0x'||substr(sha256({cat(*parts)}),1,8))::bigint"


def h60(*parts):
    return f"('0x'||substr(sha256({cat(*parts)}),1,15))::bigint"


def cat(*parts):
    return "||':'||".join(f"({p})" if not p.startswith("'") else p for p in parts)


def hx(*parts, n=24):
    return f"substr(sha256({cat(*parts)}),1,{n})"


def r6(expr):
    return f"(round(({expr})::double+1.2e-9,6)+0.0e0)"


def softmax(z):
    return (f"list_transform({z}, lambda x: exp(x-list_max({z}))/list_sum(list_transform({z}, lambda y: exp(y-list_max({z})))))")


WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapse(c):
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'),' ')"


def settled(p):
    return f"list_transform({p}, lambda v: round(v, 9))"


def norm(c):
    return collapse(f"translate(replace(lower({c}),'ß','ss'),'ſς','sσ')")


def words(c):
    return f"list_filter(string_split({collapse(c)},' '), lambda w: w<>'')"


def _z(model, extra="", bonus=None):
    b = {"A": "1.2", "B": "0.9"}[model] if bonus is None else bonus
    return (f"list_transform(range(len(keys)), lambda i: ({h(repr(model + extra), 'id::varchar', 'task', 'keys[i+1]')} % 6000)/1000e0"
            f" + case when i=label then {b}e0 else 0e0 end)")


CTES = {
    "questions": """
 select o_orderkey as id, o_custkey as group_id, o_orderpriority as source, 'status' as task, 'choice' as type, ['F','O','P'] as keys,
   list_position(['F','O','P'], o_orderstatus)-1 as label from orders
 union all select o_orderkey, o_custkey, o_orderpriority, 'urgent','noul',['false','true'],
   case when substr(o_orderpriority,1,1)::int<=2 then 1 else 0 end from orders
 union all select o_orderkey, o_custkey, o_orderpriority, 'priority','score',['0','1','2','3','4'], substr(o_orderpriority,1,1)::int-1 from orders""",
    "permq": f"""
 select * exclude(label,keys,truth), ks as keys, list_position(ks,truth)-1 as label from (
 select *, keys[label+1] as truth, list_transform(list_sort(list_transform(keys, lambda k: sha256(id::varchar||':'||k)||k)), lambda s: s[65:]) as ks from questions)""",
    "pairs": """
 select o_orderkey as id, o_custkey::varchar||':'||((rn-1)//2)::varchar as pair_id, case when rn%2=1 then 'a' else 'b' end as sibling
 from (select o_orderkey,o_custkey,row_number() over (partition by o_custkey order by o_orderkey) rn from orders)""",
    "states": f"select doc_id as id, text as state, source, lang, sha256({norm('text')}) as skey from documents",
    "labelled": f"""
 select doc_id as id, text as state, source, lang, sha256({norm('text')}) as skey, u.qid, u.instructions, u.label
 from documents join labels using(doc_id), lateral (values ('toxic','Is the text toxic?',toxic),('quality','Is the text of good quality?',quality)) u(qid,instructions,label)""",
    "cases": f"""
 select *, case when family='quantity_limit' then quantity else days end as measure from (
 select *, (['return_window','late_fee','quantity_limit','warranty'])[{h("'fam'", 'case_id')}%4+1] as family, datediff('day',order_date,ship_date) as days from (
 select l_orderkey as order_id, l_quantity::bigint as quantity, round(l_extendedprice*100)::bigint as cents, l_returnflag as flag, l_shipdate::date as ship_date,
   {hx("'case'", 'l_orderkey::varchar', 'l_partkey::varchar', 'l_suppkey::varchar', 'l_linenumber::varchar', 'l_quantity::bigint::varchar', 'round(l_extendedprice*100)::bigint::varchar', n=16)} as case_id,
   o_custkey as party, o_orderdate::date as order_date from lineitem join orders on l_orderkey=o_orderkey))""",
    "tiers": """
 select * from (values ('return_window',-100000,31,'accept'),('return_window',31,100000,'deny'),('late_fee',-100000,1,'none'),('late_fee',1,31,'minor'),
 ('late_fee',31,100000,'major'),('quantity_limit',-100000,26,'within'),('quantity_limit',26,100000,'over'),('warranty',-100000,366,'standard'),
 ('warranty',366,731,'extended'),('warranty',731,100000,'expired')) t(family,lo,hi,label)""",
    "tx": f"""
 select *, case when g<6 then 'train' when g=6 then 'calibration' when g=7 then 'development' else 'test' end as split,
   case when g>=7 and {h("'regime'", 'group_id')}%4=0 then 'heldout_task' else 'iid' end as regime from (
 select *, octet_length(encode(request_body)) as request_bytes, octet_length(encode(response_body)) as response_bytes,
   {h("'split'", 'group_id')}%10 as g, (['triage','export','review','sync'])[week%4+1] as family,
   start_ms+{h("'rc'", 'event_id::varchar')}%400 as request_collected_ms, completed_ms+{h("'pc'", 'event_id::varchar')}%400 as response_collected_ms from (
 select *, service_ms+1+{h("'cp'", 'event_id::varchar')}%500 as completed_ms, case when event_type='error' then k*10 end as retry_after_ms,
   case when method='GET' then '{{}}' else '{{"if_version":'||version||',"value":'||k||'}}' end as request_body,
   case when event_type='error' then '{{"error":"busy","retry_after_ms":'||k*10||'}}' else '{{"id":"'||resource_id||'","secret":"s'||k||'","value":'||k||',"version":'||version||'}}' end as response_body from (
 select *, {hx("'ep'", 'user_id::varchar', 'week::varchar')} as episode_id, {hx("'gr'", '(user_id//3)::varchar', 'week::varchar')} as group_id,
   (['human','script','agent'])[user_id%3+1] as origin, {hx("'rq'", 'event_id::varchar')} as request_id, {hx("'ac'", 'user_id::varchar', '(event_id%2)::varchar')} as actor_id,
   case when event_type in ('view','click','error') then 'GET' when event_type='signup' and not odd then 'PUT' else 'POST' end as method,
   case when event_type in ('view','error') then '/documents?page='||(k%3) when event_type='purchase' then '/exports' when event_type='signup' and odd then '/session'
     when event_type in ('click','signup') and not odd then '/artifacts/'||art else '/documents/'||doc end as path,
   case when event_type='error' then (case when odd then 503 else 429 end) when event_type in ('signup','purchase') then 201 else 200 end as status,
   start_ms+{h("'sv'", 'event_id::varchar')}%20 as service_ms, event_id%5+1 as version,
   case when event_type in ('click','signup') and not odd then art when event_type='error' then null else doc end as resource_id,
   '10.0.'||(user_id%256)||'.'||(event_id%250+1) as src_ip, event_id%60000+1024 as src_port from (
 select *, start_ms//604800000 as week, {h("'kind'", 'event_id::varchar')}%2=1 as odd, {hx("'art'", '(event_id%7)::varchar')} as art, {hx("'doc'", '(event_id%200)::varchar')} as doc from (
 select event_id,user_id,event_type,regexp_extract(props,'([0-9]+)',1)::bigint as k, epoch_us(ts)//1000 as start_ms from events)))))""",
    "txo": "select *, row_number() over (partition by episode_id order by start_ms,event_id)-1 as ordinal from tx",
    "txc": """
 select *, sha256(episode_id||':'||(cum-mut)) as before_hash, sha256(episode_id||':'||cum) as after_hash, mut=1 as state_change from (
 select *, (sum(mut) over (partition by episode_id order by ordinal))::bigint as cum from (
 select *, case when method in ('PUT','POST') and status<400 then 1 else 0 end as mut from txo))""",
    "txl": f"""
 select *, case when prev_request_id is null then []::varchar[] when {h("'dep'", 'event_id::varchar')}%25=0 then [{hx("'ghost'", 'event_id::varchar')}] else [prev_request_id] end as depends_on,
   case when {h("'ver'", 'event_id::varchar')}%25=0 then prev_version+1 else prev_version end as dep_version from (
 select *, lag(request_id) over w as prev_request_id, lag(completed_ms) over w as prev_completed_ms, lag(response_body) over w as prev_response_body,
   lag(version) over w as prev_version, lag(resource_id) over w as prev_resource_id from txo window w as (partition by episode_id order by start_ms,event_id))""",
    "trialspec": "select * from (values ('T0',0.9e0),('T1',0.95e0),('T2',1.2e0),('T3',1.15e0),('T4',1.0e0),('T5',1.05e0),('T6',1.3e0),('T7',0.7e0)) t(trial,bonus)",
    "trials": f"""
 select *, {settled(softmax('logits'))} as p from (select q.*, trial, list_transform(range(len(keys)), lambda i: ({h('trial', 'id::varchar', 'task', 'keys[i+1]')}%6000)/1000e0
   + case when i=label then bonus else 0e0 end) as logits from questions q cross join trialspec)""",
}
for _m in "AB":
    CTES[f"dec{_m}"] = f"select *, {settled(softmax('logits'))} as p, 'clean' as variant from (select *, {_z(_m)} as logits from questions)"
    CTES[f"perm{_m}"] = f"select *, {settled(softmax('logits'))} as p, 'permuted' as variant from (select *, {_z(_m, 'perm')} as logits from permq)"
    CTES[f"unk{_m}"] = f"""
 select id, group_id, 'unknowable' as source, task, type, keys, label, {settled(softmax('logits'))} as p, id as control_id from (
   select * exclude(logits,p), list_transform(keys, lambda k: ({h(repr(_m + 'unk'), 'id::varchar', 'task', 'k')}%1500)/1000e0) as logits from dec{_m} where {h("'unk'", 'id::varchar')}%10=0)
 union all select id, group_id, 'unknowable_control', task, type, keys, label, p, null from dec{_m} where {h("'unk'", 'id::varchar')}%10=0"""
# per-row scores of a prediction table
SCORES = """
 select *, list_position(p,list_max(p))-1=label as ok, list_max(p) as conf,
  ln(list_sum(list_transform(logits, lambda x: exp(x-list_max(logits)))))-(logits[label+1]-list_max(logits)) as nll,
  list_sum(list_transform(range(len(p)), lambda i: pow(p[i+1]-case when i=label then 1 else 0 end,2))) as brier,
  case when type='score' then abs(list_sum(list_transform(range(len(p)), lambda i: p[i+1]*i))-label) end as mae,
  case when type='score' then list_sum(list_transform(range(1,len(p)), lambda i: pow(list_sum(p[1:i])-case when i-1>=label then 1 else 0 end,2)))/(len(p)-1) end as rps
 from {src}"""
for _m in "AB":
    CTES[f"sc{_m}"] = SCORES.format(src=f"dec{_m}")
CTES["views"] = f"""select txo.*, v.profile from txo cross join (values ('full'),('prefix_loss'),('sampled_loss')) v(profile) where v.profile='full' or (v.profile='prefix_loss' and ordinal>=2)
 or (v.profile='sampled_loss' and {h("'mask'", 'group_id', 'ordinal::varchar')}/4294967296e0<0.8e0)"""
for _m, _b in (("A", "1.2"), ("B", "0.9")):
    CTES[f"win{_m}"] = f"""select *, {settled(softmax('logits'))} as p from (select *, list_transform(range(3), lambda i: ({h(repr('w' + _m), 'id', 'keys[i+1]')}%6000)/1000e0+case when i=label then {_b}e0 else 0e0 end) as logits from (
 select substr(sha256(episode_id||':'||profile||':'||w),1,24) as id, group_id, episode_id as parent, 'ops_'||family as source, split, regime, profile as view, case when profile='full' then 'clean' else profile end as variant,
 ['human','script','agent'] as keys, list_position(['human','script','agent'],origin)-1 as label, n_requests, 'choice' as type from (
 select episode_id, group_id, split, regime, family, origin, profile, ordinal//4 as w, count(*) as n_requests from views group by all)))"""
    CTES[f"scw{_m}"] = SCORES.format(src=f"win{_m}")
CTES["sct"] = SCORES.format(src="trials")
DEPS = {"permq": ["questions"], "permA": ["permq"], "permB": ["permq"], "decA": ["questions"], "decB": ["questions"], "unkA": ["decA"], "unkB": ["decB"],
        "scA": ["decA"], "scB": ["decB"], "txo": ["tx"], "txc": ["txo"], "txl": ["txo"], "trials": ["questions", "trialspec"], "sct": ["trials"],
        "views": ["txo"], "winA": ["views"], "winB": ["views"], "scwA": ["winA"], "scwB": ["winB"]}


def sql(text, *needs, **ctes):
    """A query with the derived tables it needs in front; extra CTEs go by keyword, in order."""
    done, out = set(), []

    def add(name):
        if name in done:
            return
        for dep in DEPS.get(name, ()):
            add(dep)
        done.add(name)
        out.append(f"{name} as ({CTES[name].strip()})")
    for n in needs:
        add(n)
    out += [f"{k} as ({v.strip()})" for k, v in ctes.items()]
    return ("with recursive " + ",\n".join(out) + "\n" if out else "") + text.strip()

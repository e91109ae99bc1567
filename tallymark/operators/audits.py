"""Consistency audits of request/response ledgers (B4, B5, B15-B22, B25-B27). Every audit returns findings
(episode_id, subject, code); an empty table is a pass. Nothing is collected: the checks are row expressions, lags bucketed
by day, aggregates or equi-joins."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions import spread
from ..functions.text import h32
from .events import PROFILES

HEX24, HEX64 = "^[0-9a-f]{24}$", "^[0-9a-f]{64}$"
SPLITS = ("train", "calibration", "development", "test")
REGIMES = ("iid", "heldout_task")
ORIGINS = ("human", "script", "agent")
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
AUDIT_METHODS = ("GET", "POST", "PUT", "DELETE")


def _codes(df, checks, subject="request_id", episode="episode_id"):
    """One finding per failed check; a check that cannot be decided counts as passed only where it says so."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in checks]))
    return df.select(F.col(episode).alias("episode_id"), F.col(subject).cast("string").alias("subject"), F.explode(codes).alias("code"))


def _first_or(cond, prev):
    return prev.isNull() | cond


def audit_order(tx):
    """Canonical order inside the episode (by ordinal) and inside each actor."""
    chunk = F.floor(F.col("ordinal") / 4096)
    t = spread.previous(tx.select("episode_id", "actor_id", "request_id", "ordinal", "start_ms", "service_ms", "completed_ms"), ["episode_id"], ["ordinal"], ["start_ms", "completed_ms"], chunk, "e_")
    t = spread.previous(t, ["episode_id", "actor_id"], ["ordinal"], ["completed_ms"], chunk, "a_")
    s, v, c = F.col("start_ms"), F.col("service_ms"), F.col("completed_ms")
    return _codes(t, [("invalid_time", s.isNotNull() & v.isNotNull() & c.isNotNull() & (s >= 0) & (v >= 0) & (c >= 0)), ("response_before_cause", (s <= v) & (v < c)),
                      ("request_order", _first_or(s >= F.col("e_start_ms"), F.col("e_start_ms"))), ("service_order", _first_or(v >= F.col("e_completed_ms"), F.col("e_completed_ms"))),
                      ("actor_overlap", _first_or(s >= F.col("a_completed_ms"), F.col("a_completed_ms")))])


def audit_collection(tx):
    """Collection cannot precede the event."""
    return _codes(tx, [("request_collected_early", F.col("request_collected_ms") >= F.col("start_ms")), ("response_collected_early", F.col("response_collected_ms") >= F.col("completed_ms"))])


def audit_fields(tx, actors):
    """Network tuple, method, path, status, required fields, unique request ids, registered actors (episode_id, actor_id)."""
    a = actors.select("episode_id", "actor_id").distinct().withColumn("_known", F.lit(True))
    t = tx.join(a, ["episode_id", "actor_id"], "left")
    required = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ("request_id", "actor_id", "method", "path", "status", "start_ms", "completed_ms", "src_ip", "src_port", "request_bytes", "response_bytes")])
    rows = _codes(t, [("missing_wire_field", required), ("invalid_network_tuple", F.col("src_ip").rlike(IPV4) & F.col("src_port").between(1, 65535)),
                      ("invalid_http_request", F.col("method").isin(*AUDIT_METHODS) & F.col("path").startswith("/")), ("invalid_http_status", F.col("status").between(100, 599)), ("unknown_actor", F.col("_known"))])
    dup = tx.groupBy("episode_id", "request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("episode_id", F.col("request_id").alias("subject"), F.lit("duplicate_request").alias("code"))
    return rows.unionByName(dup)


def canonical_json(body):
    """Compact JSON of an object body with sorted keys."""
    m = F.from_json(body, "map<string,variant>")
    keys = F.array_sort(F.map_keys(m))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(m, k))))


def audit_payload_bytes(tx):
    """Byte columns are the UTF-8 length of the canonical body; the resource version is the body's version."""
    version = F.get_json_object("response_body", "$.version").cast("bigint")
    return _codes(tx, [("request_bytes", F.col("request_bytes") == F.octet_length(canonical_json(F.col("request_body")))), ("response_bytes", F.col("response_bytes") == F.octet_length(canonical_json(F.col("response_body")))),
                       ("resource_version_mismatch", version.isNull() | (F.col("version") == version))])


def audit_state_chain(tx):
    """Each transition starts at the previous committed state; the flag agrees; failures do not mutate; digests are valid."""
    t = spread.previous(tx, ["episode_id"], ["ordinal"], ["after_hash"], F.floor(F.col("ordinal") / 4096), "p_")
    b, a = F.col("before_hash"), F.col("after_hash")
    return _codes(t, [("invalid_state_hash", b.rlike(HEX64) & a.rlike(HEX64)), ("broken_state_chain", _first_or(b == F.col("p_after_hash"), F.col("p_after_hash"))), ("state_change_mismatch", F.col("state_change") == (b != a)),
                      ("failed_request_mutates_state", (F.col("status") < 400) | (b == a))])


def audit_dependencies(tx):
    """Every dependency exists earlier in the episode and had completed when the request started. The parent side is
    keyed by its unique request id, so a hot episode does not concentrate the join."""
    d = tx.select("episode_id", "request_id", "ordinal", "start_ms", F.explode("depends_on").alias("dep"))
    p = tx.select("episode_id", F.col("request_id").alias("dep"), F.col("ordinal").alias("p_ordinal"), F.col("completed_ms").alias("p_done"))
    j = d.join(p, ["episode_id", "dep"], "left")
    return _codes(j, [("undelivered_decision_dependency", (F.col("p_ordinal") < F.col("ordinal")) & (F.col("p_done") <= F.col("start_ms")))])


def audit_resources(tx):
    """Consumed resources (array of struct(producer_request_id, resource_id, version, produced_at_ms, content_sha256, kind))
    against the producing response; state_dependencies and consumed_artifacts are exact projections of them."""
    c = tx.select("episode_id", "request_id", "service_ms", F.explode("consumed_resources").alias("c")).filter(F.col("c.producer_request_id").isNotNull())
    p = tx.select("episode_id", F.col("request_id").alias("prod"), F.col("completed_ms").alias("p_done"), F.col("resource_id").alias("p_rid"), F.col("version").alias("p_version"),
                  F.sha2("response_body", 256).alias("p_sha"))
    j = c.withColumn("prod", F.col("c.producer_request_id")).join(p, ["episode_id", "prod"], "left")
    rows = _codes(j, [("future_state_dependency", F.col("p_done") <= F.col("service_ms")),
                      ("resource_version_mismatch", F.col("p_done").isNull() | (F.col("c.resource_id").eqNullSafe(F.col("p_rid")) & F.col("c.version").eqNullSafe(F.col("p_version")) & (F.col("c.content_sha256") == F.col("p_sha"))
                                                                                & (F.col("c.produced_at_ms") == F.col("p_done"))))])
    producers = F.array_distinct(F.array_compact(F.transform("consumed_resources", lambda r: r["producer_request_id"])))
    arts = F.filter("consumed_resources", lambda r: r["kind"] == "artifact")
    return rows.unionByName(_codes(tx, [("resource_dependency_projection", (F.col("state_dependencies") == producers) & (F.col("consumed_artifacts") == arts))]))


def audit_coordination(links, tx):
    """Claimed hand-offs (episode_id, artifact, write_request, read_request, export_request, delivered_version) against the
    ledger: three equi-joins on unique request ids, then predicates."""
    def side(tag):
        cols = ["actor_id", "method", "path", "status", "start_ms", "completed_ms", "version", "response_body", "state_change"]
        return tx.select("episode_id", F.col("request_id").alias(f"{tag}_request"), F.struct(*cols).alias(tag[0]))
    j = links.join(side("write"), ["episode_id", "write_request"], "left").join(side("read"), ["episode_id", "read_request"], "left").join(side("export"), ["episode_id", "export_request"], "left")
    there = F.col("w").isNotNull() & F.col("r").isNotNull() & F.col("e").isNotNull()
    target = F.concat(F.lit("/artifacts/"), "artifact")
    routes = (F.col("w.method") == "PUT") & (F.col("r.method") == "GET") & (F.col("w.path") == target) & (F.col("r.path") == target) & (F.col("w.actor_id") != F.col("r.actor_id"))
    good = lambda s: F.col(f"{s}.status").between(200, 299)
    times = (F.col("w.completed_ms") <= F.col("r.start_ms")) & (F.col("r.start_ms") <= F.col("r.completed_ms")) & (F.col("r.completed_ms") <= F.col("e.start_ms"))
    delivered = (F.get_json_object("w.response_body", "$.id") == F.col("artifact")) & (F.get_json_object("r.response_body", "$.id") == F.col("artifact")) & (F.col("r.version") == F.col("w.version"))
    effect = (F.col("e.method") == "POST") & (F.col("e.path") == "/exports") & (F.col("e.actor_id") == F.col("r.actor_id")) & (F.col("delivered_version") == F.col("w.version")) & F.col("e.state_change")
    skip = lambda cond: ~there | F.coalesce(cond, F.lit(False))
    return _codes(j, [("coordination_missing_request", there), ("coordination_routes", skip(routes)), ("coordination_failed_operation", skip(good("w") & good("r") & good("e"))), ("coordination_causality", skip(times)),
                      ("coordination_delivery", skip(delivered)), ("coordination_no_effect", skip(effect))], subject="read_request")


def audit_views(tx, views):
    """views = (episode_id, profile, ordinal, request_id, seq, omitted, content) with `seq` the position inside the selected
    or omitted list. tx has (episode_id, ordinal, request_id, content). Compared per (episode, profile, ordinal)."""
    want = tx.select("episode_id", "ordinal", F.col("request_id").alias("want_id"), F.col("content").alias("want_content")).withColumn("profile", F.explode(F.array(*[F.lit(p) for p in PROFILES])))
    got = views.groupBy("episode_id", "profile", "ordinal").agg(
        F.sum((~F.col("omitted")).cast("int")).alias("sel"), F.sum(F.col("omitted").cast("int")).alias("omi"), F.max(F.when(~F.col("omitted"), F.col("content"))).alias("content"))
    j = want.join(got, ["episode_id", "profile", "ordinal"], "full_outer")
    s, o = F.coalesce("sel", F.lit(0)), F.coalesce("omi", F.lit(0))
    cells = _codes(j.withColumn("subject", F.concat_ws("/", "profile", F.col("ordinal").cast("string"))), [
        ("export_coverage", (s + o == 1) & F.col("want_id").isNotNull()), ("export_content", (s == 0) | F.col("content").eqNullSafe(F.col("want_content"))),
        ("full_view_omits_events", (F.col("profile") != "full") | (o == 0)), ("prefix_mask", (F.col("profile") != "prefix_loss") | ((o > 0) == (F.col("ordinal") < 2)))], subject="subject")
    # canonical order: inside each list the ordinal must grow with the position
    v = spread.previous(views, ["episode_id", "profile", "omitted"], ["seq", "ordinal"], ["ordinal"], F.floor(F.col("seq") / 4096), "p_")
    order = v.filter(F.col("p_ordinal") >= F.col("ordinal")).select("episode_id", F.concat_ws("/", "profile", F.col("ordinal").cast("string")).alias("subject"), F.lit("export_order").alias("code"))
    return cells.unionByName(order)


def empty_views(tx, views):
    """Number of views without any selected event, per profile."""
    every = tx.select("episode_id").distinct().withColumn("profile", F.explode(F.array(*[F.lit(p) for p in PROFILES])))
    some = views.filter(~F.col("omitted")).select("episode_id", "profile").distinct()
    return every.join(some, ["episode_id", "profile"], "left_anti").groupBy("profile").agg(F.count(F.lit(1)).alias("empty_views"))


def audit_mask_independence(masked):
    """(group, profile, ordinal) cells where counterpart episodes differ in the keep decision; an aggregate, not pairs."""
    g = masked.groupBy("group_id", "profile", "ordinal").agg(F.min(F.col("kept").cast("int")).alias("lo"), F.max(F.col("kept").cast("int")).alias("hi"), F.count(F.lit(1)).alias("episodes"))
    return g.filter("lo <> hi").select("group_id", "profile", "ordinal", F.lit("origin_dependent_observation_mask").alias("code"))


def audit_episode_metadata(episodes, actors):
    """episodes = (episode_id, group_id, split, family, regime, seed, fold, provenance, target_actor, origin); actors =
    (episode_id, actor_id, intended_origin, controller_kind)."""
    reg = actors.groupBy("episode_id", "actor_id").agg(F.count(F.lit(1)).alias("n"), F.max("intended_origin").alias("actor_origin"), F.max("controller_kind").alias("kind"))
    target = reg.select("episode_id", F.col("actor_id").alias("target_actor"), "actor_origin", F.lit(True).alias("_reg"))
    e = episodes.join(target, ["episode_id", "target_actor"], "left")
    fold = F.conv(F.substring("group_id", 1, 8), 16, 10).cast("bigint") % 5
    p = F.col("provenance")
    rows = _codes(e, [
        ("opaque_id", F.col("episode_id").rlike(HEX24) & F.col("group_id").rlike(HEX24)), ("partition_metadata", F.col("split").isin(*SPLITS) & (F.col("family") != "")), ("evaluation_regime", F.col("regime").isin(*REGIMES)),
        ("simulation_provenance", (p["kind"] == "executed_simulation") & (p["network_capture"] == "false") & (p["clock"] == "logical_ms") & (p["live_llm"] == "false")),
        ("missing_target_actor", F.col("_reg")), ("target_origin_basis", F.col("_reg").isNull() | (F.col("origin") == F.col("actor_origin"))), ("missing_environment_seed", F.col("seed").isNotNull()), ("calibration_fold", F.col("fold") == fold)], subject="episode_id")
    dup = episodes.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("episode_id", F.col("episode_id").alias("subject"), F.lit("duplicate_episode").alias("code"))
    regs = _codes(reg, [("actor_registry", F.col("n") == 1), ("actor_provenance", F.col("actor_origin").isin(*ORIGINS) & (F.col("kind") == "simulated_policy"))], subject="actor_id")
    return rows.unionByName(dup).unionByName(regs)


def audit_groups(episodes):
    """One episode per origin per group, shared metadata, no (family, seed) in two groups, held-out families and versions
    absent from training."""
    meta = F.struct("split", "family", "seed", "fold", "regime", "version")
    g = episodes.groupBy("group_id").agg(F.min(meta).alias("a"), F.max(meta).alias("b"), F.count(F.lit(1)).alias("n"), *[F.sum((F.col("origin") == o).cast("int")).alias(f"n_{o}") for o in ORIGINS])
    one = reduce(lambda x, y: x & y, [F.col(f"n_{o}") == 1 for o in ORIGINS]) & (F.col("n") == len(ORIGINS))
    groups = _codes(g.withColumn("episode_id", F.lit("")), [("group_metadata_mismatch", F.col("a") == F.col("b")), ("missing_matched_origin", one)], subject="group_id")
    latent = episodes.groupBy("family", "seed").agg(F.min("group_id").alias("a"), F.max("group_id").alias("b")).filter("a <> b") \
        .select(F.lit("").alias("episode_id"), F.concat_ws("/", "family", F.col("seed").cast("string")).alias("subject"), F.lit("latent_task_multiple_groups").alias("code"))
    train = episodes.filter(F.col("split") == "train")
    held = episodes.filter(F.col("regime") == "heldout_task")
    fam = train.select("family").distinct().withColumn("_f", F.lit(True))
    ver = train.select("version").distinct().withColumn("_v", F.lit(True))
    h = held.join(fam, "family", "left").join(ver, "version", "left")
    leak = _codes(h, [("heldout_task_leakage", F.col("_f").isNull() & F.col("split").isin("development", "test")), ("heldout_controller_leakage", F.col("_v").isNull())], subject="episode_id")
    return groups.unionByName(latent).unionByName(leak)


def audit_report(*findings):
    """Finding counts by code."""
    return reduce(lambda a, b: a.unionByName(b), findings).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def role_counts(actors, episodes, tx, views):
    """Origins at four stages: registered actors, target episodes, executed interactions, selected evidence rows."""
    role = actors.select("episode_id", "actor_id", F.col("intended_origin").alias("origin"))
    stage = lambda d, name: d.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
    act = lambda d: d.select("episode_id", "actor_id").join(role, ["episode_id", "actor_id"])
    return stage(role, "registered").unionByName(stage(episodes, "target")).unionByName(stage(act(tx), "executed")).unionByName(stage(act(views), "selected"))


# ---- seeded defects ------------------------------------------------------------------------------------------------
def seed_defects(tx):
    """A ledger with one defect in a hashed share of rows, for exercising the audits."""
    x = h32("tdef", F.col("event_id")) % 60
    d = tx.withColumn("x", x)
    x = F.col("x")
    for name, cond, value in (
            ("service_ms", x == 0, F.col("start_ms") - 5), ("completed_ms", x == 1, F.col("service_ms")), ("start_ms", x == 2, F.col("start_ms") - 7200000), ("request_collected_ms", x == 3, F.col("start_ms") - 1),
            ("response_collected_ms", x == 4, F.col("completed_ms") - 1), ("src_ip", x == 5, F.lit("300.1.2.3")), ("src_port", x == 6, F.lit(0)), ("method", x == 7, F.lit("BREW")), ("path", x == 8, F.lit("documents")),
            ("status", x == 9, F.lit(99)), ("request_bytes", x == 10, F.col("request_bytes") + 1), ("response_bytes", x == 11, F.col("response_bytes") + 1), ("version", x == 12, F.col("version") + 1),
            ("request_id", x == 13, F.lit("dup")), ("actor_id", x == 14, F.lit("ghost")), ("service_ms", x == 15, F.lit(None))):
        d = d.withColumn(name, F.when(cond, value).otherwise(F.col(name)))
    return d


def seed_chain_defects(tx):
    x = h32("cdef", F.col("event_id")) % 40
    d = tx.withColumn("x", x)
    x = F.col("x")
    d = d.withColumn("before_hash", F.when(x == 0, F.sha2(F.lit("broken"), 256)).otherwise(F.col("before_hash"))).withColumn("state_change", F.when(x == 1, ~F.col("state_change")).otherwise(F.col("state_change")))
    return d.withColumn("after_hash", F.when(x == 2, F.lit("zz")).otherwise(F.col("after_hash"))).withColumn("status", F.when(x == 3, F.lit(500)).otherwise(F.col("status")))

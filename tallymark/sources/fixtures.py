"""Typed tables derived from the given parquet files: prediction rows, records, cases, request/response ledgers, trials.

Every value comes from a column or from sha256 of one, so that any engine can rebuild the same table. All steps are
row-local unless a docstring says otherwise.
"""
from functools import reduce

from pyspark.sql import functions as F

from ..functions import spread
from ..functions import vectors as V
from ..functions.text import h32, sha, state_key

BONUS = {"A": 1.2, "B": 0.9}
WEEK_MS = 604800000
DAY_MS = 86400000

# options of the three questions asked about an order (fixed values)
STATUS_KEYS = ("F", "O", "P")
YES_NO = ("false", "true")
LEVELS = ("0", "1", "2", "3", "4")

# label tiers per policy family: lo <= measure < hi (fixed values)
TIERS = (
    ("return_window", -100000, 31, "accept"), ("return_window", 31, 100000, "deny"),
    ("late_fee", -100000, 1, "none"), ("late_fee", 1, 31, "minor"), ("late_fee", 31, 100000, "major"),
    ("quantity_limit", -100000, 26, "within"), ("quantity_limit", 26, 100000, "over"),
    ("warranty", -100000, 366, "standard"), ("warranty", 366, 731, "extended"), ("warranty", 731, 100000, "expired"),
)
FAMILIES = ("return_window", "late_fee", "quantity_limit", "warranty")

# policy families whose limits belong to the case: what is measured, the levels (limit, factor, closed, label) and the limits a
# case may have (fixed values)
POLICIES = {
    "return_window": ("elapsed", "purchase", "request", ((1, 1, True, "true"), (None, 1, True, "false")), ((14,), (30,), (45,), (60,))),
    "spend_threshold": ("number", "amount", None, ((1, 1, True, "auto_approved"), (None, 1, True, "director_signoff")), ((250,), (500,), (1000,), (2500,))),
    "authorization": ("same", "signer", "approver", ((0, 1, True, "true"), (None, 1, True, "false")), ((0,),)),
    "age_eligibility": ("number", "age", None, ((1, 1, False, "false"), (None, 1, True, "true")), ((16,), (18,), (21,), (25,))),
    "quantity_limit": ("number", "qty", None, ((1, 1, True, "within_limit"), (1, 2, True, "slightly_over"), (None, 1, True, "far_over")), ((2,), (3,), (5,), (10,))),
    "deadline": ("elapsed", "due", "received", ((0, 1, True, "0"), (1, 1, True, "1"), (None, 1, True, "2")), ((3,), (7,), (14,))),
    "warranty_claim": ("elapsed", "purchase", "claim", ((1, 1, True, "0"), (2, 1, True, "1"), (None, 1, True, "2")), ((90, 365), (180, 730), (365, 1095))),
    "sla_response": ("number", "hours", None, ((1, 1, True, "0"), (2, 1, True, "1"), (None, 1, True, "2")), ((4, 24), (8, 48), (24, 72), (1, 8))),
    "late_fee": ("number", "days_late", None, ((1, 1, True, "0"), (2, 1, True, "1"), (None, 1, True, "2")), ((5, 30), (10, 60), (15, 45))),
    "volume_discount": ("number", "units", None, ((1, 1, False, "0"), (2, 1, False, "1"), (None, 1, True, "2")), ((10, 50), (25, 100), (5, 20), (100, 500))),
    "shipping_delay": ("elapsed", "promised", "delivered", ((1, 1, True, "0"), (2, 1, True, "1"), (None, 1, True, "2")), ((1, 4), (2, 7), (3, 10))),
}


def lit_array(values):
    return F.array(*[F.lit(v) for v in values])


MOST = max(map(len, (STATUS_KEYS, YES_NO, LEVELS)))     # options that a question may have


def per_key(fn, most=MOST, keys="keys"):
    """`fn(key, i)` of every option of `keys`, as a list of columns that are null behind the last option. Spark compiles plain columns;
    the body of a lambda over an array it interprets."""
    return [F.when(F.size(keys) > i, fn(F.get(keys, F.lit(i)), i)) for i in range(most)]


def with_probabilities(df, logit, most=MOST):
    """Adds `logits` (`logit(key, i)` of every option) and `p`, their softmax as `V.settled` rounds it, in the same order of additions."""
    k = range(most)
    df = df.select("*", *[z.alias(f"_z{i}") for i, z in enumerate(per_key(logit, most))])
    df = df.withColumn("_top", F.greatest(*[f"_z{i}" for i in k]))
    df = df.select("*", *[F.exp(F.col(f"_z{i}") - F.col("_top")).alias(f"_e{i}") for i in k])
    df = df.withColumn("_sum", reduce(lambda a, i: a + F.coalesce(f"_e{i}", F.lit(0.0)), k, F.lit(0.0)))
    array = lambda cols: F.slice(F.array(*cols), F.lit(1), F.size("keys"))
    out = df.withColumn("logits", array([f"_z{i}" for i in k])).withColumn("p", array([F.round(F.col(f"_e{i}") / F.col("_sum"), 9) for i in k]))
    return out.drop("_top", "_sum", *[f"_{c}{i}" for c in "ze" for i in k])


class Tables:
    """The given tables and the ones derived from them."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- prediction rows -------------------------------------------------------------------------------------------
    def questions(self):
        """Three labelled questions per order, no predictions yet."""
        digit = F.substring("o_orderpriority", 1, 1).cast("int")

        def q(name, kind, keys, label):
            return F.struct(F.lit(name).alias("task"), F.lit(kind).alias("type"), lit_array(keys).alias("keys"),
                            label.cast("int").alias("label"))
        three = F.array(
            q("status", "choice", STATUS_KEYS, F.array_position(lit_array(STATUS_KEYS), F.col("o_orderstatus")) - 1),
            q("urgent", "noul", YES_NO, F.when(digit <= 2, 1).otherwise(0)),
            q("priority", "score", LEVELS, digit - 1))
        return (self._over_cores(self.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")
                .select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("source"), F.inline(three)))

    def _over_cores(self, df, key):
        """The rows over all cores where the file splits into fewer parts: they are about to be multiplied and hashed. The parts of a
        stream are not known before it runs, its batches are always dealt out."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(2 * cores, key) if df.isStreaming or df.rdd.getNumPartitions() < cores else df

    def decisions(self, model="A", salt=None, bonus=None):
        """Prediction rows of one model on the clean variant."""
        b = BONUS.get(model, 1.0) if bonus is None else bonus
        salt = model if salt is None else salt
        z = lambda k, i: ((h32(F.lit(salt), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0)
                          + F.when(F.col("label") == i, F.lit(float(b))).otherwise(0.0))
        return (with_probabilities(self.questions(), z)
                .withColumn("question", F.col("task")).withColumn("variant", F.lit("clean"))
                .withColumn("parent", F.col("id")).withColumn("inference_temperature", F.lit(1.0)))

    def permuted(self, model="A"):
        """The same questions with options in hashed order and fresh logits."""
        base = self.questions().withColumn("truth", V.at("keys", "label"))
        order = F.array(*per_key(lambda k, i: F.struct(sha(F.col("id"), k).alias("o"), k.alias("k"))))
        base = base.withColumn("keys", F.sort_array(F.slice(order, F.lit(1), F.size("keys")))["k"])
        base = base.withColumn("label", (F.array_position("keys", F.col("truth")) - 1).cast("int"))
        z = lambda k, i: ((h32(F.lit(model + "perm"), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0)
                          + F.when(F.col("label") == i, F.lit(BONUS[model])).otherwise(0.0))
        return (with_probabilities(base, z).withColumn("question", F.col("task"))
                .withColumn("variant", F.lit("permuted")).withColumn("parent", F.col("id")).drop("truth"))

    def paired(self, model="A"):
        """Consecutive orders of one customer as siblings a/b. Neither side of the join is small, though both come from few compressed bytes."""
        d = self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
        d = spread.spread_rank(d, ["c"], ["id"], F.floor(F.col("id") / 50000), "rn", many=True)
        d = d.select("id", F.concat_ws(":", "c", ((F.col("rn") - 1).cast("bigint") / 2).cast("bigint").cast("string")).alias("pair_id"),
                     F.when(F.col("rn") % 2 == 1, "a").otherwise("b").alias("sibling"))
        return self.decisions(model).join(d.hint("merge"), "id")

    def unknowable(self, model="A"):
        """Every tenth order also has an evidence-removed twin; the intact row is its control."""
        d = self.decisions(model).filter(h32("unk", F.col("id")) % 10 == 0)
        flat = F.transform("keys", lambda k: (h32(F.lit(model + "unk"), F.col("id"), F.col("task"), k) % 1500) / F.lit(1000.0))
        u = (d.withColumn("logits", flat).withColumn("p", V.settled(V.softmax("logits"))).withColumn("source", F.lit("unknowable"))
             .withColumn("control_id", F.col("id")))
        c = d.withColumn("source", F.lit("unknowable_control")).withColumn("control_id", F.lit(None).cast("bigint"))
        return u.unionByName(c)

    # ---- labelled documents ----------------------------------------------------------------------------------------
    def states(self):
        return self.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("state"), "source", "lang",
                                     state_key("text").alias("skey"))

    def labelled(self, **measured):
        """One row per (document, question): toxic as yes/no, quality as yes/no. `measured` are further columns of the document, computed
        once before the join, so that a reader of these alone does not move texts."""
        d = self.documents.select("doc_id", "text", "source", "lang", *[c.alias(name) for name, c in measured.items()]).join(self.labels, "doc_id")
        qs = F.array(
            F.struct(F.lit("toxic").alias("qid"), F.lit("Is the text toxic?").alias("instructions"), F.col("toxic").cast("int").alias("label")),
            F.struct(F.lit("quality").alias("qid"), F.lit("Is the text of good quality?").alias("instructions"), F.col("quality").cast("int").alias("label")))
        return d.select(F.col("doc_id").alias("id"), F.col("text").alias("state"), "source", "lang",
                        state_key("text").alias("skey"), *measured, F.inline(qs))

    # ---- policy cases ----------------------------------------------------------------------------------------------
    def cases(self):
        """One case per order line; the policy family is picked by hash."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        li = self.lineitem.select(
            "l_orderkey", F.col("l_quantity").cast("bigint").alias("quantity"), cents.alias("cents"),
            F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("ship_date"),
            F.substring(sha("case", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
                            F.col("l_quantity").cast("bigint"), cents), 1, 16).alias("case_id"))
        o = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("party"),
                               F.col("o_orderdate").cast("date").alias("order_date"))
        c = li.join(o, "l_orderkey")
        c = c.withColumn("family", F.element_at(lit_array(FAMILIES), (h32("fam", F.col("case_id")) % 4 + 1).cast("int")))
        return (c.withColumn("days", F.datediff("ship_date", "order_date").cast("bigint"))
                .withColumn("measure", F.when(F.col("family") == "quantity_limit", F.col("quantity")).otherwise(F.col("days")))
                .withColumnRenamed("l_orderkey", "order_id"))

    def policies(self):
        """The policy table: one row per family and level."""
        rows = [(family, kind, first, second, level, at, float(factor), closed, label) for family, (kind, first, second, levels, _) in POLICIES.items() for level, (at, factor, closed, label) in enumerate(levels)]
        return self.spark.createDataFrame(rows, "family string, kind string, first string, second string, level int, at int, factor double, closed boolean, label string")

    def policy_cases(self):
        """One case per order line under one of all policy families, with limits of its own; a ninth lacks a fact."""
        c = self.cases().select("case_id", "order_date", "days", "quantity", "cents")
        family = F.element_at(lit_array(tuple(POLICIES)), (h32("policy", F.col("case_id")) % len(POLICIES) + 1).cast("int"))
        c = c.withColumn("family", family).withColumn("_l", h32("limits", F.col("case_id"))).withColumn("_gone", h32("gone", F.col("case_id")) % 9 == 0)
        f, known = F.col("family"), ~F.col("_gone")

        def per_family(fn):
            out = None
            for name, policy in POLICIES.items():
                out = F.when(f == name, fn(name, policy)) if out is None else out.when(f == name, fn(name, policy))
            return out
        elapsed = {"return_window": F.col("days"), "deadline": F.floor(F.col("days") / 4) - 8, "warranty_claim": F.col("days") * 9, "shipping_delay": F.floor(F.col("days") / 8) - 3}
        number = {"spend_threshold": F.col("cents") % 5000, "age_eligibility": F.col("quantity"), "quantity_limit": F.col("quantity"), "sla_response": F.col("days"), "late_fee": F.col("days") - 10, "volume_discount": F.col("cents") % 700}
        none = {"dates": F.create_map().cast("map<string,date>"), "numbers": F.create_map().cast("map<string,double>"), "parties": F.create_map().cast("map<string,string>")}
        dates = per_family(lambda n, p: F.create_map(F.lit(p[1]), F.col("order_date"), F.lit(p[2]), F.when(known, F.date_add("order_date", elapsed[n].cast("int")))) if p[0] == "elapsed" else none["dates"])
        numbers = per_family(lambda n, p: F.create_map(F.lit(p[1]), F.when(known, number[n].cast("double"))) if p[0] == "number" else none["numbers"])
        party = lambda salt: F.concat(F.lit("p"), (h32(salt, F.col("case_id")) % 3).cast("string"))
        parties = per_family(lambda n, p: F.create_map(F.lit(p[1]), F.when(known, party("signer")), F.lit(p[2]), party("approver")) if p[0] == "same" else none["parties"])
        limits = per_family(lambda n, p: F.element_at(F.array(*[lit_array([float(x) for x in o]) for o in p[4]]), (F.col("_l") % len(p[4]) + 1).cast("int")))
        return c.select("case_id", "family", dates.alias("dates"), numbers.alias("numbers"), parties.alias("parties"), limits.alias("limits"))

    # ---- request/response ledger -----------------------------------------------------------------------------------
    def tx(self):
        """One HTTP transaction per event."""
        e = self.events.select(
            "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000).cast("bigint").alias("start_ms"))
        return ledger(e)

    def tx_ordered(self, **measured):
        """Ledger with its zero-based position in the episode (bucketed by day). `measured` are further columns of a transaction, computed
        before it is ranked, so that a reader of these alone does not move bodies."""
        return spread.spread_rank(self.tx().withColumns(measured), ["episode_id"], ["start_ms", "event_id"], F.floor(F.col("start_ms") / DAY_MS), "ordinal") \
            .withColumn("ordinal", F.col("ordinal") - 1)

    def tx_chain(self):
        """Ledger with the application-state hashes before and after each transaction."""
        t = self.tx_ordered().withColumn("mut", F.when(F.col("method").isin("PUT", "POST") & (F.col("status") < 400), 1).otherwise(0))
        t = spread.running_totals(t, ["episode_id"], "ordinal", F.floor(F.col("start_ms") / DAY_MS), ["mut"])
        return (t.withColumn("before_hash", sha(F.col("episode_id"), F.col("cum_mut") - F.col("mut")))
                .withColumn("after_hash", sha(F.col("episode_id"), F.col("cum_mut")))
                .withColumn("state_change", F.col("mut") == 1).drop("cum_mut", "tot_mut", "mut"))

    def tx_links(self):
        """Ledger with the previous transaction of the same episode as its recorded dependency."""
        t = spread.previous(self.tx_ordered(), ["episode_id"], ["start_ms", "event_id"],
                            ["request_id", "completed_ms", "response_body", "version", "resource_id"], F.floor(F.col("start_ms") / DAY_MS))
        bad = h32("dep", F.col("event_id")) % 25 == 0
        return (t.withColumn("depends_on", F.when(F.col("prev_request_id").isNull(), F.array().cast("array<string>"))
                             .when(bad, F.array(F.substring(sha("ghost", F.col("event_id")), 1, 24))).otherwise(F.array("prev_request_id")))
                .withColumn("dep_version", F.when(h32("ver", F.col("event_id")) % 25 == 0, F.col("prev_version") + 1).otherwise(F.col("prev_version"))))

    # ---- window predictions ----------------------------------------------------------------------------------------
    def window_rows(self, model="A"):
        """Origin predictions for windows of four transactions of each observed view of an episode."""
        from ..operators.events import apply_masks
        v = apply_masks(self.tx_ordered())
        w = v.groupBy("episode_id", "group_id", "split", "regime", "family", "origin", "profile", F.floor(F.col("ordinal") / 4).alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
        keys = lit_array(("human", "script", "agent"))
        w = w.select(F.substring(sha(F.col("episode_id"), F.col("profile"), F.col("w")), 1, 24).alias("id"), "group_id", F.col("episode_id").alias("parent"),
                     F.concat(F.lit("ops_"), "family").alias("source"), "split", "regime", F.col("profile").alias("view"),
                     F.when(F.col("profile") == "full", "clean").otherwise(F.col("profile")).alias("variant"), keys.alias("keys"),
                     (F.array_position(keys, F.col("origin")) - 1).cast("int").alias("label"), "n_requests", F.lit("choice").alias("type"),
                     F.lit("operator_origin").alias("question"), F.lit("operator_origin").alias("task"))
        z = F.transform("keys", lambda k, i: (h32(F.lit("w" + model), F.col("id"), k) % 6000) / F.lit(1000.0) + F.when(i == F.col("label"), F.lit(BONUS[model])).otherwise(0.0))
        return w.withColumn("logits", z).withColumn("p", V.settled(V.softmax("logits"))).withColumn("inference_temperature", F.lit(1.0))

    # ---- experiment ledger -----------------------------------------------------------------------------------------
    def trials(self):
        """Eight trials (four recipes, two seeds each) re-scoring the clean questions; one row per prediction."""
        spec = F.array(*[F.struct(F.lit(f"T{i}").alias("trial"), F.lit(TRIAL_BONUS[i]).alias("bonus")) for i in range(8)])
        q = self.questions().select("*", F.inline(spec))
        z = lambda k, i: ((h32(F.col("trial"), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0)
                          + F.when(F.col("label") == i, F.col("bonus")).otherwise(0.0))
        return with_probabilities(q, z).drop("bonus")


# option bonus per trial: trials 2r and 2r+1 are the two seeds of recipe r (fixed values)
TRIAL_BONUS = (0.9, 0.95, 1.2, 1.15, 1.0, 1.05, 1.3, 0.7)


def ledger(e):
    """Wire fields of the transactions behind (event_id, user_id, event_type, k, start_ms) rows, batch or stream."""
    def hx(*parts):
        return F.substring(sha(*parts), 1, 24)
    ev, et, k = F.col("event_id"), F.col("event_type"), F.col("k")
    e = e.withColumn("week", F.floor(F.col("start_ms") / WEEK_MS).cast("bigint")).withColumn("r", h32("kind", ev))
    odd = F.col("r") % 2 == 1
    art, doc = hx("art", ev % 7), hx("doc", ev % 200)
    page = F.concat(F.lit("/documents?page="), (k % 3).cast("string"))
    e = e.select(
        "*", hx("ep", F.col("user_id"), F.col("week")).alias("episode_id"),
        hx("gr", F.floor(F.col("user_id") / 3).cast("bigint"), F.col("week")).alias("group_id"),
        F.element_at(lit_array(("human", "script", "agent")), (F.col("user_id") % 3 + 1).cast("int")).alias("origin"),
        hx("rq", ev).alias("request_id"), hx("ac", F.col("user_id"), ev % 2).alias("actor_id"),
        F.when(et.isin("view", "click", "error"), "GET").when((et == "signup") & ~odd, "PUT").otherwise("POST").alias("method"),
        F.when(et.isin("view", "error"), page).when(et == "purchase", "/exports").when((et == "signup") & odd, "/session")
        .when(et.isin("click", "signup") & ~odd, F.concat(F.lit("/artifacts/"), art)).otherwise(F.concat(F.lit("/documents/"), doc)).alias("path"),
        F.when(et == "error", F.when(odd, 503).otherwise(429)).when(et.isin("signup", "purchase"), 201).otherwise(200).alias("status"),
        (F.col("start_ms") + h32("sv", ev) % 20).alias("service_ms"),
        (ev % 5 + 1).alias("version"),
        F.when(et.isin("click", "signup") & ~odd, art).when(et == "error", F.lit(None)).otherwise(doc).alias("resource_id"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (ev % 250 + 1).cast("string")).alias("src_ip"),
        (ev % 60000 + 1024).alias("src_port"))
    e = e.withColumn("completed_ms", F.col("service_ms") + 1 + h32("cp", ev) % 500)
    e = e.withColumn("retry_after_ms", F.when(et == "error", k * 10))
    e = e.withColumn("request_body", F.when(F.col("method") == "GET", "{}").otherwise(
        F.format_string('{"if_version":%d,"value":%d}', F.col("version"), k)))
    e = e.withColumn("response_body", F.when(et == "error", F.format_string('{"error":"busy","retry_after_ms":%d}', k * 10)).otherwise(
        F.format_string('{"id":"%s","secret":"s%d","value":%d,"version":%d}', F.col("resource_id"), k, k, F.col("version"))))
    e = e.withColumn("request_bytes", F.octet_length("request_body").cast("bigint")).withColumn("response_bytes", F.octet_length("response_body").cast("bigint"))
    e = e.withColumn("request_collected_ms", F.col("start_ms") + h32("rc", ev) % 400)
    e = e.withColumn("response_collected_ms", F.col("completed_ms") + h32("pc", ev) % 400)
    g = h32("split", F.col("group_id")) % 10
    e = e.withColumn("split", F.when(g < 6, "train").when(g == 6, "calibration").when(g == 7, "development").otherwise("test"))
    e = e.withColumn("regime", F.when((g >= 7) & (h32("regime", F.col("group_id")) % 4 == 0), "heldout_task").otherwise("iid"))
    return e.withColumn("family", F.element_at(lit_array(("triage", "export", "review", "sync")), (F.col("week") % 4 + 1).cast("int"))).drop("r")

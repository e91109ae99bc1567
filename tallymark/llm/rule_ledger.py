"""Quality rules as a bitmask ledger: measure once, keep one failure bit per rule, apply policies and ablations to the bits.

Everything is built-in expressions over the document's own row, so a ledger needs no shuffle; policies and ablations read
only the ledger.
"""
from pyspark.sql import functions as F

from .common import SPACE, let, no_clash, text_of, words

# name -> failing condition over the measures; the position is the bit
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "upper_case": "100 * n_upper > 60 * word_chars",
    "word_length": "word_chars > 30 * n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES = {"v1": BASE, "v2": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def mask(names):
    """Bits of the named rules."""
    order = list(RULES)
    return sum(1 << order.index(n) for n in set(names))


def _repeat_words(w):
    """Positions of `w` inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash; only texts with
    a repeated hash sort theirs."""
    def count(h):
        order = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.filter(
            F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"])), lambda i: i.isNotNull()))
        covered = F.array_distinct(F.flatten(F.transform(order, lambda i: F.array(i, i + 1, i + 2))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(covered))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, count))


def measure(docs, text="text"):
    """Adds the columns of MEASURES (long); columns of these names are replaced. Null texts measure as empty ones."""
    t = text_of(text)

    def of_words(w):
        chars = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x))
        return F.struct(F.size(w).alias("n_words"), chars.alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))
    filled = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    measured = no_clash(docs, *MEASURES).select("*", let(words(t), of_words).alias("_w"), let(filled, of_lines).alias("_l"),
                                                 F.regexp_count(t, F.lit(r"[#*$%&|<>]")).alias("_s"), F.regexp_count(t, F.lit(r"\p{Lu}")).alias("_u"))
    value = {"n_symbols": F.col("_s"), "n_upper": F.col("_u"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")}
    return measured.select("*", *[(value[m] if m in value else F.col(f"_w.{m}")).cast("bigint").alias(m) for m in MEASURES]).drop("_w", "_l", "_s", "_u")


def ledger(docs, text="text"):
    """The documents' columns with all measures and `failed_bits` (long). Null, empty and blank texts fail few_words only;
    repeated rows get equal entries; an empty table gives an empty ledger."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return no_clash(measure(docs, text), "failed_bits").withColumn("failed_bits", total)


def apply_policy(entries, policy="v2", name="kept"):
    """Adds `name`: true where no rule of the policy failed. A policy is a key of POLICIES or a list of rule names."""
    m = mask(POLICIES[policy] if isinstance(policy, str) else policy)
    return entries.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint")) == 0)


def ablation(entries, policy="v2"):
    """Per rule of the policy: how many documents fail it, how many only it rejects, and how many survive without it. The
    ledger is reduced to one count per bit pattern, at most 2**rules rows, before the rules are looked at."""
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    m = mask(names)
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("bigint").alias("bit")) for n in names]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    others = F.lit(m).cast("bigint").bitwiseXOR(F.col("bit"))
    return each.groupBy("rule").agg(total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(F.col("bits") == F.col("bit")).alias("only_this"),
                                    total(F.col("bits").bitwiseAND(others) == 0).alias("kept_without"))

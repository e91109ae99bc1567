"""Column expressions over probability and logit arrays. Indices are zero-based, as in the data model."""
from pyspark.sql import functions as F

from .text import _c

FLOOR = 1e-9   # probability floor used by every log (fixed value)


def let(value, fn):
    """Bind an expression once inside a larger one, so that it is not evaluated per element of a lambda."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def settled(p):
    """Probabilities rounded to nine decimals: derived tables must agree between engines to the last bit, because operators
    compare and order them as they are."""
    return F.transform(p, lambda x: F.round(x, 9))


def asum(arr):
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x)


def at(arr, idx0):
    return F.element_at(_c(arr), (_c(idx0) + 1).cast("int"))


def argmax0(p):
    """First maximum wins."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


def softmax(z, temperature=1.0):
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return let(F.array_max(_c(z)), lambda m: let(
        F.transform(_c(z), lambda x: F.exp((x - m) / t)),
        lambda e: let(asum(e), lambda s: F.transform(e, lambda x: x / s))))


def floor_log(p, floor=FLOOR):
    return F.transform(_c(p), lambda x: F.log(F.greatest(x, F.lit(floor))))


def nll_logits(z, label, temperature=1.0):
    """log-sum-exp form of the negative log likelihood at a temperature."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return let(F.array_max(_c(z)), lambda m:
               F.log(F.aggregate(_c(z), F.lit(0.0), lambda a, x: a + F.exp((x - m) / t))) - (at(z, label) - m) / t)


def nll_probs(p, label, floor=FLOOR):
    return -F.log(F.greatest(at(p, label), F.lit(floor)))


def brier(p, label):
    return asum(F.transform(_c(p), lambda x, i: F.pow(x - F.when(i == _c(label), 1.0).otherwise(0.0), F.lit(2.0))))


def mean_level(p):
    return asum(F.transform(_c(p), lambda x, i: x * i))


def rps(p, label):
    """Mean squared difference of the cumulative distributions over the first L-1 levels."""
    steps = F.aggregate(
        F.transform(F.slice(_c(p), 1, F.size(_c(p)) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")),
        lambda a, v: F.struct((a["c"] + v["x"]).alias("c"),
                              (a["s"] + F.pow(a["c"] + v["x"] - F.when(v["i"] >= _c(label), 1.0).otherwise(0.0),
                                              F.lit(2.0))).alias("s")))
    return steps["s"] / (F.size(_c(p)) - 1)


def realign(values, from_keys, to_keys):
    """Values reordered from one key order to another (keys are unique inside a question)."""
    return F.transform(_c(to_keys), lambda k: F.element_at(_c(values), F.array_position(_c(from_keys), k).cast("int")))


def max_abs_delta(a, b):
    return F.array_max(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


TIE_NUDGE = 1.2e-9   # moves exact halves off the rounding boundary, where engines that differ in the last bit would part


def r6(col, name=None):
    """Six decimals for comparison with another engine."""
    # adding 0.0 turns a rounded -0.0 into 0.0, so that equal numbers print and hash alike
    c = F.round(_c(col).cast("double") + F.lit(TIE_NUDGE), 6) + F.lit(0.0)
    return c.alias(name) if name else c

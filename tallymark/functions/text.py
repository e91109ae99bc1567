"""Text normal form, digests and hash-derived uniforms (all JVM-side)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space plus the four ASCII separators that Python's str.split() treats as blanks (fixed values)
WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# what `collapse` has to change: every run of blanks but the single plain space. Most characters are printable ASCII, which the
# first part refuses at once
BLANK = rf"[[^\x{{21}}-\x{{7e}}]&&{WS[:-1]}]"
CHANGED = rf"[{BLANK}&&[^ ]]{BLANK}*| {BLANK}+"


def collapse(col):
    """Whitespace runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), CHANGED, " "))


def norm_text(col):
    """Case-folded, whitespace-collapsed text. Folding = lower case plus the three common full-fold letters
    (sharp s, long s, final sigma); other multi-letter folds are left as `lower` gives them."""
    folded = F.lower(_c(col))
    for letter, plain in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):            # searched as bytes; `translate` looks up every character
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return collapse(folded)


def state_key(col):
    return F.sha2(norm_text(col), 256)


def h32(*parts):
    """First eight hex digits of sha256 over ':'-joined parts, as a bigint in [0, 2**32)."""
    return F.conv(F.substring(sha(*parts), 1, 8), 16, 10).cast("bigint")


def h60(*parts):
    """First fifteen hex digits of sha256 over ':'-joined parts, as a bigint in [0, 2**60)."""
    return F.conv(F.substring(sha(*parts), 1, 15), 16, 10).cast("bigint")


def sha(*parts):
    joined = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.sha2(joined, 256)


def uniform(*parts):
    return h32(*parts) / F.lit(4294967296.0)


def words(col):
    """Whitespace-separated words of the text (the built-in size counter is their number)."""
    return F.filter(F.split(collapse(col), " "), lambda w: w != "")


def word_count(col):
    t = collapse(col)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("bigint")


def first_words(col, n):
    return F.array_join(F.slice(words(col), 1, n), " ")

"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

The composition's states before the edit are pairs (q, q) of one acceptor state, so a state is known by the stem that leads to it.
The vocabulary is dealt by such initial states. A state whose continuations fit into one task is composed there: the minimal
acceptor of the continuations is built, the transducer copies symbols up to the edit, and after it both tracks must accept the
same rest, which is looked up per pair of states. A state with more continuations is stepped over by Spark: the edit at
this very state leads to post-edit states that accept the same rest, which is a grouping by (stem, rest), and the copied symbol
leads to longer stems. Every pair has one edit place, the length of its common prefix, and is counted there only.
No pairs are emitted: a task or a grouping adds up, per word, how many words are near and which is the largest.
"""
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import small_side, stored, text_of

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_WORDS = 2_000          # continuations composed in one task
MOST_CHARS = 1_000_000       # and their characters


def runs(docs):
    """doc_id, run: every maximal run of letters of the texts, A-Z in lower case. Null texts have none."""
    found = F.regexp_extract_all(F.translate(text_of("text"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(rows, divisor=199):
    """run: as it is, or without one code point where `divisor` divides the crc32 of `<doc_id>:<run>`. Rows without a doc_id are
    left as they are."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("_h"), F.char_length("run").cast("bigint")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return rows.withColumn("_h", h).select(F.when(F.col("_h") % divisor == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(rows, least_length=6, least_count=5):
    """word, n: the distinct runs of at least `least_length` code points and `least_count` occurrences."""
    long_enough = rows.filter(F.char_length("run") >= least_length)
    return long_enough.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words, built in one pass: states that accept the same rests are one.
    `arcs[q]` maps symbols to states, `final[q]` tells whether the empty rest is accepted."""

    def __init__(self, words):
        self.arcs, self.final, self._known = [], [], {}
        path, before = [({}, False)], ""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._freeze(path, before, same)
            path += [({}, False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            before = word
        self._freeze(path, before, 0)
        self.start = self._state(*path[0])

    def _state(self, arcs, final):
        key = (final, tuple(arcs.items()))
        q = self._known.get(key)
        if q is None:
            q = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return q

    def _freeze(self, path, word, keep):
        while len(path) > keep + 1:
            q = self._state(*path.pop())
            path[-1][0][word[len(path) - 1]] = q

    def rests(self, p, q, known):
        """The words that both states accept, as a list; `known` keeps the answers per pair. Symbols are followed only where both
        states have them, on a stack instead of by recursion."""
        p, q = min(p, q), max(p, q)
        stack = [(p, q)]
        while stack:
            a, b = pair = stack[-1]
            if pair in known:
                stack.pop()
                continue
            less, more = (self.arcs[a], self.arcs[b]) if len(self.arcs[a]) <= len(self.arcs[b]) else (self.arcs[b], self.arcs[a])
            steps = [(s, (min(t, more[s]), max(t, more[s]))) for s, t in less.items() if s in more]
            ahead = [x for _, x in steps if x not in known]
            if ahead:
                stack += ahead
                continue
            stack.pop()
            known[pair] = ([""] if self.final[a] and self.final[b] else []) + [s + rest for s, x in steps for rest in known[x]]
        return known[p, q]


def near_pairs(words):
    """Pairs of the sorted distinct words that differ by one inserted, deleted or replaced code point, each once."""
    acceptor, known = Acceptor(words), {}
    stack = [("", acceptor.start)]
    while stack:
        stem, q = stack.pop()
        arcs = list(acceptor.arcs[q].items())
        for i, (a, p) in enumerate(arcs):
            for b, r in arcs[i + 1:]:                                # a replaced by b
                for rest in acceptor.rests(p, r, known):
                    yield stem + a + rest, stem + b + rest
            for rest in acceptor.rests(p, q, known):                # a deleted; not where the next symbol is a as well: that is one place later
                if not rest.startswith(a):
                    yield stem + a + rest, stem + rest
            stack.append((stem + a, p))


def _compose(batches):
    """Rows sorted by (stem, rest) become (word, n_near, best): the best near word is the one with the largest count, then the least."""
    stem, rows = None, []

    def joined():
        found = {}
        count = {rest: n for rest, _, n in rows}
        for pair in near_pairs([rest for rest, _, _ in rows]):
            for x, y in (pair, pair[::-1]):
                k, best = found.get(x, (0, None))
                mine = (-count[y], y)
                found[x] = (k + 1, mine if best is None or mine < best else best)
        whole = {rest: word for rest, word, _ in rows}
        words = [whole[x] for x in found]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([k for k, _ in found.values()], pa.int64()), pa.array([-b[0] for _, b in found.values()], pa.int64()),
                                           pa.array([whole[b[1]] for _, b in found.values()], pa.string())], ["word", "n_near", "form_n", "form"])
    for batch in batches:
        for s, rest, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if s != stem and rows:
                yield joined()
                rows = []
            stem = s
            rows.append((rest, word, n))
    if rows:
        yield joined()


@lru_cache(maxsize=1)
def _common_prefix():
    """Length of the common prefix of two strings, in code points. It runs once per state that is stepped over."""
    @F.udf(LongType(), useArrow=True)
    def common(a, b):
        n = min(len(a), len(b))
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
        return lo
    return common


def _digest(*parts):
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary"))


NEAR = "word string, n_near bigint, form_n bigint, form string"


def near_words(vocab, most_words=MOST_WORDS, most_chars=MOST_CHARS):
    """word, n_near, form_n, form of every word of `vocab` (distinct word, n) that has a near word: how many there are, and the one
    of largest n (ties: the least in code-point order). Initial states with more than `most_words` continuations, or `most_chars`
    characters, are stepped over as often as needed."""
    rows = vocab.select("word", "n", F.lit(0).cast("bigint").alias("k"), F.lit("").alias("stem"))
    parts = []
    while True:
        states = rows.groupBy("stem").agg(F.count(F.lit(1)).alias("_words"), F.sum(F.char_length("word") - F.col("k")).alias("_chars"), F.min("word").alias("_lo"), F.max("word").alias("_hi"))
        states = states.filter("_words > 1").withColumn("_large", (F.col("_words") > most_words) | (F.col("_chars") > most_chars))
        states = states.withColumn("_common", F.when(F.col("_large"), _common_prefix()("_lo", "_hi"))).select(F.col("stem").alias("_stem"), "_large", "_common")
        states = stored(states, "states")
        rows = stored(rows.join(small_side(states, 100), F.col("stem") == F.col("_stem")).drop("_stem"), "continuations")
        ready = rows.filter("not _large").select("stem", F.expr("substring(word, cast(k + 1 as int))").alias("rest"), "word", "n")
        parts.append(ready.repartition("stem").sortWithinPartitions("stem", "rest").mapInArrow(_compose, NEAR))
        large = rows.filter("_large").select("word", "n", F.col("_common").alias("k"), F.expr("substring(word, 1, cast(_common as int))").alias("_copied"))
        if not states.filter("_large").limit(1).count():
            break
        # the edit at this state: one symbol is read (replaced, or deleted) or none (deleted on the other track), then the rests agree
        symbol = F.when(F.char_length("word") > F.col("k"), F.expr("substring(word, cast(k + 1 as int), 1)"))
        after = F.when(symbol.isNotNull(), F.struct(symbol.alias("symbol"), _digest("k", "_copied", F.expr("substring(word, cast(k + 2 as int))")).alias("state")))
        none = F.struct(F.lit(None).cast("string").alias("symbol"), _digest("k", "_copied", F.expr("substring(word, cast(k + 1 as int))")).alias("state"))
        first = F.expr("substring(word, cast(k + 1 as int), 1)")         # of the rest, on the track that reads nothing
        edits = large.withColumn("_first", first).withColumn("_edit", F.explode(F.array(after, none))).filter("_edit is not null")
        edits = edits.select("word", "n", F.col("_edit.symbol").alias("symbol"), F.col("_edit.state").alias("state"), F.when(F.col("_edit.symbol").isNull(), F.col("_first")).alias("_first"))
        parts.append(_same_rest(edits))
        rows = stored(large.filter(F.char_length("word") > F.col("k")).select("word", "n", (F.col("k") + 1).alias("k"), _digest(F.expr("substring(word, 1, cast(k + 1 as int))")).alias("stem")), "longer-stems")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return found.select("word", "n_near", (-F.col("_best.m")).alias("form_n"), F.col("_best.form").alias("form"))


def _same_rest(edits):
    """Near words among rows of one post-edit state: all with different symbols, and the one word without a symbol with those whose
    symbol its rest doesn't begin with. A state has one row per symbol of the alphabet at most."""
    group = Window.partitionBy("state")
    mine = F.struct((-F.col("n")).alias("m"), F.col("word").alias("word"), F.col("symbol").alias("symbol"), F.col("_first").alias("first"))
    rows = edits.withColumn("_all", F.collect_list(mine).over(group)).filter(F.size("_all") > 1)
    # a replaced symbol differs; a deleted one is not followed by itself
    near = F.filter("_all", lambda o: F.when(F.col("symbol").isNull(), o["symbol"].isNotNull() & (o["symbol"] != F.col("_first"))).when(
        o["symbol"].isNull(), o["first"] != F.col("symbol")).otherwise(o["symbol"] != F.col("symbol")))
    rows = rows.withColumn("_near", near).filter(F.size("_near") > 0).withColumn("_best", F.array_min("_near"))
    return rows.select("word", F.size("_near").cast("bigint").alias("n_near"), (-F.col("_best.m")).alias("form_n"), F.col("_best.word").alias("form"))


def _roots(links):
    """word, root: the last word that forms lead to, for every word with a form (word, form). Each round doubles the steps."""
    steps = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = stored(steps.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
        steps = moved.select("word", "root")
        if not moved.filter("_moved").limit(1).count():
            return steps


def spelling_variants(vocab, share=5, **limits):
    """word, form, root, n, n_near, form_n of every word of `vocab` (word, n).

    Near are words that differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties:
    the least) where that is at least `share` times the word's own, else null; root follows the forms to the last (a form has a
    larger n, so there is no circle), the word itself if it has none. Null words and counts are left out, repeated words added up."""
    vocab = stored(vocab.filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    near = near_words(vocab, **limits).withColumnRenamed("word", "_word")
    out = vocab.join(near, F.col("word") == F.col("_word"), "left").drop("_word")
    fits = F.col("form_n") >= share * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms-of-words")
    roots = _roots(out.filter("form is not null")).withColumnRenamed("word", "_word")
    out = out.join(roots, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of_texts(docs, divisor=199, least_length=6, least_count=5, **how):
    """`spelling_variants` over the runs of letters of `docs` (doc_id, text), with the errors that `misspelt` plants. Empty tables and
    null or empty texts give no words; columns beyond the two are not read; rows that repeat count each for itself."""
    return spelling_variants(vocabulary(misspelt(runs(docs.select("doc_id", "text")), divisor), least_length, least_count), **how)

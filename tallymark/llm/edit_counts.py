"""Token counts that follow edits: a tree of pre-token sums per document, of which an edit rebuilds only what it touches.

A byte-level vocabulary never merges across pre-tokens, and the pre-token pattern reads a text from left to right without
looking back. So an edit can change only pre-tokens from shortly before its start (the pattern looks a few characters ahead)
up to the first place where old and new boundaries meet again behind it. These are encoded anew; everything else keeps its
counts, and the sums above the touched leaves are corrected.
"""
import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from .common import no_clash, text_of, tokenizer_path

LOOKAHEAD = 4               # characters behind a pre-token that its match may depend on, at most
LEAF = 256                  # pre-tokens of a fresh leaf; a leaf is split beyond twice as many
MOST_PIECES = 1_000_000
LONGEST_HELD = 64           # characters of a pre-token that is kept
EDIT_TYPE = "array<struct<start:bigint,length:bigint,insert:string>>"


class _Counts(dict):
    """Tokens of a pre-token, encoded once; long ones are rare and encoded each time, so that the bytes held are bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        if len(piece) > LONGEST_HELD:
            return len(self.encode(piece))
        if len(self) >= MOST_PIECES:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=2)
def counter(ranks, pattern):
    """(pre-token pattern, token counts) of a tiktoken rank file's content."""
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return regex.compile(pattern), _Counts(encoding.encode_ordinary)


class TokenTree:
    """Leaves hold the character and token numbers of up to 2 * LEAF pre-tokens; a binary tree holds the sums of leaves."""

    def __init__(self, chars, tokens):
        cuts = range(0, len(chars), LEAF)
        self.leaves = [np.array([chars[i:i + LEAF], tokens[i:i + LEAF]], np.int64) for i in cuts] or [np.zeros((2, 0), np.int64)]
        self._build()

    def _build(self):
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size, self.sums = size, np.zeros((2 * size, 2), np.int64)
        self.sums[size:size + len(self.leaves)] = [leaf.sum(axis=1) for leaf in self.leaves]
        for half in (size >> k for k in range(1, size.bit_length())):
            self.sums[half:2 * half] = self.sums[2 * half:4 * half:2] + self.sums[2 * half + 1:4 * half:2]

    def _refresh(self, leaf):
        at = self.size + leaf
        self.sums[at] = self.leaves[leaf].sum(axis=1)
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    @property
    def tokens(self):
        return int(self.sums[1, 1])

    @property
    def chars(self):
        return int(self.sums[1, 0])

    def find(self, position):
        """(leaf, index in it, first character) of the pre-token that holds a character position; the end for later ones."""
        if position >= self.chars:
            last = len(self.leaves) - 1
            return last, self.leaves[last].shape[1], self.chars
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if position - before >= self.sums[at, 0]:
                before += int(self.sums[at, 0])
                at += 1
        leaf = at - self.size
        ends = np.cumsum(self.leaves[leaf][0])
        k = int(np.searchsorted(ends, position - before, side="right"))
        return leaf, k, before + int(ends[k] - self.leaves[leaf][0, k])

    def boundaries(self, leaf, k, start):
        """Pre-token starts from a place on: (leaf, index, character), the end of the text last."""
        while leaf < len(self.leaves):
            row = self.leaves[leaf][0]
            while k < len(row):
                yield leaf, k, start
                start += int(row[k])
                k += 1
            leaf, k = leaf + 1, 0
        yield len(self.leaves) - 1, self.leaves[-1].shape[1], start

    def replace(self, first, last, chars, tokens):
        """Puts new pre-tokens in place of those from `first` up to, without, `last` (both (leaf, index))."""
        (a, i), (b, j) = first, last
        fresh = np.concatenate([self.leaves[a][:, :i], np.array([chars, tokens], np.int64).reshape(2, -1), self.leaves[b][:, j:]], axis=1)
        if a == b and fresh.shape[1] <= 2 * LEAF:
            self.leaves[a] = fresh
            self._refresh(a)
            return
        parts = [fresh[:, k:k + LEAF] for k in range(0, fresh.shape[1], LEAF)]
        self.leaves[a:b + 1] = parts
        if not self.leaves:
            self.leaves = [np.zeros((2, 0), np.int64)]
        self._build()

    def pack(self):
        both = np.concatenate(self.leaves, axis=1).astype("<u4")
        return struct.pack("<I", both.shape[1]) + both.tobytes()

    @classmethod
    def unpack(cls, data):
        n = struct.unpack_from("<I", data)[0]
        both = np.frombuffer(data, "<u4", 2 * n, 4).reshape(2, n)
        return cls(both[0], both[1])


def build(text, pattern, counts):
    parts = pattern.findall(text)
    return TokenTree(np.fromiter(map(len, parts), np.int64, len(parts)), np.fromiter(map(counts.__getitem__, parts), np.int64, len(parts)))


def apply_edit(text, tree, start, length, insert, pattern, counts):
    """(edited text, pre-tokens encoded anew); the tree is changed in place. Positions outside the text are moved to its ends."""
    s = min(max(start or 0, 0), len(text))
    e = min(s + max(length or 0, 0), len(text))
    insert = insert or ""
    edited = text[:s] + insert + text[e:]
    shift = len(edited) - len(text)
    leaf, k, anchor = tree.find(max(0, s - LOOKAHEAD))
    old = tree.boundaries(leaf, k, anchor)
    at = next(old)
    chars, tokens, here = [], [], anchor
    matches = pattern.finditer(edited, anchor)
    while True:
        while at[2] + shift < here or at[2] < e:
            nxt = next(old, None)
            if nxt is None:
                break
            at = nxt
        if here >= s + len(insert) and at[2] >= e and at[2] + shift == here:
            break
        match = next(matches, None)
        if match is None:
            at = (len(tree.leaves) - 1, tree.leaves[-1].shape[1], tree.chars)
            break
        part = match.group()
        chars.append(len(part))
        tokens.append(counts[part])
        here = match.end()
    tree.replace((leaf, k), at[:2], chars, tokens)
    return edited, len(chars)


def _run(model, pattern, with_state):
    def run(batches):
        find, counts = counter(model.value, pattern)
        for batch in batches:
            texts, edits, states = (batch.column(c).to_pylist() for c in ("_text", "_edits", "_tree"))
            out = []
            for text, changes, state in zip(texts, edits, states):
                tree = build(text, find, counts) if state is None else TokenTree.unpack(state)
                before, pieces, anew = tree.tokens, sum(x.shape[1] for x in tree.leaves), 0
                for c in changes or ():
                    if c is not None:
                        text, n = apply_edit(text, tree, c["start"], c["length"], c["insert"], find, counts)
                        anew += n
                out.append((before, tree.tokens, pieces, anew) + ((text, tree.pack()) if with_state else ()))
            columns = list(zip(*out)) or [()] * (6 if with_state else 4)
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())] if with_state else [])
            rest = [c for c in batch.schema.names if c not in ("_text", "_edits", "_tree")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *arrays], [*rest, "n_tokens", "n_tokens_edited", "n_pretokens", "n_encoded_anew", *(["edited", "tree"] if with_state else [])])
    return run


def count_edits(docs, edits="edits", text="text", tree=None, ranks=None, pattern=None, with_state=False):
    """Applies the edits of every row's own list, in order, to its text and counts tokens before and after.

    `edits` names a column array<struct<start, length, insert>>, each edit in characters of the text as it then is; `tree`
    names a column with an earlier result's tree, else the tree is built here. Returns the other columns with n_tokens,
    n_tokens_edited, n_pretokens and n_encoded_anew (pre-tokens that the edits made it encode) and, with `with_state`, the edited text and its tree for the
    next round. Null texts count as empty, null edits and null fields change nothing, positions are moved into the text.
    Every document is a row of its own, so no key gathers others; columns named as the new ones are replaced."""
    import public_tokenizers
    with open(ranks or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["n_tokens", "n_tokens_edited", "n_pretokens", "n_encoded_anew", *(["edited"] if with_state else [])]
    state = F.col(tree) if tree else F.lit(None).cast("binary")
    work = docs.select("*", text_of(text).alias("_text"), F.col(edits).cast(EDIT_TYPE).alias("_edits"), state.alias("_tree"))
    work = no_clash(work.drop(text, edits, *([tree] if tree else []), *(["tree"] if with_state else [])), *names)
    rest = [f for f in work.schema.fields if f.name not in ("_text", "_edits", "_tree")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["n_tokens bigint, n_tokens_edited bigint, n_pretokens bigint, n_encoded_anew bigint" + (", edited string, tree binary" if with_state else "")])
    return work.mapInArrow(_run(model, pattern or public_tokenizers.PATTERN, with_state), schema)

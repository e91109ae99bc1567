"""Piece encoding and decoding: the best-scoring segmentation into vocabulary pieces (Viterbi) over a double-array trie.

A text is prefixed with a blank, blanks become the marker U+2581, and the pieces of the segmentation with the greatest sum of
log scores are its tokens; characters that no piece covers become byte pieces. No piece has a marker after another
character, so a segmentation never crosses from a character to a following marker: every such unit is solved on its own, once
per worker, and many units at a time - the trie is walked for all of them in step.

The vocabulary may be of either kind. Where its scores are merge ranks (0, -1, -2, ...) instead of log probabilities, the
log score of rank r is -log(r + 2) less the logarithm of the vocabulary size: frequent, early-merged pieces stay cheaper and fewer pieces win.
"""
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import no_clash, text_of, tokenizer_path
from .units import UnitTable, grouped

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
TEXT_COLUMN = "text"
LONG_UNIT, STRETCH = 2048, 1 << 16      # bytes of a unit that is solved alone, and of its text solved at once
WINDOW = 4096              # places tried at once when a trie node is laid out


class DoubleArray:
    """Trie of byte strings in two arrays: the child of state s by byte b is base[s] + b, valid where check there is s."""

    def __init__(self, keys, values):
        children = [{}]
        ends = [-1]
        for key, value in zip(keys, values):
            s = 0
            for b in key:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][b]
            ends[s] = value
        size = 2 * len(children) + 4096
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], value[0], empty = 0, ends[0], np.ones(size, bool)
        empty[0] = False
        first, place, queue = 1, {0: 0}, deque([0])
        while queue:
            node = queue.popleft()
            kids, s = children[node], place[node]
            if not kids:
                continue
            codes = sorted(kids)
            start = max(1, first - codes[0])
            while True:
                while start + WINDOW + 512 > len(check):
                    base, check, value = (np.concatenate([a, np.full(len(a), f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                    empty = np.concatenate([empty, np.ones(len(empty), bool)])
                fits = np.logical_and.reduce([empty[start + c:start + c + WINDOW] for c in codes])
                if fits.any():
                    start += int(fits.argmax())
                    break
                start += WINDOW
            base[s] = start
            for b in codes:
                t = start + b
                check[t], value[t], empty[t], place[kids[b]] = s, ends[kids[b]], False, t
                queue.append(kids[b])
            while not empty[first]:
                first += 1
        pad = 256                                              # a child's slot is always inside the arrays
        base, check, value = (np.concatenate([a, np.full(pad, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
        self.base, self.check, self.value = base, check, value


class Vocabulary:
    """Pieces, log scores and byte pieces of a SentencePiece model file's content, with the trie of its ordinary pieces."""

    def __init__(self, model):
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.vocab_size()
        self.pieces = [p.id_to_piece(i).encode() for i in range(n)]
        kind = [("byte" if p.is_byte(i) else "control" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "piece") for i in range(n)]
        scores = np.array([p.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if kind[i] == "piece"]
        usable = scores[plain]
        if len(usable) and usable.max() <= 0 and (usable == np.round(usable)).all():     # merge ranks; user-defined pieces lie far below
            scores = -np.log(np.where(scores < -n, 0.0, -scores) + 2.0) - np.log(n)
        self.scores = scores
        self.unknown_score = float(scores[plain].min()) - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, p.unk_id(), np.uint32)
        self.bytes_of = {}
        for i in range(n):
            if kind[i] == "byte":
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
                self.bytes_of[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif kind[i] == "piece":
                self.bytes_of[i] = self.pieces[i].replace(MARK, b" ")
        for i in plain:
            if MARK in self.pieces[i].lstrip(MARK) and self.pieces[i].replace(MARK, b""):
                head = self.pieces[i]
                while head.startswith(MARK):
                    head = head[len(MARK):]
                if MARK in head:
                    raise ValueError("a piece has a marker after another character; units cannot be split there")
        self.trie = DoubleArray([self.pieces[i] for i in plain], plain)
        self.longest = max((len(self.pieces[i]) for i in plain), default=0)

    def viterbi(self, units):
        """Ids of every unit (non-empty UTF-8 byte strings): greatest total score, on equal scores the earlier start of the
        last piece. Blanks are read as markers. All units of about one length advance together; long ones are solved alone."""
        units = [u.replace(b" ", MARK) for u in units]
        out = [None] * len(units)
        for k, u in enumerate(units):
            if len(u) > LONG_UNIT:
                out[k] = self._solve_long(u)
        order = sorted((k for k in range(len(units)) if out[k] is None), key=lambda k: len(units[k]))
        at = 0
        while at < len(order):
            width = len(units[order[at]])
            end = at + 1
            while end < len(order) and len(units[order[end]]) <= width + 4 + width // 8 and (end - at) * (width + 8) < 4_000_000:
                end += 1
            self._solve([units[k] for k in order[at:end]], order[at:end], out)
            at = end
        return out

    def _solve(self, units, names, out):
        n, lengths = len(units), np.fromiter(map(len, units), np.int64, len(units))
        width = int(lengths.max())
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width)
        inside = np.arange(width)[None, :] < lengths[:, None]
        first = ((text & 0xC0) != 0x80) & inside
        size = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        piece, came = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        rows_all = np.arange(n)
        for i in range(width):
            rows = rows_all[first[:, i]]
            if not len(rows):
                continue
            state, covered = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            live = np.arange(len(rows))
            one = size[rows, i]
            for j in range(i, min(width, i + self.longest)):
                r = rows[live]
                ok = j < lengths[r]
                nxt = base[state[live]] + text[r, j].astype(np.int64)
                ok &= check[nxt] == state[live]
                ok &= nxt > 0
                live, nxt = live[ok], nxt[ok]
                if not len(live):
                    break
                state[live] = nxt
                v = value[nxt]
                hit = v >= 0
                k, v = live[hit], v[hit]
                r = rows[k]
                covered[k] |= (j + 1 - i) == one[k]
                score = best[r, i] + self.scores[v]
                better = score > best[r, j + 1]
                r, v = r[better], v[better]
                best[r, j + 1], piece[r, j + 1], came[r, j + 1] = score[better], v, i
            k = ~covered
            r = rows[k]
            e = i + one[k]
            score = best[r, i] + self.unknown_score
            better = score > best[r, e]
            r, e = r[better], e[better]
            best[r, e], piece[r, e], came[r, e] = score[better], -1, i
        for row, name in enumerate(names):
            e, ids = int(lengths[row]), []
            while e:
                s = int(came[row, e])
                p = int(piece[row, e])
                ids.extend([p] if p >= 0 else self.byte_ids[np.frombuffer(units[row], np.uint8)[s:e]][::-1].tolist())
                e = s
            out[name] = ids[::-1]

    def _solve_long(self, unit):
        """As `_solve`, of one unit, stretch by stretch: all pieces that begin in a stretch are found in one walk down the trie from
        every character at once; the scores then run over them in order of their beginnings."""
        text = np.frombuffer(unit, np.uint8)
        n, base, check, value = len(text), self.trie.base, self.trie.check, self.trie.value
        piece, came = np.empty(n + 1, np.int32), np.empty(n + 1, np.int32)
        ahead = max(self.longest, 4) + 1
        best, by, start = [0.0], [-1], [0]
        for lo in range(0, n, STRETCH):
            hi = min(n, lo + STRETCH)
            at = lo + np.flatnonzero((text[lo:hi] & 0xC0) != 0x80)
            size = np.where(text[at] < 0x80, 1, np.where(text[at] < 0xE0, 2, np.where(text[at] < 0xF0, 3, 4)))
            live, state, covered = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            begins, ends, ids = [], [], []
            for depth in range(self.longest):
                inside = at[live] + depth < n
                live, state = live[inside], state[inside]
                nxt = base[state] + text[at[live] + depth].astype(np.int64)
                ok = (check[nxt] == state) & (nxt > 0)
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                hit = value[state] >= 0
                k = live[hit]
                covered[k] |= depth + 1 == size[k]
                begins.append(at[k]), ends.append(at[k] + depth + 1), ids.append(value[state[hit]])
            begins.append(at[~covered]), ends.append((at + size)[~covered]), ids.append(np.full(int((~covered).sum()), -1, np.int32))
            s, e, v = (np.concatenate(x) for x in (begins, ends, ids))
            w = np.where(v >= 0, self.scores[v], self.unknown_score)
            order = np.argsort(s, kind="stable")
            room = hi - lo + ahead - len(best)
            best, by, start = best + [-np.inf] * room, by + [-1] * room, start + [0] * room
            for b, e_, v_, w_ in zip((s[order] - lo).tolist(), (e[order] - lo).tolist(), v[order].tolist(), w[order].tolist()):
                score = best[b] + w_
                if score > best[e_]:
                    best[e_], by[e_], start[e_] = score, v_, b + lo
            piece[lo:hi], came[lo:hi] = by[:hi - lo], start[:hi - lo]
            best, by, start = best[hi - lo:], by[hi - lo:], start[hi - lo:]
        piece[n], came[n] = by[0], start[0]
        ids, e = [], n
        while e:
            b, p = int(came[e]), int(piece[e])
            ids.extend([p] if p >= 0 else self.byte_ids[text[b:e]][::-1].tolist())
            e = b
        return ids[::-1]

    def decode(self, ids):
        """The text of ids: pieces joined, markers as blanks, the leading blank dropped; byte pieces that are no UTF-8 become
        U+FFFD. Control pieces have no text."""
        joined = b"".join(self.bytes_of.get(i, b"") for i in ids)
        return joined[1:] if joined.startswith(b" ") else joined


@lru_cache(maxsize=2)
def vocabulary(model):
    v = Vocabulary(model)
    return v, UnitTable(v.viterbi, most=200_000, slots=1 << 19)


def unit_slices(texts):
    """(buffer, starts, ends, units per text) of byte strings: each text behind one blank, cut before every run of blanks. A
    marker in a text stands for a blank; an empty text has no unit."""
    texts = [b" " + t.replace(MARK, b" ") if t else t for t in texts]
    raw = b"".join(texts)
    blank = np.frombuffer(raw, np.uint8) == 32
    limits = np.cumsum([len(t) for t in texts])
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[np.unique(limits[limits < len(raw)])] = True
    if len(first):
        first[0] = True
    starts = np.flatnonzero(first)
    return raw, starts, np.append(starts[1:], len(raw)), np.diff(np.searchsorted(starts, limits, side="left"), prepend=0)


def _codec(model, text_at):
    def run(batches):
        vocab, coder = vocabulary(model.value)
        table = np.array([vocab.bytes_of.get(i, b"") for i in range(len(vocab.pieces))], object)
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            for lo, hi in grouped(texts):
                flat, ends = coder.encode_all(*unit_slices(texts[lo:hi]))
                parts = table[flat].tolist()
                ids, decoded, start = [], [], 0
                for end in ends.tolist():
                    ids.append(flat[start:end].astype(np.int32))
                    joined = b"".join(parts[start:end])
                    decoded.append((joined[1:] if joined.startswith(b" ") else joined).decode("utf-8", "replace"))
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for k, c in enumerate(batch.columns) if k != text_at], pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(decoded, pa.string())],
                    [*[c for k, c in enumerate(batch.schema.names) if k != text_at], "ids", "n_pieces", "ids_crc32", "decoded"])
    return run


def encode_decode(docs, model=None, text=TEXT_COLUMN):
    """Every row with its text replaced by ids (array<int>), n_pieces, ids_crc32 and decoded, the text that the ids give back.

    Decoding restores every text exactly, but that the marker U+2581 in a text comes back as a blank. Null and empty texts
    have no ids and decode to the empty text. Columns named as the new ones are replaced. `model` is the place of a model
    file on the driver; its content is broadcast (a fixed vocabulary)."""
    with open(model or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = no_clash(docs, "ids", "n_pieces", "ids_crc32", "decoded")
    rest = [f.name for f in rows.schema.fields if f.name != text]
    rows = rows.select(*rest, text_of(text).alias(text))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text], "ids array<int>, n_pieces bigint, ids_crc32 bigint, decoded string"])
    return rows.mapInArrow(_codec(content, len(rest)), schema)

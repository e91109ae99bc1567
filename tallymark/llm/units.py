"""Encoding texts by their repeated parts: each distinct unit is encoded once per worker and looked up afterwards.

Units are slices of one byte buffer. Those of up to 23 bytes are their own exact key, three 64-bit lanes with the length in
the last byte, and a whole batch is looked up at once in an open-addressing table; longer ones are rare and go through a dict.
"""
import numpy as np

MOST_UNITS = 500_000
SLOTS = 1 << 20
LONG_BYTES = 8 << 20        # of units longer than a key, held at once
LONGEST_KEY = 23
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ragged(starts, lengths):
    """Indices of the given slices, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def grouped(texts, size=1_000_000):
    """Slices (lo, hi) of a list of byte strings, each of about `size` bytes or one string."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def word_slices(texts):
    """(buffer, starts, ends, words per text) of the words of byte strings: maximal runs without the six ASCII blanks."""
    raw = b" " + b" ".join(texts) + b" "
    blank = _SPACE[np.frombuffer(raw, np.uint8)]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    return raw, starts, ends, np.diff(np.searchsorted(starts, limits, side="right"), prepend=0)


def _lanes(raw, starts, lengths):
    """Key lanes (n, 3) of slices of at most LONGEST_KEY bytes."""
    padded = raw + bytes(32)
    at = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
    keys = np.empty((len(starts), 3), np.uint64)
    for k in range(3):
        keys[:, k] = at[starts + 8 * k] & _MASKS[np.clip(lengths - 8 * k, 0, 8)]
    keys[:, 2] |= lengths.astype(np.uint64) << np.uint64(56)
    return keys


def _slots(keys):
    h = np.zeros(len(keys), np.uint64)
    for k in range(3):
        h = (h ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64)


class UnitTable:
    """Looks up id sequences of units; `encode` turns a list of new units (bytes) into a list of id lists. When `most` units are
    held, or `long_bytes` of units longer than a key, a new table is begun and the last is kept aside: frequent units move over, rare
    and long ones are forgotten, so memory stays bounded but for the units of one call. `most` is at most half the slots, so the
    table never fills. Results do not depend on it."""

    def __init__(self, encode, most=MOST_UNITS, slots=SLOTS, long_bytes=LONG_BYTES):
        self.encode, self.most, self.size, self.long_bytes = encode, min(most, slots // 2), slots, long_bytes
        self.aside = None
        self._clear()

    def _clear(self):
        self.table, self.long, self.count = np.zeros((self.size, 4), np.uint64), {}, 0
        self.held = 0                                                         # bytes in `long`
        self.start, self.length, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _begin_anew(self):
        self.aside = (self.table, self.start, self.length, self.ids)
        self._clear()

    def _room(self, name, size):
        a = getattr(self, name)
        if size > len(a):
            grown = np.zeros(max(size, len(a) + len(a) // 2), a.dtype)
            grown[:len(a)] = a
            setattr(self, name, grown)

    def _add(self, lengths, ids):
        """Appends id sequences; their rows."""
        n = self.count
        for name, size in (("start", n + len(lengths)), ("length", n + len(lengths)), ("ids", self.used + len(ids))):
            self._room(name, size)
        self.start[n:n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + len(lengths)] = lengths
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.count = n + len(lengths)
        return np.arange(n, self.count)

    def _encoded(self, units):
        codes = self.encode(units)
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        return self._add(lengths, np.fromiter((i for c in codes for i in c), np.uint32, int(lengths.sum())))

    def _find(self, table, keys):
        found, where, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), _slots(keys) & (len(table) - 1)
        while len(where):
            entry, key = table[slot], keys[where]
            used = entry[:, 3] > 0
            same = used & (entry[:, 0] == key[:, 0]) & (entry[:, 1] == key[:, 1]) & (entry[:, 2] == key[:, 2])
            found[where[same]] = entry[same, 3].astype(np.int64) - 1
            on = used & ~same
            where, slot = where[on], (slot[on] + 1) & (len(table) - 1)
        return found

    def _insert(self, keys, rows):
        """Distinct new keys."""
        slot, left = _slots(keys) & (self.size - 1), np.arange(len(keys))
        while len(left):
            free = self.table[slot, 3] == 0
            take, at = left[free], slot[free]
            self.table[at, 3] = rows[take].astype(np.uint64) + np.uint64(1)       # of several at one slot the last stays
            won = self.table[at, 3] == rows[take].astype(np.uint64) + np.uint64(1)
            self.table[at[won], :3] = keys[take[won]]
            again = ~free
            again[np.flatnonzero(free)[~won]] = True
            left, slot = left[again], (slot[again] + 1) & (self.size - 1)

    def rows(self, raw, starts, ends):
        """Row of every slice, of at most `most` slices."""
        lengths = ends - starts
        short = np.flatnonzero(lengths <= LONGEST_KEY)
        keys = _lanes(raw, starts[short], lengths[short])
        found = self._find(self.table, keys)
        missing = np.flatnonzero(found < 0)
        longer = np.flatnonzero(lengths > LONGEST_KEY)
        units = [raw[s:e] for s, e in zip(starts[longer].tolist(), ends[longer].tolist())]
        fresh = list(set(units).difference(self.long))
        if self.count and (self.count + len(missing) + len(fresh) > self.most or self.held + sum(map(len, fresh)) > self.long_bytes):
            self._begin_anew()
            fresh = list(set(units))
            missing, found = np.arange(len(short)), np.full(len(short), -1, np.int64)
        if len(missing) and self.aside:
            old = self._find(self.aside[0], keys[missing])
            have = np.flatnonzero(old >= 0)
            rows, first = np.unique(old[have], return_index=True)
            lengths_of = self.aside[2][rows]
            self._insert(keys[missing[have[first]]], self._add(lengths_of, self.aside[3][ragged(self.aside[1][rows], lengths_of)]))
            missing = missing[old < 0]
        if len(missing):
            at = {}
            for k, s, e in zip(missing.tolist(), starts[short[missing]].tolist(), ends[short[missing]].tolist()):
                at.setdefault(raw[s:e], k)
            self._insert(keys[list(at.values())], self._encoded(list(at)))
        if (found < 0).any():
            gap = np.flatnonzero(found < 0)
            found[gap] = self._find(self.table, keys[gap])
        out = np.empty(len(starts), np.int64)
        out[short] = found
        if fresh:
            self.long.update(zip(fresh, self._encoded(fresh).tolist()))
            self.held += sum(map(len, fresh))
        if units:
            out[longer] = [self.long[u] for u in units]
        return out

    def encode_all(self, raw, starts, ends, per_text):
        """(ids, ends): the ids of all texts one after the other, and where each text's end. Slices lie in order. They are looked
        up in runs of at most `most`, so one text may have any number of distinct units."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(starts), self.most):
            s, e = starts[lo:lo + self.most], ends[lo:lo + self.most]
            rows = self.rows(raw[s[0]:e[-1]], s - s[0], e - s[0])
            lengths.append(self.length[rows])
            ids.append(self.ids[ragged(self.start[rows], lengths[-1])])
        done = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(ids), done[np.cumsum(per_text)]

"""Numpy work of the repeated-substring operator: anchors, segments, and blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import numpy as np

#: Bytes of a string that counts as repeated; bytes of an anchor gram.
LENGTH, GRAM = 100, 20
_R = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words64(data: bytes, n: int) -> np.ndarray:
    """For each of the first n positions the 8 bytes from there as a big-endian number; data holds 8 bytes beyond n."""
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        count = (n - o + 7) // 8
        out[o::8] = np.frombuffer(data, ">u8", count, o)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_R), -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, r, np.uint64))]) for r in (_R, np.uint64(inverse)))


class Segmenter:
    """Cuts texts into runs of LENGTH-byte strings that share an anchor: the least-hashed gram inside the string, the
    leftmost of equals. Which gram that is depends on the string's bytes alone, so equal strings have equal anchors, and
    the offset of the anchor in the string tells strings of one run apart: no run holds a string twice."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        if not 16 <= gram < length:
            raise ValueError("a gram has 16 bytes at least and fewer than the string")
        if length - gram + 1 > 255:
            raise ValueError("a run has 255 strings at most: eight bits of a place hold their number")
        self.length, self.gram = length, gram
        self.powers = _powers(1 << 16)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """text index, start in the text, number of strings, anchor hash and digest of the bytes, for each run."""
        length, gram = self.length, self.gram
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        n = int(sizes.sum())
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        data = b"".join([*texts, bytes(gram + 8)])
        x = words64(data, n + gram - 8)
        h = x[:n] * np.uint64(0xBF58476D1CE4E5B9) + (x[gram - 16 : gram - 16 + n] ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h += x[gram - 8 : gram - 8 + n] * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(32)
        del x
        bits = np.uint64(max(n - 1, 1).bit_length())
        low = h[: n - gram + 1]
        low = ((low >> bits) << bits) | np.arange(len(low), dtype=np.uint64)
        width, done = length - gram + 1, 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        low = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # where the anchor of each string stands
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = owner[: n - length + 1] == owner[length - 1 :]
        at = np.flatnonzero(inside)
        if not len(at):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        anchor = low[at]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        begin, count = at[first], np.diff(np.append(first, len(at)))
        key = h[anchor[first]]
        return owner[begin], begin - starts[owner[begin]], count, key, self.digests(data, n, begin, begin + count + length - 1)

    def digests(self, data: bytes, n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial digest of each byte range, the same wherever the bytes stand."""
        if len(self.powers[0]) <= n:
            self.powers = _powers(2 * n)
        up, down = self.powers
        total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[np.frombuffer(data, np.uint8, n)] * up[:n], dtype=np.uint64)])
        out = (total[end] - total[begin]) * down[begin]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (end - begin).astype(np.uint64)
        return out ^ (out >> np.uint64(32))


#: A difference cover modulo 7: any two residues can be shifted by one amount (under 7) onto covered ones.
MODULUS, COVER = 7, (0, 1, 3)
#: Suffixes that are sorted at a time.
BUCKET = 250_000
_SHIFT = [[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)]


class BlockSuffixes:
    """Sorts chosen suffixes of a block of text by their first `length` bytes, one suffix bucket at a time.

    The suffixes at covered positions (3 of 7) are ranked first, to a depth of at least `length`, by doubling: positions a
    multiple of 7 apart are both covered. Then buckets of suffixes with near leading bytes are sorted one after another by
    their first 16 bytes; longer ties are resolved without looking at more text, since two tied suffixes can be shifted by
    less than 7 onto covered positions whose ranks are known. Besides the ranks only one bucket is held at a time."""

    def __init__(self, text: bytes, length: int = LENGTH):
        self.n, self.length = len(text), length
        self.words = words64(text + bytes(length + 32), self.n + length + 16)
        n = self.n
        covered = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        rank = np.zeros(n + 4 * length + 64, np.int64)  # zero beyond the text: the least
        depth = 2 * MODULUS
        order = np.lexsort((self.words[covered + depth - 8], self.words[covered]))
        rank[covered[order]] = self._dense(self.words[covered[order]], self.words[covered[order] + depth - 8])
        while depth < length:
            far = rank[covered + depth]
            order = np.lexsort((far, rank[covered]))
            rank[covered[order]] = self._dense(rank[covered[order]], far[order])
            depth *= 2
        self.rank = rank

    @staticmethod
    def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """1, 2, ... over sorted pairs, equal pairs alike."""
        return 1 + np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])

    def buckets(self, at: np.ndarray):
        """Parts of `at` that hold all suffixes of a range of leading bytes, in order; about BUCKET suffixes each."""
        if len(at) <= BUCKET:
            yield at
            return
        lead = (self.words[at] >> np.uint64(48)).astype(np.int64)  # two bytes: the counts take half a megabyte
        part = (np.cumsum(np.bincount(lead, minlength=1 << 16)) - 1) // BUCKET  # each leading value goes where its last suffix falls
        of = part[lead]
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        yield from np.split(at[order], cuts)

    def sorted_bucket(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket's suffixes in order, and whether each differs in its first `length` bytes from the one before."""
        at = at[np.lexsort((self.words[at + 8], self.words[at]))]
        a, b = self.words[at], self.words[at + 8]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new)
        tied = ~new | ~np.append(new[1:], True)
        if tied.any():
            where = np.flatnonzero(tied)
            resolved = self._by_cover(at[where], group[where])
            at[where] = at[where][resolved]  # groups keep their places; their members are put in order
            same = where[1:][(group[where][1:] == group[where][:-1])]
            equal = np.ones(len(same), bool)
            for k in [*range(16, self.length - 8, 8), self.length - 8]:
                equal &= self.words[at[same] + k] == self.words[at[same - 1] + k]
            new[same] = ~equal
        return at, new

    def _by_cover(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of tied suffixes by group, then by the cover ranks: each counts the members of its group below it."""
        residue = at % MODULUS
        members = [np.flatnonzero(residue == r) for r in range(MODULUS)]
        below = np.zeros(len(at), np.int64)
        wide = np.int64(self.rank.max() + 2)
        for b in range(MODULUS):
            if not len(members[b]):
                continue
            keys = {}
            for a in range(MODULUS):
                if not len(members[a]):
                    continue
                shift = _SHIFT[a][b]
                if shift not in keys:
                    keys[shift] = np.sort(group[members[b]] * wide + self.rank[at[members[b]] + shift])
                base = group[members[a]] * wide
                below[members[a]] += np.searchsorted(keys[shift], base + self.rank[at[members[a]] + shift]) - np.searchsorted(keys[shift], base)
        return np.lexsort((below, group))


def repeated_starts(text: bytes, at: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the strings of `length` bytes at `at` (belonging to document doc, at byte `place` there) also start
    earlier: in a document of smaller id, or in the same one at a smaller place."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    order_of = np.full(len(text), -1, np.int64)
    order_of[at] = np.arange(len(at))
    suffixes = BlockSuffixes(text, length)
    for bucket in suffixes.buckets(at):
        found, new = suffixes.sorted_bucket(bucket)
        own = order_of[found]
        kind = np.cumsum(new)
        order = np.lexsort((place[own], doc[own], kind))
        later = np.concatenate([[False], kind[order][1:] == kind[order][:-1]])
        d, p = doc[own][order], place[own][order]
        # a row written twice has equal ids and places: neither copy is the earlier one
        starts = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
        later &= (d != d[starts]) | (p != p[starts])
        out[own[order[later]]] = True
    return out

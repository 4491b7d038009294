"""Runs of repeated words: a suffix automaton with link-cut access.

Each word appended to the automaton gives a new state; the path from it over suffix links to the root
holds all suffixes of the text so far.  Every state remembers where its strings stood last, and an access
repaints the whole path with the new end.  States of one colour form stretches of a path; they are kept as
splay trees, so an append meets few of them.  A stretch of colour e, deepest length L, met at end r says
that the last L words also end at e, and nothing longer does: with q = r - e, L >= q, that is a square of
period q, and the stretch of words with this period begins exactly at r - q - L + 1.  Followed from one r to
the next, it grows to the whole run; q is its smallest period, since a smaller one would have been met as
a later end.

A run of at least max(6, 4 q) words holds each of its four-word windows twice or more.  Windows that stand
only once are found by counting over a slice of texts, again and again on what they leave, and only stretches of
repeating windows are given to an automaton.  A run lies inside one stretch, so none is lost or cut.
An automaton takes about 70 to 180 bytes a word of the stretch.

Missing and empty texts have no words and no runs; rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import in_slices, rows_of, texts_of

LEAST, TIMES = 6, 4
WINDOW = 4


class Automaton:
    """A suffix automaton whose link tree keeps, for each state, the last end of its strings.

    State 0 is the root and on no path.  A splay tree holds one painted stretch, upper states to the left; its root
    has the colour and, as parent, the state above the stretch.  The first transition of a state
    stands in arrays, further ones in dictionaries.
    """

    def __init__(self):
        self.length, self.link, self.word, self.to = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.left, self.right, self.parent, self.colour = array("i", [0]), array("i", [0]), array("i", [0]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.last, self.size = 0, 0

    def _state(self, length: int, link: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.word, -1), (self.to, 0), (self.left, 0), (self.right, 0),
                              (self.parent, link), (self.colour, -1)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def append(self, word: int) -> list[tuple[int, int]]:
        """(last end, length) of the stretches on the path of the new state: the word's number is the end."""
        r, p = self.size, self.last
        new = self._state(r + 1, 0)
        while p >= 0 and not self._next(p, word):
            self._set(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, word)
            if self.length[p] + 1 == self.length[q]:
                above = q
            else:
                above = self._clone(p, q, word)
            self.link[new] = self.parent[new] = above
        self.last, self.size = new, r + 1
        return self._access(new, r)

    def _clone(self, p: int, q: int, word: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self._next(p, word) == q:
            self._set(p, word, c)
            p = self.link[p]
        self._splay(q)  # its strings stood where those of q stood: just above q, in the same stretch
        a = self.left[q]
        self.left[c] = a
        if a:
            self.parent[a] = c
        self.left[q] = c
        self.parent[c] = q
        return c

    def _splay(self, x: int) -> None:
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        if not p or left[p] != x and right[p] != x:
            return
        top = p
        while (g := parent[top]) and (left[g] == top or right[g] == top):
            top = g
        self.colour[x] = self.colour[top]
        while True:
            p = parent[x]
            if not p or left[p] != x and right[p] != x:
                return
            g = parent[p]
            inner = bool(g) and (left[g] == p or right[g] == p)
            if inner:
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b:
            parent[b] = p
        parent[p], parent[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _access(self, v: int, r: int) -> list[tuple[int, int]]:
        met, below, x = [], 0, v
        while x:
            self._splay(x)
            e = self.colour[x]
            deeper = self.right[x]
            if deeper:
                self.colour[deeper] = e
            if e >= 0:
                met.append((e, self.length[x]))
            self.right[x] = below
            below, x = x, self.parent[x]
        self.colour[below] = r
        return met


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``times`` periods and ``least`` words or more, by start and period."""
    ids: dict = {}
    tree = Automaton()
    found: dict[tuple[int, int], int] = {}
    for r, w in enumerate(words):
        for e, length in tree.append(ids.setdefault(w, len(ids))):
            q = r - e
            if length >= (times - 1) * q and length + q >= least:
                found[e - length + 1, q] = r
    return sorted((start, r - start + 1, q) for (start, q), r in found.items())


def stretches(keys: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of the words (given as hashes) in which every four-word window stands twice or more.

    ``bounds`` are the borders of the texts, which no window crosses.  Ranges are cut down until nothing changes.
    """
    starts, ends = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    out = []
    while True:
        ok = ends - starts >= least
        starts, ends = starts[ok], ends[ok]
        if not len(starts):
            return out
        sizes = ends - starts - WINDOW + 1
        owner = np.repeat(np.arange(len(starts)), sizes)
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first, sizes) + np.repeat(starts, sizes)
        with np.errstate(over="ignore"):
            h = (owner + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(WINDOW):
                h = (h ^ keys[at + k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        whole = np.bitwise_and.reduceat(twice, first)
        out += list(zip(starts[whole].tolist(), ends[whole].tolist()))
        twice &= ~whole[owner]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
        cut = np.flatnonzero(np.diff(owner)) + 1  # a range may end where the next one's begins
        a, b = edge[::2], edge[1::2]
        inside = cut[twice[cut] & twice[cut - 1]] if len(cut) else cut
        a, b = np.sort(np.concatenate([a, inside])), np.sort(np.concatenate([b, inside]))
        starts, ends = at[a], at[b - 1] + WINDOW


def with_runs(doc_id: int, words: list) -> list:
    """The words with a periodic tail put in: for one id of ten, chosen by its checksum."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def words_of(text: str) -> list[bytes]:
    """Words parted by white space of ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _texts_with_runs(rows) -> Iterator[tuple]:
    """(doc_id, words, runs) for rows (id, text)."""
    for part in in_slices(rows, 1 << 20):
        texts = [words_of(text) if doc_id is None else with_runs(doc_id, words_of(text)) for doc_id, text in part]
        bounds = np.cumsum([0, *map(len, texts)])
        keys = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(bounds[-1])).view(np.uint64)
        found: list[list] = [[] for _ in texts]
        for a, b in stretches(keys, bounds):
            doc = int(np.searchsorted(bounds, a, "right")) - 1
            base = int(bounds[doc])
            found[doc] += [(start + a - base, length, q) for start, length, q in runs(texts[doc][a - base:b - base])]
        for (doc_id, _), words, own in zip(part, texts, found):
            yield doc_id, words, sorted(own, key=lambda x: (x[0], x[2]))


def collapsed(words: list, found: list) -> list:
    """The words without what stands behind the first period of any run."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(drop).tolist()) if not gone]


def strongest(found: list) -> tuple | None:
    """The run of the greatest length by period, compared exactly; ties: smallest start, then period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) per row of documents.

    The four numbers are those of the strongest run, missing without one.  A row without id gets no tail put in.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        types = [pa.int64()] * 6 + [pa.string()] * 2
        out = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names)
            out.clear()
            return made
        for doc_id, words, found in _texts_with_runs(rows_of(batches, "doc_id", "text")):
            best = strongest(found)
            listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
            out.append((doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            if len(out) == 2000:
                yield batch()
        yield batch()
    return texts_of(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

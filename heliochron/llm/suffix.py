"""Removal of long repeated byte strings by suffix sorting, one bucket of suffixes at a time.

A byte goes if it lies in a string of ``width`` bytes that also starts earlier: in a document with a
smaller id, or further left in the same one.  That asks for the order of all suffixes, of which only
those matter whose first ``width`` bytes occur again.  The work is laid out so that no task sees more
than a bucket:

1. Each text is cut into spans of windows that share a content-defined anchor (``anchors``).  Equal windows
   lie in spans with equal anchor hashes, so spans are dealt to buckets by that hash.  A span
   whose windows all equal those of an earlier span is settled by its 128 bits of hash: it goes.  So is, within
   a task, everything but the first of equal spans, before anything is sent.
2. Where spans with one anchor hold different windows, at the borders of repeats, their bytes are fetched
   and the suffixes that start in them are sorted: bucket by bucket of first bytes, by their first V bytes,
   longer ties by precomputed ranks of a difference-cover sample: for any two places there is a
   distance below V at which both are sampled.  Neighbours in that order with ``width`` bytes in
   common are the repeats.  Of an anchor with very many differing spans only the windows are fetched whose
   64-bit hash stands at two places: a window whose hash stands nowhere else has no equal.
3. The ranges found are joined to the texts by document.

Documents are told apart by (id, hash of the text), by the id alone if none has two texts; a missing id comes before all others.  Rows that
repeat both are one document read twice and get the same result.  Missing and empty texts, and texts
shorter than ``width``, lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import K, leftmost_smallest, run_hashes, spans
from .common import by_position, in_slices, partitions, position, rows_of, shuffles_released, stored, texts_of
from .tokens import pick_runs

V = 64
NO_ID = -1 << 63
BUCKET_BYTES = 48 << 20  # text behind a bucket of spans
SLICE = 1 << 19  # characters hashed at a time: a place takes about 70 bytes meanwhile
PACKED = 1 << 17  # spans of a task that are dealt to the buckets at once
SPLIT = 1_000  # differing spans of one anchor that go to one task; more are dealt by their windows
HELD = 4_000  # spans dealt by windows among which equal windows are settled before they are sent
CHUNK = 1 << 20  # bytes whose suffixes are sorted at a time, if one anchor or window has no more; a byte takes about 60 meanwhile


# ---- suffix order within a task ------------------------------------------------------------------

def cover(v: int = V) -> np.ndarray:
    """A difference cover modulo v: every difference d is q*r - b with b < r, q*r and b in the cover."""
    r = int(np.ceil(np.sqrt(v)))
    return np.unique(np.concatenate([np.arange(r), np.arange(0, v + r, r) % v]))


def distances(v: int = V) -> np.ndarray:
    """[i, j]: the smallest d with i + d and j + d both in the cover, modulo v."""
    inside = np.zeros(v, bool)
    inside[cover(v)] = True
    out = np.full((v, v), v, np.int64)
    i = np.arange(v)
    for d in range(v - 1, -1, -1):
        here = inside[(i + d) % v]
        out[np.ix_(here, here)] = d
    return out


class SuffixOrder:
    """Order of the suffixes of a byte text, right to at least ``depth`` bytes (all of them by default).

    Holds the text as 8-byte words and the ranks of the sampled places; buckets are sorted on demand.
    """

    def __init__(self, text: np.ndarray, depth: int | None = None, v: int = V):
        self.v, self.n = v, len(text)
        w = np.concatenate([text, np.zeros(4 * v + 16, np.uint8)]).astype(np.uint64)
        for m in (1, 2, 4):  # big-endian words of 2, 4, 8 bytes
            w = (w[:-m] << np.uint64(8 * m)) | w[m:]
        self.words, self.apart = w, distances(v)
        inside = np.zeros(v, bool)
        inside[cover(v)] = True
        sample = np.flatnonzero(inside[np.arange(self.n) % v])
        order, tie = self._by_words(sample)
        rank, reach = np.empty(len(sample), np.int64), v
        rank[np.searchsorted(sample, order)] = np.cumsum(~tie)
        self.rank = np.zeros(self.n + 2 * v, np.int64)  # what lies behind the end comes first
        self.rank[sample] = rank
        # The place ``reach`` further on is sampled too: ranks of twice the length come from pairs.
        while reach < min(self.n, depth or self.n) and rank.max(initial=0) < len(sample):
            pair = [rank, self.rank[np.minimum(sample + reach, self.n)]]
            order = np.lexsort(pair[::-1])
            new = np.ones(len(order), np.int64)
            new[1:] = (pair[0][order[1:]] != pair[0][order[:-1]]) | (pair[1][order[1:]] != pair[1][order[:-1]])
            rank[order] = np.cumsum(new)
            self.rank[sample] = rank
            reach *= 2

    def _tied(self, places: np.ndarray, at: np.ndarray, offsets) -> np.ndarray:
        """For numbers ``at`` of places: whether the words there are those of the place before."""
        ok = np.ones(len(at), bool)
        for k in offsets:
            some = np.flatnonzero(ok)
            ok[some] = self.words[places[at[some]] + k] == self.words[places[at[some] - 1] + k]
        return ok

    def _by_words(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by their first v bytes, and whether each equals the one before in them.

        Two words settle most; what they tie is sorted by the rest only where the rest differs.
        """
        places = places[np.lexsort([self.words[places + 8], self.words[places]])]
        short = np.zeros(len(places), bool)
        short[1:] = self._tied(places, np.arange(1, len(places)), (0, 8))
        at, later = np.flatnonzero(short), range(16, self.v, 8)
        tie = np.zeros(len(places), bool)
        tie[at] = self._tied(places, at, later)
        group = np.cumsum(~short) - 1
        odd = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
        odd[group[short & ~tie]] = True
        rows = np.flatnonzero(odd[group])
        if len(rows):
            some = places[rows]
            places[rows] = some[np.lexsort([*(self.words[some + k] for k in reversed(later)), group[rows]])]
            again = rows[short[rows]]
            tie[again] = self._tied(places, again, later)
        return places, tie

    def sort(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One bucket of suffixes in order, and whether each equals the one before in the first v bytes."""
        places, tie = self._by_words(places)
        joined = tie.copy()
        joined[:-1] |= tie[1:]
        rows = np.flatnonzero(joined)
        some, group = places[rows], (np.cumsum(~tie) - 1)[rows]
        kind = some % self.v
        order = np.lexsort([self.rank[some + self.apart[kind, kind]], kind, group])
        places[rows], kind = some[order], kind[order]
        mixed = np.zeros(len(rows), bool)
        mixed[1:] = (group[1:] == group[:-1]) & (kind[1:] != kind[:-1])
        for g in np.unique(group[mixed]):
            a, b = np.searchsorted(group, [g, g + 1])
            places[rows[a:b]] = self._merge(places[rows[a:b]], kind[a:b])
        return places, tie

    def _merge(self, places: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Suffixes tied to v bytes, ordered within each place modulo v: each counts those of other kinds below it."""
        cuts = np.flatnonzero(np.diff(kind)) + 1
        runs = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]))
        below = np.empty(len(places), np.int64)
        for i, (a, b) in enumerate(runs):
            below[a:b] = np.arange(b - a)
            for j, (c, d) in enumerate(runs):
                if i != j:
                    gap = self.apart[kind[a], kind[c]]
                    below[a:b] += np.searchsorted(self.rank[places[c:d] + gap], self.rank[places[a:b] + gap], "left" if i < j else "right")
        return places[np.argsort(below, kind="stable")]

    def same(self, places: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """For numbers ``at``, tied in their first v bytes: whether ``width`` bytes equal those of the place before."""
        return self._tied(places, at, [*range(self.v, width - 7, 8), width - 8] if width > self.v else [])


def repeated(text: np.ndarray, places: np.ndarray, width: int, bucket: int = 1 << 18) -> np.ndarray:
    """For increasing places: whether the ``width`` (V or more) bytes there also stand at an earlier one of the places."""
    order = SuffixOrder(text, width)
    first = order.words[places]
    cuts = np.unique(np.sort(first[:: max(1, len(first) // 4096)])[:: max(1, 4096 * bucket // max(1, len(first)))]) if len(first) > bucket else first[:0]
    which = np.searchsorted(cuts, first, "right")
    out = np.zeros(len(places), bool)
    for k in range(len(cuts) + 1):
        own = places[which == k]
        if not len(own):
            continue
        s, tie = order.sort(own)
        new = np.ones(len(s), bool)
        at = np.flatnonzero(tie)
        new[at] = ~order.same(s, at, width)
        earliest = np.minimum.reduceat(s, np.flatnonzero(new))[np.cumsum(new) - 1]
        out[np.searchsorted(places, s[s != earliest])] = True
    return out


# ---- spans: packed columns between tasks ---------------------------------------------------------

SPAN = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("s", "<i8"), ("n", "u1")])


def _pack(rows: np.ndarray) -> bytes:
    import pyarrow as pa
    raw = b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in SPAN.names)
    return len(rows).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    import pyarrow as pa
    n = int.from_bytes(data[:8], "little")
    raw, out, at = pa.decompress(data[8:], n * SPAN.itemsize, "zstd", asbytes=True), np.empty(n, SPAN), 0
    for f in SPAN.names:
        out[f] = np.frombuffer(raw, SPAN[f], n, at)
        at += n * SPAN[f].itemsize
    return out


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by (h, c, place in the corpus), repeated rows left out; and which of them have an earlier equal."""
    rows = rows[np.lexsort([rows[f] for f in ("s", "th", "doc", "c", "h")])]
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["h"][1:] == rows["h"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
    again = same.copy()
    for f in ("doc", "th", "s"):
        again[1:] &= rows[f][1:] == rows[f][:-1]
    return rows[~again], same[~again]


RANGES = "doc long, th long, s long, n int"


def _range_batch(doc, th, s, n, h=None, fan=None):
    import pyarrow as pa
    cols = [pa.array(np.asarray(v, t)) for v, t in ((doc, np.int64), (th, np.int64), (s, np.int64), (n, np.int32))]
    if h is None:
        return pa.RecordBatch.from_arrays(cols, ["doc", "th", "s", "n"])
    cols += [pa.array(np.asarray(h).view(np.int64)), pa.array(np.asarray(fan, np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["doc", "th", "s", "n", "h", "fan"])


def _runs(rows: np.ndarray) -> np.ndarray:
    """Rows of windows that repeat as ranges: n = 0 marks them, with c as the number of windows; neighbours are joined."""
    rows = rows[np.lexsort([rows[f] for f in ("s", "th", "doc")])]
    n = rows["n"].astype(np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["th"][1:] != rows["th"][:-1]) | (rows["s"][1:] != rows["s"][:-1] + n[:-1])
    out = rows[new]
    out["h"], out["n"], out["c"] = 0, 0, np.add.reduceat(n, np.flatnonzero(new)) if len(rows) else 0
    return out


def _dealt(rows: np.ndarray, gone: np.ndarray, buckets: int):
    """(bucket, spans): rows by their hash; what has been settled goes anywhere, so that common spans don't meet in one bucket."""
    import pyarrow as pa
    bucket = rows["h"] % buckets
    order = np.lexsort([rows["s"], rows["th"], rows["doc"], bucket])
    rows, edges = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges)).tolist()
    packs = [_pack(rows[edges[k]:edges[k + 1]]) for k in used]
    if len(gone):
        gone = _runs(gone)
        used, packs = [*used, int(gone["doc"][0]) % buckets], [*packs, _pack(gone)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packs, pa.binary())], ["bucket", "spans"])


def _dealt_spans(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches) -> Iterator:
        held, count = [], 0

        def dealt():
            rows, later = _classes(np.concatenate(held))
            held.clear()
            return _dealt(rows[~later], rows[later], buckets)
        for part in in_slices(((d, t, th) for d, t, th in rows_of(batches, "doc", "text", "th")), SLICE):
            raw = [r[1].encode("utf-8", "surrogatepass") for r in part]
            ends = np.cumsum([len(x) for x in raw])
            text, s, n, h, c = spans(np.frombuffer(b"".join(raw), np.uint8), ends, width)
            rows = np.empty(len(s), SPAN)
            rows["h"], rows["c"], rows["s"], rows["n"] = h, c, s, n
            rows["doc"], rows["th"] = (np.array([r[k] for r in part], np.int64)[text] for k in (0, 2))
            held.append(rows)
            count += len(rows)
            if count >= PACKED:
                yield dealt()
                count = 0
        if held:
            yield dealt()
    return texts.mapInArrow(run, "bucket int, spans binary")


def _judged(dealt: DataFrame) -> DataFrame:
    """Ranges (h missing) that repeat as a whole, and spans (h, fan) that must be looked at."""
    def judge(table):
        import pyarrow as pa
        rows = np.concatenate([_unpack(x) for x in table.column("spans").to_pylist()])
        gone = rows[rows["n"] == 0]
        rows, later = _classes(rows[rows["n"] > 0])
        first = rows[~later]
        new = np.ones(len(first), bool)
        new[1:] = first["h"][1:] != first["h"][:-1]
        kinds = np.diff(np.append(np.flatnonzero(new), len(first)))[np.cumsum(new) - 1] if len(first) else np.zeros(0, np.int64)
        open_ = first[kinds > 1]
        fan = -(-kinds[kinds > 1] // SPLIT)
        doc, th, s = (np.concatenate([rows[later][f], gone[f], open_[f]]) for f in ("doc", "th", "s"))
        n = np.concatenate([rows[later]["n"], gone["c"].astype(np.int64), open_["n"]])
        settled = len(doc) - len(open_)
        batch = _range_batch(doc, th, s, n, np.concatenate([np.zeros(settled, np.uint64), open_["h"]]),
                             np.concatenate([np.zeros(settled, np.int64), fan]))
        return pa.Table.from_batches([batch])
    return dealt.groupBy("bucket").applyInArrow(judge, RANGES + ", h long, fan int")


def _spans_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, th, text, spans) of the texts with spans to look at."""
    lists = found.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "n", "h", "fan")).alias("spans"))
    return texts.join(lists, ["doc", "th"]).select("doc", "th", "text", "spans")


def _candidates(texts: DataFrame, wide: DataFrame, width: int, buckets: int) -> DataFrame:
    """Windows of spans of anchors with very many: those that may repeat as spans of one window (h, fan = 1), known ranges (fan = 0).

    Equal windows are settled ``HELD`` spans at a time: only the earliest is sent, as a hash and a place, the others are
    known.  So a window comes to its bucket once per ``HELD`` spans, however often it stands.  A window with a hash
    of its own is in neither.
    """
    def hashes(batches) -> Iterator:
        held = []

        def dealt():
            first: dict[bytes, int] = {}
            rows, k = np.empty(sum(x[3] for x in set(held)), SPAN), 0
            rows["h"], rows["c"], rows["n"] = 0, 0, 1
            later = np.zeros(len(rows), bool)
            for doc, th, s, n, piece in sorted(set(held)):
                rows["doc"][k:k + n], rows["th"][k:k + n], rows["s"][k:k + n] = doc, th, np.arange(s, s + n)
                h = []
                for i in range(n):
                    w = piece[i:i + width]
                    at = first.setdefault(w, k + i)
                    if at == k + i:
                        h.append(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"))
                    else:
                        h.append(0)
                        later[k + i], rows["c"][at] = True, 1  # c: has an equal here
                rows["h"][k:k + n] = np.array(h, np.uint64)
                k += n
            held.clear()
            return _dealt(rows[~later], rows[later], buckets)
        for doc, th, text, found in rows_of(batches, "doc", "th", "text", "spans"):
            raw = text.encode("utf-8", "surrogatepass")
            for x in found:
                held.append((doc, th, x["s"], x["n"], raw[x["s"]:x["s"] + x["n"] + width - 1]))
                if len(held) >= HELD:
                    yield dealt()
        if held:
            yield dealt()

    def meet(table):
        import pyarrow as pa
        rows = np.concatenate([_unpack(x) for x in table.column("spans").to_pylist()])
        gone, rows = rows[rows["n"] == 0], _classes(rows[rows["n"] > 0])[0]
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = rows["h"][1:] == rows["h"][:-1]
        rows = rows[same[1:] | same[:-1] | (rows["c"] > 0)]
        doc, th, s, h = (np.concatenate([gone[f], rows[f]]) for f in ("doc", "th", "s", "h"))
        n = np.concatenate([gone["c"].astype(np.int64), rows["n"]])
        return pa.Table.from_batches([_range_batch(doc, th, s, n, h, np.repeat([0, 1], [len(gone), len(rows)]))])
    return _spans_of(texts, wide).mapInArrow(hashes, "bucket int, spans binary").groupBy("bucket").applyInArrow(meet, RANGES + ", h long, fan int")


def _pieces(texts: DataFrame, open_: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, key, doc, th, s, n, bytes, mine): the bytes of open spans and which windows in them are judged there.

    Equal windows have equal keys: the anchor's hash, or the window's own where an anchor has more than ``SPLIT`` spans.
    Known ranges (s, n) have no bytes.
    """
    narrow = open_.where("fan = 1").unionByName(_candidates(texts, open_.where("fan > 1"), width, buckets))

    def fetch(batches) -> Iterator:
        import pyarrow as pa
        schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("n", pa.int32()),
                            ("bytes", pa.binary()), ("mine", pa.binary())])
        out = []
        for doc, th, text, found in rows_of(batches, "doc", "th", "text", "spans"):
            raw = text.encode("utf-8", "surrogatepass")
            for x in found:
                s, n = x["s"], x["n"]
                piece, mine, key = (raw[s:s + n + width - 1], b"\1" * n, x["h"]) if x["fan"] else (None, None, doc)
                out.append({"bucket": key % buckets, "key": key, "doc": doc, "th": th, "s": s, "n": n, "bytes": piece, "mine": mine})
                if len(out) >= 4000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
        yield pa.RecordBatch.from_pylist(out, schema)
    return _spans_of(texts, narrow).mapInArrow(fetch, "bucket int, key long, doc long, th long, s long, n int, bytes binary, mine binary")


def _chunks(table, most: int) -> list:
    """The pieces by key, in parts of about ``most`` bytes; pieces of one key stay together."""
    import pyarrow.compute as pc
    table = table.sort_by("key")
    key, size = table.column("key").to_numpy(), pc.binary_length(table.column("bytes")).to_numpy().astype(np.int64)
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    part = (np.cumsum(size) - size)[begins] // most
    cuts = begins[np.append(True, part[1:] != part[:-1])[:len(part)]].tolist()
    return [table.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(key)])]


def _in_order(table, width: int):
    """The windows of these pieces that stand earlier among them, as ranges."""
    rows = sorted(set(zip(*(table.column(c).to_pylist() for c in ("doc", "th", "s", "mine", "bytes")))))
    # Anchors are put at multiples of V: equal windows then stand at equal places modulo V.
    raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    sizes = np.array([len(r[4]) for r in rows], np.int64)
    starts = np.cumsum(sizes) - sizes
    anchor = leftmost_smallest(run_hashes(raw), width - K + 1)[starts].astype(np.int64)
    begins = np.empty(len(rows), np.int64)
    gap = (-anchor) % V
    at = 0
    for i, (g, n) in enumerate(zip(gap.tolist(), sizes.tolist())):
        begins[i] = at = at + (g - at) % V
        at += n
    ends = begins + sizes
    text = np.zeros(int(ends[-1]), np.uint8)
    text[pick_runs(begins, sizes)] = raw
    mine = np.zeros(len(text), bool)
    mine[pick_runs(begins, sizes - width + 1)] = np.frombuffer(b"".join(r[3] for r in rows), np.uint8) > 0
    places = np.flatnonzero(mine)
    hit = places[repeated(text, places, width)]
    owner = np.searchsorted(begins, hit, "right") - 1
    start = np.ones(len(hit), bool)
    start[1:] = (np.diff(hit) != 1) | (np.diff(owner) != 0)
    a = np.flatnonzero(start)
    n, o = np.diff(np.append(a, len(hit))), owner[a]
    doc, th, s = (np.array([r[k] for r in rows], np.int64)[o] for k in range(3))
    return _range_batch(doc, th, s + hit[a] - begins[o], n)


def _borders(texts: DataFrame, open_: DataFrame, width: int, buckets: int) -> DataFrame:
    """The windows of open spans that stand earlier too, as ranges."""
    def settle(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        known = table.filter(pc.is_null(table.column("bytes"))).select(["doc", "th", "s", "n"])
        found = [_in_order(part, width) for part in _chunks(table.filter(pc.is_valid(table.column("bytes"))), CHUNK)]
        return pa.concat_tables([known, *([pa.Table.from_batches(found)] if found else [])])

    return _pieces(texts, open_, width, buckets).groupBy("bucket").applyInArrow(settle, RANGES)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, th): what tells documents apart, none missing."""
    t = texts_of(docs)
    return t.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", F.xxhash64("text").alias("th"))


def no_hash(doc: Column) -> Column:
    """Zero instead of th.  No literal: that would be dropped from the keys of joins, and grouped rows would be dealt out again."""
    return doc.bitwiseAND(F.lit(0).cast("long"))


def measured(texts: DataFrame) -> tuple[bool, int]:
    """Whether an id has several texts, so that th is needed to tell documents apart, and the bytes of all texts."""
    each = texts.groupBy("doc", "th").agg(F.sum(F.octet_length("text")).alias("size"))
    most, size = each.groupBy("doc").agg(F.count("*").alias("k"), F.sum("size").alias("size")).agg(F.max("k"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return (most or 0) > 1, size


def removals(texts: DataFrame, size: int, width: int = 100) -> DataFrame:
    """(doc, th, ranges): per document with repeats the ranges (s, n) of window starts to take out; ``size``: bytes of all texts."""
    buckets = max(partitions(texts), size // BUCKET_BYTES)
    with shuffles_released(texts.sparkSession):
        judged = stored(_judged(_dealt_spans(texts, width, buckets)), "spans")
    whole = judged.where("fan = 0").select("doc", "th", "s", "n")
    border = _borders(texts, judged.where("fan > 0"), width, buckets)
    return whole.unionByName(border).groupBy("doc", "th").agg(F.collect_list(F.struct("s", "n")).alias("ranges"))


def cut(raw: bytes, ranges, width: int, characters: bool = False) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed); ``characters``: keep characters that a range cuts in two."""
    edges: list[list[int]] = []
    for s, n in sorted((r["s"], r["n"]) for r in (() if ranges is None else ranges)):
        e = s + n + width - 1
        if edges and s <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], e)
        else:
            edges.append([s, e])
    if characters:
        inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
        for x in edges:
            while inner(x[0]):
                x[0] += 1
            while inner(x[1]):
                x[1] -= 1
    kept, at = [], 0
    for a, b in edges:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), sum(b - a for a, b in edges), len(edges)


def repeat_digests(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept is what is left as bytes."""
    texts = keyed(docs)
    several, size = measured(texts)
    texts = texts if several else texts.withColumn("th", no_hash(F.col("doc")))

    def run(batches) -> Iterator:
        import pyarrow as pa
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        out = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)
            out.clear()
            return made
        for doc, text, ranges in rows_of(batches, "doc", "text", "ranges"):
            raw = text.encode("utf-8", "surrogatepass")
            kept, gone, n = cut(raw, ranges, width)
            out.append((None if doc == NO_ID else doc, len(raw), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            if len(out) >= 1000:
                yield batch()
        yield batch()
    joined = texts.join(removals(texts, size, width), ["doc", "th"], "left").select("doc", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """The documents with repeated strings taken out of their texts (whole characters only), columns as they came.

    A document may be left with an empty text.  ``n_chars``, where there is one, is counted anew if the text changed.
    """
    flat, text, own_id = by_position(docs), position(docs, "text"), position(docs, "doc_id")
    texts = keyed(docs)
    several, size = measured(texts)
    ranges = removals(texts if several else texts.withColumn("th", no_hash(F.col("doc"))), size, width)

    @F.pandas_udf("string")
    def left(texts, found):
        import pandas as pd
        return pd.Series([t if r is None or t is None else cut(t.encode("utf-8", "surrogatepass"), r, width, True)[0].decode("utf-8", "surrogatepass")
                          for t, r in zip(texts, found)], dtype=object)
    doc = F.coalesce(F.col(own_id).cast("long"), F.lit(NO_ID))
    marked = flat.withColumns({"doc": doc, "th": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) if several else no_hash(doc)})
    joined = marked.join(ranges, ["doc", "th"], "left")
    joined = joined.withColumn("left_", F.when(F.col("ranges").isNull(), F.col(text)).otherwise(left(F.col(text), F.col("ranges"))))
    out = {c: F.col(c) for c in flat.columns} | {text: F.col("left_")}
    if "n_chars" in docs.columns:
        n = position(docs, "n_chars")
        out[n] = F.when(F.col("ranges").isNull(), F.col(n)).otherwise(F.char_length("left_")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) for c in flat.columns]).toDF(*docs.columns)

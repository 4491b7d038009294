"""SimHash near-duplicates through a self-join of a binary trie.

The different fingerprints of a table form a binary trie.  Pairs of its nodes are walked down together:
the bits in which the two prefixes differ add up, and a pair that has used more than the allowed number
is dropped with everything below it.  The upper levels are Spark joins between node tables, four bits
a step, until both nodes of a pair hold few enough fingerprints for one task; there the walk goes
on bit by bit in NumPy, on sorted arrays in which a node is a range.  Only nodes too large are walked
further in Spark, so a dense part of the trie is split as deep as it needs.

A task returns links that connect what it found connected, not all its pairs; which fingerprints belong
together is then settled by connected components over those links.  No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, in_slices, position, rows_of, stored, texts_of
from .graph import components
from .tokens import pick_runs

STEP = 4
LEAF = 1 << 14

# Near copies by the similarity of their shingles.
WORDS = 5
TABLES = 6
FAR = 60
SHARE = 0.8
FEW = 1 << 17  # pairs of numbers that may be broadcast, 16 bytes each
HOT = 4  # nodes with one key from which on they are compared with one of them first
WIDE = 1 << 17  # keys in a leaf, 100 bytes each: every level above deals each key out more often
BLOCK = 1 << 20  # shingles, 8 bytes each, that a task may hold twice when it compares sets


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits: bit i is set if it is set in over half of the shingles' XXH64 hashes (seed 42), repeats counted.

    Words are what white space of ASCII parts, A-Z lower-cased.  Fewer words than a shingle are one
    shingle; no words give zero.
    """
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([xxh64_intdigest(s, 42) for s in runs], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long.  Missing texts are empty."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        ids, fps = [], []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])
            ids.clear(), fps.clear()
            return made
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids.append(doc_id)
            fps.append(fingerprint(text, shingle))
            if len(ids) == 5000:
                yield batch()
        yield batch()
    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def _prefix(fp, bits: int):
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(fp, 64 - bits)


def allowed(depth: int, budget: int, first: tuple[int, int]) -> int:
    """How many bits the prefixes of a node pair may differ in: of the ``first`` bits only some, behind them up to ``budget``."""
    return min(budget, first[1] + max(0, depth - first[0]))


def node_pairs(fps: DataFrame, budget: int, leaf: int = LEAF, step: int = STEP, counted: int = 64, first: tuple[int, int] = (0, 64)) -> DataFrame:
    """(depth, a, b, errors): node pairs within the budget whose nodes are small enough for one task, each pair once.

    ``fps`` has different values.  A node at the last depth is one fingerprint.  Bits behind the first
    ``counted`` only split nodes and cost no error.  With a column ``grp``, pairs of nodes that both hold the same
    single group are left out.  With a column ``tree`` (int, few values) each of its values has a trie of its own.
    """
    grouped, tree = "grp" in fps.columns, [c for c in fps.columns if c == "tree"]
    open_ = fps.groupBy(*tree).agg(F.count("*").alias("na")).select(
        *tree, F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("errors"), "na", F.col("na").alias("nb"))
    open_ = stored(open_, "trie-pairs")
    done, depth = [], 0
    while True:
        small = (F.col("na") <= leaf) & (F.col("nb") <= leaf) if depth < 64 else F.lit(True)
        done.append(open_.where(small).select(*tree, F.lit(depth).alias("depth"), "a", "b", "errors"))
        large = open_.where(~small)
        if depth >= 64 or large.isEmpty():
            break
        held = (F.min("grp"), F.max("grp")) if grouped else (F.lit(0), F.lit(1))
        child = (fps.groupBy(*tree, _prefix(F.col("fp"), depth + step).alias("c")).agg(F.count("*").alias("n"), held[0].alias("g"), held[1].alias("h"))
                 .withColumn("up", F.shiftrightunsigned("c", step)))
        child = stored(child, "trie-nodes")
        ca, cb = child.toDF(*tree, "ca", "nca", "ga", "ha", "a"), child.toDF(*tree, "cb", "ncb", "gb", "hb", "b")
        one_group = (F.col("ga") == F.col("ha")) & (F.col("gb") == F.col("hb")) & (F.col("ga") == F.col("gb"))
        errors = F.col("errors") + F.lit(int(depth < counted)) * F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << step) - 1)))
        open_ = (large.join(ca, [*tree, "a"]).join(cb, [*tree, "b"]).where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))).where(~one_group)
                 .select(*tree, F.col("ca").alias("a"), F.col("cb").alias("b"), errors.cast("int").alias("errors"), F.col("nca").alias("na"), F.col("ncb").alias("nb"))
                 .where(F.col("errors") <= allowed(depth + step, budget, first)))
        open_ = stored(open_, "trie-pairs")
        depth += step
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value connected to it) that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def batched(links, size: int):
    """Lists of pairs of arrays with about ``size`` links each."""
    out, held = [], 0
    for pair in links:
        out.append(pair)
        held += len(pair[0])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def _children(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where in each range the first value with bit ``depth`` (from the top) set stands."""
    shift = np.uint64(63 - depth)
    return np.searchsorted(values, ((values[lo] >> shift) | np.uint64(1)) << shift).clip(lo, hi)


def _compare(a, b, alo, na, blo, nb, budget, same, mask, ga=None, gb=None):
    """Numbers (i, j) of values of small node pairs that are near enough."""
    wide = np.repeat(nb, na)  # a row for each value on the left
    i, j = np.repeat(pick_runs(alo, na), wide), pick_runs(np.repeat(blo, na), wide)
    near = np.flatnonzero(np.bitwise_count((a[i] ^ b[j]) & mask) <= budget)
    i, j = i[near], j[near]
    if same or ga is not None:
        ok = i < j if same else np.ones(len(i), bool)
        if ga is not None:
            ok &= ga[i] != gb[j]
        i, j = i[ok], j[ok]
    if len(i):
        yield i, j


def _blocks(alo, na, blo, nb, same, expand):
    """Node pairs (alo, na, blo, nb) put together or cut until a block has about ``expand`` pairs of values."""
    large = na * nb > expand
    rest = np.flatnonzero(~large)
    upto = np.cumsum((na * nb)[rest])
    for part in np.split(rest, np.flatnonzero(np.diff(upto // expand)) + 1):
        if len(part):
            yield alo[part], na[part], blo[part], nb[part]
    one = lambda v: np.array([v], np.int64)
    for k in np.flatnonzero(large):
        high = min(int(na[k]), max(1, int(expand ** 0.5)))
        wide = max(1, expand // high)
        for x in range(0, int(na[k]), high):
            for y in range(0, int(nb[k]), wide):
                n, m = min(high, int(na[k]) - x), min(wide, int(nb[k]) - y)
                if not same or blo[k] + y + m > alo[k] + x:  # else no i < j
                    yield one(alo[k] + x), one(n), one(blo[k] + y), one(m)


def walk(a: np.ndarray, b: np.ndarray, depth: int, errors: int, budget: int, same: bool, brute: int = 64, width: int = 1 << 16, expand: int = 1 << 20, counted: int = 64,
         ga: np.ndarray | None = None, gb: np.ndarray | None = None, first: tuple[int, int] = (0, 64)):
    """Numbers (i, j) of sorted values of two nodes that differ in at most ``budget`` of the first ``counted`` bits.

    Yields arrays.  ``errors`` bits of the prefixes differ already; ``same``: both nodes are one node.
    At most about ``width`` node pairs are walked down at a time, depth first over the rest, and about
    ``expand`` pairs of values compared.  ``ga``, ``gb``: groups of the values; pairs within a group are left out,
    node pairs that hold one group as a whole.  ``first``: see :func:`allowed`; pairs that it leaves out may be left out.
    """
    one = lambda v: np.array([v], np.int64)
    mask = np.uint64((1 << 64) - (1 << (64 - counted)))
    if ga is not None:
        turns_a, turns_b = (np.concatenate([[0], np.cumsum(g[1:] != g[:-1])]) for g in (ga, gb))
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(errors))] if len(a) and len(b) else []
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > width:
            half = len(alo) // 2
            stack += [(d, *(v[:half] for v in (alo, ahi, blo, bhi, err))), (d, *(v[half:] for v in (alo, ahi, blo, bhi, err)))]
            continue
        if ga is not None:
            mixed = (turns_a[alo] != turns_a[ahi - 1]) | (turns_b[blo] != turns_b[bhi - 1]) | (ga[alo] != gb[blo])
            alo, ahi, blo, bhi, err = (v[mixed] for v in (alo, ahi, blo, bhi, err))
        na, nb = ahi - alo, bhi - blo
        small = (na * nb <= brute) | ((d >= counted) & (na * nb <= expand)) | (d >= 64)
        for block in _blocks(alo[small], na[small], blo[small], nb[small], same, expand):
            yield from _compare(a, b, *block, budget, same, mask, ga, gb)
        keep = ~small
        if not keep.any():
            continue
        alo, ahi, blo, bhi, err = (v[keep] for v in (alo, ahi, blo, bhi, err))
        am, bm = _children(a, alo, ahi, d), _children(b, blo, bhi, d)
        own = same & (alo == blo) & (ahi == bhi)
        apart, most = int(d < counted), allowed(d + 1, budget, first)
        parts = []
        for al, ah, bl, bh, more, skip in ((alo, am, blo, bm, 0, None), (am, ahi, bm, bhi, 0, None), (alo, am, bm, bhi, apart, None), (am, ahi, blo, bm, apart, own)):
            ok = (ah > al) & (bh > bl) & (err + more <= most)
            if skip is not None:
                ok &= ~skip
            parts.append((al[ok], ah[ok], bl[ok], bh[ok], err[ok] + more))
        merged = [np.concatenate(x) for x in zip(*parts)]
        if len(merged[0]):
            stack.append((d + 1, *merged))


def _dealt(fps: DataFrame, budget: int, leaf: int, counted: int, first: tuple[int, int] = (0, 64), step: int = STEP) -> DataFrame:
    """The rows of ``fps`` once for each pair of leaves that their fingerprint is part of."""
    tree = [c for c in fps.columns if c == "tree"]
    pairs = node_pairs(fps.select(*tree, *[c for c in ("fp", "grp") if c in fps.columns]), budget, leaf, step, counted, first)
    pairs = stored(pairs.withColumn("pair", F.xxhash64(*tree, "depth", "a", "b")), "trie-leaves")
    depths = [r[0] for r in pairs.select("depth").distinct().collect()]  # at most 64 / STEP + 1
    sides = pairs.select(*tree, "pair", "depth", "a", "b", "errors", F.explode(F.expr("IF(a = b, array(a), array(a, b))")).alias("at"))
    keyed = fps.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("fp"), d).alias("at")) for d in depths or [0]])).alias("k")).select(*fps.columns, "k.*")
    return keyed.join(sides, [*tree, "depth", "at"]).select("pair", "depth", "a", "b", "errors", "at", *[c for c in fps.columns if c != "tree"])


def _walked(table, budget: int, counted: int, first: tuple[int, int] = (0, 64)):
    """Row numbers (i, j) of the near fingerprints of one pair of leaves, in arrays."""
    depth, a, b, errors = (table.column(c)[0].as_py() for c in ("depth", "a", "b", "errors"))
    fp, at = (table.column(c).to_numpy() for c in ("fp", "at"))
    fp = fp.view(np.uint64)
    left, right = ((rows := np.flatnonzero(at == x))[np.argsort(fp[rows], kind="stable")] for x in (a, b))
    grp = table.column("grp").to_numpy() if "grp" in table.column_names else None
    ga, gb = (None, None) if grp is None else (grp[left], grp[right])
    for i, j in walk(fp[left], fp[right], depth, errors, budget, a == b, counted=counted, ga=ga, gb=gb, first=first):
        yield left[i], right[j]


def links(fps: DataFrame, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that connect, directly or through others, all pairs of different values of ``fp``
    that differ in at most ``budget`` bits.
    """
    def join(table):
        import pyarrow as pa
        name = table.column("fp").to_numpy().view(np.uint64)
        x = y = np.zeros(0, np.uint64)
        for some in batched(_walked(table, budget, 64), 1 << 20):
            x, y = forest(*(np.concatenate(v) for v in zip((x, y), *((name[i], name[j]) for i, j in some))))
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})
    return _dealt(fps, budget, leaf, 64).groupBy("pair").applyInArrow(join, "a long, b long")


def candidates(fps: DataFrame, budget: int, far: int, share: float, leaf: int = WIDE) -> DataFrame:
    """(a, b): links that connect all pairs of nodes of (tree, fp, node, grp, n, sketch) of different groups that may share ``share`` of their shingles.

    The first 32 bits of ``fp`` differ in at most ``budget`` and the first 16 of these in at most half as many, the sketches in at
    most ``far``, and the numbers of shingles n allow it; pairs that differ in more of the first 16 may be found as well.  A task returns fewer links than it has nodes, however many such pairs there are.
    """
    first = (16, budget // 2)

    def join(table):
        import pyarrow as pa
        name, n = (table.column(c).to_numpy() for c in ("node", "n"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(name), -1)

        def close():
            for i, j in _walked(table, budget, 32, first):
                ok = _may(n[i], n[j], share)
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= far
                if ok.any():
                    yield name[i[ok]], name[j[ok]]
        x = y = np.zeros(0, np.int64)
        for some in batched(close(), 1 << 20):
            x, y = forest(*(np.concatenate(v) for v in zip((x, y), *some)))
        return pa.table({"a": x, "b": y})
    return _dealt(fps, budget, leaf, 32, first, 1).groupBy("pair").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over links.

    Fingerprints are linked at ``budget`` or fewer differing bits.  Missing and empty texts have
    fingerprint zero and are linked as any other; rows of one id count once each; a missing id never
    names a component unless it has no other.
    """
    own = stored(fingerprints(docs, shingle), "fingerprints")
    return own.join(stored(named(own, budget, leaf), "components"), "fp").select("doc_id", "fp", "component_id")


def named(own: DataFrame, budget: int, leaf: int = LEAF) -> DataFrame:
    """(fp, component_id) for each different fingerprint of a stored (doc_id, fp)."""
    first = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(first.select("fp"), budget, leaf))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id")


# ---- near copies by the similarity of their shingles ---------------------------------------------

def _may(n, m, share: float):
    """Whether sets of n and m elements may share ``share`` of their union."""
    return np.minimum(n, m) >= share * np.maximum(n, m) - 1e-6


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, edges of the texts): words are what white space of ASCII parts, A-Z lower-cased."""
    from xxhash import xxh64_intdigest
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    seen: dict[bytes, int] = {}
    at = np.array([seen.setdefault(w, len(seen)) for some in words for w in some], np.int64)
    hashes = np.array([xxh64_intdigest(w, 42) for w in seen], np.uint64)
    return hashes[at], np.cumsum([0, *map(len, words)])


def _run_hashes(words: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the different hashes of each text's runs of ``size`` words, in order; fewer words are one run, no words none."""
    counts = np.diff(edges)
    factors = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(size)], np.uint64)
    runs = np.where(counts >= size, counts - size + 1, counts > 0)
    ends = np.cumsum(runs)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    short = np.repeat(counts < size, runs)
    at = pick_runs(edges[:-1], np.where(counts >= size, runs, 0))
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        h += words[at + i] * factors[i]
    out[~short] = h
    few = np.flatnonzero((counts > 0) & (counts < size))
    h = counts[few].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)  # no run of full size
    for i in range(size - 1):
        more = counts[few] > i
        h[more] += words[edges[few[more]] + i] * factors[i]
    out[short] = h
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(33)
    starts = ends - runs
    for a, b in zip(starts.tolist(), ends.tolist()):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[starts[runs > 0]] = True
    return out[first], np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(runs)), runs)[first], minlength=len(runs)))])


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as hashes, in order."""
    return _run_hashes(*_word_hashes([text]), words)[0]


_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()  # a byte's bits as eight bytes


def _majority(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """64 bits for each part of ``values``: those that over half of it have set; none for an empty part.

    The bits of a byte are counted as eight bytes of one number, at most 255 values at a time.
    """
    counts = np.diff(edges)
    real = np.flatnonzero(counts)
    out = np.zeros((len(counts), 8), np.uint8)
    if len(real):
        pieces = -(-counts[real] // 255)
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(edges[real] - 255 * first, pieces) + 255 * np.arange(pieces.sum())
        ends = np.minimum(starts + 255, np.repeat(edges[real + 1], pieces))
        raw = values.view(np.uint8).reshape(-1, 8)
        sums = np.zeros(len(values) + 1, np.uint64)
        for k in range(8):
            np.cumsum(_SPREAD[raw[:, k]], out=sums[1:])  # differences of less than 256 in each byte hold, whatever runs over
            ones = np.add.reduceat((sums[ends] - sums[starts]).view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
            out[real, k] = np.packbits(ones * 2 > counts[real, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64).ravel()


def sketch(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: hash of the set of shingles, their number, 256 bits over them, TABLES keys of 32 bits over runs of two words.

    Two sets that share a part J of their union differ in about 256 * acos(2J / (1 + J)) / pi bits: 39 at 0.8, 68 at
    0.5, 128 if they have nothing in common.
    """
    from xxhash import xxh64_intdigest
    found = _word_hashes(texts)

    def bits(h: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
        out = []
        for k in range(n):
            v = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            out.append(_majority(v ^ (v >> np.uint64(32)), edges))
        return np.stack(out, axis=1)
    h, edges = _run_hashes(*found, words)
    at = edges.tolist()
    node = np.array([xxh64_intdigest(h[a:b].tobytes(), 7) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)
    return node, np.diff(edges), bits(h, edges, 4), bits(*_run_hashes(*found, 2), TABLES // 2).view(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, n, sketch, keys) per row; equal nodes are equal sets of shingles."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for part in in_slices(rows_of(batches, "doc_id", "text", "th"), 1 << 20):
            ids, texts, th = zip(*part)
            node, n, bits, keys = sketch(texts)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, TABLES, np.int32), pa.array(keys.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(node), pa.array(n), pa.array([x.tobytes() for x in bits], pa.binary()), lists],
                                             ["doc_id", "th", "node", "n", "sketch", "keys"])
    texts = texts_of(docs).withColumn("th", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, th long, node long, n long, sketch binary, keys array<long>")


def similar(part: np.ndarray, n: np.ndarray, bits: np.ndarray, elements: np.ndarray, starts: np.ndarray, far: int, share: float):
    """Numbers (i, j) of sets that share ``share`` or more of their union, so many that they connect what such pairs connect.

    Set i has the ``n[i]`` different ``elements`` (numbers from 0) from ``starts[i]`` on.  Only sets of the same ``part`` are compared,
    whose sketches ``bits`` differ in at most ``far``; one that is connected already is compared with the others, not looked for again.
    """
    marked = np.zeros(int(elements.max()) + 1 if len(elements) else 0, bool)
    order = np.argsort(part, kind="stable")
    for rest in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        found: list[int] = []
        while len(rest):
            if not found:
                found, rest = [int(rest[0])], rest[1:]
            i = found.pop()
            ok = _may(n[i], n[rest], share)
            ok[ok] = np.bitwise_count(bits[rest[ok]] ^ bits[i]).sum(1) <= far
            near = np.flatnonzero(ok & (n[rest] > 0))
            marked[elements[starts[i]:starts[i] + n[i]]] = True
            hits = []
            for at in range(0, len(near), 1024):
                j = rest[near[at:at + 1024]]
                common = np.add.reduceat(marked[elements[pick_runs(starts[j], n[j])]], np.cumsum(n[j]) - n[j], dtype=np.int64)
                hits.append(near[at:at + 1024][common / (n[i] + n[j] - common) >= share])
            marked[elements[starts[i]:starts[i] + n[i]]] = False
            if hits and len(hit := np.concatenate(hits)):
                yield np.full(len(hit), i), rest[hit]
                found += rest[hit].tolist()
                rest = np.delete(rest, hit)


def alike(docs: DataFrame, own: DataFrame, parts: DataFrame, far: int, share: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all nodes of one part of (node, root) whose sets of shingles share ``share`` of their union, by the sets themselves.

    A part that weighs more than ``block`` is dealt out: every two of its blocks meet in a task.  Small parts share tasks.  A node weighs
    as many as it has shingles and 512.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa
        for rows in in_slices(rows_of(batches, "node", "text"), 1 << 20):
            h, edges = _run_hashes(*_word_hashes([t for _, t in rows]), WORDS)
            at = edges.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["node", "h"])

    def join(table):
        import pyarrow as pa
        node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        elements = np.unique(np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64), return_inverse=True)[1]
        x = y = np.zeros(0, np.int64)
        for some in batched(similar(root, n, bits, elements, np.cumsum(n) - n, far, share), 1 << 16):
            x, y = (np.concatenate(v) for v in zip((x, y), *((node[i], node[j]) for i, j in some)))
        return pa.table({"a": x, "b": y})
    members = own.join(parts, "node").groupBy("node").agg(*[F.min(c).alias(c) for c in ("th", "n")], F.any_value("sketch").alias("sketch"), F.min("root").alias("root"))
    members = stored(members, "near-members")
    sizes = stored(members.groupBy("root").agg(F.sum(F.col("n") + 512).alias("size")), "part-sizes")
    tasks = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // block + 1
    texts = members.select("th", "node")
    if members.count() <= FEW:  # else all texts are dealt out to find them
        texts = F.broadcast(texts)
    every = texts_of(docs).select(F.xxhash64("text").alias("th"), "text")
    sets = every.join(texts, "th").select("node", "text").mapInArrow(run, "node long, h binary").groupBy("node").agg(F.any_value("h").alias("h"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.expr("filter(sequence(0, blocks - 1), x -> x != mine)")
    key = F.when(F.col("blocks") == 1, F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"), F.lit(-1).alias("x"), F.lit(-1).alias("y")))).otherwise(
        F.transform(others, lambda x: F.struct(F.col("root").alias("task"), F.least(x, "mine").alias("x"), F.greatest(x, "mine").alias("y"))))
    dealt = (members.join(sizes, "root").withColumn("blocks", blocks).withColumn("mine", mine).join(stored(sets, "shingle-sets"), "node")
             .withColumn("key", F.explode(key)).select("key.*", "node", "root", "n", "sketch", "h"))
    return dealt.groupBy("task", "x", "y").applyInArrow(join, "a long, b long")


def _near(pairs: DataFrame, far: int, share: float) -> DataFrame:
    """(a, b), a < b, of those rows (a, na, sa, b, nb, sb) whose sketches and numbers of shingles allow ``share``."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(a), -1) for c in ("sa", "sb"))
            ok = _may(na, nb, share) & (np.bitwise_count(x ^ y).sum(1) <= far)
            yield pa.RecordBatch.from_arrays([pa.array(f(a[ok], b[ok])) for f in (np.minimum, np.maximum)], ["a", "b"])
    return pairs.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(run, "a long, b long").distinct()


def gathered(nodes: DataFrame, far: int, share: float, hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """``nodes`` with groups ``grp`` of nodes that candidate links connect, and these links (None: no key is hot).

    Only for keys that ``hot`` nodes or more have: their nodes are compared with one of them.  So most of a large group of near
    copies is one group before pairs are looked for.
    """
    alone = nodes.withColumn("grp", F.col("node"))
    keyed = nodes.select("node", "n", "sketch", F.posexplode("keys").alias("t", "key"))
    first = F.min(F.struct(F.xxhash64("node").alias("order"), "node", "n", "sketch")).alias("m")
    centres = keyed.groupBy("t", "key").agg(F.count("*").alias("nodes"), first).where(F.col("nodes") >= hot)
    centres = stored(centres.select("t", "key", F.col("m.node").alias("b"), F.col("m.n").alias("nb"), F.col("m.sketch").alias("sb")), "centres")
    if centres.isEmpty():
        return alone, None
    spokes = keyed.join(centres, ["t", "key"]).where(F.col("node") != F.col("b"))
    links = stored(_near(spokes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), "b", "nb", "sb"), far, share), "near-pairs")
    return stored(alone.join(components(links), "node", "left").withColumn("grp", F.coalesce("root", "grp")).drop("root"), "gathered"), links


def near_links(docs: DataFrame, own: DataFrame, far: int = FAR, budget: int = 5, leaf: int = WIDE, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect all nodes of the stored :func:`sketches` that share ``share`` of their shingles.

    Candidate links part the nodes first, fewer links than nodes in each task; within a part the sets decide.
    Of two keys with five or fewer differing bits either the upper or the lower halves differ in two or fewer: each key has a trie that
    begins with its upper half and one that begins with its lower.  Behind the key a fingerprint has 12 bits of the group, then
    20 of the node: a group lies in one part of the trie.
    """
    nodes = stored(own.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "keys")]), "distinct-sketches")
    nodes, links = gathered(nodes, far, share, hot)
    low = F.shiftleft(F.xxhash64("grp").bitwiseAND(F.lit(0xFFF)), 20).bitwiseOR(F.col("node").bitwiseAND(F.lit(0xFFFFF)))
    turned = F.transform("keys", lambda k: F.shiftleft(k.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftright(k, 16)))
    tries = nodes.select("node", "grp", "n", "sketch", low.alias("low"), F.posexplode(F.concat("keys", turned)).alias("tree", "key"))
    fps = tries.select("tree", F.shiftleft("key", 32).bitwiseOR(F.col("low")).alias("fp"), "node", "grp", "n", "sketch")
    some = stored(candidates(fps, budget, far, share, leaf), "near-pairs")
    links = some if links is None else links.unionByName(some)
    roots = components(links)
    parts = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "near-parts")
    return stored(alike(docs, own, parts, far, share), "near-links")


def drop_near_copies(docs: DataFrame, far: int = FAR, budget: int = 5, leaf: int = WIDE) -> DataFrame:
    """The documents with one of each group of near copies left, the one of the smallest id; columns as they came.

    Near copies share 0.8 or more of their different five-word shingles, by the sets of the shingles' hashes.
    Candidates are found by trie self-joins over TABLES keys of 32 bits, ``budget`` of which may differ; two-word
    shingles make these keys, since they change least between copies.  At 0.8 a pair is missed by all of them in about
    two of a thousand cases, in three of a hundred if it has only four or five shingles.  ``far`` of 256 SimHash bits
    may differ before the sets are compared, 3.6 deviations more than 0.8 gives (one pair in eight thousand there differs in more).  Groups are what links connect.
    Rows that repeat id and text stay or go together.
    """
    own = stored(sketches(docs), "sketches")
    roots = components(near_links(docs, own, far, budget, leaf))
    grouped = own.join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    grouped = stored(grouped, "near-groups")
    best = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.count("*").alias("n")).where("n > 1")
    losers = (grouped.join(best, "root").where(~F.col("best").eqNullSafe(F.struct("doc_id", "th")))
              .select(F.col("doc_id").alias("id_"), F.col("th").alias("digest_")).distinct())
    flat = by_position(docs).withColumns({"i_": F.col(position(docs, "doc_id")).cast("long"),
                                          "t_": F.xxhash64(F.coalesce(F.col(position(docs, "text")).cast("string"), F.lit("")))})
    left = flat.join(losers, (flat["t_"] == losers["digest_"]) & flat["i_"].eqNullSafe(losers["id_"]), "left_anti")
    return left.drop("i_", "t_").toDF(*docs.columns)

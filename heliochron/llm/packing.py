"""Best-fit packing by minimum bin slack.

How well items fill bins depends only on how many there are of each length, and a length is at most
the capacity.  So Spark counts the lengths (at most ``capacity`` rows), and the plan is made from
the counts: the longest length left starts a bin, a bitset of reachable sums over the lengths
available finds the fullest bin, and that combination is removed as often as the counts allow.  A
plan has a few thousand lines at most, however many items there are.  Items take their places in it
by their number within their length: numbers run inside (length, bucket) groups and the buckets'
bases are prefix sums, so a length that a third of all items share is dealt to many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, rows_of, stored, texts_of
from .tokens import encode_slices

KEEP = 300_000  # words a worker holds between slices, about 150 bytes each


def fullest(first: int, counts: dict[int, int], capacity: int) -> list[int]:
    """The lengths, ``first`` among them, that fill a bin best; long ones before short ones.

    Bit s of a bitset says that a sum s is reachable.  Multiples are added in powers of two, so a
    length costs a few shifts of one large integer.  Of equal sums the one made of longer items
    wins: short items stay for later bins.
    """
    room = capacity - first
    steps, reach = [], [1]
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length] - (length == first), room // length)
        k = 1
        while most > 0:
            k = min(k, most)
            steps.append((length, k))
            reach.append(reach[-1] | ((reach[-1] << (length * k)) & mask))
            most -= k
            k *= 2
        if reach[-1] >> room & 1:
            break  # a full bin: shorter items aren't needed
    left, out = reach[-1].bit_length() - 1, [first]
    for (length, k), before in zip(reversed(steps), reversed(reach[:-1])):
        if not before >> left & 1:
            out += [length] * k
            left -= length * k
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) until no item is left."""
    left = Counter({k: v for k, v in counts.items() if v > 0})
    out = []
    while left:
        bin_ = fullest(max(left), left, capacity)
        used = Counter(bin_)
        times = min(left[x] // n for x, n in used.items())
        out.append((times, bin_))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def places(steps: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the rows (first number, times, first sequence, offset) of its places, by first number."""
    out: dict[int, list] = {}
    taken: Counter = Counter()
    sequence = 0
    for times, bin_ in steps:
        offset = 0
        for length in bin_:
            out.setdefault(length, []).append((taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(items: DataFrame, order: list[Column], capacity: int, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset``: items of one sequence_id lie gaplessly in one sequence.

    ``order`` tells items apart; items it can't tell apart are interchangeable.  Items of no length, or
    longer than the capacity, get a missing place.  ``items`` is read twice: give a stored table.
    """
    rows = items.where(F.col(length).between(1, capacity)).groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n")).collect()
    table = places(plan({r.l: r.n for r in rows}, capacity))  # at most `capacity` rows were fetched
    buckets = partitions(items)
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    dealt = items.withColumn("bucket_", bucket)
    bases = (dealt.groupBy(F.col(length).alias("l_"), F.col("bucket_").alias("b_")).agg(F.count("*").alias("n_"))
             .withColumn("base_", F.sum("n_").over(Window.partitionBy("l_").orderBy("b_")) - F.col("n_")))
    own = Window.partitionBy(length, "bucket_").orderBy(*order)
    numbered = (dealt.join(bases, (F.col(length) == F.col("l_")) & (F.col("bucket_") == F.col("b_")), "left")
                .withColumn("number_", F.col("base_") + F.row_number().over(own) - 1)
                .drop("l_", "b_", "n_", "base_", "bucket_"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, numbers):
        import pandas as pd
        out = pd.DataFrame({"sequence_id": pd.array([pd.NA] * len(lengths), "Int64"), "offset": pd.array([pd.NA] * len(lengths), "Int64")})
        ls, ns = lengths.to_numpy(float), numbers.to_numpy(float)
        for x in np.unique(ls[~np.isnan(ls)]):
            if int(x) in table:
                t, rows = table[int(x)], np.flatnonzero(ls == x)
                n = ns[rows].astype(np.int64)
                at = np.searchsorted(t[:, 0], n, "right") - 1
                out.iloc[rows, 0] = t[at, 2] + n - t[at, 0]
                out.iloc[rows, 1] = t[at, 3]
        return out

    return (numbered.withColumn("p_", place(F.col(length), F.col("number_")))
            .withColumns({"sequence_id": F.col("p_.sequence_id"), "offset": F.col("p_.offset")}).drop("p_", "number_"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` ids, the end id included.

    Returns doc_id, piece, start, length, ids_crc32 and, if wanted, ids (the little-endian unsigned
    32-bit ids of the piece).  Only the first piece of a long document may be shorter than the
    capacity.  Missing and empty texts are the end id alone; repeated rows give repeated pieces.
    """
    def cut(batches) -> Iterator:
        import pyarrow as pa
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        out: list[tuple] = []

        def batch():
            cols = zip(*out) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)
            out.clear()
            return made
        for (doc_id, _), ids in encode_slices(rows_of(batches, "doc_id", "text"), tokenizer, keep=KEEP):
            ids = np.append(ids.astype("<u4"), np.array([end_id], "<u4"))
            head = len(ids) % capacity or min(capacity, len(ids))
            edges = [0, *range(head, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                raw = ids[a:b].tobytes()
                out.append((doc_id, k, a, b - a, zlib.crc32(raw)) + (raw,) * with_ids)
            if len(out) >= 2000:
                yield batch()
        yield batch()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts_of(docs).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` ids."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return pack(pieces, [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], capacity)


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

"""Token files: flat unsigned integers beside 64-bit document offsets, read through memory maps.

A folder holds, per part in order of doc_id:

* ``part-00000.ids``      the ids, little-endian, 2 bytes each if the vocabulary allows, else 4
* ``part-00000.docs``     int64 doc_id per document
* ``part-00000.offsets``  uint64 per document and one more: global positions of its ids

and a ``manifest`` table (part, documents, ids, width).  Parts are written on their own, in any order
and again if an executor is lost: a file appears under its name only when it is whole.  A part's
base is the prefix sum of the ids in the parts before it; only the parts' counts are summed on the driver.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, rows_of, texts_of
from .tokens import encode_slices, encoder

MANIFEST = "part int, documents long, ids long, width int, base long"


class Folder:
    """Files below a path: the local file system for plain and file: paths, else what Arrow can open."""

    def __init__(self, path: str):
        from pyarrow import fs
        if "://" in path and not path.startswith("file:"):
            self.fs, self.root = fs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def write(self, name: str, chunks) -> None:
        """Write under a name of its own, then move: no reader sees half a file."""
        self.fs.create_dir(self.root, recursive=True)
        mine = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(mine) as f:
            for c in chunks:
                f.write(c)
        self.fs.move(mine, f"{self.root}/{name}")

    def array(self, name: str, dtype: str) -> np.ndarray:
        """The whole file as an array: mapped where local, so that only what is touched is read."""
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).size == 0:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(path, dtype, "r")
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode every document, append ``end_id`` and write the folder; returns its manifest.

    Documents are ordered by doc_id (missing ids first); rows of one id are ordered by a hash of the
    text, so that many of them may lie in several parts.  Missing and empty texts are the end id alone.
    """
    spark = docs.sparkSession
    rows = texts_of(docs)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(parts or partitions(docs), *keys).sortWithinPartitions(*keys)

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        part, folder = TaskContext.get().partitionId(), Folder(path)
        dtype = encoder(tokenizer).dtype
        doc_ids, ends, total = [], [0], 0

        def chunks():
            nonlocal total
            for (doc_id, _), ids in encode_slices(rows_of(batches, "doc_id", "text"), tokenizer):
                total += len(ids) + 1
                doc_ids.append(-1 << 63 if doc_id is None else doc_id)
                ends.append(total)
                yield np.append(ids, np.array([end_id], dtype)).astype(dtype).tobytes()
        name = f"part-{part:05d}"
        folder.write(f"{name}.ids", chunks())
        folder.write(f"{name}.docs", [np.array(doc_ids, "<i8").tobytes()])
        folder.write(f"{name}.ends", [np.array(ends, "<u8").tobytes()])
        yield pa.RecordBatch.from_pylist([{"part": part, "documents": len(doc_ids), "ids": total, "width": dtype.itemsize}],
                                         pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))

    ranged.mapInArrow(write, "part int, documents long, ids long, width int").write.mode("overwrite").parquet(f"{path}/counts")
    counted = sorted(spark.read.parquet(f"{path}/counts").collect())  # one row per part
    width = max((r.width for r in counted), default=2)
    base, manifest = 0, []
    for r in counted:
        manifest.append((r.part, r.documents, r.ids, width, base))
        base += r.ids

    def rebase(batches) -> Iterator:
        folder = Folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:05d}"
                folder.write(f"{name}.offsets", [(folder.array(f"{name}.ends", "<u8") + np.uint64(row["base"])).tobytes()])
            yield batch

    table = spark.createDataFrame(manifest, MANIFEST).repartition(max(1, min(len(manifest), partitions(docs))))
    table.mapInArrow(rebase, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in a folder, from its files alone."""
    def read(batches) -> Iterator:
        import pyarrow as pa
        folder = Folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:05d}"
                ids = folder.array(f"{name}.ids", f"<u{row['width']}")
                docs, offsets = folder.array(f"{name}.docs", "<i8"), folder.array(f"{name}.offsets", "<u8").astype(np.int64)
                for at in range(0, len(docs), 1000):
                    some, edges = docs[at:at + 1000].tolist(), offsets[at:at + 1001].tolist()
                    raw = [ids[a - row["base"]:b - row["base"]].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])]
                    cols = [pa.array([None if d == -1 << 63 else d for d in some], pa.int64()), pa.array(edges[:-1], pa.int64()),
                            pa.array(np.diff(edges), pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    manifest = spark.read.parquet(f"{path}/manifest")
    spread = manifest.repartition(max(1, partitions(manifest)), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def document(path: str, part: dict, number: int) -> np.ndarray:
    """One document's ids out of a part (a manifest row), without reading the rest of the file."""
    folder, name = Folder(path), f"part-{part['part']:05d}"
    a, b = (int(x) - part["base"] for x in folder.array(f"{name}.offsets", "<u8")[number:number + 2])
    assert os.path.basename(name) == name
    return np.asarray(folder.array(f"{name}.ids", f"<u{part['width']}")[a:b])

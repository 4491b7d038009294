"""BPE encoding and decoding with content-defined chunks that documents share.

Texts are cut where a rolling hash of the last bytes says so: equal passages are cut alike, wherever they
stand.  Chunks that occur more than once in the corpus are encoded once, by the first document
that has them, and their ids sent to the others; all other chunks are encoded where they lie.

A chunk's ids are those of the chunk alone, so near its ends they may differ from the ids of the whole
text.  Each join is repaired: the last and first ids of its sides are turned back into text, encoded as
one and compared; the stretch grows until, on either side, both agree on a place where their ids may meet: one that
no token crosses (a space after a visible ASCII character), or one between two letters whose ids the merges leave
side by side.  What lies between these is replaced.  So texts without spaces need no longer stretches than others.

A document is told apart by its id and a hash of its text; a missing id is one more value, rows that
repeat both are encoded alike.  Missing and empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _TABLE, _mix
from .common import in_slices, rows_of, stored, texts_of
from .tokens import Encoder, byte_chars, encoder

NO_ID = -1 << 63
WINDOW = 32
AVERAGE = 11  # bits: about 2,048 bytes between cuts
LEAST, MOST = 512, 16_384


def cuts(raw: bytes, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text in UTF-8: at characters, by a hash of the last WINDOW bytes."""
    n = len(raw)
    if n <= least:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    with np.errstate(over="ignore"):
        g, m, power = _TABLE[data], 1, 0x9E3779B97F4A7C15
        while m < WINDOW:
            if len(g) > m:
                g[m:] = g[m:] + g[:-m] * np.uint64(power)
            power, m = power * power % (1 << 64), 2 * m
        hit = (np.flatnonzero((_mix(g) >> np.uint64(64 - average)) == 0) + 1).tolist()
    out, at = [], 0
    for c in [*hit, n]:
        while c - at > most:
            at = _whole(raw, at + most)
            out.append(at)
        c = _whole(raw, c)
        if c - at >= least or c == n and c > at:
            out.append(c)
            at = c
    return out


def _whole(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


class Codec:
    """Ids to bytes and back for one tokenizer file."""

    def __init__(self, vocab: dict[str, int], enc: Encoder | None = None):
        """``enc`` is needed to join, not to decode."""
        self.enc = enc
        back = {c: b for b, c in byte_chars().items()}
        self.raw: list[bytes] = [b""] * (1 + max(vocab.values(), default=0))
        for token, i in vocab.items():
            self.raw[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.text = [str(i).encode() for i in range(len(self.raw))]
        self.inner = np.array([x[:1] >= b"\x80" and x[:1] < b"\xc0" for x in self.raw], bool)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.fixed = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def decode(self, ids) -> str:
        """As the library's decode with special tokens kept: the bytes of all ids, broken ones replaced."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def decimals(self, ids) -> bytes:
        return b",".join(map(self.text.__getitem__, ids.tolist()))

    def _firm(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Borders between ids: their numbers, byte offsets, and whether no token crosses the place (a space after visible ASCII)."""
        ends = np.cumsum(self.size[ids])
        raw = np.frombuffer(self.bytes_of(ids), np.uint8)
        at = ends[:-1]
        ok = (raw[at] == 32) & (raw[at - 1] > 32) & (raw[at - 1] < 127) if len(at) else np.zeros(0, bool)
        return np.arange(1, len(ids)), at, ok

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges leave these two ids side by side."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            raw = (self.raw[a] + self.raw[b]).decode("latin-1").translate(self.enc.chars)
            self.pairs[a, b] = self.enc.merges.encode(raw, add_special_tokens=False).ids == [a, b]
        return self.pairs[a, b]

    def _seam(self, raw: bytes, at: int, firm: bool, a: int, b: int) -> bool:
        """Whether ids a and b may meet at a place of the text: a firm one, or inside a run of letters and left alone by the merges.

        Ids of one run of letters are those of its encoding if and only if the merges leave each two neighbours alone.
        """
        if firm:
            return True
        if raw[at] & 0xC0 == 0x80:  # inside a character
            return False
        start = at - 1
        while start > 0 and raw[start] & 0xC0 == 0x80:
            start -= 1
        near = raw[start:at + 4].decode("utf-8", "ignore")
        return len(near) > 1 and near[0].isalpha() and near[1].isalpha() and self.fixed(near[:2]) and self._fit(a, b)

    def join(self, parts: list[np.ndarray]) -> np.ndarray:
        """The ids of the whole text from those of its chunks."""
        if not parts:
            return np.zeros(0, self.enc.dtype)
        done = [parts[0]]  # repaired but for the last one's end
        for nxt in parts[1:]:
            self._repair(done, nxt)
        return np.concatenate(done)

    def _cut(self, tail, head, new, starts, raw, border, whole_left, whole_right) -> tuple[int, int, int, int] | None:
        """(u, i, j, v): tail[:u], new[i:j], head[v:] fit together, as near to the border as it goes."""
        def borders(ids, offset, back):
            k, at, ok = self._firm(ids)
            at = at + offset
            i = np.searchsorted(starts, at)
            same = starts[np.minimum(i, len(starts) - 1)] == at
            order = np.flatnonzero(same & (at > 0) & (at < len(raw)))
            return [(int(k[x]), int(i[x]), int(at[x]), bool(ok[x])) for x in (order[::-1] if back else order)]
        lefts = next(((u, i) for u, i, at, ok in borders(tail, 0, True) if self._seam(raw, at, ok, int(tail[u - 1]), int(new[i]))), (0, 0) if whole_left else None)
        if lefts is None:
            return None
        rights = next(((j, v) for v, j, at, ok in borders(head, border, False) if j >= lefts[1] + 1 and self._seam(raw, at, ok, int(new[j - 1]), int(head[v]))),
                      (len(new), len(head)) if whole_right else None)
        return None if rights is None else (*lefts, *rights)

    def _repair(self, done: list[np.ndarray], right: np.ndarray) -> None:
        m = 24
        while True:
            left = done.pop()
            while len(left) < m and done:
                left = np.concatenate([done.pop(), left])
            a, b = max(0, len(left) - m), min(len(right), m)
            while 0 < a < len(left) and self.inner[left[a]]:  # not from inside a character
                a += 1
            while 0 < b < len(right) and self.inner[right[b]]:
                b -= 1
            tail, head = left[a:], right[:b]
            whole_left, whole_right = a == 0 and not done, b == len(right)
            raw = self.bytes_of(tail) + self.bytes_of(head)
            border = int(self.size[tail].sum())
            try:
                new = np.array(self.enc.library.encode(raw.decode("utf-8"), add_special_tokens=False).ids, self.enc.dtype)
            except UnicodeDecodeError:  # the stretch begins or ends inside a character
                new = None
            if new is not None:
                starts = np.concatenate([[0], np.cumsum(self.size[new])])
                found = self._cut(tail, head, new, starts, raw, border, whole_left, whole_right)
                if found is not None:
                    u, i, j, v = found
                    done += [x for x in (left[:a + u], np.concatenate([new[i:j], right[v:]])) if len(x)]
                    if not done:
                        done.append(left[:0])
                    return
                if whole_left and whole_right:
                    done.append(new)
                    return
            done.append(left)
            m *= 2


def codec(path: str, joins: bool = True) -> Codec:
    """The worker's codec for a tokenizer file; one that only decodes needs no encoder in memory."""
    from .common import worker_state
    state = worker_state().setdefault("codecs", {})
    if (path, joins) not in state:
        if joins:
            enc = encoder(path)
            enc.keep = min(enc.keep, 100_000)
            if enc.layout != "bytes":
                raise ValueError("chunks are joined for byte-level merges only")
            state[path, joins] = Codec(enc.library.get_vocab(True), enc)
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            state[path, joins] = Codec(spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]})
    return state[path, joins]


def _squeeze(data: bytes) -> bytes:
    import pyarrow as pa
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    import pyarrow as pa
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _chunk_table(texts: DataFrame) -> DataFrame:
    """(doc, th, at, size, h1, h2): the chunks of every text with 128 bits of hash."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for part in in_slices(rows_of(batches, "doc", "text", "th"), 4 << 20):
            doc, th, at, size, hashes = [], [], [], [], []
            for d, text, t in part:
                raw, a = text.encode("utf-8", "surrogatepass"), 0
                for b in cuts(raw):
                    doc.append(d), th.append(t), at.append(a), size.append(b - a)
                    hashes.append(hashlib.blake2b(raw[a:b], digest_size=16).digest())
                    a = b
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, th, at, size, h[:, 0], h[:, 1])], ["doc", "th", "at", "size", "h1", "h2"])
    return texts.mapInArrow(run, "doc long, th long, at long, size long, h1 long, h2 long")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, width) per row: the ids of the whole text, little-endian, ``width`` bytes each."""
    texts = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", F.xxhash64("text").alias("th"))
    chunks = stored(_chunk_table(texts), "chunks")
    place = F.struct("doc", "th", "at")
    shared = (chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .where(F.col("first") != F.col("last")).select("h1", "h2", "first"))
    shared = stored(shared, "shared-chunks")
    uses = chunks.join(shared, ["h1", "h2"]).select("doc", "th", "at", "size", "h1", "h2", (place == F.col("first")).alias("owner"))
    uses = stored(uses, "chunk-uses")

    def squeeze(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed = pa.array([_squeeze(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), packed], ["doc", "th", "packed"])
    packed = texts.mapInArrow(squeeze, "doc long, th long, packed binary")  # the shuffle of the texts, used twice

    def own(batches) -> Iterator:
        import pyarrow as pa
        enc = codec(tokenizer).enc
        for part in in_slices(((r[1], _expand(r[0]).decode("utf-8", "surrogatepass"), r[1]) for r in rows_of(batches, "packed", "mine")), 2 << 20):
            keys, pieces = [], []
            for _, text, mine in part:
                raw = text.encode("utf-8", "surrogatepass")
                for x in mine:
                    keys.append((x["h1"], x["h2"]))
                    pieces.append(raw[x["at"]:x["at"] + x["size"]].decode("utf-8", "surrogatepass"))
            ids = [_squeeze(x.tobytes()) for x in enc.encode(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(ids, pa.binary())],
                                             ["h1", "h2", "ids"])
    owned = uses.where("owner").groupBy("doc", "th").agg(F.collect_list(F.struct("h1", "h2", "at", "size")).alias("mine"))
    encoded = stored(packed.join(owned.hint("merge"), ["doc", "th"]).select("packed", "mine").mapInArrow(own, "h1 long, h2 long, ids binary"), "encoded-chunks")
    given = (uses.select("doc", "th", "at", "size", "h1", "h2").distinct().join(encoded, ["h1", "h2"])
             .groupBy("doc", "th").agg(F.collect_list(F.struct("at", "size", "ids")).alias("given")))

    def assemble(batches) -> Iterator:
        import pyarrow as pa
        c = codec(tokenizer)
        rows = ((r[0], _expand(r[1]).decode("utf-8", "surrogatepass"), r[2]) for r in rows_of(batches, "doc", "packed", "given"))
        for part in in_slices(rows, 2 << 20):
            plans, new = [], []
            for _, text, found in part:
                raw, a, plan = text.encode("utf-8", "surrogatepass"), 0, []
                have = {x["at"]: x for x in found or ()}
                bounds = cuts(raw) if have else [len(raw)] * bool(raw)
                run = 0
                for b in bounds:  # neighbouring chunks of one's own are encoded together
                    if a in have:
                        if run < a:
                            plan.append(len(new))
                            new.append(raw[run:a].decode("utf-8", "surrogatepass"))
                        plan.append(np.frombuffer(_expand(have[a]["ids"]), c.enc.dtype))
                        run = b
                    a = b
                if run < len(raw):
                    plan.append(len(new))
                    new.append(raw[run:].decode("utf-8", "surrogatepass"))
                plans.append(plan)
            ids = c.enc.encode(new)
            out = [c.join([ids[p] if isinstance(p, int) else p for p in plan]) for plan in plans]
            for at in range(0, len(part), 200):
                some = range(at, min(len(part), at + 200))
                yield pa.RecordBatch.from_arrays([pa.array([None if part[i][0] == NO_ID else part[i][0] for i in some], pa.int64()),
                                                  pa.array([out[i].tobytes() for i in some], pa.binary()),
                                                  pa.array([c.enc.dtype.itemsize] * len(some), pa.int32())], ["doc_id", "ids", "width"])
    joined = packed.join(given.hint("merge"), ["doc", "th"], "left").select("doc", "packed", "given")
    return joined.mapInArrow(assemble, "doc_id long, ids binary, width int")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded, decoded_sha256) per row of (doc_id, ids, width)."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        c = codec(tokenizer, joins=False)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], names)
            out.clear()
            return made
        for doc_id, data, width in rows_of(batches, "doc_id", "ids", "width"):
            ids = np.frombuffer(data, f"<u{width}")
            text = c.decode(ids)
            out.append((doc_id, len(ids), hashlib.sha256(c.decimals(ids)).hexdigest(), text, hashlib.sha256(text.encode()).hexdigest()))
            if len(out) >= 500:
                yield batch()
        yield batch()
    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string")

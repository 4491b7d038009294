"""Secrets in texts, also behind nested encodings.

A worklist holds layers: a text and, for each of its characters, the span of the original text it was made
from.  Every layer is scanned; what it holds of percent escapes, Unicode escapes, base64 and compressed
bytes is unwrapped into further layers, until none is new.  A layer already seen at the same place is left
out, so data that unpack to themselves end the work.  A find in a layer is a span of the original.

No pattern crosses a line, so escapes are decoded a line at a time: a find may begin before an escape and
end behind it.  Base64 becomes a layer of its own, character by character in place; what is compressed
behind it is one span, the whole code.

Missing and empty texts have no spans; rows are judged one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import rows_of, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
# Tables that mark the letters of a run, so that a plain search finds long ones.
_HEX = bytes(chr(c) in "0123456789abcdef" for c in range(256))
_CODE = bytes(c < 128 and (chr(c).isalnum() or chr(c) in "+/_-") for c in range(256))
INFLATED = 64 << 20  # characters that one compressed code may unpack to; beyond, the code itself is reported


class Layer:
    """A text and where in the original each of its characters begins and ends."""

    __slots__ = ("text", "begin", "end")

    def __init__(self, text: str, begin, end):
        self.text, self.begin, self.end = text, begin, end

    def part(self, a: int, b: int) -> Layer:
        return Layer(self.text[a:b], self.begin[a:b], self.end[a:b])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.begin[a], self.end[b - 1]

    def key(self) -> tuple:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.begin[0], self.end[-1]


class _Same:
    """One number for every character of a layer that is a single span."""

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, at):
        return self if isinstance(at, slice) else self.value


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what stands openly in a text; kind is a number in ``KINDS``.

    Matches of a kind are leftmost and do not overlap; a find that is too short still takes its characters.
    A pattern is tried only where a plain search shows that it may match.
    """
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                yield 0, *m.span()
    # Runs are taken whole, so the least length may stand in the pattern.
    if b"AKIA" in raw:
        for m in ACCESS.finditer(text):
            yield 1, *m.span()
    if b"\1" * 24 in raw.translate(_HEX):
        for m in HEX.finditer(text):
            yield 2, *m.span()


def wrapped(text: str) -> bool:
    """Whether a text may hold something encoded."""
    return "%" in text or "\\" in text or "&#" in text or b"\1" * 16 in text.encode("utf-8", "surrogatepass").translate(_CODE)


def _characters(raw: bytes) -> list[tuple[str, int]]:
    """(character, bytes it takes) of bytes in UTF-8; a byte that fits nowhere is one broken character."""
    out, at = [], 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            out.append((raw[at:at + size].decode(), size))
        except UnicodeDecodeError:
            size = 1
            out.append(("\ufffd", 1))
        at += size
    return out


def _percent(escape: str) -> list[tuple[str, int]]:
    return [(c, 3 * n) for c, n in _characters(bytes.fromhex(escape.replace("%", "")))]


def _unicode(escape: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for m in ONE.finditer(escape):
        code = next(int(g, 10 if i == 5 else 16) for i, g in enumerate(m.groups(), 1) if g)
        c = chr(code) if code < 0x110000 else "\ufffd"
        if out and "\ud800" <= out[-1][0] <= "\udbff" and "\udc00" <= c <= "\udfff":
            high, n = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + ord(c) - 0xDC00), n + len(m[0])))
        else:
            out.append((c, len(m[0])))
    return out


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """Each line with escapes as a layer in which they are decoded."""
    at = 0
    while m := pattern.search(layer.text, at):
        a, b = layer.text.rfind("\n", 0, m.start()) + 1, layer.text.find("\n", m.end())
        b = len(layer.text) if b < 0 else b
        chars, begin, end, done = [], [], [], a
        for m in pattern.finditer(layer.text, a, b):
            chars.append(layer.text[done:m.start()])
            begin += layer.begin[done:m.start()]
            end += layer.end[done:m.start()]
            k = m.start()
            for c, n in decode(m[0]):
                chars.append(c)
                begin.append(layer.begin[k])
                end.append(layer.end[k + n - 1])
                k += n
            done = m.end()
        chars.append(layer.text[done:b])
        begin += layer.begin[done:b]
        end += layer.end[done:b]
        yield Layer("".join(chars), begin, end)
        at = b


def _bytes_of(code: str) -> bytes | None:
    code = code.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(code[:len(code) - (len(code) % 4 == 1)] + "=" * (-len(code) % 4 % 3), validate=True)
    except binascii.Error:
        return None


def _unpacked(raw: bytes) -> bytes | None:
    """What compressed bytes hold, INFLATED + 1 of them at most; None if they are not compressed."""
    try:
        if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and raw[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
            return zlib.decompressobj(47).decompress(raw, INFLATED + 1)
        if raw[:3] == b"BZh":
            return bz2.BZ2Decompressor().decompress(raw, INFLATED + 1)
        if raw[:6] == b"\xfd7zXZ\0":
            return lzma.LZMADecompressor().decompress(raw, INFLATED + 1)
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard
            return zstandard.ZstdDecompressor().stream_reader(raw).read(INFLATED + 1)
    except Exception:  # each library has errors of its own for bytes that only look compressed
        return None
    return None


def _decoded(layer: Layer, found: set) -> Iterator[Layer]:
    codes = BASE64.finditer(layer.text) if b"\1" * 16 in layer.text.encode("utf-8", "surrogatepass").translate(_CODE) else ()
    for m in codes:
        a, b = m.span()
        raw = _bytes_of(m[0])
        if not raw:
            continue
        seen = set()
        packed = False
        while (inner := _unpacked(raw)) is not None:
            packed = True
            if len(inner) > INFLATED:
                found.add((0, *layer.span(a, b)))
                inner = b""
            mark = hashlib.blake2b(raw, digest_size=16).digest()
            if mark in seen:
                break
            seen.add(mark)
            raw = inner
        if packed:
            text = raw.decode("utf-8", "replace")
            if text:
                first, last = layer.span(a, b)
                yield Layer(text, _Same(first), _Same(last))
            continue
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if CONTROL.search(text):
            continue
        begin, end, at = [], [], 0
        for c in text:  # byte k lies in the letters 8k // 6 to (8k + 7) // 6
            n = len(c.encode())
            begin.append(layer.begin[a + at * 8 // 6])
            end.append(layer.end[a + ((at + n) * 8 - 1) // 6])
            at += n
        yield Layer(text, begin, end)


def secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(what stands openly, all spans), each (start, kind, end) in order."""
    base = sorted((a, kind, b) for kind, a, b in scan(text))
    if not wrapped(text):
        return base, base
    found: set[tuple[int, int, int]] = set()
    first = Layer(text, range(len(text)), range(1, len(text) + 1))
    todo, seen = [first], set()
    while todo:
        layer = todo.pop()
        if layer is not first:
            for kind, a, b in scan(layer.text):
                found.add((kind, *layer.span(a, b)))
        for inner in (*_replaced(layer, PERCENT, _percent), *_replaced(layer, UNICODE, _unicode), *_decoded(layer, found)):
            if inner.text and (key := inner.key()) not in seen:
                seen.add(key)
                todo.append(inner)
    return base, sorted({*base, *((a, kind, b) for kind, a, b in found)})


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of documents.

    The counts and the digest are of what stands openly; ``spans`` are ``kind:start:end`` in code points of the
    original, end exclusive, by start, kind and end, comma-joined, with those behind encodings.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        types = [pa.int64()] * 4 + [pa.string()] * 2
        out = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)
            out.clear()
            return made
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            base, every = secrets(text)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            out.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            if len(out) == 5000:
                yield batch()
        yield batch()
    return texts_of(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

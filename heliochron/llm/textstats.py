"""Statistics of a text's form: what the quality rules and the quality classifier look at."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

#: The signs counted as symbols, and white space that parts words.
SYMBOLS = "#*$%&|<>"
_SPACE = re.compile("[\x20\x09-\x0D]+")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "digit_share", "mark_share", "distinct_share", "line_words",
          "alone_share", "odd_share"]


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space."""
    return [w for w in _SPACE.split(text) if w]


def repeat_words(words: list[str]) -> int:
    """Words that lie in three-word windows found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, at, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple:
    """The values of COUNTS, then of SHARES; an empty text has zeros."""
    words = words_of(text)
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0) + (0.0,) * len(SHARES)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if _SPACE.sub("", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = repeat_words(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    letters = kinds[65:91].sum() + kinds[97:123].sum()
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    alone = sum(1 for w in words if not w[0].isalnum() and not w[-1].isalnum())
    return (n, chars, symbols, dup, repeated, symbols / chars, dup / lines, repeated / n, chars / n, float(kinds[65:91].sum() / max(1, letters)),
            float(kinds[48:58].sum() / chars), float(marks / chars), len(set(words)) / n, n / lines, alone / n,
            float(kinds[:32].sum() - kinds[9:14].sum() + kinds[127]) / chars)


def add_statistics(texts: DataFrame) -> DataFrame:
    """(doc_id, COUNTS as long, SHARES as double) per row of (doc_id, text)."""
    from .common import rows_of
    names = ["doc_id", *COUNTS, *SHARES]

    def run(batches):
        import pyarrow as pa
        types = [pa.int64()] * (1 + len(COUNTS)) + [pa.float64()] * len(SHARES)
        out = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)
            out.clear()
            return made
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.append((doc_id, *statistics(text)))
            if len(out) >= 5000:
                yield batch()
        yield batch()
    return texts.mapInArrow(run, ", ".join([f"{c} long" for c in names[:1 + len(COUNTS)]] + [f"{c} double" for c in SHARES]))

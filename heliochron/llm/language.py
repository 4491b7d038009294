"""Language identification: known words first, shorter and shorter character runs for unknown ones.

A word seen in training scores its log frequency in each language.  A word not seen there is scored by the
character runs of the longest length, counted down from ``ORDER`` to one, of which training knows at least
one, as the mean log frequency of the runs known.  A text's score of a language is the sum over its words;
the prediction is the largest (ties: the smaller name), its score the share of it among all languages.

The model is counted by Spark over at most ``sample`` labelled documents (those of the smallest hash of the
id) and at most ``each`` of every language (chosen likewise), so that a rare one is learnt too.  They are taken with their
whole texts, and the model is bounded: ``words`` words and ``runs`` runs of each length per language.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_position, in_slices, position, rows_of, smallest, smallest_each, stored, texts_of
from .quality import held_out

ORDER = 5
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = _RUN.findall(text.lower())
    return [w for w in found if w.isalpha()] if all(map(str.isalpha, found)) else \
        [v for w in found for v in "".join(c if c.isalpha() else " " for c in w).split()]


def runs_of(word: str, n: int) -> list[str]:
    """Runs of n characters of a word with its ends marked; single letters without the marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Languages:
    """Log frequencies per language, a row of ``table`` for each word and run; ``names`` in order."""

    names: list[str]
    words: dict[str, int]
    runs: dict[str, int]
    table: np.ndarray
    room: int = 200_000  # unknown words whose scores are held between texts
    memo: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.known = len(self.table)
        table = np.empty((self.known + self.room, len(self.names)))  # behind the model: rows of unknown words
        table[:self.known] = self.table
        self.table = table

    def __getstate__(self):
        return self.names, self.words, self.runs, self.table[:self.known], self.room

    def __setstate__(self, state):
        self.__init__(*state)

    def back_off(self, w: str) -> np.ndarray:
        """The score of a word that training has not seen."""
        get = self.runs.get
        for n in range(min(ORDER, len(w) + 2), 0, -1):  # no run is longer than the marked word
            found = [i for i in map(get, runs_of(w, n)) if i is not None]
            if found:
                return np.add.reduce(self.table[found], axis=0) / len(found)
        return np.zeros(len(self.names))

    def rows(self, words: list[str]) -> list[int]:
        """The row of each of some different words, for whose unknown ones there must be room."""
        get, memo = self.words.get, self.memo
        out = []
        for w in words:
            i = get(w)
            if i is None:
                i = memo.get(w)
                if i is None:
                    i = self.known + len(memo)
                    self.table[i] = self.back_off(w)
                    memo[w] = i
            out.append(i)
        return out

    def predict(self, text: str) -> tuple[str, float]:
        found = words_of(text)
        if not found or not self.names:
            return "und", 0.0
        counts = Counter(found)
        words, times = list(counts), np.fromiter(counts.values(), float, len(counts))[:, None]
        total = np.zeros(len(self.names))
        for at in range(0, len(words), self.room):
            part = words[at:at + self.room]
            if len(self.memo) + len(part) > self.room:
                self.memo.clear()
            total = np.add.reduce(np.concatenate([total[None], self.table[self.rows(part)] * times[at:at + self.room]]), axis=0)
        best = int(np.argmax(total))
        return self.names[best], float(1 / np.exp(total - total[best]).sum())


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, kind, token, n): words (kind 0) and runs of kind characters, counted; summed per slice first."""
    def run(batches):
        import pyarrow as pa
        for part in in_slices(rows_of(batches, "lang", "text"), 16 << 20):
            words: dict[str, Counter] = {}
            for lang, text in part:
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, seen in words.items():
                for kind in range(ORDER + 1):
                    if kind:
                        out: Counter = Counter()
                        for w, n in seen.items():
                            for r in runs_of(w, kind):
                                out[r] += n
                    else:
                        out = seen
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array([kind] * len(out), pa.int32()),
                                                      pa.array(list(out.keys()), pa.string()), pa.array(list(out.values()), pa.int64())],
                                                     ["lang", "kind", "token", "n"])
    return rows.mapInArrow(run, "lang string, kind int, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = 20_000, words: int = 20_000, runs: int = 10_000, least: int = 2, folds: int = 4, fold: int = 2, each: int = 500) -> Languages:
    """Count a model over labelled documents outside the held-out fold; nothing to learn from gives no languages."""
    flat, lang = by_position(docs), position(docs, "lang")
    own_id, text = position(docs, "doc_id"), position(docs, "text")
    usable = flat.where(F.col(lang).isNotNull() & F.col(own_id).isNotNull() & ~held_out(F.col(own_id).cast("long"), folds, fold)).select(
        F.col(own_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chosen = smallest(usable.select("doc_id").distinct(), "doc_id", sample)
    chosen = chosen.unionByName(smallest_each(usable.select("lang", "doc_id").distinct(), "lang", "doc_id", each).select("doc_id")).distinct()
    counted = stored(_counts(usable.join(F.broadcast(chosen), "doc_id")), "language-counts")  # at most `sample` ids and `each` a language
    top = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "token")
    ranked = counted.where(F.col("n") >= least).withColumn("rank", F.row_number().over(top))
    kept = ranked.where(F.col("rank") <= F.when(F.col("kind") == 0, words).otherwise(runs)).drop("rank")
    sums = {(r.lang, r.kind): (r.total, r.different) for r in
            counted.groupBy("lang", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("different")).collect()}
    names = sorted({k for k, _ in sums})
    at = {name: i for i, name in enumerate(names)}
    words_at, runs_at, table = {}, {}, []
    rows = kept.collect()  # at most words + ORDER * runs a language
    floor = {k: np.array([np.log(0.5 / (sums.get((x, k), (0, 0))[0] + sums.get((x, k), (0, 0))[1] + 1)) for x in names]) for k in range(ORDER + 1)}
    for r in rows:
        total, different = sums[(r.lang, r.kind)]
        i = (runs_at if r.kind else words_at).setdefault(r.token, len(table))
        if i == len(table):
            table.append(floor[r.kind].copy())
        table[i][at[r.lang]] = np.log((r.n + 0.5) / (total + different + 1))
    return Languages(names, words_at, runs_at, np.array(table, float).reshape(len(table), len(names)))


def identify(docs: DataFrame, model: Languages | None = None, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; ``und`` and zero if the text is missing or has no letter."""
    model = model or train(docs, **how)

    def run(batches):
        import pyarrow as pa
        names = ["doc_id", "lang_pred", "score"]
        types = [pa.int64(), pa.string(), pa.float64()]
        out = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 3, types)], names)
            out.clear()
            return made
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.append((doc_id, *model.predict(text)))
            if len(out) >= 5000:
                yield batch()
        yield batch()
    found = texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")

"""Quality rules: a decision list learned from labelled statistics, applied as Spark expressions.

Sequential covering: a rule is grown condition by condition (a threshold on one statistic) by its gain
over the bad documents not yet covered, on two thirds of the labelled rows; on the last third its tail
is pruned while that raises its accuracy.  It joins the list if it is nearly always right there, and
what it covers is left to it.  The list is ordered and readable; a document that no rule meets is kept.

The statistics of all documents are written once; rules are learned from at most ``sample`` of the
labelled rows (those of the smallest hash of the id), a few numbers each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest, stored, texts_of
from .textstats import COUNTS, SHARES, add_statistics

Condition = tuple[str, str, float]
FEATURES = [*SHARES, "n_words"]


def _holds(x: np.ndarray, names: Sequence[str], rule: Sequence[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        out &= v > cut if op == ">" else v <= cut
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            v, y = x[inside, k], bad[inside]
            order = np.argsort(v, kind="stable")
            v, up = v[order], np.cumsum(y[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            if len(cuts) > 256:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 256).astype(int)]
            for op, p, n in (("<=", up[cuts], cuts + 1 - up[cuts]), (">", up[-1] - up[cuts], len(v) - cuts - 1 - (up[-1] - up[cuts]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                j = int(np.argmax(g))
                if g[j] > gain:
                    best, gain = (name, op, float((v[cuts[j]] + v[cuts[j] + 1]) / 2)), g[j]
        if best is None:
            break
        rule.append(best)
        inside &= _holds(x, names, [best])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: Sequence[str] = FEATURES, sure: float = 0.95, most: int = 4, least: int = 3,
          length: int = 40, seed: int = 7) -> list[tuple[list[Condition], int, int]]:
    """An ordered list of (conditions, right, wrong on the pruning rows).  ``sure``: accuracy a rule needs there,
    on ``least`` rows or more; ``most`` conditions a rule, ``length`` rules at most.  Ties go to the first feature."""
    part = np.random.default_rng(seed).permutation(len(x)) % 3 == 0
    gx, gy, px, py = x[~part], bad[~part], x[part], bad[part]
    out = []
    while len(out) < length and gy.any():
        rule = _grow(gx, gy, names, most)
        if not rule:
            break

        def worth(r):
            hit = _holds(px, names, r)
            return (1 + py[hit].sum()) / (2 + hit.sum())
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _holds(px, names, rule)
        right, wrong = int(py[hit].sum()), int((~py[hit]).sum())
        if right < least or right < sure * (right + wrong):
            break
        out.append((rule, right, wrong))
        left = ~_holds(gx, names, rule)
        gx, gy, px, py = gx[left], gy[left], px[~hit], py[~hit]
    return out


def expression(rules) -> Column:
    """The number of the first rule that a row meets, from 1; missing if none."""
    tests = [reduce(lambda a, b: a & b, [F.col(n) > F.lit(c) if op == ">" else F.col(n) <= F.lit(c) for n, op, c in rule]) for rule, *_ in rules]
    if not tests:
        return F.lit(None).cast("int")
    out = F.when(tests[0], 1)
    for i, t in enumerate(tests[1:], 2):
        out = out.when(t, i)
    return out


def in_words(rules) -> list[str]:
    return [f"{i}. bad if " + " and ".join(f"{n} {op} {c:.6g}" for n, op, c in rule) + f"  ({right} right, {wrong} wrong)"
            for i, (rule, right, wrong) in enumerate(rules, 1)]


def labelled(stats: DataFrame, labels: DataFrame, sample: int, names: Sequence[str] = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(features, bad) of at most ``sample`` labelled rows; rows without a label are passed over."""
    lab = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    found = smallest(stats.join(lab, "doc_id").select("doc_id", "quality", *names), "doc_id", sample)
    rows = stored(found, "labelled-statistics").toPandas()
    return rows[list(names)].to_numpy(float), rows["quality"].to_numpy() == 0


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000, sure: float = 0.95) -> DataFrame:
    """(doc_id, COUNTS, base_failed, rule, kept) per row.

    base_failed: fewer than 50 words, or over half of the words lie in repeated three-word windows.
    Missing and empty texts have no words and fail.  Repeated rows are judged alike.  Without labels no rule is learned.
    Of a statistic with more than 256 thresholds between labelled rows, 256 spread evenly over them are tried.
    """
    stats = stored(add_statistics(texts_of(docs)), "text-statistics")
    rules = learn(*labelled(stats, labels, sample), sure=sure)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.withColumns({"base_failed": failed, "rule": expression(rules)})
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
            .select("doc_id", *COUNTS, "base_failed", "rule", "kept"))

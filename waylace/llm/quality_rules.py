"""Quality rules: fixed base rules, then a decision list learned from labels.

The list is grown by sequential covering.  A rule against low quality starts
empty and takes the threshold condition with the most information gain on the
growing rows until it covers no good row; then conditions are dropped from its
end while that helps on the pruning rows.  Rules are added while they are
precise there; covered rows leave; the rules' order is the list's order.  The
list is emitted as one ordered ``CASE`` expression over the statistics.

The learner sees at most ``MOST_LABELLED`` labelled rows (a fixed share by a
hash of the id beyond that), none of which has ``crc32(doc_id) mod 5 = 0``.

Defined results: null counts as an empty text, which has no words and fails
the base rules; without usable labels the list is empty and only base rules
decide; rows that repeat an id each get their row; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylace.llm.arrow import map_rows
from waylace.llm.quality import labelled_rows
from waylace.llm.statistics import COUNTS, FEATURES, statistics
from waylace.plans.scratch import materialize

MOST_LABELLED = 50_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_CONDITIONS = 4
MAX_RULES = 24
#: Least share of low-quality rows among those that a rule covers in the pruning rows.
PRECISION = 0.85
LEAST_COVERED = 3
CUTS = 48


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column >= self.cut if self.at_least else column <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.at_least else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition with the most gain on these rows."""
    n_bad, n = int(bad.sum()), len(bad)
    base = np.log2(n_bad / n)
    best, gain = None, 1e-9
    for f, name in enumerate(FEATURES):
        column = x[:, f]
        order = np.argsort(column, kind="stable")
        ordered, marks = column[order], np.concatenate([[0], np.cumsum(bad[order])])
        values = np.unique(np.concatenate([np.quantile(column, np.linspace(0, 1, CUTS), method="nearest"), np.quantile(column[bad], np.linspace(0, 1, CUTS), method="nearest")]))
        for at_least in (True, False):
            if at_least:
                split = np.searchsorted(ordered, values, "left")
                p, all_rows = n_bad - marks[split], n - split
            else:
                split = np.searchsorted(ordered, values, "right")
                p, all_rows = marks[split], split
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(p > 0, p * (np.log2(p / all_rows) - base), 0.0)
            k = int(np.argmax(gains))
            if gains[k] > gain:
                best, gain = Condition(name, at_least, float(values[k])), float(gains[k])
    return best


def learn_list(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Ordered rules that mark low quality; ``y`` is 1 for good rows."""
    bad = y < 0.5
    turn = np.arange(len(bad)) % 3
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & (turn > 0), left & (turn == 0)
        if bad[grow].sum() < LEAST_COVERED:
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
            found = _best(x[inside], bad[inside])
            if found is None:
                break
            rule = (*(c for c in rule if (c.feature, c.at_least) != (found.feature, found.at_least)), found)
            inside &= found.covers(x)

        def worth(r: Rule, prune=prune) -> float:
            hit = _covers(r, x[prune])
            p = int((hit & bad[prune]).sum())
            return (2 * p - int(hit.sum())) / max(1, int(hit.sum()))

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        hit = _covers(rule, x[prune]) if rule else np.zeros(0, dtype=bool)
        if not rule or hit.sum() < LEAST_COVERED or bad[prune][hit].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def list_expression(rules: list[Rule]) -> Column:
    """The text of the first rule that holds; null if none does."""
    out = None
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        text = " and ".join(map(str, rule))
        out = F.when(every, text) if out is None else out.when(every, text)
    return F.lit(None).cast("string") if out is None else out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, COUNTS (long) and FEATURES (double) for every row."""

    def make():
        def row(doc_id, raw):
            counts, features = statistics(raw)
            return (doc_id, *counts, *features)

        return row

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{f} double" for f in FEATURES)])
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")), make, schema)


def learn_rules(stats: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> list[Rule]:
    """The list for a table of statistics and labels by ``doc_id``."""
    features = stats.select("doc_id", F.array(*FEATURES).alias("x"))
    table = labelled_rows(features, labels, label_col, most).select("x", "y").toArrow()
    if not table.num_rows:
        return []
    x, y = np.array(table["x"].to_pylist(), dtype=np.float64), table["y"].to_numpy()
    order = np.lexsort((y, *x.T))  # the list must not depend on the order in which rows came
    return learn_list(x[order], y[order])


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``kept`` and the ``rule`` that rejected it."""
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    rules = learn_rules(stats, labels, label_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stats.withColumns({"base_failed": failed, "rule": list_expression(rules)})
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")

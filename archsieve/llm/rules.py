"""Quality rules: text statistics and a learned decision list over them.

``statistics`` counts words, symbols, repeated lines and repeated windows of every whole text. ``learn``
covers the poor documents of a labelled sample one rule after another: a rule is a conjunction of
thresholds, grown on two thirds of the sample by information gain and pruned on the last third. The
rules become one ordered ``CASE WHEN`` that Spark evaluates.

Null and empty texts have no words, and all counts are 0. A document with several labels is poor if one of
them says so. Without labels, or with labels of one kind only, the list is empty and rejects nothing.
Learning reads at most ``LEARN_ROWS`` labelled rows of numbers, chosen by a hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archsieve.llm.common import texts, tidy

LEARN_ROWS = 20_000
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_cries", "n_distinct")
WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
SYMBOLS = "#*$%&|<>"

#: Features of the list: (name, expression of the counts).
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "cries_a_word": "n_cries / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def repeated(words: list[list[str]], window: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words lie in a window that the text has twice or more. Exact: windows are
    numbered by doubling (1, 2, 4, 8 words), each number standing for one text and one sequence."""
    sizes = np.array([len(w) for w in words])
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.zeros(len(words), dtype=np.int64)
    number = dict(zip(names := list(set(flat)), range(len(names))))
    owner = np.repeat(np.arange(len(words)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)  # the end of each word's text
    code = owner * len(names) + np.array(list(map(number.__getitem__, flat)), dtype=np.int64)
    here, width = np.arange(len(flat)), 1
    while True:
        found, code, count = np.unique(code, return_inverse=True, return_counts=True)
        twice = count[code] >= 2
        here, code = here[twice], code[twice]
        if width == window or not len(here):
            break
        step = min(width, window - width)
        whole = np.full(len(flat) + step, -1, dtype=np.int64)
        whole[here] = code
        other = whole[here + step]
        fits = (other >= 0) & (here + step + width <= last[here])
        here, code, width = here[fits], code[fits] * (len(found) + 1) + other[fits], width + step
    change = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(change, here, 1)
    np.add.at(change, here + window, -1)
    return np.bincount(owner, np.cumsum(change)[:-1] > 0, minlength=len(words)).astype(np.int64)


def repeated_lines(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines), len(lines) - len(set(lines))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in texts(batch):
                words = [WORD.findall(t) for t in bodies]
                lines = [repeated_lines(t) for t in bodies]
                columns = [
                    [len(w) for w in words], [sum(map(len, w)) for w in words], [sum(map(t.count, SYMBOLS)) for t in bodies], [x[1] for x in lines], repeated(words),
                    [x[0] for x in lines], [sum(map(len, UPPER.findall(t))) for t in bodies], [t.count("!") for t in bodies], [len(set(w)) for w in words],
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: list[Condition], longest: int) -> Rule:
    """Add the condition with the most information gain until no good document is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (~bad & inside).any():
        p, n = (bad & inside).sum(), inside.sum()
        best, gain = None, 1e-9
        for c in cuts:
            m = inside & c.holds(x)
            q = (bad & m).sum()
            if q and (g := q * (np.log2(q / m.sum()) - np.log2(p / n))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions while the rule's worth (poor minus good, of all covered) does not fall."""

    def worth(r: Rule) -> float:
        m = covers(r, x, len(bad))
        return (2.0 * (bad & m).sum() - m.sum()) / m.sum() if m.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def cover(values: np.ndarray, bad: np.ndarray, least_precision: float = 0.9, least_docs: int = 3, longest: int = 4, most_rules: int = 20) -> list[Rule]:
    """Sequential covering. values: a row for each document, a column for each of FEATURES."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    pruning = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~pruning).any():
        x = dict(zip(FEATURES, values.T))
        of = lambda m: {k: v[m] for k, v in x.items()}
        g, p = left & ~pruning, left & pruning
        cuts = [Condition(f, above, float(c)) for f, v in of(g).items() for c in np.unique(np.quantile(v, np.linspace(0, 1, 33)[1:])) for above in (True, False)]
        rule = grow(of(g), bad[g], cuts, longest)
        if not rule:
            break
        rule = prune(rule, of(p), bad[p])
        m = left & covers(rule, x, len(bad))
        if (bad & m).sum() < least_docs or (bad & m).sum() < least_precision * m.sum():
            break
        rules.append(rule)
        left &= ~m
    return rules


def learn(counts: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list of at most LEARN_ROWS labelled documents (poor: a label's quality is 0)."""
    poor = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") <= 0).alias("poor"))
    sample = poor.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    rows = counts.where(~base_failed()).join(sample, "doc_id").select("doc_id", "poor", F.struct(*[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]).alias("x"))
    # an id that repeats gives one of its rows, so that no more than LEARN_ROWS come to the driver
    got = rows.groupBy("doc_id", "poor").agg(F.min("x").alias("x")).select("doc_id", "poor", "x.*").toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    bad = got["poor"].to_numpy(dtype=bool)
    return cover(got[list(FEATURES)].to_numpy(dtype=float), bad) if bad.any() and not bad.all() else []


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: an ordered conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))

"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts are computed once per row. From labelled rows a list of rules is learned:
each rule is a conjunction of thresholds, grown by FOIL gain on one part of the sample, pruned on
the rest, and kept only if it is precise there. The list becomes one ordered Spark conditional
expression, so that applying it costs no Python and can be read.

Nulls and repeats: a null text has no words; rows without a label, or whose label is null, only get
the verdict; a document labelled more than once counts with its lowest label, an id with several texts
with the least of them; without labels of both classes the list is empty and keeps all. Columns of docs named like a statistic are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns

#: Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 20_000
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: What rules look at: name and Spark expression over the counts.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that occur twice or more, the first included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = text.translate(None, _SPACE)
    tails = 0 if solid.isascii() else len(solid) - len(solid.decode("utf-8", "surrogatepass"))
    return (
        len(words), len(solid) - tails, _without(text, _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        _without(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _without(text, b"0123456789"), _without(text, b"!?"), len(set(words)),
    )


def with_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    def make():
        return lambda texts: np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS)).T.copy()

    return with_columns(docs, text_col, ", ".join(f"{c} long" for c in COUNTS), [pa.int64()] * len(COUNTS), make)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _centred(c: Condition, values: np.ndarray) -> Condition:
    """The same condition with its threshold in the middle of the gap that it lies in."""
    low, high = values[values <= c.threshold], values[values > c.threshold]
    return Condition(c.feature, c.above, float((low.max() + high.min()) / 2)) if len(low) and len(high) else c


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    """Adds the condition with the largest FOIL gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, chosen = 1e-9, None
        for name, values in x.items():
            for t in np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, 33))):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    got = inside & c.holds(x)
                    p, n = (bad & got).sum(), (~bad & got).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best:
                        best, chosen = gain, c
        if chosen is None:
            break
        chosen = _centred(chosen, x[chosen.feature][inside])
        rule += (chosen,)
        inside &= chosen.holds(x)
    return rule


def learn(
    sample: pd.DataFrame, *, most_rules: int = 12, longest: int = 3, precision: float = 0.9, least: int = 2
) -> list[Rule]:
    """Ordered rules for rows with quality 0. sample: FEATURES, quality and fold (0-2; 0 prunes)."""
    rules: list[Rule] = []
    bad, held = sample["quality"].to_numpy() == 0, sample["fold"].to_numpy() == 0
    x = {name: sample[name].to_numpy(np.float64) for name in FEATURES}
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, h = left & ~held, left & held
        if not (bad & g).any() or not (~bad & g).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], longest)
        xh = {k: v[h] for k, v in x.items()}

        def worth(r: Rule) -> tuple[float, int]:
            got = _covers(r, xh, int(h.sum()))
            p, n = (bad[h] & got).sum(), (~bad[h] & got).sum()
            return ((p - n) / (p + n) if p + n else -1.0, int(p))

        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=worth)
        got = _covers(rule, x, len(bad)) & left
        p, n = (bad & got).sum(), (~bad & got).sum()
        if worth(rule)[0] < 2 * precision - 1 or p < least or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~got
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False where a rule of the list fires, tried in order."""
    out = None
    for rule in rules:
        fires = F.lit(True)
        for c in rule:
            fires = fires & c.column()
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, **how
) -> list[Rule]:
    """Learns from at most sample_rows labelled documents, chosen by the hash of their id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    )
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # bounded by sample_rows
    texts = texts.groupBy(id_col, "quality").agg(F.min(F.coalesce(text_col, F.lit(""))).alias(text_col))  # an id may stand in very many rows
    rows = with_counts(texts, text_col=text_col)
    features = [F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]
    fold = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(3)).alias("fold")
    return learn(rows.select(*features, "quality", fold).orderBy(F.xxhash64(id_col), id_col).toPandas(), **how)


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
    least_words: int = 50, most_repeat_percent: int = 50, **how,
) -> DataFrame:
    """Adds the counts, base_failed (fixed rules) and kept (false if base_failed, else the list's verdict)."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows, **how)
    out = with_counts(docs.drop("base_failed", "kept"), text_col=text_col)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))

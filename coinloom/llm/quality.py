"""Quality by a sparse rule ensemble.

Small regression trees are boosted on statistics of labelled texts. Every path from a root to
an inner or outer node is a rule, a conjunction of thresholds; rules that tell apart nothing
new are dropped. A logistic model with a lasso penalty gives most rules no weight, and what is
left is compiled into one Spark column expression over the statistics.

Cases: a null text counts as empty; an empty text has all statistics 0 and is scored by the
rules like any other. Rows without a label, or with a null one, are not learned from; of
several labels for one id the largest counts, and of several texts for one id the one with the
smallest statistics. With no labels, one kind only, or no statistic that tells them apart, every
score is the share of label 1, or 0.5. Null ids pass through; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, spare, text_blocks, word_hashes

#: Labelled rows that are learned from, at most about.
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, SHRINK, BINS = 40, 3, 0.3, 24
LASSO = 0.0015
STEPS = 400

STATISTICS = (
    "log_chars", "word_chars", "upper", "digit", "mark", "stop", "exclaim", "pipe", "line_words", "distinct", "distinct_pairs", "short_words", "top_word",
)

#: Classes of bytes: 0 lower-case letters and parts of characters beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b" \t\r\x0b\x0c", 1), (b"\n", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b"0123456789", 4), (b".,;:?'\"()-", 5), (b"!", 6), (b"|", 7)):
    _CLASS[list(_chars)] = _kind
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-!|"]] = 8


def _statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, from its bytes and the hashes of its words."""
    out = []
    for _, raw, at in text_blocks(column):
        words, of = word_hashes(raw, at)
        kinds = _CLASS[raw]
        space = (kinds == 1) | (kinds == 2)
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            own = words[of[i] : of[i + 1]]
            n, n_words = b - a, len(own)
            if not n_words:
                out.append([0.0] * len(STATISTICS))
                continue
            count = np.bincount(kinds[a:b], minlength=9)
            runs = np.diff(np.flatnonzero(np.concatenate(([True], space[a:b], [True])))) - 1
            short = int(((runs > 0) & (runs <= 3)).sum())
            ink = max(1, n - int(count[1]) - int(count[2]))
            _, repeats = np.unique(own, return_counts=True)
            pairs = len(np.unique(own[:-1] * np.uint64(31) + own[1:])) / (n_words - 1) if n_words > 1 else 1.0
            out.append(
                [np.log1p(n), ink / n_words, count[3] / ink, count[4] / ink, count[8] / ink, count[5] / n_words, count[6] / n_words, count[7] / n_words, n_words / (1 + count[2]), len(repeats) / n_words, pairs, short / n_words, repeats.max() / n_words]
            )
    return np.array(out, dtype=np.float64).reshape(-1, len(STATISTICS))


_STATISTICS_TYPE = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])


def statistics(text: str = "text") -> Column:
    """Column: struct of the statistics of a text."""

    def each(texts: pa.Array) -> pa.Array:
        table = _statistics(texts)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=list(STATISTICS))

    return F.arrow_udf(each, _STATISTICS_TYPE)(F.col(text))


#: A rule: (statistic, True for above / False for at most, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, stats: Column) -> Column:
        """The score as a Spark column over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for at, above, cut in rule:
                value = stats[STATISTICS[at]]
                holds = holds & ((value > cut) if above else (value <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[s]} {'>' if up else '<='} {c:.4g}" for s, up, c in r) for r, w in zip(self.rules, self.weights, strict=True)]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, above, cut in rule:
        out &= (x[:, at] > cut) if above else (x[:, at] <= cut)
    return out


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray) -> None:
    """Split rows by the largest fall in squared error; note the path of every node."""
    r = residual[rows]
    best = (1e-9, -1, -1)
    if depth and len(rows) >= 20:
        base = r.sum() ** 2 / len(rows)
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            n = np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1).cumsum()[:-1]
            s = np.bincount(binned[rows, f], weights=r, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            ok = (n >= 10) & (n <= len(rows) - 10)
            if not ok.any():
                continue
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - base, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0:
        step[rows] = r.mean()
        return
    low = binned[rows, f] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        rule = (*path, (f, above, float(cuts[f][k])))
        rules.append(rule)
        _grow(x, binned, cuts, residual, side, depth - 1, rule, rules, step)


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Boost trees, turn their paths into rules, and weight the rules under a lasso penalty."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(1 - 1e-6, max(1e-6, share))
        return RuleEnsemble((), (), float(np.log(share / (1 - share))))
    cuts = []
    for f in range(x.shape[1]):
        marks = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(marks[marks < x[:, f].max()])
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = y.mean()
    score = np.full(len(y), np.log(share / (1 - share)))
    rules: list[Rule] = []
    rng = np.random.default_rng(5)
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(1, len(y) * 7 // 10), replace=False))
        step = np.zeros(len(y))
        _grow(x, binned, cuts, residual, rows, DEPTH, (), rules, step)
        score += SHRINK * step * 4
    seen: dict[bytes, Rule] = {}
    for rule in rules:
        mark = _holds(rule, x)
        if 0 < mark.sum() < len(y):
            seen.setdefault(np.packbits(mark if mark[0] else ~mark).tobytes(), rule)
    kept = list(seen.values())
    if not kept:  # too few rows to split, or rows that no statistic tells apart
        return RuleEnsemble((), (), float(np.log(share / (1 - share))))
    z = np.stack([_holds(r, x) for r in kept], axis=1).astype(np.float64)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    z = (z - mean) / scale
    # Accelerated proximal gradient for the mean logistic loss plus LASSO times the weights' sizes.
    w, v, b, t = np.zeros(len(kept)), np.zeros(len(kept)), float(np.log(share / (1 - share))), 1.0
    u = np.ones(len(kept)) / len(kept) ** 0.5
    for _ in range(20):  # largest eigenvalue, for the step
        u = z.T @ (z @ u)
        size = float(np.linalg.norm(u))
        u /= size
    rate = 4 * len(y) / size
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        new = v - rate * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        b -= float((p - y).mean()) * 2
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    used = np.flatnonzero(np.abs(w) > 1e-9)
    weights = w[used] / scale[used]
    intercept = b - float((w[used] * mean[used] / scale[used]).sum())
    return RuleEnsemble(tuple(kept[i] for i in used), tuple(float(x) for x in weights), float(intercept))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> RuleEnsemble:
    """Fit on labelled rows, at most about sample of them, chosen by a hash of the id."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
    total = labels.count()
    if total > sample:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    if sample <= BROADCAST_ROWS:  # about sample rows of two numbers
        marks = F.broadcast(marks)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(marks, "doc_id")
    rows = rows.select("doc_id", "y", statistics("text").alias("s")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("s").alias("s"))
    table = rows.select("doc_id", "y", "s.*").toPandas()  # a row an id of the sample
    table = table.sort_values(["doc_id", *STATISTICS], ignore_index=True)
    return fit(table[list(STATISTICS)].to_numpy(np.float64), (table["y"].to_numpy(np.float64) > 0).astype(np.float64))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", *keep: str) -> DataFrame:
    """The columns to keep, score, and predicted, for each row of docs."""
    rows = docs.select(*keep, statistics(text).alias("_statistics"))
    rows = rows.withColumn("_score", model.column(F.col("_statistics")))
    return rows.select(*keep, F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """The rows of docs that are predicted good."""
    mark = spare(docs, "_quality_statistics")
    rows = docs.withColumn(mark, statistics(text))
    return rows.where(model.column(F.col(mark)) >= THRESHOLD).drop(mark)

"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.llm.text import bound_batches, held_out, labelled_sample, plain, row_udf

SAMPLE_ROWS = 20_000  # labelled documents that the trees learn from, at most

_CLASSES = ("upper", "lower", "digit", "space", "newline", "mark", "symbol", "beyond")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)), np.int64)
    for k, members in enumerate((
        range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), (10,), b".,;:!?'\"()-", b"#*$%&|<>", range(128, 256),
    )):
        table[list(members), k] = 1
    return table


_TABLE = _class_table()
FEATURES = (
    "log_words", "log_bytes", "word_bytes", "word_spread", *[f"share_{c}" for c in _CLASSES], "exclaim", "distinct", "root_distinct", "top_word",
    "adjacent_equal", "repeat_triple", "line_repeat", "log_lines", "line_bytes", "worst_line_symbol", "worst_line_upper", "symbol_lines",
    "upper_lines", "pressed", "longest_word", "stop_words",
)


def statistics(text: bytes) -> list[float]:
    """The features of one text; an empty text has all zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text, np.uint8)
    share = (np.bincount(codes, minlength=256) @ _TABLE) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    ids = {w: k for k, w in enumerate(seen)}
    order = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    triples = (order[:-2] * len(ids) + order[1:-1]) * len(ids) + order[2:] if n > 2 else order[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    starts = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
    starts = starts[starts < size]
    long = np.diff(np.append(starts, size))
    symbol = np.add.reduceat(_TABLE[codes, 6] + (codes == 33), starts) / long
    upper = np.add.reduceat(_TABLE[codes, 0], starts) / long
    weight = long / size
    big = long >= 20
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), *share, text.count(b"!") / n, len(seen) / n, len(seen) / np.sqrt(n),
        max(seen.values()) / n, float(np.mean(order[1:] == order[:-1])) if n > 1 else 0.0,
        1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), size / len(lines),
        symbol[big].max() if big.any() else 0.0, upper[big].max() if big.any() else 0.0, weight[symbol > 0.08].sum(), weight[upper > 0.5].sum(),
        len(zlib.compress(text, 1)) / size, lengths.max(), sum(c for w, c in seen.items() if len(w) <= 3) / n,
    ]


@dataclass
class Trees:
    """A forest flattened into arrays: level-order nodes of complete trees of one depth."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, trees = len(x), np.arange(len(self.feature))
        at = np.zeros((rows, len(trees)), np.int64)
        inner = self.feature.shape[1]
        while inner and at.size and at[0, 0] < inner:
            f, c = self.feature[trees, at], self.cut[trees, at]
            at = 2 * at + 1 + (x[np.arange(rows)[:, None], f] > c)
        return self.base + self.leaf[trees, at - inner].sum(axis=1) if len(trees) else np.full(rows, self.base)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Boost logistic loss; every split is the best one of the gradient histograms of its node.

    With no rows the score is 0.5, with one class that class's smoothed share.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    cells = binned + np.arange(width) * bins
    margin = np.full(len(y), base)
    all_f, all_c, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width * bins + cells).ravel()
            g = np.bincount(at, np.repeat(grad, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
            rows = np.bincount(at, minlength=many * width * bins).reshape(many, width, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(rows < least) | (rows[:, :, -1:] - rows < least)] = -np.inf
            flat = gain.reshape(many, -1)
            best = flat.argmax(axis=1)
            bin_at = np.full(many, bins)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], cut[first + k], bin_at[k] = f, cuts[f][b], b
            local = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > bin_at[local])
        spot = node - inner
        leaf = -rate * np.bincount(spot, grad, leaves) / (np.bincount(spot, hess, leaves) + l2)
        margin += leaf[spot]
        all_f.append(feature)
        all_c.append(cut)
        all_leaf.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_leaf), base)


def _features(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Learn ``labels.quality`` from a bounded sample outside the held-out fold.

    Statistics are computed by the tasks; the driver gets one short vector per
    sampled document.
    """
    bound_batches(docs.sparkSession)
    found = (
        labelled_sample(docs, labels, "quality", rows)
        .select("order", "doc_id", "y", row_udf(lambda: lambda texts: [statistics(t) for t in texts], "array<double>")("text").alias("x"))
        .toPandas().sort_values(["order", "doc_id"], kind="stable")
    )
    found = found[found["x"].map(len) == len(FEATURES)]
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    return fit_trees(x, found["y"].to_numpy(np.float64))


def score_column(model: Trees):
    """Arrow function from a text to the probability of label 1."""
    return row_udf(lambda: lambda texts: model.score(_features(texts)), "double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The score depends on the text alone.  Null and empty texts have zero
    statistics and a score like any other; repeated rows are scored one by one;
    without usable labels every score is 0.5.  A row with a null doc_id counts
    as held out.  Extra columns are ignored.
    """
    model = fit(docs, labels, rows)
    scored = plain(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), score_column(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    model = fit(docs, labels, rows)
    return docs.withColumn("_llm_score", score_column(model)("text")).filter(F.col("_llm_score") >= threshold).drop("_llm_score")

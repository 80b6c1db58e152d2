"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.llm.text import bound_batches, held_out, labelled_sample, plain, row_udf

SAMPLE_ROWS = 10_000  # labelled documents that the network learns from, at most
SAMPLE_WORDS = 3_000  # longer documents are scored whole but not learned from
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 18, 8, 6, (1, 2, 3)
STEM = 4  # leading letters that the second embedding of a word hashes
PAD = max(WIDTHS) - 1
GAP = PAD + 1  # zero words between texts: a window that starts at a text's first one sees no other text
_SLOTS = [(w, k) for w in WIDTHS for k in range(w)]


_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: bytes) -> list[str]:
    """Runs of letters in lower case, so that marks around a word don't make it another."""
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


class WordHash(dict):
    """Two 32-bit hashes of each word, of all its letters and of its stem, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word) | xxhash.xxh32_intdigest(word[:STEM], 1) << 32
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@dataclass
class Network:
    """Two hashed embeddings per word, of the word and of its stem, convolutions of several widths, max pooling, one logistic layer."""

    first: np.ndarray
    second: np.ndarray
    filters: dict[int, np.ndarray]  # width -> width x DIMS x FILTERS
    bias: dict[int, np.ndarray]
    out: np.ndarray
    shift: float

    def embed(self, hashes: np.ndarray) -> np.ndarray:
        one, two = _spots(hashes)
        return self.first[one] + self.second[two]

    def responses(self, hashes: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each of its places: words x slots x FILTERS."""
        e = self.embed(hashes)
        return np.stack([e @ self.filters[w][k] for w, k in _SLOTS], axis=1)

    def pooled(self, responses: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Maxima per document of ``responses[words]`` over the windows that start at its words or the zero word after them."""
        bounds = np.stack((starts, ends), axis=1).ravel()
        pools = []
        for w in WIDTHS:
            total = np.zeros((len(words) - PAD, FILTERS), np.float32)
            for k in range(w):
                total += responses[words[k : len(words) - PAD + k], _SLOTS.index((w, k))]
            pools.append(np.tanh(np.maximum.reduceat(total, bounds, axis=0)[::2] + self.bias[w]))
        return np.concatenate(pools, axis=1)

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out[:-1] + self.out[-1] + self.shift


def _spots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BUCKETS - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all texts in one array, 0 the zero word, and where the windows of each text start and end."""
    lengths = np.array([len(t) + GAP for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else lengths
    words = np.zeros(int(lengths.sum()) + PAD, np.int64)
    for t, s in zip(texts, starts):
        words[s : s + len(t)] = t
    return words, starts, starts + lengths - PAD


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.05, seed: int = 7) -> Network:
    """Fit the network to word hashes per text.

    The first embedding dimension starts at the smoothed log odds of a word's
    bucket, so that the pooled maxima point at telling words from the start;
    everything is then trained with Adagrad.  A class with few texts is weighted
    up to the other's total.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.02, (BUCKETS, DIMS)).astype(np.float32),
        rng.normal(0, 0.02, (BUCKETS, DIMS)).astype(np.float32),
        {w: rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS + 1, np.float64), 0.0,
    )
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    net.out[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return net
    # document frequencies of buckets by class
    for table, side in ((net.first, 0), (net.second, 1)):
        hits = np.zeros((2, BUCKETS))
        for t, label in zip(texts, y):
            hits[int(label)][np.unique(_spots(t)[side])] += 1
        odds = np.log((hits[1] + 0.1) / (y.sum() + 0.2)) - np.log((hits[0] + 0.1) / (len(y) - y.sum() + 0.2))
        table[:, 0] = np.where(hits.sum(axis=0) > 2, np.clip(odds, -3, 3), -0.5) * 0.25
    for w in WIDTHS:
        net.filters[w][:, 0, :] = np.abs(net.filters[w][:, 0, :])
    net.out[:-1] = 0.1
    net.out[-1] = 0.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    state = {"first": np.full(BUCKETS, 1e-3, np.float32), "second": np.full(BUCKETS, 1e-3, np.float32), "out": np.full_like(net.out, 1e-3)}
    square = {w: np.full_like(net.filters[w], 1e-3) for w in WIDTHS} | {-w: np.full_like(net.bias[w], 1e-3) for w in WIDTHS}
    for _ in range(epochs):
        turn = rng.permutation(len(y))
        for s in range(0, len(turn), batch):
            pick = turn[s : s + batch]
            _, starts, ends = _layout([texts[i] for i in pick])
            hashes = np.concatenate([np.concatenate((texts[i], np.zeros(GAP, np.uint64))) for i in pick] + [np.zeros(PAD, np.uint64)])
            real = np.concatenate([np.concatenate((np.ones(len(texts[i]), bool), np.zeros(GAP, bool))) for i in pick] + [np.zeros(PAD, bool)])
            e = net.embed(hashes) * real[:, None]
            tops, pools = {}, []
            for w in WIDTHS:
                z = sum(e[k : len(e) - PAD + k] @ net.filters[w][k] for k in range(w))
                tops[w] = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                pools.append(np.tanh(np.take_along_axis(z, tops[w], axis=0) + net.bias[w]))
            pooled = np.concatenate(pools, axis=1)
            error = (sigmoid(net.margin(pooled)) - y[pick]) * weight[pick] / len(pick)
            grad_out = np.append(error @ pooled, error.sum()) + 1e-5 * net.out
            back = error[:, None] * net.out[:-1] * (1 - pooled**2)
            for j, w in enumerate(WIDTHS):
                g = back[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                step = np.zeros_like(net.filters[w])
                for k in range(w):
                    at = tops[w] + k
                    values = e[at]  # docs x FILTERS x DIMS
                    step[k] = np.einsum("df,dfi->if", g, values)
                    push = (g[:, :, None] * net.filters[w][k].T[None]).reshape(-1, DIMS) * real[at].reshape(-1, 1)
                    for table, spots in ((net.first, _spots(hashes[at.ravel()])[0]), (net.second, _spots(hashes[at.ravel()])[1])):
                        name = "first" if table is net.first else "second"
                        np.add.at(state[name], spots, (push**2).mean(axis=1))
                        np.add.at(table, spots, -rate * push / np.sqrt(state[name][spots])[:, None])
                square[w] += step**2
                square[-w] += g.sum(axis=0) ** 2
                net.filters[w] -= rate * step / np.sqrt(square[w])
                net.bias[w] -= rate * g.sum(axis=0) / np.sqrt(square[-w])
            state["out"] += grad_out**2
            net.out -= 2 * rate * grad_out / np.sqrt(state["out"])
    return net


class Scorer:
    """Margins of texts; the responses of up to ``most`` distinct words are kept."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.most, self.hash = net, most, WordHash()
        self.reset()

    def reset(self) -> None:
        self.spot: dict[str, int] = {}
        self.table = np.zeros((1, len(_SLOTS), FILTERS), np.float32)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            words = words_of(text)
            group.append(words)
            size += len(words)
            if size > 100_000:
                out.append(self._group(group))
                group, size = [], 0
        if group:
            out.append(self._group(group))
        return np.concatenate(out) if out else np.zeros(0)

    def _group(self, group: list[list[str]]) -> np.ndarray:
        if len(self.spot) > self.most:
            self.reset()
        new = [w for w in dict.fromkeys(w for words in group for w in words) if w not in self.spot]
        if new:
            first = len(self.spot) + 1
            self.spot.update(zip(new, range(first, first + len(new))))
            if first + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), first + len(new)), len(_SLOTS), FILTERS), np.float32)
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first : first + len(new)] = self.net.responses(self.hash.of(new))
        get = self.spot.__getitem__
        laid = _layout([np.fromiter(map(get, x), np.int64, len(x)) for x in group])
        return self.net.margin(self.net.pooled(self.table, *laid))


def best_cut(margin: np.ndarray, y: np.ndarray, default: float) -> float:
    """The margin that gives the highest F1, in the middle of its gap; ``default`` without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return default
    order = np.argsort(-margin, kind="stable")
    m, hit = margin[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(m[1:] < m[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k])


@dataclass
class Detector:
    net: Network
    cuts: dict[str, float]  # score thresholds by language; "" for all others


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_words: int = SAMPLE_WORDS) -> Detector:
    """Learn ``labels.toxic`` from a bounded sample outside the held-out fold.

    One document in five of the sample only calibrates: the scores are shifted
    so that 0.5 is the best single cut, and each language with both classes
    among them gets its own cut.  The language moves a threshold, never a score.
    """
    bound_batches(docs.sparkSession)
    width = F.size(F.split("text", "[\\x20\\x09-\\x0D]+"))
    short = plain(docs, "doc_id", "text").filter(F.col("text").isNull() | (width <= most_words))
    hashes = row_udf(lambda: lambda texts, h=WordHash(): [h.of(words_of(t)).tobytes() for t in texts], "binary")
    sample = labelled_sample(short, labels, "toxic", rows).select("order", "doc_id", "y", hashes("text").alias("words"))
    langs = plain(docs, "doc_id", "lang").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").distinct()
    found = sample.toPandas().sort_values(["order", "doc_id"], kind="stable")
    spoken = {r["doc_id"]: r["lang"] for r in langs.collect()}
    texts = [np.frombuffer(w, np.uint64) for w in found["words"]]
    y = found["y"].to_numpy(np.float64)
    lang = np.array([spoken.get(d) or "" for d in found["doc_id"]], object)
    calibrates = np.arange(len(y)) % 5 == 4
    net = train([t for t, c in zip(texts, calibrates) if not c], y[~calibrates])
    return calibrate(net, [t for t, c in zip(texts, calibrates) if c], y[calibrates], lang[calibrates])


def calibrate(net: Network, texts: list[np.ndarray], y: np.ndarray, lang: np.ndarray) -> Detector:
    if not texts:
        return Detector(net, {"": 0.5})
    table = np.zeros((1 + sum(map(len, texts)), len(_SLOTS), FILTERS), np.float32)
    hashes = np.concatenate(texts)
    if len(hashes):
        table[1:] = net.responses(hashes)
    ends = np.cumsum([len(t) for t in texts])
    laid = _layout([np.arange(e - len(t), e, dtype=np.int64) + 1 for t, e in zip(texts, ends)])
    margin = net.margin(net.pooled(table, *laid))
    cut = best_cut(margin, y, 0.0)
    net.shift -= cut
    cuts = {str(k): float(sigmoid(np.array(best_cut(margin[lang == k] - cut, y[lang == k], 0.0)))) for k in sorted(set(lang)) if k}
    return Detector(net, cuts | {"": 0.5})


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, and by language threshold and toxic, for every row of ``docs``.

    The score depends on the whole text alone: no word, no response.  Null and
    empty texts score as texts without words; repeated rows one by one; a null
    doc_id counts as held out; a null or unknown language has threshold 0.5;
    without usable labels every score is the smoothed share of label 1.
    """
    found = fit(docs, labels, rows)
    bound_batches(docs.sparkSession)

    def make():
        scorer = Scorer(found.net)
        return lambda texts: sigmoid(scorer.margins(texts))

    cut = F.coalesce(F.create_map(*[F.lit(x) for pair in found.cuts.items() for x in pair])[F.coalesce("lang", F.lit(""))], F.lit(0.5))
    scored = plain(docs, "doc_id", "text", "lang").select(
        "doc_id", held_out().alias("held_out"), row_udf(make, "double")("text").alias("score"), cut.alias("threshold")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("toxic", F.col("score") >= F.col("threshold"))


__all__ = ["Detector", "Network", "Scorer", "best_cut", "calibrate", "fit", "score_documents", "train"]

"""Quality classifier: support vectors over n-gram indicators that are scaled by naive Bayes log-count ratios.

Indicators are n-grams of three streams of tokens that a text is read as: its words (1 and
2), the words' shapes (1 to 3; "Word," is "Aa,"), and its recurrences (1): tokens for 1, 2, 4
and so on words in a row that have come before in the text, and as many in a row that are
the one before again. All are hashed into a fixed number of places.
Each place is scaled by the log ratio of its smoothed counts in both classes; a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent, and its
margins are turned into probabilities by a logistic fit on rows it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, text_or_empty, tidy

PLACES = 1 << 18
#: Bound of the fit: labelled rows used at most, those with the least hashes of their ids.
SAMPLE_ROWS = 8000
#: And bytes of their features, four for each indicator of a text.
SAMPLE_BYTES = 96 << 20
THRESHOLD = 0.7
REMEMBERED = 150_000
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_words: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    """Upper-case letters as A, others as a, digits as 0, other characters as they are; runs of one kind once."""
    out, last = [], ""
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if c != last:
            out.append(c)
            last = c
    return "".join(out)


def _word(word: str) -> tuple[int, int]:
    found = (xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass")))
    if len(word) <= 256:
        _words[word] = found
    return found


def _runs(flags: np.ndarray) -> np.ndarray:
    """The powers of two (their exponents) that are no longer than the longest run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    longest = int((edge[1::2] - edge[::2]).max(initial=0))
    return np.arange(longest.bit_length())


def indicators(text: str, places: int = PLACES) -> np.ndarray:
    """Distinct places of a whole text's n-grams."""
    if len(_words) > REMEMBERED:
        _words.clear()
    get = _words.get
    pairs = [get(w) or _word(w) for w in text.split()]
    if not pairs:
        return np.array([0], np.int64)  # the place of texts without words
    both = np.array(pairs, np.uint64)
    word, kind = both[:, 0], both[:, 1]
    with np.errstate(over="ignore"):
        grams = [word, (word[:-1] * _BASE + word[1:]) * _MIX + np.uint64(3), kind * _BASE + np.uint64(1)]
        pair = (kind[:-1] * _BASE + kind[1:]) * _MIX + np.uint64(2)
        grams.append(pair)
        if len(kind) > 2:
            grams.append((pair[:-1] ^ (pair[:-1] >> np.uint64(31))) * _BASE + kind[2:])
        again = np.ones(len(word), bool)
        again[np.unique(word, return_index=True)[1]] = False
        same = np.concatenate([[False], word[1:] == word[:-1]])
        grams += [_runs(again).astype(np.uint64) + np.uint64(100), _runs(same).astype(np.uint64) + np.uint64(200)]
        h = np.concatenate(grams)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        found = np.zeros(places, bool) if len(h) > places // 16 else None
        at = ((h >> np.uint64(40)) % np.uint64(places - 1)).astype(np.int64) + 1
        if found is None:
            return np.unique(at)
        found[at] = True  # a long text: cheaper than sorting
        return np.flatnonzero(found)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    places: int

    def score(self, text: str) -> float:
        """Probability of label 1."""
        z = self.slope * (float(self.weights[indicators(text, self.places)].sum()) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, places: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of class 1 rows with the indicator) / (share of class 0 rows), smoothed."""
    counts = [np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == c] or [np.empty(0, np.int64)]), minlength=places) + smooth for c in (0, 1)]
    r = np.log(counts[1] / (np.sum(y == 1) + 2 * smooth)) - np.log(counts[0] / (np.sum(y == 0) + 2 * smooth))
    seen = counts[0] + counts[1] > 2 * smooth + 1  # an indicator of one row says nothing
    return np.where(seen, r, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: np.ndarray, places: int, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear model of the L1 hinge loss. rows: places of each row, whose features are `values` at them; y: +1 or -1; c: cost of each row."""
    w, bias = np.zeros(places), 0.0
    alpha, order = np.zeros(len(rows)), np.arange(len(rows))
    v = [values[r] for r in rows]
    q = np.array([x @ x + 1 for x in v])  # 1: the bias is a feature of its own
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            r, x = rows[i], v[i]
            g = y[i] * (w[r] @ x + bias) - 1
            a = alpha[i]
            if (a == 0 and g >= 0) or (a == c[i] and g <= 0):
                continue
            most = max(most, abs(g))
            alpha[i] = min(max(a - g / q[i], 0.0), c[i])
            step = (alpha[i] - a) * y[i]
            w[r] += step * x
            bias += step
        if most < tolerance:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with smoothed targets, by Newton's method."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, places: int = PLACES, cost: float = 1.0) -> Model:
    """rows: indicators of each labelled text; y: 0 or 1. With one class only, every score is that class's smoothed share."""
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(places), 0.0, 1.0, float(np.log(share / (1 - share))), places)

    def train(at: np.ndarray) -> tuple[np.ndarray, float]:
        own, t = [rows[i] for i in at], y[at]
        r = log_count_ratios(own, t, places)
        # scaled so that a usual row has length 1
        r /= np.sqrt(np.mean([r[x] @ r[x] for x in own]) + 1e-12)
        w, bias = dual_coordinate_descent(own, r, np.where(t == 1, 1.0, -1.0), np.full(len(t), cost), places)
        return w * r, bias

    folds, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for f in range(3):  # margins of rows that a fit has not seen
        at = np.flatnonzero(folds != f)
        if len(set(y[at].tolist())) < 2:
            return Model(np.zeros(places), 0.0, 1.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), places)
        w, bias = train(at)
        for i in np.flatnonzero(folds == f):
            margin[i] = w[rows[i]].sum() + bias
    slope, offset = _logistic(margin, y)
    w, bias = train(np.arange(len(y)))
    return Model(w, bias, max(slope, 1e-6), offset, places)


def sampled_features(docs: DataFrame, chosen: DataFrame, featurize, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """(features, y) of the documents in `chosen` (doc_id, y; a bounded sample), in the order of their ids' hashes, up to most_bytes of features.

    Only features leave the executors, not texts. Of rows that repeat an id, the one with the
    least features counts; ids without a document play no part.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([featurize(t.as_py()) for t in b.column(1)], pa.binary()), b.column(2)], names=["doc_id", "x", "y"])

    # the sample has a fixed bound, so it may be broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, x binary, y int").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = materialize(rows.withColumn("h", F.xxhash64("doc_id")), "sample", 8)
    total, end = 0, None
    for r in rows.select("h", "doc_id", F.octet_length("x").alias("n")).sort("h", "doc_id").collect():
        total += r.n
        if total > most_bytes:
            break
        end = (r.h, r.doc_id)
    if end is None:
        return []
    kept = rows.where((F.col("h") < end[0]) | ((F.col("h") == end[0]) & (F.col("doc_id") <= end[1])))
    out = [(r.x, r.y) for r in kept.sort("h", "doc_id").select("x", "y").collect()]
    discard(rows)
    return out


def readable_labels(labels: DataFrame, label: str, allowed, id_col: str = "doc_id") -> DataFrame:
    """doc_id, y (0 or 1) of labels that may be read; of several of an id, the greatest. Other labels, and null ones, are no labels."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where(allowed(F.col("doc_id")) & F.col("y").isin(0, 1))
    return known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))


def least_hashes(ids: DataFrame, n: int) -> DataFrame:
    """n rows at most, those with the least hashes of their doc_ids."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _features(text: str) -> bytes:
    return indicators(text).astype("<i4").tobytes()


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=lambda i: F.lit(True), sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """A model fitted on at most sample_rows labelled documents and sample_bytes of their features, those with the least hashes of their ids.

    allowed: condition on the id of rows whose label may be read. Defined cases: null and
    empty texts are texts without words; a very long text has all its indicators; labels that
    are null, neither 0 nor 1, or of no document play no part; of several labels of an id the
    greatest counts, of several documents one; without labels, or with those of one class
    only, every score is that class's smoothed share (one half without any); docs and labels
    may have any other columns.
    """
    chosen = least_hashes(readable_labels(labels, label, allowed, id_col), sample_rows)
    rows = sampled_features(docs, chosen, _features, sample_bytes, id_col, text_col)
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for x, _ in rows], np.array([y for _, y in rows], np.int64))


def with_score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the model's score of each whole text; null text is empty text. A column of docs with the name of the new one gives way."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col])
    at, schema = docs.columns.index(text_col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.value.score(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, score_col])
        tidy(_words)

    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")


def score_documents(docs: DataFrame, model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1), predicted (1 if score >= threshold); one row per document.

    Defined cases: null and empty text get the score of a text without words; a very long
    text is scored whole; null or repeated ids and repeated rows are scored row by row; equal
    texts have equal scores; an empty table gives no rows; other columns are never read.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_score(texts, model).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least_score: float = 0.5, label: str = "quality", allowed=lambda i: F.lit(True), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (all columns, whatever their names) without the documents that the classifier rejects: those with a lower score than least_score.

    Cases as in train() and score_documents(). Without labels of both classes nothing is
    rejected, as there is nothing to tell good from bad by.
    """
    model = train(docs, labels, label, allowed, id_col=id_col, text_col=text_col)
    if not model.weights.any():
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    (score,) = fresh(docs, "score")
    return with_score(docs, model, text_col, score).where(F.col(score) >= least_score).select(*[F.col(f"`{c}`") for c in docs.columns])

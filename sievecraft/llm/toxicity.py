"""Toxicity: non-negative positive-unlabelled learning with a numpy linear model.

The fit sees confirmed toxic texts and unlabelled ones: a sample of all documents, whether
they have a label or not, and no label of theirs is looked at. The class prior p is a
parameter; where none is given, it is the share of toxic ones among all labels that may be
read. With the bounded loss l(z) = 1 / (1 + exp(z)), the risk of marking harmless text is
R_u(l(-z)) - p * R_p(l(-z)), estimated without harmless examples; where a batch's estimate
falls below zero, the model overfits, and the step ascends it instead.

A text is the set of its words, a word the set of its byte n-grams (with both ends marked)
and itself, hashed. A word's value is the sum of its places' weights, so scoring a text
needs one addition per distinct word that the worker has met before.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .quality import least_hashes, readable_labels, sampled_features, score_documents

PLACES = 1 << 18
GRAMS = (4, 5, 6)
#: Bounds of the fit: confirmed toxic texts and unlabelled ones at most (those with the least hashes of their ids), and bytes of their distinct words for each of both.
CONFIRMED_ROWS = 4000
UNLABELLED_ROWS = 12000
SAMPLE_BYTES = 48 << 20
#: Places take part in the fit that stand in this many texts, that are so many standard errors more common in confirmed texts than in unlabelled ones, and by which a text is toxic with this chance or more: p times the one share over the other.
LEAST_TEXTS = 5
LEAST_Z = 4.0
LEAST_CHANCE = 0.5
THRESHOLD = 0.7
REMEMBERED = 400_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def places_of(word: bytes, places: int = PLACES) -> list[int]:
    """Places of a word: of itself, its n-grams, and (apart) those at its start."""
    h, marked = xxhash.xxh3_64_intdigest, b"<" + word + b">"
    out = {h(b"=" + word) % places}
    for n in GRAMS:
        out.update(h(marked[i : i + n]) % places for i in range(len(marked) - n + 1))
    return sorted(out)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    known: dict = field(default_factory=dict, repr=False)

    def value(self, word: bytes) -> float:
        v = float(self.weights[places_of(word, len(self.weights))].sum())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(word) <= 256:
            self.known[word] = v
        return v

    def margin(self, text: str) -> float:
        known, z = self.known, self.bias
        for w in words_of(text):
            v = known.get(w)
            z += self.value(w) if v is None else v
        return z

    def score(self, text: str) -> float:
        z = self.margin(text)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _families(sets: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Whether a text is the first of its family: texts whose word sets share a pair of least hashes are taken for copies."""
    seen: set[tuple] = set()
    first = np.ones(len(sets), bool)
    # fixed values: odd multipliers
    mix = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
    for i, words in enumerate(sets):
        if len(words):
            h = hashes[words]
            with np.errstate(over="ignore"):
                least = ((h[None, :] ^ (h[None, :] >> np.uint64(29))) * mix[:, None]).min(1).tolist()
            marks = [(k, least[2 * k], least[2 * k + 1]) for k in range(3)]
            first[i] = not any(m in seen for m in marks)
            seen.update(marks)
    return first


def risk(z: np.ndarray, confirmed: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of margins z: the risk of missing toxic rows, that of marking harmless ones (an estimate, which may fall below zero), and the gradients of both by z."""
    n_p, n_u = confirmed.sum(), unlabelled.sum()
    marking = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    slope = marking * (1 - marking)
    toxic = prior * ((1 - marking) * confirmed).sum() / n_p
    harmless = (marking * unlabelled).sum() / n_u - prior * (marking * confirmed).sum() / n_p
    return toxic, harmless, -prior * slope * confirmed / n_p, slope * unlabelled / n_u - prior * slope * confirmed / n_p


def non_negative_fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    confirmed: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    n_places: int,
    epochs: int = 300,
    batches: int = 1,
    rate: float = 0.05,
    decay: float = 1e-5,
    beta: float = 0.0,
    seed: int = 11,
) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: (places, counts) of each text; confirmed, unlabelled: which rows are in which sample."""
    indptr = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows])])
    place = np.concatenate([p for p, _ in rows]).astype(np.int64)
    count = np.concatenate([c for _, c in rows]).astype(float)
    owner = np.repeat(np.arange(len(rows)), np.diff(indptr))
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_places), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(n_places + 1), np.zeros(n_places + 1), 0
    for _ in range(epochs):
        deal = rng.integers(batches, size=len(rows))
        for k in range(batches):
            own_p, own_u = confirmed & (deal == k), unlabelled & (deal == k)
            if not own_p.any() or not own_u.any():
                continue
            z = np.bincount(owner, count * w[place], len(rows)) + b
            _, harmless, miss, mark = risk(z, own_p, own_u, prior)
            g = miss + mark if harmless >= -beta else -mark  # the estimate cannot be negative: step back
            grad = np.concatenate([np.bincount(place, count * g[owner], n_places) + decay * w, [g.sum()]])
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            b -= step[-1]
    return w, b


def fit(confirmed: list[bytes], unlabelled: list[bytes], prior: float, places: int = PLACES, least_z: float = LEAST_Z, least_texts: int = LEAST_TEXTS, least_chance: float = LEAST_CHANCE) -> Model:
    """confirmed, unlabelled: distinct words of each text, blank-separated. Where there is no text of either kind, or nothing tells them apart, every score is the prior."""
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    nothing = Model(np.zeros(places), float(np.log(prior / (1 - prior))))
    number: dict[bytes, int] = {}
    sets = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in [*confirmed, *unlabelled]]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    n = len(confirmed)
    # of texts that are copies of each other, each sample has one
    keep = np.concatenate([_families(sets[:n], hashes), _families(sets[n:], hashes)])
    toxic = np.arange(len(sets)) < n
    sets, toxic = [t for t, k in zip(sets, keep) if k], toxic[keep]
    n_p, n_u = toxic.sum(), (~toxic).sum()
    if not n_p or not n_u:
        return nothing
    flat, ends = array("i"), [0]
    for w in number:
        flat.extend(places_of(w, places))
        ends.append(len(flat))
    flat, ends = np.frombuffer(flat, np.int32), np.array(ends)

    def row(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([flat[ends[w] : ends[w + 1]] for w in words.tolist()] or [flat[:0]]), return_counts=True)

    in_p, in_u = np.zeros(places), np.zeros(places)
    for words, is_toxic in zip(sets, toxic):
        (in_p if is_toxic else in_u)[row(words)[0]] += 1
    # places that speak for toxic texts
    q = (in_u + 0.5) / (n_u + 1)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(q * (1 - q) * (1 / n_p + 1 / n_u) + 1e-12)
    chance = prior * (in_p / n_p) / ((in_u + 1) / (n_u + 1))
    chosen = np.flatnonzero((in_p + in_u >= least_texts) & (z >= least_z) & (chance >= least_chance))
    if not len(chosen):
        return nothing
    at = np.full(places, -1)
    at[chosen] = np.arange(len(chosen))
    rows = []
    for words in sets:
        p, c = row(words)
        p = at[p]
        rows.append((p[p >= 0], c[p >= 0]))
    w, b = non_negative_fit(rows, toxic, ~toxic, prior, len(chosen))
    weights = np.zeros(places)
    weights[chosen] = w
    return Model(weights, b)


def _features(text: str) -> bytes:
    return b" ".join(sorted(words_of(text)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    allowed=lambda i: F.lit(True),
    prior: float | None = None,
    confirmed_rows: int = CONFIRMED_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """A model fitted on confirmed toxic documents and on unlabelled ones, in bounded samples (see above).

    allowed: condition on the id of rows whose label may be read; unlabelled texts are taken
    from such rows too. prior: the share of toxic texts among all; None takes it from all
    readable labels. Defined cases: null and empty texts are texts without words; a very long
    text has all its words; labels that are null, neither 0 nor 1, or of no document play no
    part; of several labels of an id the greatest counts, of several documents one; without
    confirmed texts or without documents every score is the prior (one half without labels);
    docs and labels may have any other columns.
    """
    known = materialize(readable_labels(labels, label, allowed, id_col), "labels", 8)
    if prior is None:
        share = known.agg(F.sum("y").alias("n"), F.count(F.lit(1)).alias("of")).first()
        prior = ((share.n or 0) + 1) / (share.of + 2)
    confirmed = sampled_features(docs, least_hashes(known.where("y = 1"), confirmed_rows), _features, sample_bytes, id_col, text_col)
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & allowed(F.col("doc_id"))).distinct()
    unlabelled = sampled_features(docs, least_hashes(ids, unlabelled_rows).withColumn("y", F.lit(0)), _features, sample_bytes, id_col, text_col)
    discard(known)
    return fit([x for x, _ in confirmed], [x for x, _ in unlabelled], prior)


__all__ = ["Model", "fit", "non_negative_fit", "places_of", "risk", "score_documents", "train", "words_of"]

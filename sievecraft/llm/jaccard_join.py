"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each document's set of word 5-grams gets 128 MinHash values. Equal texts are one class,
   and so are texts with equal sets, which are surely linked.
2. Bands of the signature put sets into buckets. Buckets with the same members count once.
   A bucket's members are compared with its least one, 32 MinHash values at a time; with m of
   n values equal, the chance that the similarity reaches the threshold is (for a uniform
   prior) the upper tail of Beta(m + 1, n - m + 1), and pairs go as soon as it falls below the
   tolerance. Members that are apart from the least one are compared with all others of the
   bucket, in tiles. Only pairs that are left become edges, and of those only as many as
   connect the same members; their components are the candidate groups.
3. Now the texts of the groups' members are fetched. Inside a group, tiles of bounded size
   meet pairwise; pairs are pruned in the same steps, and what is left is verified exactly on
   the n-gram sets. A tile pair returns each member's number of links and edges to one member
   of each linked cluster, so its output is as long as its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, fresh, materialize, sieved, text_or_empty, tidy
from ..operators.components import connected_components

GRAM = 5
THRESHOLD = 0.8
HASHES = 128
BANDS = 32
ROWS = 4
STEP = 32
#: A pair is given up when its chance of reaching the threshold is lower.
TOLERANCE = 1e-9
#: Members of a tile, and their n-grams, at most (or one member).
TILE = 2048
TILE_GRAMS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Stretches without white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams(text: str, n: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; a text of fewer words, but some, has one gram of all of them."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = out * _BASE + h[j : len(h) - k + 1 + j]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(g: np.ndarray) -> np.ndarray:
    """MinHash values of a set of gram hashes."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(g), 2048):
            part = g[k : k + 2048]
            low = ((part[None, :] * _FACTORS[:, None] + _ADDENDS[:, None]) >> np.uint64(32)).min(1)
            out = np.minimum(out, low.astype(np.uint32))
    return out


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """n compared values -> the fewest equal ones with which a pair is not given up."""
    out = {}
    for n in range(step, hashes + 1, step):
        # the tail of Beta(m + 1, n - m + 1) at t is the chance of m or fewer successes in n + 1 trials of chance t
        chance, tail = [comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(n + 2)], 0.0
        for m in range(n + 1):
            tail += chance[m]
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            sets = [grams(t.as_py()) for t in part.column(2)]
            names = [xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in sets]
            signs = [signature(g).astype("<u4").tobytes() if len(g) else None for g in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array([len(g) for g in sets], pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", "key", "gset", "n_grams", "sig"]
            )
    tidy()


def _signatures(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), "<u4").reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, gset) of each band of a signature."""
    for b in batches:
        sig = _signatures(b.column(1))
        with np.errstate(over="ignore"):
            bucket = np.empty((len(sig), BANDS), np.uint64)
            for band in range(BANDS):
                h = np.full(len(sig), band + 1, np.uint64)
                for r in range(ROWS):
                    h = (h ^ sig[:, band * ROWS + r]) * _MIX
                    h ^= h >> np.uint64(31)
                bucket[:, band] = h * _BASE
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64).ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))], names=["bucket", "gset"])


def _survivors(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that are never given up; same: a is b, and only i < j are wanted."""
    equal = np.zeros((len(a), len(b)), np.uint8)
    for c in range(STEP):
        equal += a[:, c, None] == b[None, :, c]
    keep = equal >= least[STEP]
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    n_equal = equal[i, j].astype(np.int64)
    for n in range(2 * STEP, HASHES + 1, STEP):
        if not len(i):
            break
        for k in range(0, len(i), 100_000):
            s = slice(k, k + 100_000)
            n_equal[s] += (a[i[s], n - STEP : n] == b[j[s], n - STEP : n]).sum(1)
        on = n_equal >= least[n]
        i, j, n_equal = i[on], j[on], n_equal[on]
    return i, j


def _similar(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (left[i], right[j]) of sets reach the Jaccard threshold, exactly."""
    size_l, size_r = (np.array([len(x) for x in s], np.int64) for s in (left, right))
    if len(i) <= 4 * (len(left) + len(right)):
        both = np.fromiter((len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j)), np.int64, len(i))
    else:  # many pairs: grams that several members have, as columns of 0/1 matrices
        values, n = np.unique(np.concatenate([*left, *right]), return_counts=True)
        values = values[n > 1]
        common = np.zeros((len(left), len(right)), np.float32)
        for k in range(0, len(values), 4096):
            part = values[k : k + 4096]

            def matrix(sets: list[np.ndarray]) -> np.ndarray:
                m = np.zeros((len(sets), len(part)), np.float32)
                for r, s in enumerate(sets):
                    lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], side="right")
                    at = np.searchsorted(part, s[lo:hi])
                    m[r, at[part[np.minimum(at, len(part) - 1)] == s[lo:hi]]] = 1
                return m

            common += matrix(left) @ matrix(right).T
        both = common[i, j].astype(np.int64)
    # a comparison of integers where the threshold is a ratio of small ones
    return both >= threshold * (size_l[i] + size_r[j] - both) - 1e-9


def _alike(least: dict[int, int]):
    """Of pairs (gset, head, two signatures): alike, whether the pair is never given up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _signatures(b.column(2)), _signatures(b.column(3))
            left, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n in range(STEP, HASHES + 1, STEP):
                equal[left] += (x[left, n - STEP : n] == y[left, n - STEP : n]).sum(1)
                left = left[equal[left] >= least[n]]
            alike = np.zeros(len(x), bool)
            alike[left] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike)], names=["gset", "head", "alike"])

    return run


def _heads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's cluster under links (i, j)."""
    head = np.arange(n)
    while len(i):
        new = head.copy()
        np.minimum.at(new, i, head[j])
        np.minimum.at(new, j, head[i])
        new = new[new]
        if (new == head).all():
            break
        head = new
    return head


def _bucket_tile(least: dict[int, int]):
    """Members of a bucket that are apart from its least one, against others of the bucket: edges that connect what is never given up."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        apart = pdf[pdf.apart].drop_duplicates("gset")
        others = pdf[~pdf.apart].drop_duplicates("gset")
        names = np.array(sorted({*apart.gset, *others.gset}), object)
        at = {g: n for n, g in enumerate(names)}
        i, j = _survivors(_signatures(apart.sig), _signatures(others.sig), False, least)
        i, j = (np.array([at[g] for g in side], np.int64) for side in (apart.gset.to_numpy()[i], others.gset.to_numpy()[j]))
        head = _heads(len(names), i, j)
        linked = np.flatnonzero(head != np.arange(len(names)))
        return pd.DataFrame({"a": names[linked], "b": names[head[linked]]})

    return run


def _tile(threshold: float, least: dict[int, int]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, ti, tj = key
        pdf = pdf.drop_duplicates("gset").sort_values("gset")
        sig, sets, names, tile, weight = _signatures(pdf.sig), [grams(t) for t in pdf.text], pdf.gset.to_numpy(), pdf.tile.to_numpy(), pdf.n_texts.to_numpy()
        a, b = np.flatnonzero(tile == ti), np.flatnonzero(tile == tj)
        i, j = _survivors(sig[a], sig[b], ti == tj, least)
        if len(i):
            ok = _similar([sets[x] for x in a], [sets[x] for x in b], i, j, threshold)
            i, j = a[i[ok]], b[j[ok]]
        links = np.zeros(len(names), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        at = np.flatnonzero(links > 0)
        return pd.DataFrame({"gset": names[at], "links": links[at], "head": names[_heads(len(names), i, j)[at]]})

    return run


def _candidate_groups(sets: DataFrame, n: int, least: dict[int, int], tile: int) -> DataFrame:
    """node (a set), component: sets that pairs which are never given up connect. sets: gset, sig."""
    buckets = sets.select("gset", "sig").mapInArrow(_bands, "bucket long, gset binary")
    full = buckets.groupBy("bucket").agg(F.min("gset").alias("head"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("gset")).alias("members")).where("n > 1")
    # one bucket of those with the same members; written out, so that both sides of the join are plain exchanges, which Spark can split where a key is common
    heads = materialize(full.groupBy("head", "n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "head", "n"), "heads", files_for(n, 4 * BANDS))
    hung = materialize(buckets.join(heads, "bucket").where("gset <> head").select("bucket", "gset", "head", "n"), "hung")
    signs = sets.select(F.col("gset").alias("of"), "sig")
    pairs = hung.select("gset", "head").distinct()
    pairs = pairs.join(signs.select(F.col("of").alias("gset"), F.col("sig").alias("own_sig")), "gset").join(signs.select(F.col("of").alias("head"), F.col("sig").alias("head_sig")), "head")
    compared = materialize(pairs.select("gset", "head", "own_sig", "head_sig").mapInArrow(_alike(least), "gset binary, head binary, alike boolean"), "compared", files_for(n, 64))

    # buckets of which some members are apart from the least one: those against all others
    members = materialize(hung.where("n > 2").join(compared, ["gset", "head"]).select("bucket", "gset", F.expr("NOT alike").alias("apart")), "bucket-members")
    tiles = members.groupBy("bucket").agg(F.ceil(F.count_if("apart") / tile).cast("int").alias("tr"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("ta")).where("tr > 0")
    mixed = members.join(materialize(tiles, "mixed-buckets", files_for(n, 16)), "bucket").withColumn("h", F.xxhash64("gset"))
    mixed = mixed.join(signs, mixed["gset"] == signs["of"]).drop("of")
    rows, columns = F.pmod("h", F.col("tr")).cast("int"), F.pmod("h", F.col("ta")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = mixed.where("apart").select("bucket", rows.alias("i"), each("ta").alias("j"), "gset", "sig", F.lit(True).alias("apart"))
    other = mixed.select("bucket", each("tr").alias("i"), columns.alias("j"), "gset", "sig", F.lit(False).alias("apart"))
    met = one.unionByName(other).groupBy("bucket", "i", "j").applyInPandas(_bucket_tile(least), "a binary, b binary")
    edges = compared.where("alike").select(F.col("gset").alias("a"), F.col("head").alias("b")).unionByName(met)
    groups = connected_components(edges, files=files_for(n, 64))
    discard(heads, hung, compared, members)
    return groups


def similar_texts(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False, tile_grams: int = TILE_GRAMS
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, and with_key the text's md5 as key.

    class_id: the least doc_id of the documents that links connect with it (itself, if
    none); n_links: the other texts whose word 5-gram sets reach the Jaccard threshold;
    n_copies: documents with the very same text, this one included.
    Defined cases: null text is empty text; texts without words are linked with none, but
    equal ones are copies of each other; a text of fewer than 5 words has one gram; texts
    that differ in white space or case only are linked; a very long text is compared whole;
    a null doc_id takes part by its text, and its class has the least id that is not null, if
    any; repeated rows are copies; an empty table gives no rows; other columns are ignored.
    """
    least = least_matches(threshold, tolerance)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty(text_col))).alias("key"), text_or_empty(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_sign, "doc_id long, key binary, gset binary, n_grams long, sig binary"), "signed")
    n = signed.count()
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.min("gset").alias("gset"), F.min("n_grams").alias("n_grams"))
    classes = materialize(classes, "classes", files_for(n, 96))
    sets = classes.where("gset IS NOT NULL").groupBy("gset").agg(F.count(F.lit(1)).alias("n_texts"), F.min(F.struct("key", "rep")).alias("first"), F.min("n_grams").alias("n_grams"))
    sets = materialize(sets.join(signed.where("gset IS NOT NULL").groupBy("gset").agg(F.min("sig").alias("sig")), "gset"), "sets")
    groups = _candidate_groups(sets, n, least, tile)

    members = groups.withColumnRenamed("node", "gset").join(sets, "gset")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n_grams") / tile_grams)).cast("int").alias("tiles"))
    # written out, so that both sides of the joins are plain exchanges
    sizes = materialize(sizes, "group-sizes", files_for(n, 24))
    members = members.join(sizes, "component")
    members = members.select("gset", "component", "tiles", F.pmod(F.xxhash64("gset"), F.col("tiles")).cast("int").alias("tile"), "sig", "n_texts", F.col("first.key").alias("own_key"), F.col("first.rep").alias("own_rep"))
    members = materialize(members, "members", files_for(n, 640))
    # joined on both, so that many copies of a text are dealt by their ids
    members = members.join(sieved(texts, F.col("key"), members, "own_key"), (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_rep"))).select("gset", "component", "tiles", "tile", "sig", "n_texts", "text")
    # a member meets each tile of its group once
    placed = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "gset", "tile", "sig", "n_texts", "text"
    )
    linked = placed.groupBy("component", "ti", "tj").applyInPandas(_tile(threshold, least), "gset binary, links long, head binary")
    linked = materialize(linked, "linked", files_for(n, 64))

    final = connected_components(linked.select(F.col("gset").alias("a"), F.col("head").alias("b")), files=files_for(n, 64))
    links = linked.groupBy("gset").agg(F.sum("links").alias("links"))
    known = sets.select("gset", "n_texts").join(links, "gset", "left").join(final.withColumnRenamed("node", "gset"), "gset", "left")
    known = known.where("n_texts > 1 OR links > 0").select("gset", F.coalesce("component", "gset").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("links"))
    known = materialize(known, "known", files_for(n, 64))
    ids = classes.select("key", "gset", "rep").join(known, "gset")
    least_ids = materialize(ids.groupBy("component").agg(F.min("rep").alias("class_id")), "class-ids", files_for(n, 32))
    named = ids.join(least_ids, "component").select("key", "class_id", "links")
    about = classes.select("key", "rep", "n_copies").join(named, "key", "left")
    about = about.select("key", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    about = materialize(about, "about", files_for(n, 64))
    discard(classes, sets, groups, sizes, linked, known, least_ids)
    return signed.select("doc_id", "key").join(about, "key").select("doc_id", "class_id", "n_links", "n_copies", *(["key"] if with_key else []))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns, whatever their names, one document of each class of similar_texts(): the one whose id is the class id; where that row is repeated, or its id null, one of equal rows. Cases as there."""
    found = similar_texts(docs, threshold, id_col=id_col, text_col=text_col, with_key=True)
    own_id, own_key = fresh(docs, "id", "key")
    kept = found.where(F.col("class_id").eqNullSafe(F.col("doc_id"))).groupBy(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).agg(F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept, "kept", files_for(docs.count(), 32))
    key = F.unhex(F.md5(text_or_empty(text_col)))
    out = docs.join(kept.select(own_id, own_key), (F.col(own_key) == key) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)), "left_semi")
    if kept.where("rows > 1").limit(1).count():  # rows of the same id and text
        out = out.withColumn(own_key, key).dropDuplicates([id_col, own_key]).drop(own_key)
    return out

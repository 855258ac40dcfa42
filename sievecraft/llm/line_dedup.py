"""Line dedup: exact reference counts of lines in sharded tables, with a cuckoo filter per shard.

A line's key is counted once per document that has it. The counts lie in shards, whose number
grows with the keys; the keys whose count reaches the threshold lie in their shard's cuckoo
filter, which supports deletion, so documents can be added to and taken from the index
later: counts move, and keys that cross the threshold enter or leave the filters. Beside each
filter stand the few counted keys under the threshold that it holds by chance, which makes
its answer exact for all indexed lines.

Documents are cleaned in one way at every size: the keys of their lines are dealt to the
shards and probed there, and the found ones come back to their texts. A shard that gets many
keys, as that of a line which a third of all documents have, is probed in several tasks,
each with a copy of its filter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_or_empty, tidy

MIN_DOCS = 10
MIN_CHARS = 1
#: Distinct keys of a shard, about. An index whose shards have outgrown it twice is dealt anew.
SHARD_KEYS = 200_000
#: Keys that are probed in one task, about.
PROBE_ROWS = 1_000_000
_BLANK = b" \t\n\x0b\x0c\r"
_FLUSH = 200_000


def line_key(line: str) -> bytes:
    """The line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased, in UTF-8."""
    return line.encode("utf-8", "surrogatepass").strip(_BLANK).lower()


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; keys are pairs of 64-bit hashes."""

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.85))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint32) if table is None else table

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys."""
        print_ = (k2.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        print_[print_ == 0] = 1
        first = (k1.astype(np.int64).view(np.uint64) >> np.uint64(7)) & self.mask
        return print_, first, self.other(first, print_)

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) & self.mask)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        print_, a, b = self.places(k1, k2)
        want = print_[:, None]
        return (self.table[a] == want).any(1) | (self.table[b] == want).any(1)

    def _settle(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets, as far as they go; which ones found a slot."""
        order = np.argsort(buckets, kind="stable")
        own = buckets[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        at = np.arange(len(own))
        turn = at - np.maximum.accumulate(np.where(first, at, 0))  # how many of the bucket come before
        free = self.table[own] == 0
        nth = np.cumsum(free, 1) * free  # 1 for a bucket's first free slot, and so on
        slot = nth == (turn + 1)[:, None]
        found = slot.any(1)
        self.table[own[found], slot[found].argmax(1)] = prints[order[found]]
        done = np.zeros(len(prints), bool)
        done[order[found]] = True
        return done

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Adds distinct keys; False if the filter is full, and must be built anew."""
        if not len(k1):
            return True
        prints, first, second = self.places(k1, k2)
        for side in range(2):
            left = ~self._settle(prints, second if side else first)
            prints, first, second = prints[left], first[left], second[left]
            if not len(prints):
                return True
        rng = np.random.default_rng(1)
        for p, bucket in zip(prints.tolist(), first.tolist()):  # the few others push out what is there
            for _ in range(1000):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = p
                    break
                slot = int(rng.integers(self.SLOTS))
                p, self.table[bucket, slot] = int(self.table[bucket, slot]), p
                bucket = int(self.other(np.array([bucket], np.uint64), np.array([p], np.uint32))[0])
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> "CuckooFilter":
        """Takes out keys that were inserted."""
        prints, first, second = self.places(k1, k2)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
        return self

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> "CuckooFilter":
        capacity = len(k1)
        while not (f := cls(capacity)).insert(k1, k2):
            capacity = 2 * max(1, capacity)
        return f

    def to_bytes(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CuckooFilter":
        return cls(0, np.frombuffer(raw, "<u4").reshape(-1, cls.SLOTS).copy())


@dataclass
class LineIndex:
    """refs: k1, k2, refs (documents with the line); filters: shard, n_keys, probes (the refs of all its keys), filter, strays (keys that it holds by chance)."""

    refs: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int


def _document_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(seen.values()), pa.int64())], names=["k1", "k2", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                keys = {line_key(x) for x in t.as_py().split("\n")}
                seen.update(_hash(k) for k in keys if _long_enough(k, min_chars))
                if len(seen) >= _FLUSH:
                    yield flush()
        if seen:
            yield flush()
        tidy()

    return run


def _counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """k1, k2, n: documents with the line; counted within each task before the shuffle."""
    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_document_keys(min_chars), "k1 long, k2 long, n long")
    return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"))


_FILTERS = "shard int, n_keys long, probes long, filter binary, strays binary"


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _row(shard: int, f: CuckooFilter, rows: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """A shard's row, after a look at which of its other keys the filter holds."""
    often = rows.refs.to_numpy() >= min_docs
    k1, k2 = rows.k1.to_numpy()[~often], rows.k2.to_numpy()[~often]
    stray = f.contains(k1, k2)
    pairs = np.stack([k1[stray], k2[stray]], 1).astype("<i8")
    return pd.DataFrame({"shard": [shard], "n_keys": [int(often.sum())], "probes": [int(rows.refs.sum())], "filter": [f.to_bytes()], "strays": [pairs.tobytes()]})


def _build(min_docs: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        often = rows[rows.refs >= min_docs]
        return _row(int(key[0]), CuckooFilter.of(often.k1.to_numpy(), often.k2.to_numpy()), rows, min_docs)

    return run


def _revise(min_docs: int):
    """A shard's filter with the keys that crossed the threshold put in and taken out, or built anew where it has become too full."""

    def run(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        was, often = rows.old.to_numpy() >= min_docs, rows.refs.to_numpy() >= min_docs
        up, down, now = rows[often & ~was], rows[was & ~often], rows[often]
        f = CuckooFilter.from_bytes(before["filter"].iloc[0]) if len(before) else CuckooFilter(0)
        f.delete(down.k1.to_numpy(), down.k2.to_numpy())
        if len(now) > 0.85 * f.table.size or not f.insert(up.k1.to_numpy(), up.k2.to_numpy()):
            f = CuckooFilter.of(now.k1.to_numpy(), now.k2.to_numpy())
        return _row(int(key[0]), f, rows[rows.refs > 0], min_docs)

    return run


def _filters(refs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    return materialize(refs.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build(min_docs), _FILTERS), "line-filters")


def _shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def index_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, text_col: str = "text") -> LineIndex:
    """Count every line's documents and build the shards' filters. shards: their number, else as many as the distinct keys need.

    Defined cases: rows are documents, also where ids or whole rows repeat; null or empty
    text is one empty line, which is counted only if min_chars is 0; a line that a document
    has several times counts once; an empty table makes an empty index.
    """
    refs = materialize(_counts(docs, text_col, min_chars).select("k1", "k2", F.col("n").alias("refs")), "line-refs")
    shards = shards or _shards_for(refs.count())
    return LineIndex(refs, _filters(refs, min_docs, shards), min_docs, min_chars, shards)


def update_lines(index: LineIndex, docs: DataFrame, sign: int, text_col: str = "text") -> LineIndex:
    """index with the lines of docs counted in (sign 1) or out (sign -1). The earlier index stays valid.

    Documents to take out must be among those indexed; a line that would be counted less than
    never is refused with a ValueError. An empty table changes nothing. Where the keys have
    outgrown the shards, they are dealt to more of them.
    """
    delta = _counts(docs, text_col, index.min_chars).select("k1", "k2", F.lit(0).cast("long").alias("refs"), (F.col("n") * sign).alias("delta"))
    both = index.refs.withColumn("delta", F.lit(0).cast("long")).unionByName(delta).groupBy("k1", "k2").agg(F.sum("refs").alias("old"), (F.sum("refs") + F.sum("delta")).alias("refs"))
    both = materialize(both, "line-changes")
    about = both.agg(F.count_if(F.col("refs") > 0).alias("n"), F.count_if(F.col("refs") < 0).alias("below")).first()
    if about.below:
        raise ValueError(f"{about.below} lines are in fewer indexed documents than are to be taken out")
    refs = both.where("refs > 0").select("k1", "k2", "refs")
    if about.n > 2 * SHARD_KEYS * index.shards:
        shards = _shards_for(about.n)
        return LineIndex(refs, _filters(refs, index.min_docs, shards), index.min_docs, index.min_chars, shards)
    rows = both.withColumn("shard", _shard(index.shards)).groupBy("shard")
    filters = materialize(rows.cogroup(index.filters.groupBy("shard")).applyInPandas(_revise(index.min_docs), _FILTERS), "line-filters")
    return LineIndex(refs, filters, index.min_docs, index.min_chars, index.shards)


def _hashes(lines: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [line_key(x) for x in lines]
    counted = np.fromiter((_long_enough(k, min_chars) for k in keys), bool, len(keys))
    both = np.frombuffer(b"".join(map(_hash, keys)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1], counted


def _line_keys(min_chars: int, shards: int, tasks: dict[int, int]):
    """Per text: its distinct line keys, each with its shard, and which of the shard's tasks probes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                split = [t.split("\n") for t in part.column(1).to_pylist()]
                k1, k2, counted = _hashes([x for lines in split for x in lines], min_chars)
                owner = np.repeat(np.arange(len(split)), [len(lines) for lines in split])
                both = np.unique(np.stack([owner, k1, k2], 1)[counted], axis=0)
                shard = both[:, 1] % shards
                salt = np.zeros(len(both), np.int64)
                for s, n in tasks.items():
                    at = np.flatnonzero(shard == s)
                    salt[at] = (k + at) % n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(both[:, 0])), pa.array(both[:, 1]), pa.array(both[:, 2]), pa.array(shard.astype(np.int32)), pa.array(salt.astype(np.int32))], names=["key", "k1", "k2", "shard", "task"]
                )
        tidy()

    return run


def _probe(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """The keys that a shard's filter holds, but for those that it holds by chance."""
    if not len(rows) or not len(own):
        return rows[["key", "k1", "k2"]].iloc[:0]
    hit = CuckooFilter.from_bytes(own["filter"].iloc[0]).contains(rows.k1.to_numpy(), rows.k2.to_numpy())
    found = rows.loc[hit, ["key", "k1", "k2"]]
    strays = {tuple(p) for p in np.frombuffer(own.strays.iloc[0], "<i8").reshape(-1, 2).tolist()}
    if strays:
        found = found[[p not in strays for p in zip(found.k1.tolist(), found.k2.tolist())]]
    return found


def _drop(min_chars: int, at: int, gone_at: int, names: list[str]):
    """Takes the found lines out of the texts, and puts n_lines, n_dropped and kept in the place of the found keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                n_lines, n_dropped, kept = [], [], []
                for text, gone in zip(part.column(at), part.column(gone_at)):
                    text = text.as_py() or ""
                    lines = text.split("\n")
                    n_lines.append(len(lines))
                    if not gone.is_valid:
                        n_dropped.append(0), kept.append(text)
                        continue
                    found = set(zip(*(gone.values.field(j).to_pylist() for j in (0, 1))))
                    k1, k2, counted = _hashes(lines, min_chars)
                    left = [x for x, c, p in zip(lines, counted.tolist(), zip(k1.tolist(), k2.tolist())) if not (c and p in found)]
                    n_dropped.append(len(lines) - len(left)), kept.append("\n".join(left))
                others = [c for i, c in enumerate(part.columns) if i != gone_at]
                yield pa.RecordBatch.from_arrays([*others, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=names)
        tidy()

    return run


def _cleaned(docs: DataFrame, index: LineIndex, text_col: str, into: list[str], probe_rows: int) -> DataFrame:
    """docs' columns and, named as in `into`, n_lines, n_dropped and kept."""
    key = F.unhex(F.md5(text_or_empty(text_col)))
    # shards with so many keys that they take several tasks: at most one for each probe_rows indexed lines
    tasks = {r.shard: -(-r.probes // probe_rows) for r in index.filters.where(F.col("probes") > probe_rows).select("shard", "probes").collect()}
    rows = docs.select(key.alias("key"), text_or_empty(text_col).alias("text")).mapInArrow(_line_keys(index.min_chars, index.shards, tasks), "key binary, k1 long, k2 long, shard int, task int")
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / probe_rows)).cast("int")
    filters = index.filters.where("n_keys > 0").withColumn("task", F.explode(F.sequence(F.lit(0), copies - 1))).select("shard", "task", "filter", "strays")
    found = rows.groupBy("shard", "task").cogroup(filters.groupBy("shard", "task")).applyInPandas(_probe, "key binary, k1 long, k2 long")
    # copies of a text find the same keys
    gone = found.groupBy("key").agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))
    # written out, so that both sides of the join are plain exchanges, which Spark can split where a text is common
    hidden_key, hidden_gone = fresh(docs.select(*docs.columns, *[F.lit(0).alias(x) for x in into if x not in docs.columns]), "key", "gone")
    gone = materialize(gone.select(F.col("key").alias(hidden_key), F.col("gone").alias(hidden_gone)), "frequent-lines")
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.withColumn(hidden_key, key).join(gone, hidden_key, "left").select(*own, hidden_gone)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{x}` {t}" for x, t in zip(into, ("long", "long", "string")))])
    return joined.mapInArrow(_drop(index.min_chars, docs.columns.index(text_col), len(own), [*docs.columns, *into]), schema)


_NEW = ["n_lines", "n_dropped", "kept"]


def clean_documents(docs: DataFrame, index: LineIndex, text_col: str = "text", probe_rows: int = PROBE_ROWS) -> DataFrame:
    """docs' columns with n_lines, n_dropped and kept (the text without its frequent lines).

    Every line of docs must be indexed for the answer to be exact. Defined cases: null or
    empty text is one empty line, which stays unless min_chars is 0; a text whose lines all
    go becomes empty; a very long text is treated like any other; repeated rows are cleaned
    alike; an empty table gives no rows; columns of docs that are named as the new ones give
    way to them.
    """
    return _cleaned(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _NEW]), index, text_col, _NEW, probe_rows)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, text_col: str = "text") -> DataFrame:
    """docs' columns with n_lines, n_dropped and kept: lines found in min_docs documents or more are dropped everywhere. Cases as in clean_documents()."""
    return clean_documents(docs, index_lines(docs, min_docs, min_chars, shards, text_col), text_col)


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, text_col: str = "text") -> DataFrame:
    """docs (its own columns, whatever their names) with frequent lines taken out of the texts.

    A document that loses lines and of which only blanks are left goes; one that loses none
    stays as it is, null and empty texts too. Other cases as in clean_documents().
    """
    index = index_lines(docs, min_docs, min_chars, shards, text_col)
    new = fresh(docs, *_NEW)
    n_dropped, kept = F.col(f"`{new[1]}`"), F.col(f"`{new[2]}`")
    cleaned = _cleaned(docs, index, text_col, new, PROBE_ROWS).where((n_dropped == 0) | (F.trim(kept, F.lit(" \t\n\x0b\x0c\r")) != ""))
    return cleaned.select(*[(F.when(n_dropped > 0, kept).otherwise(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])

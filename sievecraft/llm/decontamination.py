"""Benchmark decontamination: a generalised suffix automaton over the words of all test items.

Training words are streamed through the automaton; after each word its state tells the
longest stretch of words, ending there, that some item contains. Stretches that reach the
window length (or a whole item, where that is shorter) are hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, materialize, tidy

WINDOW = 10
#: Words of items in one automaton, and their bytes, at most. Larger benchmarks take several, each broadcast by itself for a pass of its own.
BLOCK_WORDS = 250_000
BLOCK_BYTES = 16 << 20

# ASCII letters and digits and all bytes of other characters are parts of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words after lower-casing A-Z: what lies between ASCII characters that are neither letters nor digits."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several items' words. items: (number, words) of items with at least one word."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.word_id: dict[bytes, int] = {}
        next_, link, length = [{}], [-1], [0]
        ends: list[list[int]] = [[]]  # states that an item's prefixes end in
        whole: dict[int, list[tuple[int, int]]] = {}
        starts: list[tuple[int, int, list[int]]] = []
        for number, words in items:
            ids = [self.word_id.setdefault(w, len(self.word_id)) for w in words]
            last = 0
            path = []
            for c in ids:
                q = next_[last].get(c)
                if q is not None and length[q] == length[last] + 1:
                    last = q
                else:
                    if q is None:
                        cur = len(next_)
                        next_.append({}), link.append(0), length.append(length[last] + 1)
                        p = last
                        while p != -1 and c not in next_[p]:
                            next_[p][c] = cur
                            p = link[p]
                        if p != -1:
                            r = next_[p][c]
                            if length[r] == length[p] + 1:
                                link[cur] = r
                            else:
                                link[cur] = self._clone(next_, link, length, p, c, r)
                                link[r] = link[cur]
                        last = cur
                    else:
                        clone = self._clone(next_, link, length, last, c, q)
                        link[q] = clone
                        last = clone
            starts.append((number, len(ids), ids))
        # Which items hold a state's strings: mark the states along each item's walk, and what their suffix links lead to.
        held: list[set[int]] = [set() for _ in next_]
        for number, n, ids in starts:
            v = 0
            for c in ids:
                v = next_[v][c]
                u = v
                while u > 0 and number not in held[u]:
                    held[u].add(number)
                    u = link[u]
            if n < window:
                whole.setdefault(v, []).append((n, number))
        # A state's whole short items: its own and those of its suffix links, longest first.
        order = sorted(range(len(next_)), key=length.__getitem__)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(next_)
        for v in order[1:]:
            # a whole item of n words ends in state v only if it is one of v's strings
            own = tuple(sorted((x for x in whole.get(v, ())), reverse=True))
            self.short[v] = own + self.short[link[v]]
        #: The state whose strings include the last `window` words, or -1.
        self.at_window = [-1] * len(next_)
        for v in order[1:]:
            self.at_window[v] = -1 if length[v] < window else v if length[link[v]] < window else self.at_window[link[v]]
        self.items = [tuple(h) if length[v] >= window and length[link[v]] < window else () for v, h in enumerate(held)]
        self.next, self.link, self.length = next_, link, length
        self.least = min([window, *(n for _, n, _ in starts)], default=window)

    @staticmethod
    def _clone(next_, link, length, p, c, q) -> int:
        clone = len(next_)
        next_.append(dict(next_[q])), link.append(link[q]), length.append(length[p] + 1)
        while p != -1 and next_[p].get(c) == q:
            next_[p][c] = clone
            p = link[p]
        return clone

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, length, items) of every occurrence of a window, and of whole items that are shorter."""
        get = self.word_id.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        if len(known) < self.least:
            return
        # only runs of words that items have, at least as long as the shortest thing to find
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(known)]])
        long = hi - lo >= self.least
        next_, link, length, window, short, at_window, items = self.next, self.link, self.length, self.window, self.short, self.at_window, self.items
        for a, b in zip(known[lo[long]].tolist(), (known[hi[long] - 1] + 1).tolist()):
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while v and c not in next_[v]:
                    v = link[v]
                    n = length[v]
                u = next_[v].get(c)
                if u is None:
                    v = n = 0
                    continue
                v, n = u, n + 1
                if n >= window:
                    yield i, window, items[at_window[v]]
                for k, number in short[v]:
                    if k <= n:
                        yield i, k, (number,)


def _scan(automaton, names: list[str], at: dict[str, int], finish):
    """Adds an automaton's hits to those of the passes before. at: places of the columns text, hit (sorted starts and ends of hit words) and, where wanted, items and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                spans, numbers, n_words = [], [], []
                for t, before in zip(part.column(at["text"]), part.column(at["hit"]).to_pylist()):
                    words = words_of(t.as_py() or "")
                    n_words.append(len(words))
                    new, items = [], set()
                    for end, n, found in own.matches(words):
                        items.update(found)
                        new += [end - n, end]
                    spans.append(_joined(before + new) if new else before)
                    numbers.append(items)
                columns = list(part.columns)
                columns[at["hit"]] = pa.array(spans, pa.list_(pa.int64()))
                if "items" in at:
                    columns[at["items"]] = pa.array([f + sorted({names[i] for i in s}) for f, s in zip(part.column(at["items"]).to_pylist(), numbers)], pa.list_(pa.string()))
                if "n_words" in at:
                    columns[at["n_words"]] = pa.array(n_words, pa.int64())
                out = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
                yield finish(out) if finish else out
        tidy()

    return run


def _joined(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _chunks(words: list[bytes], window: int, block_words: int, block_bytes: int) -> Iterator[list[bytes]]:
    """The words, whole or (beyond the bounds) in stretches that overlap by window - 1 words, so that each window lies in one."""
    lo, n = 0, len(words)
    while True:
        hi, size = min(n, lo + window), sum(map(len, words[lo : lo + window]))
        while hi < n and hi - lo < block_words and size + len(words[hi]) <= block_bytes:
            size += len(words[hi])
            hi += 1
        yield words[lo:hi]
        if hi == n:
            return
        lo = hi - window + 1


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items, streamed in blocks of at most block_words words and block_bytes bytes (or one window); an item beyond them lies in several."""
    block: list[tuple[str, list[bytes]]] = []
    n = size = 0
    for row in benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        whole = words_of(row.t)
        for words in _chunks(whole, window, block_words, block_bytes) if whole else ():
            own = sum(map(len, words))
            if block and (n + len(words) > block_words or size + own > block_bytes):
                yield block
                block, n, size = [], 0, 0
            block.append((row.i, words))
            n, size = n + len(words), size + own
    if block:
        yield block


def _sweep(df: DataFrame, at: dict[str, int], blocks: Iterator[list[tuple[str, list[bytes]]]], window: int, finish=None, schema=None) -> DataFrame:
    """df after a pass for each block of items. One automaton stands at a time: its pass is written out before the next one is made. finish, schema: what the last pass makes of its batches."""
    spark = df.sparkSession
    block, own = next(blocks, []), df.schema
    while True:
        following = next(blocks, None)
        automaton = spark.sparkContext.broadcast(ItemAutomaton([(i, words) for i, (_, words) in enumerate(block)], window))
        names = [name for name, _ in block]
        if following is None:
            return df.mapInArrow(_scan(automaton, names, at, finish), schema or own)
        df, block = materialize(df.mapInArrow(_scan(automaton, names, at, None), own), "leaks"), following
        automaton.destroy()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, hit (starts and ends of hit stretches, in words, end exclusive), items (ids, sorted as text); one row per document.

    Defined cases: null text has no words; items that are null, without id or without words
    never match; an item of fewer than `window` words matches as a whole; items of equal
    text all match; rows of equal item id count as one; a very long text is streamed, a very
    long item lies in several automata; null or repeated doc_ids and repeated rows are looked
    at row by row; with an empty benchmark nothing is hit, an empty table gives no rows;
    other columns are ignored.
    """
    df = id_and_text(docs, id_col, text_col).select("doc_id", "text", F.array().cast("array<bigint>").alias("hit"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    out = _sweep(df, {"text": 1, "hit": 2, "items": 3, "n_words": 4}, _blocks(benchmark, item_col, item_text_col, window, block_words), window)
    return out.select("doc_id", "text", "hit", F.array_sort(F.array_distinct("items")).alias("items"), "n_words")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs without benchmark passages, all columns kept, whatever their names.

    Hit words, and what stands between hit words of one stretch, are cut out of the text;
    a document with more than max_coverage of its words hit goes. Texts without hits stay
    as they are, null and empty ones too; with an empty benchmark all do. Other cases as in
    find_leaks().
    """
    (hidden,) = fresh(docs, "hit")
    df = docs.withColumn(hidden, F.array().cast("array<bigint>"))
    at, names = docs.columns.index(text_col), docs.columns

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, texts = [], []
        for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
            hit = sum(spans[1::2]) - sum(spans[::2])
            keep.append(not hit or hit <= max_coverage * len(words_of(t)))
            texts.append(_cut(t, spans) if hit and keep[-1] else t)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return _sweep(df, {"text": at, "hit": len(names)}, _blocks(benchmark, item_col, item_text_col, window, block_words), window, finish, docs.schema)


def _cut(text: str, spans: list[int]) -> str:
    """text without the words of spans and what lies between them."""
    import re

    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def leak_digest(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(F.transform("hit", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return leaks.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated")
    )


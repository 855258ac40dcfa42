"""Substring dedup: relative Lempel-Ziv parsing of documents against indexed blocks of the corpus.

A factor says that a stretch of a document can be copied from a place of the reference,
which is the corpus itself. Factors of at least `window` words are duplicate spans.

The reference lies in blocks that are dealt by content, so that a document is parsed against
each block that can hold a factor of it, and no other. A window of words can stand elsewhere
only if its minimizer (the least hash of its 8-word grams) does, and the minimizer picks the
block. A document is cut into pieces: the windows in a row that hang on one minimizer, with
their words. Every window of the corpus lies in one piece, and equal windows in one block.

1. Documents report their distinct minimizers; those that stand at one place only are done
   with. A minimizer with more pieces than a block may hold is common: its windows become
   pieces by themselves, and are dealt by their own hash.
2. Equal pieces are counted before they are dealt, so a passage that a third of the corpus
   shares comes to its block once.
3. A block indexes its pieces' words in a suffix array (by doubling ranks of words, so
   equality is that of the words themselves) and parses each piece greedily: the longest
   match at a place of the block other than its own is the next factor. At a factor's end,
   the windows that straddle it are looked at too, and may start the next factor.
4. A document's factors are those of its pieces. Words of factors go.

All exchanges carry sums that are combined before they are dealt, or joins whose large side
can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, materialize, text_or_empty, tidy

WINDOW = 35
GRAM = 8
#: Windows of one piece at most; longer rows of windows on one minimizer are cut.
PIECE_WINDOWS = 64
#: Pieces of one block, about; a minimizer with more is common.
BLOCK_PIECES = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    """Stretches of other characters than [\\x20\\x09-\\x0D], in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all stretches of k words, by doubling."""
    out, size, left, done = None, 1, k, 0
    power = h  # hashes of stretches of `size` words
    factor = base
    while left:
        if left & 1:
            if out is None:
                out, done = power, size
            else:  # out covers `done` words; put `size` words after them
                n = len(h) - done - size + 1
                out, done = out[:n] * factor + power[done : done + n], done + size
        left >>= 1
        if left:
            n = len(h) - 2 * size + 1
            if n <= 0:
                return np.empty(0, np.uint64)
            power, factor, size = power[:n] * factor + power[size : size + n], factor * factor, 2 * size
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= w:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if size < w else out


class Windows:
    """A text's windows: their number and the minimizer of each, and the hashes of its grams; none if it has fewer words than a window."""

    def __init__(self, words: list[bytes], window: int, gram: int):
        self.n = max(0, len(words) - window + 1)
        if not self.n:
            self.minimizer = self.grams = np.empty(0, np.int64)
            return
        with np.errstate(over="ignore"):
            self.grams = _mixed(_rolling(_word_hashes(words), gram, _BASE)).view(np.int64)
        self.minimizer = _sliding_min(self.grams, window - gram + 1)

    def runs(self, single: np.ndarray | None = None) -> np.ndarray:
        """Where pieces start: a new minimizer, PIECE_WINDOWS windows after such a place, or any window in `single`."""
        new = np.concatenate([[True], self.minimizer[1:] != self.minimizer[:-1]])
        at = np.arange(self.n)
        first = np.maximum.accumulate(np.where(new, at, 0))
        new |= (at - first) % PIECE_WINDOWS == 0
        return np.flatnonzero(new if single is None else new | single)


def _anchors(window: int, gram: int):
    """Per text: its distinct minimizers, with the number of pieces on each, and whether the gram stands at two places of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                keys, marks, pieces, twice, texts = [], [], [], [], part.column(1)
                for i in range(part.num_rows):
                    w = Windows(words_of(texts[i].as_py()), window, gram)
                    if w.n:
                        m, n = np.unique(w.minimizer[w.runs()], return_counts=True)
                        at = np.searchsorted(m, w.grams)
                        at[at == len(m)] = 0
                        marks.append(m), pieces.append(n)
                        twice.append(np.bincount(at[m[at] == w.grams], minlength=len(m)) > 1)
                        keys.append(np.full(len(m), i))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(marks)), part.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(pieces).astype(np.int64)), pa.array(np.concatenate(twice))], names=["minimizer", "key", "pieces", "twice"]
                    )
        tidy()

    return run


def _pieces(window: int, gram: int):
    """Per text: its pieces on repeated minimizers. deal: what picks the block; piece: a 128-bit hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                rows, starts, deals, names, texts = [], [], [], [], []
                for i in range(part.num_rows):
                    words = words_of(part.column(2)[i].as_py())
                    w = Windows(words, window, gram)
                    marks = part.column(3)[i].values
                    marked, common = (marks.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    single = np.isin(w.minimizer, marked[common])
                    first = w.runs(single)
                    last = np.append(first[1:], w.n)
                    on = np.isin(w.minimizer[first], marked)
                    for a, z, m, s in zip(first[on].tolist(), last[on].tolist(), w.minimizer[first[on]].tolist(), single[first[on]].tolist()):
                        text = b" ".join(words[a : z + window - 1])
                        name = xxhash.xxh3_128_digest(text)
                        rows.append(i), starts.append(a), texts.append(text), names.append(name)
                        deals.append(int.from_bytes(name[:8], "little", signed=True) if s else m)
                if rows:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1).take(at), pa.array(starts, pa.int32()), pa.array(names, pa.binary()), pa.array(deals, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                        names=["key", "copies", "start", "piece", "deal", "words"],
                    )
        tidy()

    return run


class Block:
    """A suffix array over the words of a block's distinct pieces."""

    def __init__(self, texts: list[str]):
        lens = np.array([t.count(" ") + 1 for t in texts], np.int64)
        ids, distinct = pd.factorize(np.array(" ".join(texts).split(" "), object))
        # each piece ends in a word of its own, so no match goes past its end
        self.starts = np.cumsum(lens + 1) - lens - 1
        self.lens = lens
        x = np.empty(int(lens.sum()) + len(lens), np.int64)
        ends = self.starts + lens
        inside = np.ones(len(x), bool)
        inside[ends] = False
        x[inside], x[ends] = ids, len(distinct) + np.arange(len(lens))
        self.owner = np.repeat(np.arange(len(lens)), lens + 1)
        # ranks of stretches of 1, 2, 4, ... words; beyond the array's end is nothing, the least
        self.ranks = [x.astype(np.int32)]
        size, longest = 1, int(lens.max()) + 1
        while size < longest:
            r = self.ranks[-1].astype(np.int64)
            ahead = np.zeros(len(r), np.int64)
            ahead[:-size] = r[size:] + 1
            self.ranks.append(np.unique(r * (len(r) + len(distinct) + 2) + ahead, return_inverse=True)[1].astype(np.int32))
            size *= 2
        order = np.argsort(self.ranks[-1], kind="stable")
        a, b, same = order[:-1], order[1:], np.zeros(len(order) - 1, np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):  # words that neighbours in the order have in common
            r = self.ranks[j]
            last = len(r) - 1
            same += (r[np.minimum(a + same, last)] == r[np.minimum(b + same, last)]).astype(np.int64) << j
        #: per place: the length of the longest match elsewhere in the block, and where it is
        self.length, self.place = np.zeros(len(x), np.int64), np.full(len(x), -1)
        self.length[b], self.place[b] = same, a
        more = same > self.length[a]
        self.length[a[more]], self.place[a[more]] = same[more], b[more]

    def factors(self, repeated: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """(piece, start, length, source piece, place in it) of every factor, in order. repeated: pieces that stand at several places, and so are factors as a whole."""
        whole = np.flatnonzero(repeated)
        out = [(p, 0, n, p, 0) for p, n in zip(whole.tolist(), self.lens[whole].tolist())]
        at = np.flatnonzero((self.length >= window) & ~repeated[self.owner])
        owner, end = -1, 0
        for i, p, n, j in zip(at.tolist(), self.owner[at].tolist(), self.length[at].tolist(), self.place[at].tolist()):
            if p != owner:
                owner, end = p, -1
            # a window inside the last factor adds nothing; one that straddles its end may start the next
            if i + window > end and i + n > end:
                out.append((p, i, n, j, None))
                end = i + n
        if not out:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        piece, start, length, source = (np.array([f[k] for f in out], np.int64) for k in range(4))
        parsed = np.arange(len(out)) >= len(whole)
        place = np.where(parsed, source, 0)
        source = np.where(parsed, self.owner[place], source)
        return piece, np.where(parsed, start - self.starts[piece], 0), length, source, np.where(parsed, place - self.starts[source], 0)


def _parse_block(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        names, repeated = pdf.piece.to_numpy(), pdf.n.to_numpy() > 1
        piece, start, length, source, place = Block(pdf.words.tolist()).factors(repeated, window)
        return pd.DataFrame({"piece": names[piece], "at": start.astype("int32"), "length": length.astype("int32"), "source": names[source], "place": place.astype("int32")})

    return run


_FACTORS = "piece binary, at int, length int, source binary, place int"


def covered(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in a factor."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:n] > 0


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the words of a document's factors out."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            n_removed, kept = [], []
            for i in range(part.num_rows):
                words = words_of(part.column(1)[i].as_py())
                at, length = (part.column(2)[i].values.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                gone = covered(len(words), at, length)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(x for x, g in zip(words, gone) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_removed", "kept"])
    tidy()


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words and the words joined by one space."""
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            words = [words_of(t.as_py()) for t in part.column(2)]
            kept = [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "key", "n_words", "kept"])


def _parsed(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str, block_pieces: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of docs: texts (doc_id, key, text), those with pieces (key, copies, text), pieces (key, copies, start, piece, deal, words), and factors of pieces (piece, at, length, source, place)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty(text_col))).alias("key"), text_or_empty(text_col).alias("text"))
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))

    # 1: which minimizers stand at several places (also in copies of one text), and which are common
    anchors = materialize(texts.select("key", "text").mapInArrow(_anchors(window, gram), "minimizer long, key binary, pieces long, twice boolean"), "anchors")
    n_anchors = anchors.count()
    seen = anchors.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.sum("pieces").alias("pieces"))
    # written out, so that both sides of the join are plain exchanges, which Spark can split where a key is common
    repeated = materialize(seen.where("n > 1 OR twice").select("minimizer", (F.col("pieces") > block_pieces).alias("common")), "repeated-minimizers", files_for(n_anchors, 9))
    marked = anchors.select("minimizer", "key").join(repeated, "minimizer").groupBy("key").agg(F.collect_set(F.struct("minimizer", "common")).alias("marks"))
    # one row for each text that has such; equal rows (doc_id and text) may stay, and do no harm
    wanted = marked.join(copies, "key").select(F.col("key").alias("own_key"), "copies", "rep", "marks")
    # joined on both, so that many copies of a text are dealt by their ids
    chosen = texts.join(wanted, (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "copies", "text", "marks")
    chosen = materialize(chosen, "marked-texts")

    # 2: pieces, equal ones counted before they are dealt
    pieces = materialize(chosen.mapInArrow(_pieces(window, gram), "key binary, copies long, start int, piece binary, deal long, words string"), "pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    distinct = pieces.groupBy("piece").agg(F.sum("copies").alias("n"), F.first("deal").alias("deal"), F.first("words").alias("words"))

    # 3: the blocks' indexes, and the parse
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("deal"), F.lit(blocks)).cast("int"))
    return texts, chosen.select("key", "copies", "text"), pieces, materialize(dealt.groupBy("block").applyInPandas(_parse_block(window), _FACTORS), "factors")


def factorize(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """key (md5 of a distinct text), start, length, source (md5 of a text), source_start: every factor, in words, with one place that it can be copied from.

    Source and place are a text's own only where another document has that very text. Other
    cases as in dedup_substrings().
    """
    _, _, pieces, factors = _parsed(docs, window, gram, id_col, text_col, block_pieces)
    where = pieces.groupBy("piece").agg(F.min(F.struct("key", "start")).alias("low"), F.max(F.struct("key", "start")).alias("high"))
    located = pieces.select("piece", "key", "start").join(factors, "piece").join(where.withColumnRenamed("piece", "source"), "source")
    mine = (F.col("low.key") == F.col("key")) & (F.col("low.start") + F.col("place") == F.col("start") + F.col("at"))
    found = F.when(mine, F.col("high")).otherwise(F.col("low"))
    return located.select("key", (F.col("start") + F.col("at")).alias("start"), "length", found["key"].alias("source"), (found["start"] + F.col("place")).alias("source_start")).distinct()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", kept_as=None, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space); one row per document.

    Removed is each word of a factor of at least `window` words, that is of a stretch of
    `window` words that also starts anywhere else, in the same document or another one; all
    places lose it. kept_as: an expression over kept (such as a digest) that is returned in
    its stead, and spares the last exchange the texts.
    Defined cases: null or empty text has no words and is kept as the empty text; a text of
    fewer words than the window loses none; a very long text is cut into pieces like any
    other; documents of equal text lose all words, if they have a window; null or repeated
    doc_ids and repeated rows are treated row by row; an empty table gives no rows; other
    columns are ignored.
    """
    wide, kept_as = kept_as is None, kept_as or (lambda c: c)
    texts, chosen, pieces, factors = _parsed(docs, window, gram, id_col, text_col, block_pieces)

    # 4: documents' factors
    placed = pieces.select("piece", "key", "start").join(factors.select("piece", "at", "length"), "piece")
    spans = placed.groupBy("key").agg(F.collect_set(F.struct((F.col("start") + F.col("at")).alias("at"), "length")).alias("spans"))
    parsed = chosen.join(spans, "key").select("key", "text", "spans").mapInArrow(_remove, "key binary, n_removed long, kept string").dropDuplicates(["key"])
    parsed = materialize(parsed.select("key", "n_removed", kept_as(F.col("kept")).alias("parsed_kept")), "outcome", None if wide else files_for(chosen.count(), 128))

    plain = texts.select("doc_id", "key", "text").mapInArrow(_plain, "doc_id long, key binary, n_words long, kept string").select("doc_id", "key", "n_words", kept_as(F.col("kept")).alias("kept"))
    return plain.join(parsed, "key", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("parsed_kept", "kept").alias("kept"))

"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass 1 tokenizes every partition of the input, keeps each document's start within its
partition, and writes the ids to a table in the shared folder. One prefix sum over the
partitions' token totals (one row per input partition) then gives each document its global
offset, and pass 2 cuts documents at multiples of the window without moving any ids.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize, tidy

WINDOW = 2048
END_ID = 1

_encoders: dict[str, "Encoder"] = {}

# fixed value: the published pattern that byte-level pre-tokenizers have built in
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs beyond what the merging engine is trusted with: its pattern goes back over blanks, and its stack is bounded.
_LONG_RUN = re.compile(r"\s{1000}|\S{4000}")


class Encoder:
    """Text -> ids of a byte-level BPE vocabulary (.json) as the tokenizers library gives them, as little-endian uint32.

    The library alone takes about twice the time of a second engine (README), so one of the
    same algorithm replays the vocabulary's merges, and only where both are sure to agree: the
    vocabulary has the built-in pattern, no normalizer and no dropout, and numbers its tokens
    in the order of its merges; the text has no added token, and no run of a thousand blanks
    or four thousand other characters. Everything else is given to the library. Tests compare
    both over every code point, random texts and whole tables.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library, self.engine = Tokenizer.from_file(vocabulary), None
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        built_in = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not spec["normalizer"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] if built_in and plain else []
        if made and all(a < b for a, b in zip(made, made[1:])):
            import tiktoken

            # The printable stand-ins that byte-level vocabularies use for bytes: a byte that prints stands for itself.
            prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in prints]
            byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
            if all(ranks[bytes([b])] < made[0] for b in range(256)):
                self.engine = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_engine(self, text: str) -> bool:
        return self.engine is not None and not any(a in text for a in self.added) and not _LONG_RUN.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self.engine.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if self._by_engine(t) else None for t in texts]
        left = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(left, self.library.encode_batch_fast([texts[i] for i in left], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[vocabulary] = Encoder(vocabulary)
        tidy()
    return _encoders[vocabulary]


def _tokenize(vocabulary: str, end_id: int | None):
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pid, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [x + tail for x in own.encode(part.column(1).to_pylist())]
                n = [len(x) // 4 for x in ids]
                starts = list(itertools.accumulate(n, initial=at))
                at = starts.pop()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([pid] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "pid", "part_start", "doc_tokens", "ids"],
                )
        tidy()

    return run


def token_table(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, global_start (its offset in the concatenated stream), doc_tokens, ids (little-endian uint32)."""
    spark = docs.sparkSession
    made = id_and_text(docs, id_col, text_col).mapInArrow(_tokenize(vocabulary, end_id), "doc_id long, pid int, part_start long, doc_tokens long, ids binary")
    tokens = materialize(made, "tokens")
    # one row per partition that was written, not per document
    totals = sorted((r.pid, r.n) for r in tokens.groupBy("pid").agg(F.sum("doc_tokens").alias("n")).collect())
    bases = list(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0)))
    base = spark.createDataFrame(bases, "pid int, base long")
    return tokens.join(F.broadcast(base), "pid").select("doc_id", (F.col("base") + F.col("part_start")).alias("global_start"), "doc_tokens", "ids")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One boundary record per piece of a document in a window of `window` ids.

    doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (of the piece in its sequence), and with_ids: ids (little-endian
    uint32). Sequences are full but for the last one, which a reader pads.
    Defined cases: null text is empty text; an empty text yields its end id alone (nothing
    where end_id is None); a very long text is tokenized whole and cut into as many pieces
    as it fills windows, whatever it consists of; null or repeated doc_ids and repeated rows
    are packed row by row; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    w = F.lit(window).cast("long")
    tokens = token_table(docs, vocabulary, end_id, id_col, text_col).where("doc_tokens > 0")
    first, last = F.floor(F.col("global_start") / w), F.floor((F.col("global_start") + F.col("doc_tokens") - 1) / w)

    def piece(s):
        lo = F.greatest(s * w, F.col("global_start")) - F.col("global_start")
        hi = F.least((s + 1) * w - F.col("global_start"), F.col("doc_tokens"))
        ids = F.substring(F.col("ids"), (lo * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int"))
        return F.struct(
            lo.alias("start"), (hi - lo).alias("length"), F.crc32(ids).alias("ids_crc32"), s.alias("sequence_id"), (F.col("global_start") + lo - s * w).alias("offset"), *([ids.alias("ids")] if with_ids else [])
        )

    pieces = tokens.select("doc_id", "doc_tokens", F.explode(F.transform(F.sequence(first.cast("long"), last.cast("long")), piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else []))

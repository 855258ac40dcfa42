"""Token counts: byte-pair merging of many pre-tokens at once in ragged numpy arrays.

A batch's pre-tokens lie end to end in one array of symbols. In each round every pre-token
finds its lowest-ranked adjacent pair and merges that pair's occurrences, all pre-tokens at
the same time; those without a mergeable pair leave. The symbols that survive are counted.

A pre-token of many symbols would keep the rounds going for thousands of ranks. Such ones
are merged by the same rule, all occurrences of the lowest rank at once, but a round touches
only the places where that rank stands and their neighbours, which a queue by rank tells.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text

LIMIT = 2048
#: Distinct pre-tokens whose counts a Python worker remembers; only a cache.
REMEMBERED = 400_000

#: Symbols from which a pre-token gets a queue of its own; the result is the same.
LONG = 256

_counters: dict[str, "Counter"] = {}


class Merger:
    """The merge table of a BPE vocabulary as sorted pair keys."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.vocab, self.suffix = vocab, suffix or ""
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank_made = made
        #: True if no pair can outrank the one whose merging made it possible: then all of a pair's occurrences can be merged in one round.
        last_made = np.full(self.size, -1, np.int64)
        np.maximum.at(last_made, made, np.arange(len(made)))
        rank = np.arange(len(made))
        self.all_at_once = bool((last_made[left] < rank).all() and (last_made[right] < rank).all())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.iinfo(np.int64).max)

    def count(self, pieces: list[list[int]]) -> np.ndarray:
        """Surviving symbols of each sequence of symbol ids."""
        out = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(out >= LONG).tolist():
            out[i] = self.count_long(np.array(pieces[i], np.int64))
        live = np.array([i for i, p in enumerate(pieces) if 1 < len(p) < LONG], np.int64)
        if not len(live) or not len(self.keys):
            return out
        none = np.iinfo(np.int64).max
        sym = np.concatenate([np.array(pieces[i], np.int64) for i in live])
        lens = out[live]
        rank = np.empty(0)
        while len(live):
            starts = np.cumsum(lens) - lens
            rank = np.full(len(sym), none)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[starts + lens - 1] = none
            best = np.minimum.reduceat(rank, starts)
            out[live] = lens
            go = best < none
            if not go.all():  # finished sequences leave
                keep = np.repeat(go, lens)
                sym, rank = sym[keep], rank[keep]
                live, lens, best = live[go], lens[go], best[go]
                if not len(live):
                    break
                starts = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(live)), lens)
            hit = rank == best[owner]
            if self.all_at_once:  # of overlapping occurrences, every other from the left
                p = np.flatnonzero(hit)
                run = np.concatenate([[True], (np.diff(p) > 1) | (owner[p[1:]] != owner[p[:-1]])])
                first = p[np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))]
                p = p[(p - first) % 2 == 0]
            else:
                p = np.flatnonzero(hit)
                p = p[np.concatenate([[True], owner[p[1:]] != owner[p[:-1]]])]
            sym[p] = self.by_rank_made[rank[p]]
            gone = np.zeros(len(sym), bool)
            gone[p + 1] = True
            lens = lens - np.bincount(owner[p], minlength=len(live))
            sym = sym[~gone]
        return out


    def count_long(self, sym: np.ndarray) -> int:
        """Surviving symbols of one long sequence: its lowest-ranked pairs are merged rank by rank, from a queue of the places of each rank."""
        none, n = np.iinfo(np.int64).max, len(sym)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), none)  # of the pair that starts at a place
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the living neighbours
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            for part in np.split(at, np.flatnonzero(np.diff(own)) + 1):
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(part)

        note(np.arange(n))
        left = n
        while waiting:
            r = heapq.heappop(waiting)
            p = np.unique(np.concatenate(places.pop(r)))
            p = p[rank[p] == r]  # others have merged since they were noted
            if not len(p):
                continue
            if self.all_at_once:  # of overlapping occurrences, every other from the left
                run = np.concatenate([[True], after[p[:-1]] != p[1:]])
                first = np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))
                p, rest = p[(np.arange(len(p)) - first) % 2 == 0], p[:0]
            else:
                p, rest = p[:1], p[1:]
            q = after[p]
            sym[p], rank[q] = self.by_rank_made[r], none
            end = after[q]
            after[p] = end
            inner = end < n
            before[end[inner]] = p[inner]
            left -= len(p)
            pair = np.full(len(p), none)
            pair[inner] = self.ranks(sym[p[inner]], sym[end[inner]])
            rank[p] = pair
            ahead = before[p][before[p] >= 0]
            rank[ahead] = self.ranks(sym[ahead], sym[after[ahead]])
            note(np.unique(np.concatenate([p, ahead, rest])))
        return left


class Counter:
    """Counts tokens as the tokenizers library would for a vocabulary file of it: BPE over regex pre-tokens and byte symbols."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout"):
            raise ValueError("only BPE vocabularies over bytes are supported")
        self.merger = Merger(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in prints]
        char = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}
        vocab, end = model["vocab"], self.merger.suffix
        self.inner = [vocab[char[b]] for b in range(256)]
        self.final = [vocab[char[b] + end] for b in range(256)]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.first_chars = added
        self.steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])]
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])]
        pattern = next((p["pattern"]["Regex"] for p in split if p["type"] == "Split"), None)
        # fixed value: the published pattern that byte-level pre-tokenizers have built in
        self.pattern = regex.compile(pattern or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.known: dict[str, int] = {}
        self.byte_of = {c: b for b, c in char.items()}
        self.vocabulary, self.library = vocabulary, None
        self.plain: set[str] = set()

    def all_known(self, text: str) -> bool:
        """Whether Python's Unicode tables know all characters. Other tables may know those it does not, so such texts are split by the library itself."""
        new = set(text) - self.plain
        if new:
            self.plain.update(c for c in new if unicodedata.category(c) != "Cn")
        return new <= self.plain

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if text.isascii() or self.all_known(text):
            return self.pattern.findall(self.normal(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8", "surrogatepass") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def normal(self, text: str) -> str:
        if "NFC" in self.steps and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # The Replace step only turns white space into blanks, which the pattern drops either way.
        if "Lowercase" in self.steps:
            # letter by letter, without a word-final form
            text = text.replace("Σ", "σ").lower()
        return text

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens it has."""
        if self.added is None or not any(a in text for a in self.first_chars):
            return self.split(text), 0
        parts = self.added.split(text)
        return [w for x in parts[::2] for w in self.split(x)], len(parts) // 2

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; pre-tokens not met before are merged together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.pieces(t) for t in texts]
        known = self.known
        new = list({w for words, _ in split for w in words if w not in known})
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            inner, final = self.inner, self.final
            symbols = [[inner[b] for b in raw[:-1]] + [final[raw[-1]]] for raw in (w.encode() for w in part)]
            known.update(zip(part, self.merger.count(symbols).tolist()))
        out = [sum(map(known.__getitem__, words)) + extra for words, extra in split]
        for w in new:  # long ones would fill the memory
            if len(w) > LONG:
                del known[w]
        return out


def counter(vocabulary: str) -> Counter:
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text; no shuffle.

    Defined cases: null text is empty text, which has no tokens; a very long text, or one of
    a single very long word, is counted whole; null or repeated doc_ids and repeated rows are
    counted row by row; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                n = own.counts(texts)
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Pure parts of the operators against plain versions, on generated inputs."""

import re

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievecraft.llm import decontamination, exact_topk, jaccard_join, line_dedup, packing, substring_dedup, token_counts

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0caAbBzZéÉßİΣς0-_'.,<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)
SETTINGS = settings(max_examples=200, deadline=None)
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


@SETTINGS
@given(TEXT)
def test_words_and_keys(text):
    assert [w.decode() for w in decontamination.words_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    assert [w.decode() for w in substring_dedup.words_of(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)
    line = text.replace("\n", " ")
    assert line_dedup.line_key(line).decode() == lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


@SETTINGS
@given(st.lists(TEXT, max_size=4))
def test_tokens(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.counter(public_tokenizers.path("word_bpe_49k.json")).counts(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    tok, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@SETTINGS
@given(st.lists(st.text("abc ", min_size=1, max_size=25).map(lambda t: " ".join(t.split())).filter(len), min_size=1, max_size=5, unique=True), st.integers(2, 5))
def test_factors_cover_every_repeated_window(texts, window):
    block, split = substring_dedup.Block(texts), [t.split(" ") for t in texts]
    piece, start, length, source, place = (x.tolist() for x in block.factors(np.zeros(len(texts), bool), window))
    seen: dict = {}
    for w in split:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] = seen.get(tuple(w[k : k + window]), 0) + 1
    for p, w in enumerate(split):
        want = {i for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for i in range(k, k + window)}
        assert {i for q, a, n in zip(piece, start, length) if q == p for i in range(a, a + n)} == want
    for p, a, n, q, b in zip(piece, start, length, source, place):
        assert n >= window and split[p][a : a + n] == split[q][b : b + n] and (p, a) != (q, b)


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25)


@SETTINGS
@given(st.lists(WORDS.filter(len), min_size=1, max_size=4), WORDS, st.integers(1, 6))
def test_automaton_finds_every_window(items, words, window):
    found = {(end - n, end, i) for end, n, own in decontamination.ItemAutomaton(list(enumerate(items)), window).matches(words) for i in own}
    want = set()
    for i, item in enumerate(items):
        k = min(window, len(item))
        own = {tuple(item[a : a + k]) for a in range(len(item) - k + 1)}
        want |= {(a, a + k, i) for a in range(len(words) - k + 1) if tuple(words[a : a + k]) in own}
    assert found == want


@SETTINGS
@given(st.lists(st.integers(0, 80), min_size=0, max_size=30).map(lambda x: sorted(zip(x[::2], x[1::2]))))
def test_joined_spans(pairs):
    spans = [x for a, b in pairs for x in (min(a, b), max(a, b) + 1)]
    flat = {i for a, b in zip(spans[::2], spans[1::2]) for i in range(a, b)}
    joined = decontamination._joined(spans)
    assert {i for a, b in zip(joined[::2], joined[1::2]) for i in range(a, b)} == flat and joined == sorted(set(joined))


@SETTINGS
@given(st.integers(1, 90), st.integers(1, 6), st.integers(0, 2**31), st.booleans())
def test_ball_tree(n, k, seed, equal):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3 if equal else -900, 4 if equal else 900, (n, 3))
    ids = rng.permutation(n)
    tree = exact_topk.BallTree(ids, x, leaf=4)
    q, own = x[0], int(ids[0])
    want = sorted((-int(v @ q), int(i)) for v, i in zip(x, ids) if i != own)[:k]
    assert [(-s, i) for s, i in tree.search(own, q, k, None, True)] == want
    if len(want) == k:  # a shared bound that is reached changes nothing
        assert [(-s, i) for s, i in tree.search(own, q, k, -want[-1][0], True)] == want


@SETTINGS
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_similarity(a, b):
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(a | b), np.uint64)
    assert (jaccard_join.signature(y) <= jaccard_join.signature(x)).all()
    want = len(a) / len(a | b) >= 0.8 - 1e-12
    one = np.zeros(1, int)
    assert bool(jaccard_join._similar([x], [y], one, one, 0.8)[0]) == want
    many = np.zeros(100, int)
    assert bool(jaccard_join._similar([x], [y], many, many, 0.8)[0]) == want  # by matrices

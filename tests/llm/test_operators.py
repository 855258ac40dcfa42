"""Each operator against brute force on small tables with every odd case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import empty, odd_documents, sorted_rows, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievecraft.llm import common, decontamination, exact_topk, jaccard_join, line_dedup, packing, quality, sharding, substring_dedup, token_counts, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- shared -----------------------------------------------------------------------------------

def test_sieve_lets_all_wanted_rows_through(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("at"), F.unhex(F.md5(F.col("id").cast("string"))).alias("bits"))
    keys = df.where("CAST(at AS INT) % 7 = 3").select(F.col("bits").alias("k"))
    got = common.sieved(df, F.col("bits"), keys, "k")
    assert got.columns == df.columns
    ids = [int(r["at"]) for r in got.collect()]
    wanted = set(range(3, 20_000, 7))
    assert len(ids) == len(set(ids)) and wanted <= set(ids) and len(ids) - len(wanted) < 50
    assert common.sieved(df, F.col("bits"), keys.limit(0), "k").count() == 0
    assert common.fresh(df, "AT", "new", "Bits") == ["AT_0", "new", "Bits_0"]


# --- 1 packing --------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    df, rows = odd_documents(spark)
    tok = Tokenizer.from_file(BYTES)
    got = packing.pack(df.repartition(5), BYTES, window=64).collect()
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    # sequences are gapless from 0, and full but for the last
    seqs = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
    for s, pieces in seqs.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    # pieces in stream order give the documents back
    docs, current = collections.Counter(), []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            current = []
        assert len(current) == r.start
        current += np.frombuffer(r.ids, "<u4").tolist()
        if len(current) == r.doc_tokens:
            docs[(r.doc_id, tuple(current))] += 1
    assert docs == want


def test_packing_empty_table_and_no_end_id(spark):
    assert packing.pack(empty(spark), BYTES).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert packing.pack(one, BYTES, end_id=None).count() == 0
    assert packing.pack(one, BYTES).select("length", "doc_tokens").first() == (1, 1)


LONG_TEXTS = [" " * 1_100_000, " " * 999 + "a" + "\t" * 999, "a" * 3999 + " " + "b" * 4001, "\u3000 " * 499 + "x" + "\xa0" * 1500, " " * 3_000_000 + "a", "\n" * 2_000_000 + "b", "a" * 1_000_000, "\u00e9" * 300_000, " \n" * 700_000 + "x", "x y " * 200_000]


def test_packing_of_very_long_texts(spark):
    tok = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame(list(enumerate(LONG_TEXTS)), "doc_id long, text string")
    made = collections.defaultdict(list)
    for r in packing.pack(docs, BYTES).sort("doc_id", "start").collect():
        assert len(made[r.doc_id]) == r.start and r.length <= packing.WINDOW
        made[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert made == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(LONG_TEXTS)}


def test_encoder_gives_the_library_s_ids_for_whole_tables(spark, small):
    own = packing.encoder(BYTES)
    texts = [r.text or "" for r in spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet").select("text").collect()]
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in own.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_encoder_gives_the_library_s_ids_for_every_character():
    import random

    own, rng = packing.encoder(BYTES), random.Random(1)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u3000\ufeff'sStrvldm019aZ."
    texts = [x.join(chars[k : k + 50]) for x in ("a", " 1 ") for k in range(0, len(chars), 50)]
    texts += ["".join(rng.choice(odd if rng.random() < 0.7 else chars) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", *LONG_TEXTS[1:4], *("".join(rng.choice(odd + "ab ") * rng.randint(1, 1500) for _ in range(5)) for _ in range(100))]
    assert own.engine is not None and sum(map(own._by_engine, texts)) > 0.9 * len(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    whole = packing.Encoder(WORDS)  # a vocabulary that only the library can read
    assert whole.engine is None and whole.encode(["ab c", ""]) == [np.array(whole.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ("ab c", "")]


# --- 2 sharding -------------------------------------------------------------------------------

def brute_table(shards, size):
    prefer = []
    for s in shards:
        d = hashlib.blake2b(s.encode(), digest_size=16).digest()
        at, skip = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:], "little") % (size - 1) + 1
        prefer.append([(at + k * skip) % size for k in range(size)])
    table, turn = [None] * size, 0
    while None in table:
        k = turn % len(shards)
        table[next(p for p in prefer[k] if table[p] is None)] = k
        turn += 1
    return table


def test_lookup_table_matches_turns_and_moves_little():
    shards = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert table.tolist() == brute_table(shards, 101)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], 101)
    kept = [a == b for a, b in zip(table, fewer) if a != 6]
    assert np.mean(kept) > 0.6
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_place(spark):
    df, rows = odd_documents(spark)
    shards = [f"s{k}" for k in range(5)]
    got = sharding.place(df.withColumn("slot", F.lit("mine")), shards, size=101)
    assert got.count() == len(rows) and {"text", "slot", "shard", "shard_name"} <= set(got.columns)
    table = sharding.lookup_table(shards, 101)
    want = df.select("doc_id", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(101)).alias("slot")).collect()
    assert sorted_rows(got, "doc_id", "slot", "shard") == sorted(((r.doc_id, r.slot, int(table[r.slot])) for r in want), key=repr)
    assert sharding.place(empty(spark), shards, size=101).count() == 0


def test_write_shards(spark, tmp_path):
    df, rows = odd_documents(spark)
    sharding.write_shards(df.withColumn("slot", F.lit("mine")).withColumn("__slot_of_row", F.lit("mine")), str(tmp_path / "out"), ["a", "b", "c"], size=11)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.where("slot = 'mine' AND __slot_of_row = 'mine'").count() == len(rows)
    assert back.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), ["a", "b"], size=11)
    assert not list((tmp_path / "none").glob("shard=*"))


# --- 3 and 4 classifiers ----------------------------------------------------------------------

def labelled(spark, n=400):
    import random

    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        text, toxic, bad = words(rng, 60), i % 5 == 0, i % 4 == 1
        if toxic:
            parts = text.split()
            for k in range(4):
                parts[rng.randrange(60)] = rng.choice(["vilesnark", "vilegrub", "rotten"]) + rng.choice(["", "ly", "s"])
            text = " ".join(parts)
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        docs.append((i, text))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "no id"), (0, docs[0][1])]
    labels += [(9999, 1, 0), (None, 1, 1), (n + 2, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, label):
    docs, labels, n = labelled(spark)
    allowed = lambda i: F.crc32(i.cast("string")) % 4 != 2
    model = module.train(docs, labels, label, allowed)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_documents(docs, model).collect()}
    assert quality.score_documents(docs, model).count() == docs.count()
    truth = {r.doc_id: r[label] for r in spark.createDataFrame([(i, int(i % 4 != 1), int(i % 5 == 0)) for i in range(n)], "doc_id long, quality int, toxic int").collect()}
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i][1] == truth[i] for i in held]) > 0.95
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for s, p in got.values())
    assert quality.score_documents(docs.limit(0), model).count() == 0
    # labels that must not be read change nothing
    flipped = labels.withColumn(label, F.when(allowed(F.col("doc_id")), F.col(label)).otherwise(1 - F.col(label)))
    again = module.train(docs, flipped, label, allowed)
    assert np.allclose(again.weights, model.weights)


def test_classifiers_with_little_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        for labels in (none, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], none.schema)):
            scores = [r.score for r in quality.score_documents(docs, module.train(docs, labels, label)).collect()]
            assert len(scores) == 2 and all(0 < s < 1 for s in scores)


def test_keep_good_keeps_columns(spark):
    docs, labels, n = labelled(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i in range(n) if i % 4 == 1}) < 5 and len(ids & {i for i in range(n) if i % 4 != 1}) > 0.98 * n * 3 / 4


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(80)]
    y = np.where([(0 in r) or (1 in r) for r in rows], 1.0, -1.0)
    values, c = rng.uniform(0.5, 1.5, 12), np.full(80, 0.5)
    w, b = quality.dual_coordinate_descent(rows, values, y, c, 12, epochs=2000, tolerance=1e-9)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r] = values[r]
    x[:, 12] = 1
    v = np.append(w, b)
    objective = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    best = objective(v)
    for _ in range(300):
        assert objective(v + rng.normal(0, 0.01, 13)) >= best - 1e-6


def test_log_count_ratios_match_a_plain_count():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(9, rng.integers(1, 6), replace=False)) for _ in range(50)]
    y = rng.integers(0, 2, 50)
    got = quality.log_count_ratios(rows, y, 10)
    for f in range(10):
        have = [sum(1 for r, t in zip(rows, y) if t == c and f in r) for c in (0, 1)]
        share = [(have[c] + 1) / (sum(y == c) + 2) for c in (0, 1)]
        assert got[f] == pytest.approx(np.log(share[1] / share[0]) if sum(have) > 1 else 0)


def test_indicators_are_the_n_grams_of_three_streams():
    """Texts share a place exactly where they share an n-gram."""
    place = lambda t: set(quality.indicators(t).tolist())
    assert place("") == place(" \n") == {0} and place("Alpha beta") == place("Alpha  beta\n")
    one = place("alpha beta") & place("alpha gamma")
    assert one >= place("alpha") and place("alpha beta") - place("gamma beta alpha")  # the pair has a place of its own
    assert quality._runs(np.array([0, 1, 1, 1, 0, 1], bool)).tolist() == [0, 1] and quality._runs(np.zeros(4, bool)).tolist() == []
    assert place("a b " * 40) > place("a b " * 20) - place("a b a b") and len(place("x " * 64)) == len(place("x " * 32)) + 2
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    assert len(place(long)) > 10_000 and max(place(long)) < quality.PLACES


def test_risk_matches_a_plain_loop():
    rng = np.random.default_rng(0)
    z, kind, p = rng.normal(0, 2, 40), rng.integers(0, 2, 40), 0.3
    confirmed, unlabelled = kind == 0, kind == 1
    loss = lambda v: 1 / (1 + np.exp(v))

    def plain(z):
        toxic = p * sum(loss(v) for v, c in zip(z, confirmed) if c) / confirmed.sum()
        harmless = sum(loss(-v) for v, u in zip(z, unlabelled) if u) / unlabelled.sum() - p * sum(loss(-v) for v, c in zip(z, confirmed) if c) / confirmed.sum()
        return np.array([toxic, harmless])

    toxic, harmless, miss, mark = toxicity.risk(z, confirmed, unlabelled, p)
    assert np.allclose([toxic, harmless], plain(z))
    for i in range(40):
        step = np.eye(40)[i] * 1e-5
        assert np.allclose((plain(z + step) - plain(z - step)) / 2e-5, [miss[i], mark[i]], atol=1e-8)


def test_non_negative_risk_separates():
    rows = [(np.array([0] if i % 4 == 0 else [1]), np.array([1.0])) for i in range(200)]
    confirmed = np.array([i % 8 == 0 for i in range(200)])
    w, b = toxicity.non_negative_fit(rows, confirmed, ~confirmed, 0.15, 2)
    assert w[0] + b > 0 > w[1] + b  # unconfirmed toxic rows are found by their likeness


def test_toxicity_reads_no_labels_but_confirmed_ones(spark):
    """Harmless labels, wrong ones included, and their absence make no difference where the prior is given."""
    docs, labels, n = labelled(spark)
    models = [toxicity.train(docs, x, prior=0.2) for x in (labels, labels.where("toxic = 1"))]
    assert models[0].weights.any() and np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias
    more = docs.unionByName(docs.where("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" rotten vilegrubly"))))
    assert not np.array_equal(toxicity.train(more, labels, prior=0.2).weights, models[0].weights)  # unlabelled text counts


def test_classifiers_bound_their_samples_and_bear_odd_names(spark):
    docs, labels, n = labelled(spark)
    long = spark.createDataFrame([(5000, "word " * 200_000 + "%%%"), (5001, "x" * 500_000), (5002, " " * 500_000)], "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    docs = docs.unionByName(long).withColumn("__score", F.lit("mine")).withColumn("score_0", F.lit("mine"))
    labels = labels.unionByName(spark.createDataFrame([(5000, 0, 1), (5001, 0, 0), (1, 0, 1), (7, 3, 3)], labels.schema)).withColumn("text", F.lit("?"))
    few = quality.sampled_features(docs, quality.least_hashes(quality.readable_labels(labels, "quality", lambda i: F.lit(True)), 1000), quality._features, 4000)
    all_ = quality.sampled_features(docs, quality.least_hashes(quality.readable_labels(labels, "quality", lambda i: F.lit(True)), 1000), quality._features, 1 << 30)
    assert 0 < sum(len(x) for x, _ in few) <= 4000 and few == all_[: len(few)] and len(few) < len(all_)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("__score <> 'mine' OR score_0 <> 'mine' OR score <> 'x'").count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count() and quality.keep_good(docs.limit(0), labels).count() == 0
    scores = quality.score_documents(docs, toxicity.train(docs, labels))
    assert scores.count() == docs.count() and scores.where("score BETWEEN 0 AND 1").count() == docs.count()


# --- 5 token counts ---------------------------------------------------------------------------

def test_token_counts(spark):
    df, rows = odd_documents(spark)
    tok = Tokenizer.from_file(WORDS)
    got = token_counts.count_tokens(df, WORDS, limit=40)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 40) for i, t in rows]
    assert sorted_rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty(spark), WORDS).count() == 0


def test_merging_long_runs_and_whole_texts(spark, small):
    tok, own = Tokenizer.from_file(WORDS), token_counts.counter(WORDS)
    texts = ["a" * 5000, "ha" * 999 + "hah", "é" * 300, "ΑΣ Σ", "'s's'll", "1234567", "İx"] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert own.counts(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_merging_very_long_words(spark):
    import random
    import time

    rng = random.Random(4)
    tok, own = Tokenizer.from_file(WORDS), token_counts.counter(WORDS)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    texts = [letters[:50_000], letters, "ab" * 40_000, "aab" * 5000 + "a", " " * 1_100_000, "\n" * 300_000 + "b", "é" * 20_000, "\u4e2d" * 20_000, "9" * 30_000, "!?" * 30_000]
    texts += ["".join(rng.choices("ab", k=rng.randint(2, 900))) for _ in range(200)]
    texts += ["".join(rng.choices("etaoin", k=rng.randint(200, 400))) for _ in range(200)]
    began = time.perf_counter()
    assert own.counts(texts[:1]) == [len(tok.encode(texts[0], add_special_tokens=False).ids)]
    assert time.perf_counter() - began < 5  # about a second, on an idle machine
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS).collect()}
    assert got == {i: len(e.ids) for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False))}


def test_merging_one_pair_at_a_time_agrees():
    own = token_counts.counter(WORDS)
    m = own.merger
    pieces = [[own.inner[b] for b in w[:-1]] + [own.final[w[-1]]] for w in (b"aaaaaaa", b"banana", b"mississippi", b"x", b"aab" * 200, b"banana" * 90)]
    fast = m.count(pieces)
    m.all_at_once = False
    try:
        assert (m.count(pieces) == fast).all()
    finally:
        m.all_at_once = True


# --- 6 Jaccard join ---------------------------------------------------------------------------

def brute_links(rows, threshold=0.8):
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    names, links, parent = list(texts), collections.Counter(), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, t in enumerate(names):
        ids = [i for i in texts[t] if i is not None]
        least[root(k)] = min([*ids, least.get(root(k))] if least.get(root(k)) is not None else ids, default=None)
    return sorted(((i, least[root(k)], links[k], len(texts[t])) for k, t in enumerate(names) for i in texts[t]), key=repr)


def test_jaccard_join(spark):
    df, rows = odd_documents(spark)
    got = jaccard_join.similar_texts(df)
    assert sorted_rows(got, "doc_id", "class_id", "n_links", "n_copies") == brute_links(rows)
    assert jaccard_join.similar_texts(empty(spark)).count() == 0


def test_jaccard_join_of_a_large_group_in_many_tiles(spark):
    import random

    rng = random.Random(5)
    base = words(rng, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, words(rng, 40)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_texts(df, tile=40)
    assert sorted_rows(got, "doc_id", "class_id", "n_links", "n_copies") == brute_links(rows)
    got = jaccard_join.similar_texts(df, tile=7, tile_grams=1000)
    assert sorted_rows(got, "doc_id", "class_id", "n_links", "n_copies") == brute_links(rows)


def test_jaccard_join_of_chained_and_mixed_buckets(spark):
    """Texts of graded likeness share buckets without being links; long texts; sets that differ in case and blanks only."""
    import random

    rng = random.Random(9)
    rows = []
    for base in range(6):
        w = words(rng, 100).split()
        for i in range(40):
            rows.append((len(rows), " ".join(w)))
            for k in rng.sample(range(100), rng.choice([1, 2, 8])):
                w[k] = f"n{base}x{i}x{k}"
    long = words(rng, 20_000)
    rows += [(900, long), (901, long + " end"), (902, long.upper()), (903, "  " + long), (904, "x" * 300_000), (905, " " * 300_000), (906, "A b"), (907, "a  b"), (908, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows)
    assert any(n for _, _, n, _ in want)
    for tile in (2048, 9):
        assert sorted_rows(jaccard_join.similar_texts(df, tile=tile), "doc_id", "class_id", "n_links", "n_copies") == want


def test_pruning_before_chaining(spark):
    """Sets that share a bucket, but are surely apart, come into no group."""
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2**32, (30, 128), dtype=np.uint32)
    sig[:, :4] = sig[0, :4]  # one bucket of all
    sig[10:15] = sig[10]  # of which five are alike
    sig[20:22, :100] = sig[20, :100]
    df = spark.createDataFrame([(bytes([i]), s.astype("<u4").tobytes()) for i, s in enumerate(sig)], "gset binary, sig binary")
    for tile in (100, 3):
        got = jaccard_join._candidate_groups(df, 30, jaccard_join.least_matches(0.8, 1e-9), tile).collect()
        assert {r.node[0]: r.component[0] for r in got} == {**dict.fromkeys(range(10, 15), 10), 20: 20, 21: 20}


def test_keep_one_of_each(spark):
    df, rows = odd_documents(spark)
    for c in ("id", "__id", "__key", "rows"):
        df = df.withColumn(c, F.lit("mine"))
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    classes = {(c, ) for _, c, _, _ in brute_links(rows)}
    left = sorted_rows(kept, "doc_id", "text")
    assert len(left) == len(set(left)) and {(i,) for i, _ in left if i is not None} == {c for c in classes if c[0] is not None}


def test_pruning_table():
    least = jaccard_join.least_matches(0.8, 1e-9)
    assert list(least) == [32, 64, 96, 128] and all(0 < least[n] < 0.8 * n for n in least)
    assert all(least[a] / a <= least[b] / b for a, b in zip(list(least), list(least)[1:]))


# --- 7 line dedup -----------------------------------------------------------------------------

WS = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_docs, min_chars=1):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(WS))
    count = collections.Counter(k for _, t in rows for k in {lower(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(lower(x)) >= min_chars and count[lower(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars,shards,probe_rows", [(10, 1, None, 10**6), (2, 3, 4, 10**6), (10, 1, 1, 5), (3, 0, 4, 7), (2, 1, 50, 1)])
def test_line_dedup(spark, min_docs, min_chars, shards, probe_rows):
    df, rows = odd_documents(spark)
    df = df.withColumn("gone", F.lit("mine")).withColumn("shard", F.lit(1))
    index = line_dedup.index_lines(df, min_docs, min_chars, shards)
    got = line_dedup.clean_documents(df, index, probe_rows=probe_rows)
    assert set(df.columns) <= set(got.columns)
    assert sorted_rows(got, "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(rows, min_docs, min_chars)


def test_line_index_is_reversible(spark):
    df, rows = odd_documents(spark)
    a, b = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1 OR doc_id IS NULL")
    ra = [r for r in rows if r[0] is not None and r[0] % 2 == 0]
    first = line_dedup.index_lines(a, 4, shards=4)
    both = line_dedup.update_lines(first, b, 1)
    assert sorted_rows(line_dedup.clean_documents(df, both), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(rows, 4)
    back = line_dedup.update_lines(both, b, -1)
    assert sorted_rows(line_dedup.clean_documents(a, back), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(ra, 4)
    assert sorted_rows(back.refs, "k1", "k2", "refs") == sorted_rows(first.refs, "k1", "k2", "refs")


def test_line_index_grows_and_refuses(spark, monkeypatch):
    df, rows = odd_documents(spark)
    a, b = df.where("doc_id < 12"), df.where("doc_id >= 12 OR doc_id IS NULL")
    first = line_dedup.index_lines(a, 2)
    assert first.shards == 1 and line_dedup.update_lines(first, empty(spark), 1).refs.count() == first.refs.count()
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    both = line_dedup.update_lines(first, b, 1)
    assert both.shards > 4
    assert sorted_rows(line_dedup.clean_documents(df, both), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(rows, 2)
    with pytest.raises(ValueError):
        line_dedup.update_lines(first, b, -1)


def test_line_dedup_of_long_texts(spark):
    rows = [(i, f"{'common ' * 50_000}\nown {i}" if i else "\n".join(f"line {k}" for k in range(100_000))) for i in range(12)] + [(20, "x" * 500_000), (21, "\n" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(line_dedup.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(rows, 10)


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_drop_frequent_lines_keeps_columns_and_empty_texts(spark):
    df, rows = odd_documents(spark)
    for c in ("n_lines", "__n_lines", "n_dropped", "__kept", "key", "gone"):
        df = df.withColumn(c, F.lit("mine"))
    got = line_dedup.drop_frequent_lines(df)
    assert got.columns == df.columns and got.where("doc_id < 5").count() == 5
    gone = {i for i, n, d, kept in brute_lines(rows, 10) if d and not kept.strip(WS)}
    assert {r.doc_id for r in got.collect()} == {i for i, _ in rows} - gone


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 5000)
    f = line_dedup.CuckooFilter.of(k1[:4000], k2[:4000])
    assert f.contains(k1[:4000], k2[:4000]).all() and f.contains(k1[4000:], k2[4000:]).mean() < 0.01
    tight = line_dedup.CuckooFilter(0)
    assert not tight.insert(k1[:100], k2[:100])
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes()).delete(k1[:2000], k2[:2000])
    assert f.insert(k1[4000:4500], k2[4000:4500]) and f.contains(k1[4000:4500], k2[4000:4500]).all() and f.delete(k1[4000:4500], k2[4000:4500])
    assert f.contains(k1[2000:4000], k2[2000:4000]).all() and f.contains(k1[:2000], k2[:2000]).mean() < 0.01


# --- 8 exact top-k ----------------------------------------------------------------------------

def brute_topk(vectors, every, k):
    rows = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            rows.append((i, [int(np.floor(1024.0 * x)) for x in v]))
    out = []
    for i, q in rows:
        if i % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(q) == len(v)))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(set(out))


@pytest.mark.parametrize("shard_rows,query_block", [(1000, 100), (40, 3), (13, 100), (5, 7)])
def test_exact_topk(spark, shard_rows, query_block):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    same = vectors[7][1]
    vectors += [(300 + i, same) for i in range(80)] + [(500, None), (501, []), (510, []), (520, [0.5]), (502, [None] * 8), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, same)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(9))
    got = exact_topk.top_k(df, 10, 5, shard_rows=shard_rows, query_block=query_block)
    assert sorted_rows(got, "query_id", "rank", "vec_id", "score") == sorted(brute_topk(vectors, 10, 5), key=repr)


def test_exact_topk_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted_rows(exact_topk.top_k(df), "query_id", "rank", "vec_id") == [(0, 1, 1)]
    assert exact_topk.top_k(df.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [1e5, 2e5]), (100, [3e5, -1e5]), (7, [5e5, 5e5])], "vec_id long, embedding array<double>")
    assert sorted_rows(exact_topk.top_k(large), "query_id", "rank", "vec_id", "score") == sorted(brute_topk([(r.vec_id, list(r.embedding)) for r in large.collect()], 100, 10), key=repr)


def test_ball_tree_prunes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 3, (500, 4)) for c in (-900, 0, 900)]).astype(np.int64)
    tree = exact_topk.BallTree.from_bytes(exact_topk.BallTree(np.arange(1500), x).to_bytes())
    found = tree.search(-1, x[0], 3, None, True)
    want = sorted(((-int(s), i) for i, s in enumerate(x @ x[0])))[:3]
    assert [(-s, i) for s, i in found] == want
    assert tree.search(-1, x[0], 3, -want[2][0], True) == found and tree.search(-1, x[0], 3, 1 - want[0][0], True) == []


# --- 9 substring dedup ------------------------------------------------------------------------

def brute_windows(rows, w):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = collections.Counter(tuple(d[k : k + w]) for d in docs for k in range(len(d) - w + 1))
    out = []
    for (i, _), d in zip(rows, docs):
        gone = [False] * len(d)
        for k in range(len(d) - w + 1):
            if count[tuple(d[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        out.append((i, len(d), sum(gone), " ".join(x for x, g in zip(d, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,gram", [(35, 8), (12, 5), (20, 20)])
def test_substring_dedup(spark, window, gram):
    df, rows = odd_documents(spark)
    got = substring_dedup.dedup_substrings(df, window, gram)
    assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept") == brute_windows(rows, window)


def test_substring_dedup_digest_and_empty(spark):
    df, rows = odd_documents(spark)
    got = substring_dedup.dedup_substrings(df, 35, kept_as=lambda c: F.sha2(c, 256))
    assert sorted_rows(got, "doc_id", "kept") == sorted(((i, sha(k)) for i, _, _, k in brute_windows(rows, 35)), key=repr)
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_rolling_hashes_depend_on_content_only():
    h = np.random.default_rng(0).integers(0, 2**63, 60, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in (1, 2, 3, 8, 35):
            whole = substring_dedup._rolling(h, k, substring_dedup._BASE)
            assert len(whole) == 60 - k + 1
            assert all(whole[i] == substring_dedup._rolling(h[i : i + k], k, substring_dedup._BASE)[0] for i in (0, 5, 60 - k))
    x = np.random.default_rng(1).integers(0, 100, 50)
    for w in (1, 2, 5, 28):
        assert substring_dedup._sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(50 - w + 1)]


def test_block_finds_longest_matches_and_greedy_factors():
    import random

    rng = random.Random(3)
    for _ in range(30):
        texts = sorted({" ".join(rng.choices("abc", k=rng.randint(4, 14))) for _ in range(12)})
        block, split = substring_dedup.Block(texts), [t.split(" ") for t in texts]

        def common(p, i, q, j):
            n = 0
            while i + n < len(split[p]) and j + n < len(split[q]) and split[p][i + n] == split[q][j + n]:
                n += 1
            return n

        repeated = np.array([rng.random() < 0.1 for _ in texts])
        factors = list(zip(*(x.tolist() for x in block.factors(repeated, 4))))
        for p, words_ in enumerate(split):
            best = [max(common(p, i, q, j) for q in range(len(texts)) for j in range(len(split[q])) if (p, i) != (q, j)) for i in range(len(words_))]
            assert block.length[block.starts[p] : block.starts[p] + len(words_)].tolist() == best
            own = [f for f in factors if f[0] == p]
            if repeated[p]:
                assert own == [(p, 0, len(words_), p, 0)]
                continue
            assert all(n == best[i] == common(p, i, q, j) >= 4 and (p, i) != (q, j) for _, i, n, q, j in own)
            want = [any(best[i] >= 4 and i <= k < i + best[i] for i in range(len(words_))) for k in range(len(words_))]
            at, n = (np.array([f[k] for f in own], np.int64) for k in (1, 2))
            assert substring_dedup.covered(len(words_), at, n).tolist() == want
            for k in np.flatnonzero(want).tolist():  # the factors decide: a word stays if those that hold it are shorter or lost
                holds = (at <= k) & (k < at + n)
                assert not substring_dedup.covered(len(words_), at[~holds], n[~holds])[k]
                assert not substring_dedup.covered(len(words_), at, np.where(holds, k - at, n))[k]


@pytest.mark.parametrize("block_pieces", [1, 7, 20_000])
def test_substring_dedup_in_many_blocks(spark, block_pieces):
    """Minimizers with more pieces than a block may hold are dealt window by window."""
    df, rows = odd_documents(spark)
    got = substring_dedup.dedup_substrings(df, 12, 5, block_pieces=block_pieces)
    assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept") == brute_windows(rows, 12)


def test_substring_dedup_of_long_and_periodic_texts(spark):
    import random

    rng = random.Random(8)
    long = words(rng, 40_000)
    texts = [long, "one two three " * 20_000, "a " * 30_000, words(rng, 50) + " " + " ".join(long.split()[777:900]), "x" * 500_000, " " * 500_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(substring_dedup.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept") == brute_windows(rows, 35)


@pytest.mark.parametrize("block_pieces", [3, 20_000])
def test_factors_are_copies_of_their_places(spark, block_pieces):
    df, rows = odd_documents(spark)
    texts = {hashlib.md5((t or "").encode()).digest(): substring_dedup.words_of(t or "") for _, t in rows}
    copies = collections.Counter(hashlib.md5((t or "").encode()).digest() for _, t in rows)
    got = substring_dedup.factorize(df, 12, 5, block_pieces=block_pieces).collect()
    gone = collections.defaultdict(set)
    for r in got:
        own, source = texts[bytes(r.key)], texts[bytes(r.source)]
        assert r.length >= 12 and own[r.start : r.start + r.length] == source[r.source_start : r.source_start + r.length]
        assert (r.key, r.start) != (r.source, r.source_start) or copies[bytes(r.key)] > 1
        gone[bytes(r.key)].update(range(r.start, r.start + r.length))
    want = {hashlib.md5((t or "").encode()).digest(): n for (i, t) in rows for j, _, n, k in brute_windows(rows, 12) if i == j and i not in (None, 5, 10) and n}
    assert {k: len(v) for k, v in gone.items() if k in want} == want


# --- 10 decontamination -----------------------------------------------------------------------

def brute_leaks(rows, items, w):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        if i is None:
            continue
        ws = split(t)
        k = min(w, len(ws))
        for a in range(len(ws) - k + 1) if k else ():
            windows[tuple(ws[a : a + k])].add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = []
    for i, t in rows:
        ws = split(t)
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(ws) - k + 1):
                if (own := windows.get(tuple(ws[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= own
        out.append((i, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark, rows):
    text = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(0, " ".join(text[0].split()[5:30])), (1, text[1].upper()), (2, "a b"), (3, None), (4, ""), (5, "x"), (6, " ".join(text[0].split()[10:40])), (7, " ".join(text[2].split()[:9])), (None, text[3]), (8, "X!"), (9, "--"), (7, " ".join(text[2].split()[20:40])), (10, "same line same line")]
    return spark.createDataFrame(items, "item_id long, text string").withColumn("hit", F.lit(1)), items


@pytest.mark.parametrize("window,block_words", [(10, 10**6), (10, 30), (3, 10**6), (1, 50)])
def test_decontamination(spark, window, block_words):
    df, rows = odd_documents(spark)
    bench, items = benchmark(spark, rows)
    leaks = decontamination.find_leaks(df.withColumn("hit", F.lit("x")), bench, window, block_words=block_words)
    got = decontamination.leak_digest(leaks)
    assert sorted_rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_leaks(rows, items, window)


def test_decontamination_empty_tables(spark):
    df, rows = odd_documents(spark)
    bench, _ = benchmark(spark, rows)
    assert decontamination.find_leaks(empty(spark), bench).count() == 0
    assert decontamination.leak_digest(decontamination.find_leaks(df, bench.limit(0))).where("contaminated").count() == 0
    assert sorted_rows(decontamination.decontaminate(df, bench.limit(0)), "doc_id", "text") == sorted(rows, key=repr)


@pytest.mark.parametrize("block_words", [10**6, 30, 1])
def test_decontaminate_in_many_passes(spark, block_words):
    """Whatever the automata hold, the same is cut; columns named as the operator's own stay."""
    df, rows = odd_documents(spark)
    bench, items = benchmark(spark, rows)
    df = df.withColumn("hit", F.lit("mine")).withColumn("hit_0", F.lit(2))
    once = decontamination.decontaminate(df, bench)
    got = decontamination.decontaminate(df, bench, block_words=block_words)
    assert got.columns == df.columns and got.where("hit <> 'mine' OR hit_0 <> 2").count() == 0
    assert sorted_rows(got, "doc_id", "text") == sorted_rows(once, "doc_id", "text")
    hits = {(i, n, h) for i, n, h, *_ in brute_leaks(rows, items, 10)}
    assert got.count() == sum(1 for i, n, h, *_ in brute_leaks(rows, items, 10) if h <= 0.5 * n) and any(h for _, _, h in hits)


def test_chunks_hold_each_window_once():
    ws = [str(k).encode() for k in range(50)]
    for window, most in ((3, 7), (10, 1), (1, 4), (10, 1000)):
        chunks = list(decontamination._chunks(ws, window, most, 10**6))
        windows = [tuple(c[k : k + window]) for c in chunks for k in range(len(c) - window + 1)]
        assert windows == [tuple(ws[k : k + window]) for k in range(50 - window + 1)] and all(len(c) <= max(window, most) for c in chunks)
    assert list(decontamination._chunks(ws[:4], 10, 2, 10**6)) == [ws[:4]]


def test_decontamination_of_long_texts(spark):
    import random

    rng = random.Random(6)
    long = words(rng, 30_000)
    rows = [(0, long), (1, "x" * 500_000), (2, " " * 500_000), (3, " ".join(long.split()[100:130]) + " end")]
    items = [(0, " ".join(long.split()[5000:5100])), (1, " ".join(long.split()[90:20_000]))]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leak_digest(decontamination.find_leaks(df, bench, block_words=3000))
    assert sorted_rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_leaks(rows, items, 10)


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(0, f"Before, this; {item.upper()}. After this all is as it was, and there is more of it than the rest"), (1, item), (2, "clean"), (3, None), (4, "")], "doc_id long, text string").withColumn("extra", F.lit(1))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {0: "Before, this; . After this all is as it was, and there is more of it than the rest", 2: "clean", 3: None, 4: ""}

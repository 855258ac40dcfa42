"""The pipeline, stage by stage, against plain versions of its stages."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from fixtures import empty, odd_documents
from pyspark.sql import functions as F
from test_operators import WS, brute_lines, brute_links
from tokenizers import Tokenizer

import corpus_pipeline
from sievecraft.llm import quality
from sievecraft.llm.common import materialize

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_cut(text, windows, w=10, coverage=0.5):
    """The text without benchmark passages, or None where it goes."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    spots = [m.span() for m in PATTERN.finditer(low)]
    words = [low[a:b] for a, b in spots]
    hit = [False] * len(words)
    for k in {len(x) for x in windows}:
        for a in range(len(words) - k + 1):
            if tuple(words[a : a + k]) in windows:
                hit[a : a + k] = [True] * k
    if sum(hit) > coverage * len(words):
        return None
    out, done, i = [], 0, 0
    while i < len(hit):
        if hit[i]:
            j = i
            while j + 1 < len(hit) and hit[j + 1]:
                j += 1
            out.append(text[done : spots[i][0]])
            done, i = spots[j][1], j
        i += 1
    return "".join([*out, text[done:]])


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = materialize(stage(spark, frame, small), f"test-{name}")
        kept[name] = frame
        if name != names[-1]:
            assert frame.columns == columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = {i: t for i, t in texts(docs).items() if model.score(t or "") >= corpus_pipeline.LEAST_SCORE}
    assert texts(kept["quality"]) == good and len(good) < docs.count()

    lines = {i: k if d else good[i] for i, n, d, k in brute_lines(list(good.items()), 10) if not d or k.strip(WS)}
    assert texts(kept["lines"]) == lines

    one = {i: lines[i] for i, c, _, _ in brute_links(list(lines.items())) if i == c}
    assert texts(kept["near_copies"]) == one

    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        ws = PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        k = min(10, len(ws))
        windows |= {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if k else set()
    cut = {i: c for i, t in one.items() if (c := plain_cut(t, windows)) is not None}
    assert texts(kept["benchmark"]) == cut

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = collections.defaultdict(list)
    for r in sorted(kept["packing"].collect(), key=lambda r: (r.doc_id, r.start)):
        made[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert made == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in cut.items()}

    again = corpus_pipeline.run(spark, small)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in kept["packing"].collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_bear_long_texts_and_clashing_names(spark, small, name, stage):
    rows = [(0, " " * 1_100_000), (1, "\n" * 2_000_000 + "b"), (2, "a" * 1_000_000), (3, None), (4, ""), (None, "no id at all"), (7, "Some words stand here."), (7, "Other words stand there.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("lang", "source", "n_chars", "__score", "__key", "__id", "__n_lines", "n_lines", "kept", "hit", "score", "key", "id", "gone", "bucket", "bits", "at")
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    got = stage(spark, docs, small)
    ids = [r.doc_id for r in got.collect()]
    if name == "packing":
        assert set(ids) == {i for i, _ in rows}
        return
    assert got.columns == docs.columns and all(got.where(F.col(c) != "mine").count() == 0 for c in names)
    if name != "quality":
        assert sorted(ids, key=repr) == sorted((i for i, t in rows if name != "near_copies" or i != 4), key=repr)


@pytest.mark.parametrize("name", ["quality", "benchmark"])
def test_stages_bear_empty_side_tables(spark, small, tmp_path, name):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs, rows = odd_documents(spark)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_and_empty_tables(spark, small, name, stage):
    docs, rows = odd_documents(spark)
    got = stage(spark, docs, small)
    assert got.count() > 0 and stage(spark, empty(spark), small).count() == 0
    if name != "packing":
        assert got.columns == docs.columns and got.schema == docs.schema or [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert got.count() <= len(rows)

"""Codecs, banks, archives, stored tables, sound: round trips and known answers."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.audio import dsp, features, routes, synth
from sievecraft.functions import codecs
from sievecraft.sources import banks, files, tables


def record(seed=0):
    rng = np.random.default_rng(seed)
    return bytes(int(rng.integers(lo, hi + 1)) for lo, hi in codecs.RANGES)


def packed(seed=0):
    return codecs.pack_bytes(record(seed))


def test_pack_round_trip(spark):
    for s in range(30):
        assert codecs.unpack_bytes(packed(s)) == record(s) and max(packed(s)) < 128
    df = spark.createDataFrame([(bytearray(packed(s)),) for s in range(5)], "p binary")
    rows = df.select("p", codecs.unpack(F.col("p")).alias("u"), codecs.pack(codecs.unpack(F.col("p"))).alias("again")).collect()
    assert all(bytes(r.u) == codecs.unpack_bytes(bytes(r.p)) and bytes(r.again) == bytes(r.p) for r in rows)


def test_clamp_and_names(spark):
    bad = list(record(1))
    bad[0], bad[134], bad[145] = 120, 77, 3
    df = spark.createDataFrame([(bad,)], "v array<int>")
    r = df.select(codecs.clamp(F.col("v")).alias("c"), codecs.clamped_count(F.col("v")).alias("n"), codecs.decode_name(F.array(*[F.lit(ord(c) | 128) for c in "AB\x01C  "])).alias("name")).first()
    assert (r.c[0], r.c[134], r.c[145], r.n, r.name) == (99, 31, 32, 3, "AB C")


def test_bank_shapes():
    bank = banks.build_bank([packed(s) for s in range(32)])
    assert len(bank) == 4104 and banks.verify_bank(bank, [packed(s) for s in range(32)]) == []
    ok = lambda raw: [r for r in banks.parse_bank(raw, "f") if r[3] is not None]
    assert [bytes(r[3]) for r in ok(bank)] == [packed(s) for s in range(32)] and all(r[5] for r in ok(bank))
    two = ok(bank + bank)
    assert len(two) == 64 and {r[1] for r in two} == {"f", "f #2"}
    assert len(ok(b"j" * 17 + bank)) == 32
    broken = bank[:-2] + bytes([bank[-2] ^ 1, 0xF7])
    assert len(ok(broken)) == 32 and not any(r[5] for r in ok(broken)) and banks.verify_bank(broken) == ["checksum"]
    assert banks.verify_bank(bank, [packed(99)] + [packed(s) for s in range(1, 32)]) == ["slot 0"]
    raw = ok(bank[6:-2])
    assert len(raw) == 32 and raw[0][4] == "raw"
    headless = ok(bytes(6) + bank[6:])
    assert len(headless) == 32 and headless[0][4] == "salvaged"
    single = ok(banks.build_single(record(3)))
    assert len(single) == 1 and bytes(single[0][3]) == packed(3) and single[0][4] == "single"
    reasons = lambda raw: [r[6] for r in banks.parse_bank(raw, "f") if r[6]]
    assert reasons(bytes([0xF0, 0x41, 0, 0, 0, 0, 0xF7])) [0] == "other manufacturer"
    assert reasons(b"hello") == ["unrecognised"] and reasons(bytes([0xF0, 0x43, 0xF7]))[0] == "short message"
    abandoned = bytes([0xF0, 0x43, 1]) + bank
    assert len(ok(abandoned)) == 32


def test_banks_through_spark(spark):
    rows = spark.createDataFrame([(s, bytearray(packed(s))) for s in range(40)], "id long, packed binary")
    made = banks.to_banks(banks.number(rows, "id"), bytes(128)).select(F.col("bank").cast("string").alias("path"), "content")
    assert made.count() == 2
    got = banks.normalise(banks.parse_banks(made)).orderBy("file", "slot").collect()
    assert len(got) == 64 and [bytes(r.packed) for r in got[:32]] == [packed(s) for s in range(32)] and got[-1].reason == "zero"
    quiet = bytearray(record(4))
    for op in range(6):
        quiet[op * 21 + 16] = 0
    one = spark.createDataFrame([("f", bytearray(banks.build_single(bytes(quiet))))], "path string, content binary")
    assert banks.normalise(banks.parse_banks(one)).first().reason == "silent"
    init = record(5)
    renamed = init[:145] + b"ANOTHER   "
    two = spark.createDataFrame([("f", bytearray(banks.build_single(renamed)))], "path string, content binary")
    assert banks.normalise(banks.parse_banks(two), init).first().reason == "init"


@pytest.mark.parametrize("name,size,want", [("a.syx", 1, True), ("A.SYX", 1, True), ("dir/BANK12", 4104, True), ("x", 163, True), ("x", 8192, True), ("readme.txt", 100, False), ("a.syx", 0, False), ("dir/", 4096, False), ("syx", 5, False)])
def test_candidate_files(spark, name, size, want):
    df = spark.createDataFrame([(name, size)], "n string, s long")
    assert df.select(files.looks_like_bank(F.col("n"), F.col("s")).alias("c")).first().c is want


def test_routes_and_zips(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"\x1f\x8b00"),), (bytearray(b"{}"),), (bytearray(b"PK"),), (bytearray(b"\xf0C"),)], "c binary")
    assert [r.r for r in df.select(files.route(F.col("c")).alias("r")).collect()] == ["session", "session", "patches", "patches"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored.syx", b"abc", zipfile.ZIP_STORED)
        z.writestr("dir/deflated.syx", b"abc" * 500, zipfile.ZIP_DEFLATED)
        z.writestr("readme.txt", b"no")
        z.writestr("odd.syx", b"x" * 900, zipfile.ZIP_BZIP2)
    src = spark.createDataFrame([("a.zip", bytearray(out.getvalue())), ("b.zip", bytearray(b"nothing"))], "path string, content binary")
    got = {(r.archive, r.entry): r for r in files.open_zips(src).collect()}
    assert bytes(got["a.zip", "stored.syx"].content) == b"abc" and len(got["a.zip", "dir/deflated.syx"].content) == 1500 and ("a.zip", "readme.txt") not in got
    assert got["a.zip", "odd.syx"].error and got["b.zip", None].error


def test_links(spark):
    df = spark.createDataFrame([(bytearray(packed(7)), "E.PIANO 1 "), (bytearray(packed(8)), "***")], "p binary, n string")
    rows = df.select("p", codecs.encode_link(F.col("p"), F.col("n")).alias("l")).withColumn("back", codecs.decode_link(F.col("l"))).collect()
    assert rows[0].l.startswith("#v=e-piano-1.") and "." not in rows[1].l and all(r.back == r.p for r in rows)
    bad = spark.createDataFrame([("#v=!!!",), ("#w=AAAA",), ("",), ("#v=AAAA",)], "l string")
    assert bad.select(codecs.decode_link(F.col("l")).alias("b")).where("b IS NOT NULL").count() == 0


def test_seven_bit_frames_and_bend(spark):
    data = bytes(range(100, 255)) + b"\0\xff"
    assert codecs.unpack7(codecs.pack7(data)) == data and max(codecs.pack7(data)) < 128
    df = spark.createDataFrame([(0, 0), (0, 64), (127, 127)], "l int, h int")
    assert [r.b for r in df.select(codecs.pitch_bend(F.col("l"), F.col("h")).alias("b")).collect()] == [-1.0, 0.0, 1.0]


def test_frames_and_hashes(spark):
    reply = codecs.frame(codecs.READ, bytes([codecs.READ_VOICE, 0, 0, 0, 0, 155, 0, 0]) + record(1))
    assert codecs.read_reply(b"\xf0" + codecs.pack7(reply) + b"\xf7") == record(1) == codecs.read_reply(codecs.pack7(reply))
    assert codecs.read_reply(b"\xf0\x01\xf7") is None and codecs.read_reply(codecs.pack7(b"\x01" + reply)) is None
    assert codecs.read_request()[0] == 0xF0 and max(codecs.read_request()[1:-1]) < 128
    assert codecs.pack7(b"\xff") == bytes([127, 1]) and codecs.pack7(b"\x00\x01") == bytes([0, 2, 0])
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([2, 1],)], "v array<int>")
    h = [r.h for r in df.select(codecs.content_hash(F.col("v")).alias("h")).collect()]
    assert h[0] == h[1] != h[2] and h[0].isalnum()


def test_stored_tables_and_settings(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "r"), "id long, v string")
    assert t.count() == 0
    t.put(spark.createDataFrame([(1, "a"), (2, "b")], t.schema), "id")
    t.put(spark.createDataFrame([(2, "c")], t.schema), "id")
    assert {(r.id, r.v) for r in t.read().collect()} == {(1, "a"), (2, "c")} and t.get("id", 2).first().v == "c"
    t.clear()
    assert t.count() == 0
    s = tables.Settings(spark, str(tmp_path / "kv"))
    s.set("threshold", 0.3)
    s.set("threshold", 0.4)
    s.set("x", [1])
    s.delete("x")
    assert s.all() == {"threshold": 0.4}


def test_backup_round_trip(spark):
    voices = spark.createDataFrame([(1, bytearray(b"k1"), True), (2, bytearray(b"k2"), False), (3, bytearray(b"k3"), False)], "id long, packed_key binary, pinned boolean")
    ratings = spark.createDataFrame([(2, 4)], "voice_id long, rating int")
    overrides = spark.createDataFrame([(2, "bass")], "id long, override string")
    standings = spark.createDataFrame([(3, 1510.0, 0)], "id long, score double, games long")
    lines = tables.export_backup(voices, ratings, overrides, standings)
    assert lines.count() == 2
    again = tables.import_backup(lines, voices.where("id <> 1"))
    assert tuple(tables.backup_summary(again).first()) == (1, 1, 0, 1)


def test_session_leaves_incomplete_features_out(spark, tmp_path):
    voices = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    one = spark.createDataFrame([(1, 2, [0.0] * 61)], "voice_id long, analysis_version int, vector array<double>")
    links, coords = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, d double"), spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    tables.write_session(str(tmp_path / "s"), voices, one, links, coords)
    back = tables.read_session(spark, str(tmp_path / "s"), {"voices": "id long, name string", "features": "voice_id long", "links": "a long, b long, d double"})
    assert set(back) == {"voices", "links"} and back["voices"].count() == 2


def test_pass_order_and_stale_reasons():
    assert tables.pass_order({"voices": 3, "features": 2}) == "analysis" and tables.pass_order({"voices": 3, "features": 3}) == "clusters"
    assert tables.pass_order({"voices": 3, "features": 3, "graph": 3}) == "embedding" and tables.pass_order({"voices": 3, "features": 3, "graph": 3, "coords": 3}) is None
    assert tables.stale_reasons({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"]


# --- sound ------------------------------------------------------------------------------------

def sine(level=99, coarse=1, transpose=24, fixed=False):
    v = np.zeros(155, int)
    for op in range(6):
        v[op * 21 : op * 21 + 4], v[op * 21 + 4 : op * 21 + 7], v[op * 21 + 18], v[op * 21 + 20] = 99, 99, coarse, 7
    v[5 * 21 + 16], v[126:130], v[130:134], v[134], v[144], v[137] = level, 99, 50, 31, transpose, 30
    if fixed:
        v[5 * 21 + 17], v[5 * 21 + 18], v[5 * 21 + 19] = 1, 2, 50
    return v


def pitch(x, rate=synth.RATE):
    z = np.flatnonzero((x[:-1] < 0) & (x[1:] >= 0))
    frac = z - x[z] / (x[z + 1] - x[z])
    return (len(z) - 1) / ((frac[-1] - frac[0]) / rate)


@pytest.mark.parametrize("kind,hz", [({}, 440.0), ({"coarse": 2}, 880.0), ({"coarse": 0}, 220.0), ({"transpose": 12}, 220.0), ({"fixed": True}, 10**2.5)])
def test_pitch_within_two_cents(kind, hz):
    y = synth.render(np.stack([sine(**kind)]), 69, 100, 0.6, 0.0)[0]
    assert abs(1200 * np.log2(pitch(y[6000:]) / hz)) < 2


def test_envelopes_follow_their_rules_step_by_step():
    """Corner points against a plain walk, one block at a time."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        rates, levels = rng.integers(0, 100, 4), rng.choice([0, 20, 50, 80, 99], 4)
        output, faster, blocks, release = int(rng.integers(0, 128)) * 32, int(rng.integers(0, 8)), 900, int(rng.integers(1, 700))
        got, level, stage, wait, want = synth.envelope(rates, levels, output, faster, blocks, release), 0.0, 0, None, []
        goals = [max(64 * (int(x) // 2) + output - 4256, 16) / 256 for x in synth._steps(levels)]

        def begin(k):
            dead = k == 0 and levels[0] == 0
            if k > 3 or not (goals[k] == level or dead):
                return None
            r = min(rates[k] + faster, 99)
            samples = synth.HOLD_SAMPLES[r] // (20 if dead else 1) if r < 77 else 20 * (99 - r)
            return max(1, -(-samples // 64))

        wait = begin(0)
        for b in range(blocks):
            if b == release:
                stage, wait = 3, None
                wait = begin(3)
            if stage < 3 or (stage == 3 and b >= release):
                q = min(rates[stage] * 41 // 64 + faster, 63)
                step = (4 + q % 4) * 2.0 ** (q // 4 - 16)
                if wait:
                    wait -= 1
                    over = not wait
                else:
                    if goals[stage] > level:
                        level = max(level, 1716 / 256) if goals[stage] > 1716 / 256 else goals[stage]
                        level = min(goals[stage], level + max(1, int(17 - level)) * step)
                    else:
                        level = max(goals[stage], level - step)
                    over = level == goals[stage]
                if over:
                    stage += 1
                    wait = begin(stage) if stage < 3 or b >= release else None
            want.append(level)
        assert np.allclose(got, want, atol=1e-4)


def test_silence_release_and_batches():
    y = synth.render(np.stack([sine(), sine(level=0)]), 60, 100, 0.3, 0.3)
    assert np.abs(y[0, :8000]).max() > 0.1 and np.abs(y[1]).max() == 0 and np.abs(y[0, -2000:]).max() < 1e-3
    r = np.array([list(record(s)) for s in range(6)])
    whole = synth.render(r, 60, 100, 0.1, 0.1)
    assert np.isfinite(whole).all() and np.allclose(whole[3], synth.render(r[3:4], 60, 100, 0.1, 0.1)[0])
    assert synth.wav(y[0])[:4] == b"RIFF"


def test_phrase_plays_notes_one_after_the_other_and_steals():
    one = np.stack([sine()])
    y = synth.render_phrase(one, [(0.0, 69, 100, 0.2), (0.5, 81, 100, 0.2)], [(0.0, 0.0), (1.0, 1.0)], tail=0.1)
    assert pitch(y[0, 3000:8000]) == pytest.approx(440, rel=2e-3) and pitch(y[0, 25000:30000]) == pytest.approx(880, rel=2e-3)
    chord = [(0.01 * k, 60, 100, 1.0) for k in range(9)]
    alone = np.abs(synth.render_phrase(one, chord[:1], tail=0.0)).max()
    assert np.abs(synth.render_phrase(one, chord, tail=0.0)[:, 20000:40000]).max() <= 8 * alone + 1e-6


def test_routes():
    assert routes.carriers(31) == [1, 2, 3, 4, 5, 6] and routes.carriers(0) == [1, 3] and routes.depth(0)[6] == 3
    for a in range(32):
        assert sorted(op for col in routes.columns(a) for op in col) == [1, 2, 3, 4, 5, 6]
        assert banks.CARRIERS[a] == set(routes.carriers(a))


def test_dsp():
    t = np.arange(22050) / 22050
    tone, noise = np.sin(2 * np.pi * 441 * t), np.random.default_rng(0).normal(size=22050)
    m, n = dsp.spectrum(tone, 8192), dsp.spectrum(noise, 8192)
    assert dsp.centroid(m, 22050) == pytest.approx(441, abs=15) and dsp.flatness(m) < 0.01 < 0.3 < dsp.flatness(n)
    assert dsp.harmonics(m, 22050, 441)[0] > 0.99 and dsp.harmonics(n, 22050, 441)[2] > 0.3
    assert dsp.track(tone, 22050, 440)[10:-10].mean() == pytest.approx(441, abs=0.2)
    assert dsp.slope(np.arange(5.0), 2 * np.arange(5.0)) == pytest.approx(2) and dsp.wobble(np.ones(50), 5) == 0


def test_features_through_spark(spark):
    df = spark.createDataFrame([(1, sine().tolist()), (2, sine(level=0).tolist())], "id long, params array<int>")
    got = {r.id: r for r in features.extract(df, rate=11025).collect()}
    assert len(got[1].vector) == len(features.NAMES) == 61 and got[2].silent and not got[1].silent
    f = dict(zip(features.NAMES, got[1].vector))
    assert f["sustain"] > 0.9 and f["inharmonicity"] < 0.05 and f["carriers"] == 6 and f["activeOps"] == 1 and abs(f["register"]) < 1e-9

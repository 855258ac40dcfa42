"""Features of records: structural ones as Column expressions, acoustic ones of a rendered probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dsp, routes, synth

# fixed values: the order of a feature vector
ACOUSTIC = [
    "attack", "decay", "sustain", "release", "brightness", "bright1", "bright2", "bright3", "bright4", "loud1", "loud2", "loud3", "loud4", "absBrightness", "register", "brightnessSlope", "spread",
    "inharmonicity", "oddEven", "flatness", "attackBrightness", "loudness", "velLevel", "velBrightness", "velAttack", "keyBrightness", "keyLevel", "keyDecay", "modResponse", "modVibrato", "modTremolo", "modTimbre", "modBrightness",
]
STRUCTURAL = [
    "carriers", "feedback", "activeOps", "modDepth", "carrierLevel", "maxRatio", "ratioSpread", "nonInteger", "fixedOps", "detuneSpread", "egAttackRate", "egEndLevel", "egSustainLevel", "keyScaling",
    "velSensParam", "rateScaling", "ampModSens", "lfoSpeed", "lfoDelay", "lfoPm", "lfoAm", "lfoSampleHold", "pitchModSens", "modWheelDepth", "ampModMax", "ampModCarriers", "ampModModulators", "pitchEg",
]
NAMES = ACOUSTIC + STRUCTURAL
WEIGHTS = [1.0] * len(ACOUSTIC) + [0.6] * len(STRUCTURAL)
VERSION = 3


# --- structural -------------------------------------------------------------------------------

def operator_table() -> Column:
    """algorithm -> six booleans: whether operator 6 to 1 is heard."""
    return F.array(*[F.array(*[F.lit(op in routes.carriers(a)) for op in range(6, 0, -1)]) for a in range(32)])


def structural(df: DataFrame, params_col: str = "params", into: str = "structural") -> DataFrame:
    """df with a struct of the structural features of 155 parameters. What several features need is a column of its own on the way, computed once."""
    params = F.col(params_col)
    p = lambda i: F.element_at(params, i + 1)
    algorithm = p(134).bitwiseAND(31)
    heard = F.element_at(operator_table(), algorithm + 1)
    field = lambda k, i: F.element_at(params, k * 21 + i + 1)
    ops = F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda k: F.struct(
            field(k, 16).alias("level"), F.element_at(F.col("__heard"), k + 1).alias("heard"), field(k, 17).alias("mode"), field(k, 20).cast("double").alias("detune"), field(k, 0).alias("attack"), field(k, 7).alias("end"), field(k, 6).alias("sustain"),
            (F.when(field(k, 18) == 0, F.lit(0.5)).otherwise(field(k, 18).cast("double")) * (1 + field(k, 19) / F.lit(100.0))).alias("ratio"), field(k, 14).bitwiseAND(3).alias("am"),
            (field(k, 9) + field(k, 10)).alias("scaling"), field(k, 15).alias("vel"), field(k, 13).alias("rs"), field(k, 14).alias("ams"),
        ),
    )
    out = df.withColumn("__heard", heard).withColumn("__ops", ops).withColumn("__active", F.filter("__ops", lambda o: o["level"] > 0))
    out = out.withColumn("__tuned", F.filter("__active", lambda o: o["mode"] != 1)).withColumn("__loud", F.filter("__active", lambda o: o["heard"])).withColumn("__mods", F.filter("__active", lambda o: ~o["heard"]))
    heard, ops, active, tuned, loud, mods = (F.col(f"__{c}") for c in ("heard", "ops", "active", "tuned", "loud", "mods"))
    total = lambda xs, f: F.aggregate(F.transform(xs, lambda o: f(o).cast("double")), F.lit(0.0), lambda a, x: a + x)
    mean = lambda xs, f: F.when(F.size(xs) > 0, total(xs, f) / F.size(xs)).otherwise(F.lit(0.0))

    def deviation(xs: Column, f) -> Column:
        m = mean(xs, f)
        return F.when(F.size(xs) > 1, F.sqrt(F.greatest(mean(xs, lambda o: f(o) * f(o)) - m * m, F.lit(0.0)))).otherwise(F.lit(0.0))

    most = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda o: o["am"])), F.lit(0))
    octave = lambda o: F.log2(o["ratio"])
    odd = F.filter(tuned, lambda o: (F.floor(o["ratio"] + 0.5) < 1) | (F.abs(o["ratio"] - F.floor(o["ratio"] + 0.5)) > 0.02))
    sens = F.element_at(F.array(*[F.lit(x / 255.0) for x in synth.PITCH_SENS]), p(143).bitwiseAND(7) + 1)
    # fixed values: amplitude sensitivity as a share of the strongest
    amp = F.element_at(F.array(*[F.lit(x / 16777216.0) for x in (0, 4342338, 7171437, 16777216)]), most(active) + 1)
    made = {
        "carriers": F.size(F.filter(heard, lambda h: h)),
        "feedback": p(135).bitwiseAND(7),
        "activeOps": F.size(active),
        "modDepth": mean(mods, lambda o: o["level"]),
        "carrierLevel": mean(loud, lambda o: o["level"]),
        "maxRatio": F.coalesce(F.array_max(F.transform(tuned, octave)), F.lit(0.0)),
        "ratioSpread": deviation(tuned, octave),
        "nonInteger": F.when(F.size(tuned) > 0, F.size(odd) / F.size(tuned)).otherwise(F.lit(0.0)),
        "fixedOps": F.size(active) - F.size(tuned),
        "detuneSpread": deviation(active, lambda o: o["detune"]),
        "egAttackRate": mean(loud, lambda o: o["attack"]),
        "egEndLevel": mean(loud, lambda o: o["end"]),
        "egSustainLevel": mean(loud, lambda o: o["sustain"]),
        "keyScaling": mean(ops, lambda o: o["scaling"]),
        "velSensParam": mean(ops, lambda o: o["vel"]),
        "rateScaling": mean(ops, lambda o: o["rs"]),
        "ampModSens": mean(ops, lambda o: o["ams"]),
        "lfoSpeed": p(137),
        "lfoDelay": p(138),
        "lfoPm": p(139),
        "lfoAm": p(140),
        "lfoSampleHold": (p(142).bitwiseAND(7) == 5).cast("int"),
        "pitchModSens": p(143).bitwiseAND(7),
        "modWheelDepth": F.least(F.lit(1.0), 0.6 * sens + 0.4 * amp),
        "ampModMax": most(active),
        "ampModCarriers": most(loud),
        "ampModModulators": most(mods),
        "pitchEg": F.abs(p(130) - 50) + F.abs(p(131) - 50) + F.abs(p(132) - 50) + F.abs(p(133) - 50),
    }
    return out.withColumn(into, F.struct(*[c.alias(n) for n, c in made.items()])).drop("__heard", "__ops", "__active", "__tuned", "__loud", "__mods")


def fundamental_semitones(params: Column) -> Column:
    """Offset of the lowest heard, tuned operator from the played note, in semitones (0 without one)."""
    heard = F.element_at(operator_table(), F.element_at(params, 135).bitwiseAND(31) + 1)
    ratios = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: F.element_at(heard, k + 1) & (F.element_at(params, k * 21 + 17) > 0) & (F.element_at(params, k * 21 + 18) == 0)),
        lambda k: F.when(F.element_at(params, k * 21 + 19) == 0, F.lit(0.5)).otherwise(F.element_at(params, k * 21 + 19).cast("double")) * (1 + F.element_at(params, k * 21 + 20) / F.lit(100.0)),
    )
    return F.coalesce(12 * F.log2(F.array_min(ratios)), F.lit(0.0)) + F.element_at(params, 145) - 24


# --- acoustic -------------------------------------------------------------------------------

def segment(x: np.ndarray, rate: int, hold: float, f0: float) -> dict[str, float]:
    """Measurements of one note held for `hold` seconds."""
    env = dsp.envelope(x)
    step = 256 / rate
    names = ("attack", "decay", "sustain", "release", "brightness", "slope", "spread", "inharm", "odd", "flat", "attack_bright", "peak", "abs_bright")
    if env.max(initial=0) < 1e-5:
        return dict.fromkeys((*names, "b1", "b2", "b3", "b4", "l1", "l2", "l3", "l4"), 0.0)
    up = max(2, min(int(hold / step), len(env)))
    held = env[:up]
    peak = held.max()
    ahead = max(1, int(round(0.06 / step)))
    target = int(held.argmax())
    for i in np.flatnonzero(held >= 0.5 * peak):
        if held[i] >= held[i + 1 : i + 1 + ahead].max(initial=0):
            target = int(i)
            break
    attack = int(np.flatnonzero(held >= 0.9 * held[target])[0])
    tail = np.sort(held[-max(1, up // 5) :])
    sustain = tail[len(tail) // 2]
    decay = 0.0
    if held[target] > 1.05 * sustain:
        low = np.flatnonzero(held[target:] <= sustain + 0.1 * (held[target] - sustain))
        decay = (low[0] if len(low) else up - target) * step
    after = env[up:]
    at_key_up = env[min(up, len(env) - 1)]
    quiet = np.flatnonzero(after <= at_key_up / 1000)
    release = (quiet[0] if len(quiet) else len(after)) * step
    if not len(quiet) and len(after) > 7:  # not over yet: carried on along its slope
        fall = dsp.slope(np.arange(3, len(after)) * step, dsp.decibel(after[3:]))
        if fall < -0.5:
            release = min(60.0, -60 / fall)
    start = min(int(attack * 256 + 0.05 * rate), max(0, int(hold * rate) - 8192))
    mags = dsp.spectrum(x[start : start + 8192], 8192)
    share, odd, inharm = dsp.harmonics(mags, rate, f0)
    half = dsp.harmonics(mags, rate, f0 / 2)
    if half[0] - share > 0.15:
        (share, odd, inharm), f0 = half, f0 / 2
    octaves, times, bright = [], [], []
    for k in range(5):
        a = int(k * max(0, hold * rate - 4096) / 4)
        frame = x[a : a + 4096]
        if np.sqrt((frame**2).mean()) >= 0.02 * peak:
            m = dsp.spectrum(frame, 4096)
            octaves.append(np.log2(max(dsp.centroid(m, rate), 1.0) / max(f0, 1.0)))
            times.append(a / rate)
    for k in range(4):
        a = int(k * max(0, hold * rate - 4096) / 3)
        frame = x[a : a + 4096]
        loud = np.sqrt((frame**2).mean())
        bright.append(np.log2(max(dsp.centroid(dsp.spectrum(frame, 4096), rate), 1.0) / max(f0, 1.0)) if loud >= 0.02 * peak else bright[-1] if bright else 0.0)
    loud = [max(-60.0, float(dsp.decibel(env[min(int(k * up / 4), len(env) - 1)] / peak))) for k in range(4)]
    bright = np.array(bright) - np.mean(bright)
    first = dsp.spectrum(x[:2048], 2048)
    return {
        "attack": attack * step, "decay": decay, "sustain": min(1.0, sustain / held[target]), "release": release, "brightness": float(np.mean(octaves)) if octaves else 0.0, "slope": dsp.slope(np.array(times), np.array(octaves)),
        "spread": dsp.spread(mags, rate) / max(f0, 1.0), "inharm": inharm, "odd": odd, "flat": dsp.flatness(mags), "attack_bright": float(np.log2(max(dsp.centroid(first, rate), 1.0) / max(f0, 1.0))), "peak": float(peak),
        "abs_bright": float(np.log2(max(dsp.centroid(mags, rate), 1.0) / 1000)), **{f"b{k + 1}": float(b) for k, b in enumerate(bright)}, **{f"l{k + 1}": v for k, v in enumerate(loud)},
    }


# fixed values: the keys and velocities that records are heard at, and for how long each key is down and listened to after
PITCHES, VELOCITIES = (36, 60, 84), (40, 120)
HOLD, TAIL = 1.0, 4.0


def mod_wheel(still: np.ndarray, moved: np.ndarray, rate: int, f0: float) -> dict[str, float]:
    """What the wheel does to a note: vibrato (cents), tremolo, timbre, brightness and the response as a whole."""
    a, b = dsp.envelope(still), dsp.envelope(moved)
    if b.max(initial=0) < 1e-5:
        return dict.fromkeys(("response", "vibrato", "tremolo", "timbre", "bright"), 0.0)
    half = max(1, int(0.075 * rate / 256))
    n = len(still) // 2
    cents = lambda x: float(np.std(1200 * np.log2(np.maximum(dsp.track(x[:n], rate, f0)[5:-5], 1) / f0))) if n > 2048 else 0.0
    vibrato = max(0.0, cents(moved) - cents(still))
    tremolo = max(0.0, dsp.wobble(b[: len(b) // 2], half) - dsp.wobble(a[: len(a) // 2], half))
    sa, sb = dsp.spectrum(still, 8192), dsp.spectrum(moved, 8192)
    timbre = float(np.abs(sa / max(sa.sum(), 1e-12) - sb / max(sb.sum(), 1e-12)).sum() / 2)
    bright = float(np.log2(max(dsp.centroid(sb, rate), 1.0) / max(dsp.centroid(sa, rate), 1.0)))
    response = min(1.0, 0.45 * min(1.0, vibrato / 1200) + 0.3 * min(1.0, tremolo / 0.5) + 0.25 * min(1.0, timbre / 0.33))
    return {"response": response, "vibrato": vibrato, "tremolo": tremolo, "timbre": timbre, "bright": bright}


def probe(records: np.ndarray, rate: int = synth.RATE, hold: float = HOLD, tail: float = TAIL) -> list[dict[str, float]]:
    """The acoustic features of records: three pitches at two velocities, and one note with the wheel up."""
    low = lambda r: min((0.5 if r[k * 21 + 18] == 0 else r[k * 21 + 18]) * (1 + r[k * 21 + 19] / 100) for k in range(6) if 6 - k in routes.carriers(int(r[134]) & 31) and r[k * 21 + 16] > 0 and r[k * 21 + 17] == 0)
    ratios = []
    for r in records:
        try:
            ratios.append(low(r) * 2.0 ** ((r[144] - 24) / 12))
        except ValueError:
            ratios.append(1.0)
    sounds = {(p, v): synth.render(records, p, v, hold, tail, rate) for p in PITCHES for v in VELOCITIES}
    octaves = (PITCHES[-1] - PITCHES[0]) / 12
    wheel = synth.render(records, 60, VELOCITIES[-1], hold, tail, rate, wheel=1.0)
    out = []
    for i, ratio in enumerate(ratios):
        f0 = {p: 440 * 2 ** ((p - 69) / 12) * ratio for p in PITCHES}
        seg = {k: segment(x[i], rate, hold, f0[k[0]]) for k, x in sounds.items()}
        ref, soft, bottom, top = seg[60, VELOCITIES[-1]], seg[60, VELOCITIES[0]], seg[PITCHES[0], VELOCITIES[-1]], seg[PITCHES[-1], VELOCITIES[-1]]
        w = mod_wheel(sounds[60, VELOCITIES[-1]][i, : wheel.shape[1]], wheel[i], rate, f0[60])
        log = lambda x: float(np.log10(max(x, 1e-4)))
        db = lambda x: float(dsp.decibel(x))
        silent = all(s["peak"] < 1e-5 for s in seg.values())
        out.append(
            {
                "attack": log(ref["attack"]), "decay": log(ref["decay"]), "sustain": ref["sustain"], "release": log(ref["release"]), "brightness": ref["brightness"], **{f"bright{k}": ref[f"b{k}"] for k in range(1, 5)}, **{f"loud{k}": ref[f"l{k}"] for k in range(1, 5)},
                "absBrightness": ref["abs_bright"], "register": float(np.log2(ratio)), "brightnessSlope": ref["slope"], "spread": ref["spread"], "inharmonicity": ref["inharm"], "oddEven": ref["odd"], "flatness": ref["flat"], "attackBrightness": ref["attack_bright"],
                "loudness": 0.0 if silent else db(ref["peak"]), "velLevel": 0.0 if silent else db(ref["peak"]) - db(soft["peak"]), "velBrightness": ref["brightness"] - soft["brightness"], "velAttack": log(ref["attack"]) - log(soft["attack"]),
                "keyBrightness": (top["brightness"] - bottom["brightness"]) / octaves, "keyLevel": 0.0 if silent else (db(top["peak"]) - db(bottom["peak"])) / octaves, "keyDecay": (log(top["decay"]) - log(bottom["decay"])) / octaves,
                "modResponse": w["response"], "modVibrato": w["vibrato"], "modTremolo": w["tremolo"], "modTimbre": w["timbre"], "modBrightness": w["bright"], "silent": float(silent),
            }
        )
    return out


def extract(df: DataFrame, batch: int = 64, rate: int = synth.RATE) -> DataFrame:
    """df: id, params -> id, version, vector (the 61 features; what is not finite is 0), silent. Samples never leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                made = probe(np.stack(part.params.to_numpy()).astype(np.int64), rate)
                acoustic = np.nan_to_num(np.array([[m[name] for name in ACOUSTIC] for m in made]), nan=0.0, posinf=0.0, neginf=0.0)
                yield pd.DataFrame({"id": part.id.to_numpy(), "acoustic": list(acoustic), "silent": [m["silent"] > 0 for m in made]})

    structure = structural(df.select("id", "params")).select("id", F.array(*[F.col(f"structural.{n}").cast("double") for n in STRUCTURAL]).alias("structural"))
    both = df.select("id", "params").mapInPandas(run, "id long, acoustic array<double>, silent boolean").join(structure, "id")
    return both.select("id", F.lit(VERSION).alias("version"), F.concat("acoustic", "structural").alias("vector"), "silent")

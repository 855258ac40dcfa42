"""What is shown of a row: axes, table cells, colours, counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..audio import features
from ..functions.expr import let

# fixed values: groups of axes for a picker, in order
AXIS_GROUPS = {
    "Learned axes": ["pca1", "pca2", "lda1", "lda2", "rating", "predicted"],
    "Envelope": ["attack", "release", "sustain", "decay", "loud1", "loud2", "loud3", "loud4"],
    "Brightness and timbre": ["brightness", "inharmonicity", "brightnessSlope", "absBrightness", "spread", "attackBrightness", "oddEven", "flatness", "bright1", "bright2", "bright3", "bright4"],
    "How it responds to playing": ["velLevel", "velBrightness", "keyBrightness", "keyLevel", "velAttack", "keyDecay", "register", "loudness"],
    "Mod wheel": ["modResponse", "modVibrato", "modTremolo", "modTimbre", "modBrightness", "modWheelDepth", "ampModCarriers", "ampModModulators", "ampModMax"],
    "Patch structure": ["algorithm", "feedback", "carriers", "activeOps", "maxRatio", "nonInteger", "ratioSpread", "fixedOps", "detuneSpread", "modDepth", "carrierLevel"],
    "Envelope and scaling parameters": ["egAttackRate", "egSustainLevel", "egEndLevel", "keyScaling", "velSensParam", "rateScaling", "pitchEg", "pitchModSens", "ampModSens"],
    "LFO": ["lfoSpeed", "lfoDelay", "lfoPm", "lfoAm", "lfoSampleHold"],
    "Corpus": ["familySounds", "familySize", "nearDupes"],
}


def axes(has: set[str], vector: str = "vector") -> dict[str, Column]:
    """Axis name -> expression over a wide row. has: optional inputs at hand ("pca", "lda", "layout", "predicted")."""
    out: dict[str, Column] = {}
    for name in ("pca", "layout", "lda"):
        if name in has:
            out |= {f"{name}1": F.col(name)[0], f"{name}2": F.col(name)[1]}
    out |= {name: F.coalesce(F.try_element_at(F.col(vector), F.lit(i + 1)).cast("double"), F.lit(0.0)) for i, name in enumerate(features.NAMES)}
    out["rating"] = F.coalesce("rating", F.lit(0.0))
    if "predicted" in has:
        out["predicted"] = F.coalesce("predicted", F.lit(0.0))
    out["algorithm"] = F.element_at("params", 135).bitwiseAND(31) + 1
    return out | {"familySounds": F.col("family_sounds"), "familySize": F.col("family_size"), "nearDupes": F.col("merged_size")}


def grouped_axes(names: list[str], groups: dict[str, list[str]] = AXIS_GROUPS) -> dict[str, list[str]]:
    """The names at hand by group; what no group names comes under Other."""
    out = {g: [n for n in wanted if n in names] for g, wanted in groups.items()}
    named = {n for wanted in groups.values() for n in wanted}
    out["Other"] = [n for n in names if n not in named]
    return {g: ns for g, ns in out.items() if ns}


def important_axes(coefficients: list[float], names: list[str], r2: float, n: int = 6) -> list[str]:
    """The axes that a model leans on most; none if it explains next to nothing."""
    if r2 < 0.08:
        return []
    return [names[i] for i in sorted(range(len(names)), key=lambda i: (-abs(coefficients[i]), i))[:n]]


# --- cells ------------------------------------------------------------------------------------

def stars(rating: Column) -> Column:
    return F.when(rating >= 1, F.repeat(F.lit("★"), rating.cast("int"))).otherwise("·")


def guessed_stars(predicted: Column) -> Column:
    return F.when(predicted.isNull(), "·").otherwise(F.repeat(F.lit("★"), F.least(F.greatest(F.floor(predicted + 0.5), F.lit(1)), F.lit(5)).cast("int")))


def milliseconds(log_seconds: Column) -> Column:
    return F.when(log_seconds.isNull(), "—").otherwise(F.concat(F.floor(F.pow(F.lit(10.0), log_seconds) * 1000 + 0.5).cast("long").cast("string"), F.lit(" ms")))


def seconds(log_seconds: Column) -> Column:
    return F.when(log_seconds.isNull(), "—").otherwise(F.concat(F.format_string("%.1f", F.pow(F.lit(10.0), log_seconds)), F.lit(" s")))


def first_of(name: Column, n: Column) -> Column:
    """The first source's name, and how many more there are."""
    return F.when(n > 1, F.concat(name, F.lit(" +"), (n - 1).cast("string"))).when(n == 1, name).otherwise("—")


def came_from(sources: Column) -> Column:
    """File name of the first source, and how many more there are."""
    return first_of(F.substring_index(F.element_at(sources, 1)["file"], "/", -1), F.size(sources))


def verdict(r2: Column) -> Column:
    """How far a preference model can be trusted."""
    return F.when(r2 > 0.25, "good").when(r2 > 0.08, "weak").otherwise("none")


def share_tier(share: Column) -> Column:
    return F.when(share > 0.15, "good").when(share > 0.05, "weak").otherwise("none")


def barely(offset: Column) -> Column:
    return F.abs(offset) <= 0.15


# --- colours ----------------------------------------------------------------------------------

# fixed values: hues of the categories, of ratings, and of a focused category's parts
CATEGORY_HUES = {"keys": 258, "bells": 310, "plucked": 145, "bass": 55, "brass": 25, "lead": 340, "organ": 225, "strings": 185, "abstract": 95}
RATING_HUES = [28, 55, 90, 130, 150]
FOCUS_HUES = [258, 55, 145, 340, 190, 25]


def oklch(lightness: Column, chroma: Column, hue: Column) -> Column:
    """An OkLCH colour as an array of red, green and blue, 0 to 255."""
    a, b = chroma * F.cos(F.radians(hue)), chroma * F.sin(F.radians(hue))
    # fixed values: the published OkLab matrices
    cone = [lightness + 0.3963377774 * a + 0.2158037573 * b, lightness - 0.1055613458 * a - 0.0638541728 * b, lightness - 0.0894841775 * a - 1.291485548 * b]
    to_rgb = [(4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701)]

    def channel(lms: Column, weights: tuple[float, float, float]) -> Column:
        linear = sum((F.lit(w) * lms[i] for i, w in enumerate(weights[1:], 1)), F.lit(weights[0]) * lms[0])
        curved = F.when(linear <= 0.0031308, 12.92 * linear).otherwise(1.055 * F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.least(F.greatest(F.floor(curved * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")

    return let(F.array(*[c * c * c for c in cone]), lambda lms: F.array(*[channel(lms, w) for w in to_rgb]))


def category_colour(category: Column) -> Column:
    hue = F.create_map(*[F.lit(x) for c, h in CATEGORY_HUES.items() for x in (c, float(h))])
    known = F.try_element_at(hue, category)
    return oklch(F.when(known.isNull(), 0.62).otherwise(0.72), F.when(known.isNull(), 0.01).otherwise(0.14), F.coalesce(known, F.lit(0.0)))


def rating_colour(rating: Column) -> Column:
    hue = F.element_at(F.array(*[F.lit(float(h)) for h in RATING_HUES]), F.greatest(F.lit(1), F.least(F.lit(5), rating.cast("int"))))
    rated = rating > 0
    return oklch(F.when(rated, 0.72).otherwise(0.42), F.when(rated, 0.14).otherwise(0.01), F.when(rated, hue).otherwise(0.0))


def cluster_hue(cluster: Column) -> Column:
    """Hues of clusters by the golden angle."""
    return (cluster.cast("double") * 137.508) % 360


def source_hue(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(360)).cast("double")


def density_scale(width: float, height: float, count: int) -> float:
    """How much to shrink points on a plot, from the room each has."""
    usual = math.sqrt(1400 * 800 / 35000)
    return 1.0 if count <= 0 else min(1.8, max(0.45, math.sqrt(width * height / count) / usual))


def draw_order(points: DataFrame, radius: str = "radius", key: str = "id") -> DataFrame:
    """Largest first, so that small ones stay visible."""
    return points.orderBy(F.col(radius).desc(), F.col(key))


# --- counts -----------------------------------------------------------------------------------

def rating_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.where("rating IS NOT NULL").groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def top_band(ratings: DataFrame) -> DataFrame:
    """One row: the highest rating given, and how many have it."""
    return rating_histogram(ratings).agg(F.max("rating").alias("rating"), F.max_by("n", "rating").alias("n"))


def progress(items: DataFrame, settled: int = 8) -> DataFrame:
    """items: rating, games. One row: total, rated, settled (compared often enough)."""
    return items.agg(F.count(F.lit(1)).alias("total"), F.count("rating").alias("rated"), F.count_if(F.coalesce("games", F.lit(0)) >= settled).alias("settled"))


def phrase_for(key: str) -> str:
    """A query that finds a source by its path."""
    return '"' + key.replace('"', "") + '"'

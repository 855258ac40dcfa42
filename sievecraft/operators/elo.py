"""Pairwise judgements: ratings that follow an ordered log of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SPREAD = 1500.0, 400.0
K, K_GAMES = 48.0, 8.0
STAR_CAP = 0.45


def expected(a: Column, b: Column) -> Column:
    """Chance that a beats b."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (b - a) / F.lit(SPREAD)))


def step(games: Column) -> Column:
    return F.lit(K) / (F.lit(1.0) + games / F.lit(K_GAMES))


def star_offset(score: Column, games: Column) -> Column:
    """What a standing adds to a star rating; too little to round to another star, and nothing without games."""
    raw = (score - F.lit(START)) / F.lit(SPREAD) * F.lit(STAR_CAP)
    return F.when(F.coalesce(games, F.lit(0)) > 0, F.least(F.greatest(raw, F.lit(-STAR_CAP)), F.lit(STAR_CAP))).otherwise(F.lit(0.0))


def effective_rating(stars: Column, score: Column, games: Column) -> Column:
    return stars + star_offset(score, games)


def fold(results: list[tuple], standings: dict | None = None) -> dict:
    """Apply (winner, loser) results in order to standings {id: (score, games)}."""
    out = dict(standings or {})
    for winner, loser in results:
        (a, ga), (b, gb) = out.get(winner, (START, 0)), out.get(loser, (START, 0))
        chance = 1.0 / (1.0 + 10.0 ** ((b - a) / SPREAD))
        out[winner] = (a + K / (1 + ga / K_GAMES) * (1 - chance), ga + 1)
        out[loser] = (b - K / (1 + gb / K_GAMES) * (1 - chance), gb + 1)
    return out


def standings(results: DataFrame) -> DataFrame:
    """results: band, seq, winner, loser -> band, id, score, games. Each band is folded in the order of seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        held = fold(list(zip(pdf.winner.tolist(), pdf.loser.tolist())))
        return pd.DataFrame({"band": pdf.band.iloc[0], "id": list(held), "score": [s for s, _ in held.values()], "games": np.array([g for _, g in held.values()], np.int64)})

    return results.select("band", "seq", "winner", "loser").groupBy("band").applyInPandas(run, "band long, id long, score double, games long")


def brackets(decisions: DataFrame) -> DataFrame:
    """Face-offs inside families: decisions: family, seq, champion, challenger, choice ("champion", "challenger" or "both").

    The winner goes on against the next challenger; "both" keeps the challenger as an extra.
    family, kept (the final champion first, then extras in order).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        champion, extras = int(pdf.champion.iloc[0]), []
        for challenger, choice in zip(pdf.challenger.tolist(), pdf.choice.tolist()):
            if choice == "challenger":
                champion = challenger
            elif choice == "both":
                extras.append(challenger)
        return pd.DataFrame({"family": [int(pdf.family.iloc[0])], "kept": [[champion, *[e for e in extras if e != champion]]]})

    return decisions.groupBy("family").applyInPandas(run, "family long, kept array<long>")


def refit_points(events: list[int], share: float = 0.25, least: int = 10) -> list[int]:
    """Which of a series of judgements (each the number of rated items after it) trigger a fit: at least max(least, round(share * rated at the last fit)) since."""
    out, since, at_fit = [], 0, 0
    for i, rated in enumerate(events):
        since += 1
        if since >= max(least, int(np.floor(share * at_fit + 0.5))):
            out.append(i)
            since, at_fit = 0, rated
    return out

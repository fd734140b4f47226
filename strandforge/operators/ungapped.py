"""Ungapped evidence: the best segment of a diagonal, chains of two, and the gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.residues import encode
from .alignment import Scoring


def _best_runs(scoring: Scoring):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                size, skip = part["n"].to_numpy(), (part["lo"] - part["q_from"]).to_numpy()
                width = max(1, int(size.max()))
                s = np.full((len(part), width), -(1 << 20), np.int64)
                row, place, score = scoring.facing(part["a"], part["b"], skip, size)
                s[row, place] = score
                upto = np.cumsum(s, axis=1)
                before = np.zeros_like(upto)
                before[:, 1:] = upto[:, :-1]
                floor = np.minimum.accumulate(before, axis=1)
                rise = upto - floor
                row, end = np.arange(len(part)), rise.argmax(1)
                best = rise[row, end]
                opens = (before == floor[row, end][:, None]) & (np.arange(width) <= end[:, None])
                start = width - 1 - opens[:, ::-1].argmax(1)
                some = best > 0
                lo = part["lo"].to_numpy()
                found = part.drop(columns=["a", "b", "n", "lo", "q_from"])
                yield found.assign(score=np.where(some, best, 0), q_start=np.where(some, lo + start, lo), q_end=np.where(some, lo + end, lo))

    return of


def reach(scores: np.ndarray, drop: int) -> tuple[int, int]:
    """How many places an extension over scores takes in and what it gains: up to the first best sum before a sum falls more than drop below it."""
    total = np.cumsum(scores)
    fallen = np.flatnonzero(total < np.maximum(np.maximum.accumulate(total), 0) - drop)
    total = total[: fallen[0]] if len(fallen) else total
    if not len(total) or total.max() <= 0:
        return 0, 0
    best = int(total.argmax())
    return best + 1, int(total[best])


def _extended(scoring: Scoring, span: int, drop: int):
    """The best extension of a diagonal's seeds to both sides; a seed that begins within the extension of one before it is passed over."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            known: dict = {}
            found = []
            for a, b, n, lo, q_from, places in zip(*(part[c] for c in ("a", "b", "n", "lo", "q_from", "places"))):
                if a not in known:
                    known[a] = scoring.rows(a)
                s = known[a][np.arange(n) + lo - q_from, encode(b)[:n]]
                best, covered = None, -1
                for at in (p - lo for p in places):
                    if at <= covered:
                        continue
                    to = min(at + span, n)
                    right, more = reach(s[to:], drop)
                    left, gain = reach(s[:at][::-1], drop)
                    covered = to - 1 + right
                    score = int(s[at:to].sum()) + more + gain
                    if best is None or score > best[0]:
                        best = (score, lo + at - left, lo + covered)
                found.append(best)
            more = pd.DataFrame(found, columns=["score", "q_start", "q_end"], index=part.index)
            yield pd.concat([part.drop(columns=["a", "b", "n", "lo", "q_from"]), more], axis=1)

    return of


def segments(diagonals: DataFrame, queries: DataFrame, targets: DataFrame, q: str, t: str, span: int, window: int = 48, scoring: Scoring = Scoring(bias=False), drop: int = 0) -> DataFrame:
    """With drop, the best X-drop extension of each diagonal's seeds (a column `places`); without, for each diagonal (q, t, diag, qmin, qmax) the best run of scores near its hits: score, q_start, q_end.

    Only the stretches that face each other (and what the composition bias of the query's needs) go to the kernel; they are cut from bytes, where a
    place is an offset. The first of equal runs counts; a run starts after the last place where the sum fell to zero."""
    qs = queries.select(q, F.col("seq").cast("binary").alias("qb"))
    ts = targets.select(t, F.col("seq").cast("binary").alias("tb"))
    both = diagonals.join(qs, q).join(ts, t)
    low = F.greatest(-F.col("diag"), F.lit(0))
    high = F.least((F.octet_length("qb") / scoring.unit).cast("int"), F.octet_length("tb") - F.col("diag"))
    if window and not drop:
        low, high = F.greatest(low, F.col("qmin") - window), F.least(high, F.col("qmax") + span + window)
    around, unit = scoring.radius, scoring.unit
    cut = both.select(*diagonals.columns, "qb", "tb", low.cast("int").alias("lo"), F.greatest(high - low, F.lit(0)).cast("int").alias("n"))
    cut = cut.withColumn("q_from", F.greatest(F.col("lo") - around, F.lit(0)))
    facing = cut.select(
        *diagonals.columns, "lo", "n", "q_from",
        F.substring("qb", F.col("q_from") * unit + 1, (F.col("lo") - F.col("q_from") + F.col("n") + around) * unit).cast("binary" if scoring.profile else "string").alias("a"),
        F.substring("tb", (F.col("lo") + F.col("diag") + 1).cast("int"), F.col("n")).cast("string").alias("b"),
    )
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in diagonals.schema)
    return facing.mapInPandas(_extended(scoring, span, drop) if drop else _best_runs(scoring), f"{kind}, score long, q_start long, q_end long")


def chains(segs: DataFrame, q: str, t: str, gap_open: int = 11, gap_extend: int = 1) -> DataFrame:
    """Pairs of segments of one (q, t), in order on both sequences, with the score of the two less the gap between their diagonals. A pair
    has 16 segments at most, so this self-join is small."""
    side = lambda x: segs.filter("score > 0").select(q, t, *[F.col(c).alias(f"{c}_{x}") for c in ("diag", "score", "q_start", "q_end")])
    joined = side("x").join(side("y"), [q, t]).filter("diag_x != diag_y AND q_end_x < q_start_y AND q_end_x + diag_x < q_start_y + diag_y")
    gap = gap_open + (F.abs(F.col("diag_y") - F.col("diag_x")) - 1) * gap_extend
    return joined.withColumn("chain_score", F.col("score_x") + F.col("score_y") - gap)


def candidates(segs: DataFrame, q: str, t: str, gate: int, most: int = 0, gaps: tuple[int, int] = (11, 1), ranked: bool = True) -> DataFrame:
    """q, t, evidence (best segment, or a chain if that is more) of the pairs that reach the gate, ranked by evidence, then t. Without a limit
    the rank can be left out, and with it the sort of each query's targets."""
    best = segs.groupBy(q, t).agg(F.max("score").alias("single"), F.sum("hits").alias("hits"))
    chained = chains(segs, q, t, *gaps).groupBy(q, t).agg(F.max("chain_score").alias("chain"))
    both = best.join(chained, [q, t], "left").select(q, t, "hits", F.greatest("single", F.coalesce("chain", "single")).alias("evidence"))
    return placed(both.filter(F.col("evidence") >= gate), q, t, most, ranked)


def placed(enough: DataFrame, q: str, t: str, most: int = 0, ranked: bool = True) -> DataFrame:
    """Candidates (q, t, evidence) with their rank, `most` of each query where it isn't 0."""
    if not most and not ranked:
        return enough
    found = enough.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(F.desc("evidence"), t)))
    return found.filter(F.col("rank") <= most) if most else found

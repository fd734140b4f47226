"""Seeds: windows of a sequence as base-20 codes, the index of a database, hits and their diagonals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import mapped, owners
from ..functions.residues import CODE, score_matrix
from ..plans.session import ship
from .masking import hidden

#: Window, low and high entropy of what is masked.
Mask = tuple[int, float, float]


@dataclass(frozen=True)
class Seed:
    """Which places of a window count."""

    mask: str = "111001101"

    def __post_init__(self) -> None:
        if not (self.mask.strip("01") == "" and self.mask[:1] == self.mask[-1:] == "1" and 2 <= self.weight <= 12):
            raise ValueError(f"not a seed: {self.mask!r}")

    @classmethod
    def contiguous(cls, k: int) -> Seed:
        return cls("1" * k)

    @property
    def places(self) -> list[int]:
        return [i for i, c in enumerate(self.mask) if c == "1"]

    @property
    def weight(self) -> int:
        return self.mask.count("1")

    @property
    def span(self) -> int:
        return len(self.mask)


def coded(data: np.ndarray, off: np.ndarray, seed: Seed, mask: Mask | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, place and code of every window, of all sequences at once, whose counted residues are known and not masked."""
    c, of = CODE[data], owners(off)
    count = max(0, len(c) - seed.span + 1)
    code, known = np.zeros(count, np.int64), np.ones(count, bool)
    good = c < 20 if mask is None else (c < 20) & ~hidden(data, off, *mask)
    for p in seed.places:
        code = code * 20 + c[p : p + count]
        known &= good[p : p + count]
    known &= of[:count] == of[seed.span - 1 :][:count]  # a window lies in one sequence
    at = np.flatnonzero(known)
    return of[at], at - off[of[at]], code[at]


def windows(sequences: DataFrame, key: str, seq: str = "seq", seed: Seed = Seed(), mask: Mask | None = None) -> DataFrame:
    """key, pos, code of every window without an unknown residue or one of low complexity (mask: window, low and high entropy; None masks nothing)."""
    ship(sequences.sparkSession)

    def kernel(part):
        of, pos, code = coded(part[1], part[2], seed, mask)
        yield {"of": of, "pos": pos.astype(np.int32), "code": code}

    return mapped(sequences, key, seq, kernel, "pos int, code long")


def summary(sequences: DataFrame, key: str, seq: str = "seq", seed: Seed = Seed()) -> DataFrame:
    """key, windows, codes, total of each key: how many windows, how many different codes, their sum. A task has whole sequences, so only sequences that share
    a key are shuffled by window."""
    ship(sequences.sparkSession)

    def kernel(part):
        of, _, code = coded(part[1], part[2], seed)
        order = np.lexsort((code, of))
        of, code = of[order], code[order]
        n = len(part[2]) - 1
        new = np.append(True, (of[1:] != of[:-1]) | (code[1:] != code[:-1]))[: len(of)]
        windows, kinds, total = np.bincount(of, minlength=n), np.bincount(of[new], minlength=n), np.zeros(n, np.int64)
        np.add.at(total, of, code)
        some = np.flatnonzero(windows)
        yield {"of": some, "windows": windows[some], "codes": kinds[some], "total": total[some]}

    shared = sequences.groupBy(key).count().filter("count > 1").select(F.col(key).alias("shared"))
    if shared.isEmpty():
        return mapped(sequences, key, seq, kernel, "windows long, codes long, total long")
    same = F.col(key).eqNullSafe(F.col("shared"))
    alone, many = sequences.join(shared, same, "left_anti"), sequences.join(shared, same, "left_semi")
    rest = windows(many, key, seq, seed).groupBy(key).agg(F.count("*").alias("windows"), F.countDistinct("code").alias("codes"), F.sum("code").alias("total"))
    return mapped(alone, key, seq, kernel, "windows long, codes long, total long").union(rest)


def index(targets: DataFrame, key: str, seq: str = "seq", seed: Seed = Seed()) -> DataFrame:
    """One row for each code of a database: postings, first and last sequence. A task adds up its own postings of some sequences before they are shuffled."""
    ship(targets.sparkSession)

    def kernel(part):
        of, _, code = coded(part[1], part[2], seed)
        order = np.lexsort((of, code))
        of, code = of[order], code[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1]))[: len(code)])
        yield {"of": of[first], "code": code[first], "n": np.diff(first, append=len(code))}

    counted = mapped(targets, key, seq, kernel, "code long, n long", 1 << 22)
    return counted.groupBy("code").agg(F.sum("n").alias("postings"), F.min(key).alias("first_target"), F.max(key).alias("last_target"))


def write_index(targets: DataFrame, key: str, table: str, seq: str = "seq", seed: Seed = Seed(), mask: Mask | None = None, buckets: int = 64) -> None:
    """The postings as a table bucketed and sorted by code, so that searches that are given it join it without a shuffle."""
    windows(targets, key, seq, seed, mask).write.mode("overwrite").bucketBy(buckets, "code").sortBy("code", key, "pos").saveAsTable(table)


def capped(postings: DataFrame, most: int) -> DataFrame:
    """The postings of codes with at most so many; 0 keeps all. This option, off by default, changes results."""
    if not most:
        return postings
    frequent = postings.groupBy("code").count().filter(F.col("count") > most).select("code")
    return postings.join(frequent, "code", "left_anti")


def hits(query_windows: DataFrame, target_windows: DataFrame, q: str, t: str, places: bool = False) -> DataFrame:
    """Seed hits by (query, target, diagonal): how many, first and last query place; with places, all of them in order (a query's length at most)."""
    left = query_windows.select(q, F.col("pos").alias("qpos"), "code")
    right = target_windows.select(t, F.col("pos").alias("tpos"), "code")
    more = [F.sort_array(F.collect_list("qpos")).alias("places")] if places else []
    return (
        left.join(right, "code")
        .groupBy(q, t, (F.col("tpos") - F.col("qpos")).alias("diag"))
        .agg(F.count("*").alias("hits"), F.min("qpos").alias("qmin"), F.max("qpos").alias("qmax"), *more)
    )


#: Windows of queries that are handed to all tasks, 16 bytes each.
HANDED = 1 << 21


def unique(df: DataFrame, key: str) -> bool:
    """Whether no two rows have one key, nulls included. Nothing but keys is read."""
    return df.groupBy(key).count().filter("count > 1").isEmpty()


def diagonals(query_windows: DataFrame, targets: DataFrame, q: str, t: str, seed: Seed = Seed(), most: int = 0, mask: Mask | None = None, pairs: bool = False) -> DataFrame:
    """hits() of the queries' windows among those of targets (t, seq); most: only the top_diagonals() of each pair, with their rank; pairs: one row
    a pair, over all its diagonals.

    A task has whole targets, so it finds the diagonals of its targets by itself, and nothing is shuffled; for that the queries' windows are handed to all
    tasks. Targets that share a key, and more than HANDED windows of queries, go by hits() and top_diagonals()."""
    spark = ship(targets.sparkSession)
    held = query_windows.select(q, "pos", "code").limit(HANDED + 1).toPandas()
    if len(held) > HANDED or not unique(targets, t):
        found = hits(query_windows, windows(targets, t, seed=seed, mask=mask), q, t)
        if pairs:
            return found.groupBy(q, t).agg(F.sum("hits").alias("hits"), F.min("qmin").alias("qmin"), F.max("qmax").alias("qmax"))
        return top_diagonals(found, q, t, most) if most else found
    names = held[q].drop_duplicates().reset_index(drop=True)
    number = np.asarray(pd.Index(names).get_indexer(held[q])) if len(held) else np.zeros(0, np.int64)
    order = np.argsort(held["code"].to_numpy(), kind="stable")
    typ = pa.Schema.from_pandas(held[[q]], preserve_index=False).field(q).type
    table = spark.sparkContext.broadcast((held["code"].to_numpy()[order], number[order].astype(np.int64), held["pos"].to_numpy()[order].astype(np.int64), pa.array(names, typ)))

    def kernel(part):
        known, of_query, at_query, named = table.value
        of, pos, code = coded(part[1], part[2], seed, mask)
        first = np.searchsorted(known, code, "left")
        count = np.searchsorted(known, code, "right") - first
        some = np.flatnonzero(count)
        for low, high in _runs(of[some], count[some]):
            at = some[low:high]
            c = count[at]
            hit = np.arange(c.sum()) + np.repeat(first[at] - (np.cumsum(c) - c), c)
            target, diag = np.repeat(of[at], c), np.zeros(c.sum(), np.int64) if pairs else np.repeat(pos[at], c) - at_query[hit]
            by = np.lexsort((diag, of_query[hit], target))
            target, diag, query, place = target[by], diag[by], of_query[hit][by], at_query[hit][by]
            new = np.flatnonzero(np.append(True, (target[1:] != target[:-1]) | (query[1:] != query[:-1]) | (diag[1:] != diag[:-1])))
            n, low_q, high_q = np.diff(new, append=len(by)), np.minimum.reduceat(place, new), np.maximum.reduceat(place, new)
            target, diag, query = target[new], diag[new], query[new]
            found = {"of": target, q: named.take(pa.array(query)), "diag": diag.astype(np.int32), "hits": n, "qmin": low_q.astype(np.int32), "qmax": high_q.astype(np.int32)}
            if most:
                by = np.lexsort((diag, -n, query, target))
                pair = np.append(True, (target[by][1:] != target[by][:-1]) | (query[by][1:] != query[by][:-1]))
                rank = np.arange(len(by)) - np.maximum.accumulate(np.where(pair, np.arange(len(by)), 0)) + 1
                keep = by[rank <= most]
                found = {k: x.take(pa.array(keep)) if isinstance(x, pa.Array) else x[keep] for k, x in found.items()} | {"rank": rank[rank <= most].astype(np.int32)}
            yield found

    kind = query_windows.schema[q].dataType.simpleString()
    names = [q, t, *([] if pairs else ["diag"]), "hits", "qmin", "qmax", *(["rank"] if most else [])]
    return mapped(targets, t, "seq", kernel, f"{q} {kind}, diag int, hits long, qmin int, qmax int" + (", rank int" if most else "")).select(names)


def _runs(of: np.ndarray, count: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of windows with about `limit` hits; those of one sequence stay together."""
    if not len(of):
        return
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
    upto, low, before = np.cumsum(count)[ends - 1], 0, 0
    for end, n in zip(ends, upto):
        if n - before > limit or end == len(of):
            yield low, int(end)
            low, before = int(end), n


def top_diagonals(diagonals: DataFrame, q: str, t: str, most: int = 4, min_hits: int = 1, diag_hits: int = 1) -> DataFrame:
    """The diagonals with most hits of each pair, ties by diagonal; pairs with fewer than min_hits hits or no diagonal of diag_hits are dropped."""
    pair = W.partitionBy(q, t)
    ranked = diagonals.withColumn("rank", F.row_number().over(pair.orderBy(F.desc("hits"), "diag")))
    if min_hits > 1 or diag_hits > 1:
        ranked = ranked.withColumn("all", F.sum("hits").over(pair)).withColumn("top", F.max("hits").over(pair))
        ranked = ranked.filter((F.col("all") >= min_hits) & (F.col("top") >= diag_hits)).drop("all", "top")
    return ranked.filter(F.col("rank") <= most)


def nearest(rows: np.ndarray, threshold: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and scores of the `most` best words that score `threshold` or more against rows (place, residue); ties by the residues' ranks at each
    place (by score, then residue), first place first.

    How many words have which score is known from the places' histograms, multiplied as polynomials. So the score of the last word that counts is
    known before any word is made, and each partial word that is kept ends in one that counts or ties."""
    k, low = len(rows), int(rows.min())
    ranked = np.argsort(-rows, axis=1, kind="stable")
    gain = np.take_along_axis(rows, ranked, 1)
    ways = np.ones(1)
    for r in rows:
        ways = np.convolve(ways, np.bincount(r - low))
    upto = np.cumsum(ways[::-1])[::-1]  # how many words score k * low + i or more
    enough = np.flatnonzero(upto >= most)
    least = max(threshold, k * low + int(enough[-1])) if len(enough) else threshold
    rest = np.append(np.cumsum(gain[::-1, 0])[::-1], 0)
    code, score, order = (np.zeros(1, np.int64) for _ in range(3))
    for i in range(k):
        total = score[:, None] + gain[i]
        at, rank = np.nonzero(total + rest[i + 1] >= least)
        code, score, order = code[at] * 20 + ranked[i][rank], total[at, rank], order[at] * 20 + rank
    best = np.lexsort((order, -score))[:most]
    return code[best], score[best]


def similar(kmers: DataFrame, k: int, threshold: int, most: int, own: bool = False) -> DataFrame:
    """code, similar, score, rank: the nearest words of each distinct contiguous k-mer code; with own, the code itself too where it isn't among them (last rank)."""
    spark = ship(kmers.sparkSession)
    m = score_matrix()[:20, :20].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy()
            for at in range(0, len(codes), 64):
                found = []
                for code in codes[at : at + 64].tolist():
                    rows = m[[code // 20**p % 20 for p in range(k - 1, -1, -1)]]
                    near, score = nearest(rows, threshold, most)
                    if own and code not in near:
                        near, score = np.append(near, code), np.append(score, rows.max(1).sum())
                    found.append((np.full(len(near), code), near, score, np.arange(1, len(near) + 1, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["code", "similar", "score", "rank"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few bytes, much work
    return kmers.select("code").repartition(tasks, "code").distinct().mapInArrow(run, "code long, similar long, score long, rank int")


def query_seeds(query_windows: DataFrame, q: str, seed: Seed, threshold: int, most: int, own: bool = True) -> DataFrame:
    """q, pos, code: the words near each window of the queries. most = 0 takes the windows' own codes only."""
    if not most:
        return query_windows.select(q, "pos", "code")
    near = similar(query_windows, seed.weight, threshold, most, own).select("code", "similar")
    return query_windows.join(near, "code").select(q, "pos", F.col("similar").alias("code"))

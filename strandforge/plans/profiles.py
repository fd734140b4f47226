"""Profiles as queries: search with one, again with what it found, and the alignment of profiles with each other.

An alignment is rows of (msa, row, pos, code); several can be searched at once, each one a query named by msa."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions.residues import ALPHABET, BACKGROUND
from ..operators import alignment, profile, seeds
from ..operators.alignment import Scoring
from ..operators.kernels import best_scores, table_path
from ..sources.writers import a3m_row
from .search import Options, candidates, near, paired, totals
from .session import cut, ship

# What gaps cost in eighths of a bit, and lambda and K where a calibration has no fit.
GAPS = (44, 4)
UNFITTED = (math.log(2) / 8, 0.041)
SCORING = Scoring(bias=False, profile=True, gaps=GAPS)


@dataclass(frozen=True)
class ProfileOptions(Options):
    """What a profile search may be asked for. Scores are eighths of a bit; sensitivity moves the word score alone."""

    spaced: str = "11111"
    exact_seeds: bool = False
    min_diag_score: int | None = 30
    comp_bias_corr: bool = False
    mask_scoring: tuple[int, float, float] | None = None
    pca: float = profile.PCA
    pcb: float = profile.PCB
    bias: float = 0.0
    samples: int = 2000
    draw: int = 0x5EED
    rounds: int = 1
    inclusion: float = 1e-3
    exhaustive: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.exact_seeds or self.comp_bias_corr or self.mask_scoring:
            raise ValueError("a profile has no words, composition or stretches of its own")
        if self.rounds < 1 or self.words[1] < 1:
            raise ValueError("a count is too small")

    @property
    def words(self) -> tuple[int, int]:
        score = max(4, math.floor(40 + (5.7 - self.sensitivity) * 6 + 0.5))
        return score if self.kmer_score is None else self.kmer_score, 512 if self.max_kmers is None else self.max_kmers


def _tasks(df: DataFrame) -> int:
    """Few bytes and much work: the number of tasks doesn't follow the bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def packed(scores: DataFrame, consensus: DataFrame) -> DataFrame:
    """msa, profile: a profile as Scoring reads it. An unknown residue scores 0."""
    byte = lambda x: F.lpad(F.hex(x.bitwiseAND(255)), 2, "0")
    cells = scores.groupBy("msa", "pos").agg(F.array_sort(F.collect_list(F.struct("code", byte(F.col("score")).alias("b")))).alias("s"))
    own = F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.col("consensus")), F.lit(0)), F.lit(21)) - 1
    place = F.concat(F.array_join(F.transform("s", lambda x: x["b"]), ""), F.lit("00"), byte(own))
    whole = cells.join(consensus, ["msa", "pos"]).groupBy("msa").agg(F.array_sort(F.collect_list(F.struct("pos", place.alias("h")))).alias("p"))
    return whole.select("msa", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("profile"))


def built(msa: DataFrame, pca: float = profile.PCA, pcb: float = profile.PCB, bias: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The scores (msa, pos, code, score, prob) and the consensus (msa, pos, consensus) of alignments."""
    weighted = profile.weights(msa)
    freq = cut(profile.frequencies(msa, weighted))
    return profile.pssm(freq, profile.effective(msa, weighted, freq), pca, pcb, bias), profile.consensus(freq)


def words(profiles: DataFrame, seed: seeds.Seed, threshold: int, most: int) -> DataFrame:
    """msa, pos, code: the best words of each window of profiles (msa, profile)."""
    last = (F.octet_length("profile") / 22).cast("int") - seed.span
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("profile"), i * 22 + 1, F.lit(seed.span * 22)))
    each = profiles.filter(last >= 0).select("msa", F.posexplode(window).alias("pos", "window"))
    places = seed.places

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                found = [seeds.nearest(np.frombuffer(w, np.int8).reshape(-1, 22)[places, :20].astype(np.int64), threshold, most)[0] for w in part["window"]]
                size = [len(x) for x in found]
                yield pd.DataFrame({"msa": part["msa"].repeat(size).to_numpy(), "pos": part["pos"].repeat(size).to_numpy(), "code": np.concatenate(found)})

    kind = each.schema["msa"].dataType.simpleString()
    return each.repartition(_tasks(each), F.xxhash64("msa", "pos")).mapInPandas(run, f"msa {kind}, pos int, code long")


def random_residues(draw: int, sample: int, size: int) -> np.ndarray:
    """Residues by their background frequencies; the same ones for the same numbers on any machine."""
    u = np.random.Generator(np.random.Philox(key=[draw, sample])).random(size)
    upto = np.cumsum(BACKGROUND)
    return np.minimum(np.searchsorted(upto / upto[-1], u, "right"), 19)


def calibrated(profiles: DataFrame, targets: DataFrame, residues: int, sequences: int, samples: int, draw: int) -> DataFrame:
    """msa, lam, k: how the best scores of a profile against random sequences are spread. Their lengths are the quantiles of all targets' lengths.

    A profile meets `samples` sequences, 100 at least, whatever the database; they are dealt to all tasks. Each profile's scores are fitted as a Gumbel
    distribution, half a score above since scores are whole; E = sequences * P(score or more) is then K m N exp(-lambda score)."""
    n, tasks = max(samples, 100), _tasks(profiles)
    upto = F.sum("count").over(W.orderBy("n"))  # a row a length
    share = lambda x: F.ceil(x * n / max(sequences, 1) - 0.5)
    lengths = targets.groupBy(F.coalesce(F.length("seq"), F.lit(0)).alias("n")).count().withColumn("to", upto).select("n", share(F.col("to") - F.col("count")).alias("a"), (share(F.col("to")) - 1).alias("b"))
    dealt = lengths.filter("b >= a").select("n", F.explode(F.sequence("a", "b")).alias("i")).groupBy((F.col("i") % tasks).alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("d"))
    work = profiles.crossJoin(dealt.select("g", F.col("d.i").alias("samples"), F.col("d.n").alias("sizes"))).repartition(tasks, F.xxhash64("msa", "g")).drop("g")
    kind = profiles.schema["msa"].dataType.simpleString()
    mean = residues / max(sequences, 1)

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for msa, held, which, sizes in zip(part["msa"], part["profile"], part["samples"], part["sizes"]):
                rows = SCORING.rows(held)
                made = [random_residues(draw, int(i), max(int(size), 1)) for i, size in zip(which, sizes)]
                score = best_scores(rows, made, *GAPS)
                yield pd.DataFrame({"msa": [msa] * len(made), "m": len(rows), "score": score})

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        found = st.gumbel(part["score"].to_numpy())
        lam, k = UNFITTED if found is None else (found[0], math.exp(found[0] * (found[1] + 0.5)) / (int(part["m"].iloc[0]) * mean))
        return pd.DataFrame({"msa": part["msa"].iloc[:1], "lam": [lam], "k": [k]})

    scores = work.mapInPandas(simulate, f"msa {kind}, m int, score long")
    return scores.groupBy("msa").applyInPandas(fit, f"msa {kind}, lam double, k double")


def _round(profiles: DataFrame, targets: DataFrame, t: str, residues: int, sequences: int, options: ProfileOptions, index: DataFrame | None) -> DataFrame:
    known = calibrated(profiles, targets, residues, sequences, options.samples, options.draw)
    space = SCORING.length(F.col("profile")).cast("double") * float(max(residues, 1))
    least = F.greatest(F.ceil(F.ln(F.col("k") * space / options.evalue) / F.col("lam")), F.lit(1)).cast("int")
    asked = cut(profiles.join(known, "msa").select("msa", F.col("profile").alias("qseq"), space.alias("space"), least.alias("least"), "lam", "k"))
    texts = targets.select(t, F.col("seq").alias("tseq"))
    found, told = None, False
    if not options.exhaustive:
        seed = seeds.Seed(options.spaced)
        held = cut(words(profiles, seed, *options.words))
        found, told = candidates(held, asked.select("msa", F.col("qseq").alias("seq"), "least"), targets, "msa", t, seed, options, SCORING, options.min_diag_score, index, False, "least", True)
        if told and options.max_hits and not options.min_qcov and not options.min_tcov:  # a profile's hits are in the order of their scores
            best = F.row_number().over(W.partitionBy("msa").orderBy(F.desc("score"), t))
            found = cut(found.select("msa", t, "score")).withColumn("rank", best).filter(F.col("rank") <= options.max_hits)
        found = cut(found.select("msa", t))
        if told:
            texts = texts.join(near(found.select(t).distinct()), t, "left_semi")
    pairs, spread = paired(found, asked, texts.filter("tseq != ''"), "msa", t)
    return alignment.aligned(pairs, "msa", t, SCORING, options.evalue, options.min_qcov, options.min_tcov, options.max_hits, spread, told)


def hit_rows(hits: DataFrame, targets: DataFrame, t: str) -> DataFrame:
    """msa, row, pos, code of hits laid against their profiles; residues between a profile's places go, gaps aren't made."""
    held = targets.select(t, F.upper("seq").alias("tseq"))
    text = F.regexp_replace(a3m_row(F.col("qlen"), F.col("tseq"), F.col("qstart"), F.col("tstart"), F.col("cigar")), "[a-z]", "")
    letters = hits.join(held, t).select("msa", F.concat(F.lit("hit "), F.col(t).cast("string")).alias("row"), F.posexplode(F.split(text, "")).alias("pos", "letter"))
    code = F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.col("letter")), F.lit(0)), F.lit(21)) - 1
    return letters.filter("letter NOT IN ('-', '')").select("msa", "row", "pos", code.alias("code"))


def profilesearch(msa: DataFrame, targets: DataFrame, t: str, index: DataFrame | None = None, **given) -> DataFrame:
    """The hits of alignments among targets (t, seq), named by msa; alignments without places find nothing.

    With rounds above 1, hits of an E-value of `inclusion` or less join their alignment, each target once, and the profiles are built and searched
    again, until no alignment has a new row. The last round's hits are returned."""
    options = ProfileOptions.of(**given)
    ship(targets.sparkSession)
    residues, sequences = totals(targets)
    rows = msa.select("msa", F.concat(F.lit("row "), F.col("row").cast("string")).alias("row"), "pos", "code")
    seen = None
    for done in range(1, options.rounds + 1):
        profiles = cut(packed(*built(rows, options.pca, options.pcb, options.bias)))
        hits = _round(profiles, targets, t, residues, sequences, options, index)
        if done == options.rounds:
            return hits
        hits = cut(hits)
        fresh = hits.filter(F.col("evalue") <= options.inclusion)
        fresh = cut(fresh if seen is None else fresh.join(seen, ["msa", t], "left_anti"))
        if fresh.isEmpty():
            return hits
        seen = fresh.select("msa", t) if seen is None else cut(seen.unionByName(fresh.select("msa", t)))
        rows = cut(rows.unionByName(hit_rows(near(fresh), targets, t)))
    raise AssertionError(options.rounds)


PAIR = "score int, qstart int, qend int, tstart int, tend int, columns int, identical int, cigar string"


#: Scores of profiles, 8 bytes each, that are handed to all tasks; more move pair by pair.
CELLS = 1 << 23


def _handed(a: DataFrame, b: DataFrame, path, names: list[str], kinds: str, tasks: int) -> DataFrame:
    """The paths of all pairs of two tables of profiles that every task has, so that pairs are but numbers."""
    spark = a.sparkSession
    sides = []
    for x, n in ((a, "left"), (b, "right")):
        held = x.toArrow()
        sides.append((held.column(n).to_pylist(), [np.array(p.values) for p in held.column(f"{n}_p")], held.column(f"{n}_c").to_pylist()))
    shared = spark.sparkContext.broadcast(sides)
    size = len(sides[1][0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = shared.value
        for part in batches:
            for at in range(0, len(part), 256):
                rows = []
                for i in part["id"].iloc[at : at + 256]:
                    i, j = divmod(int(i), size)
                    found = path(left[1][i], right[1][j], left[2][i], right[2][j])
                    if found is not None:
                        rows.append({"left": left[0][i], "right": right[0][j]} | found)
                yield pd.DataFrame(rows, columns=["left", "right", *names])

    dealt = spark.range(0, len(sides[0][0]) * size, 1, tasks)
    return dealt.mapInPandas(run, kinds)


def profileprofile(left: DataFrame, right: DataFrame, pca: float = profile.PCA, pcb: float = profile.PCB, bias: float = 0.0) -> DataFrame:
    """left, right, score, bits, cons_id, places and path: the best local alignment of each left profile, the stated queries, with each right one.

    Two places score by the odds of giving the same residue; residues that the two consensus sequences share count as identical. Pairs without a score above
    0 have no row."""

    def held(msa: DataFrame, x: str) -> DataFrame:
        scores, consensus = built(msa, pca, pcb, bias)
        cells = scores.groupBy("msa", "pos").agg(F.array_sort(F.collect_list(F.struct("code", "prob"))).alias("s"))
        place = F.struct("pos", F.col("s.prob").alias("p"), "consensus")
        whole = cells.join(consensus, ["msa", "pos"]).groupBy("msa").agg(F.array_sort(F.collect_list(place)).alias("a"))
        return cut(whole.select(F.col("msa").alias(x), F.flatten(F.col("a.p")).alias(f"{x}_p"), F.array_join("a.consensus", "").alias(f"{x}_c")))

    a = held(left, "left")
    b = a.toDF("right", "right_p", "right_c") if right is left else held(right, "right")
    tasks = _tasks(a)
    odds = np.maximum(np.array(BACKGROUND), 1e-6)
    names = [c.split()[0] for c in PAIR.split(", ")]

    def path(p, q, x, y) -> dict | None:
        both = np.log2(np.maximum((np.reshape(p, (-1, 20)) / odds) @ np.reshape(q, (-1, 20)).T, 1e-6)) * 8
        table = np.clip(np.sign(both) * np.floor(np.abs(both) + 0.5), -128, 127).astype(np.int16)
        return table_path(table, np.array(list(x))[:, None] == np.array(list(y)), *GAPS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [path(*row) for row in zip(part["left_p"], part["right_p"], part["left_c"], part["right_c"])]
            at = [i for i, x in enumerate(found) if x is not None]
            yield pd.concat([part[["left", "right"]].iloc[at].reset_index(drop=True), pd.DataFrame([found[i] for i in at], columns=names)], axis=1)

    kinds = ", ".join([*[f"{x} {y.schema[x].dataType.simpleString()}" for x, y in (("left", a), ("right", b))], PAIR])
    cells = [x.agg(F.coalesce(F.sum(F.size(f"{n}_p")), F.lit(0))).first()[0] for x, n in ((a, "left"), (b, "right"))]
    if max(cells) <= CELLS:
        pairs = _handed(a, b, path, names, kinds, 4 * tasks)
    else:
        pairs = a.crossJoin(b).repartition(tasks, F.xxhash64("left", "right")).mapInPandas(run, kinds)
    return pairs.withColumn("bits", F.col("score") / 8).withColumn("cons_id", 100.0 * F.col("identical") / F.col("columns"))

"""Residues: alphabet, codons, substitution scores, as column expressions and small arrays."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The residue order, the codon table (bases in order T, C, A, G), background frequencies, and the lower triangle of the
# integer substitution scores, row by row in residue order. X scores -1 against all.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
CODONS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BACKGROUND = [
    0.07422, 0.02469, 0.05363, 0.05431, 0.04742, 0.07415, 0.02621, 0.06792, 0.05815, 0.09891,
    0.02499, 0.04465, 0.03854, 0.03426, 0.05161, 0.05723, 0.05089, 0.07292, 0.01303, 0.03228,
]
SCORES = """
4
-1 8
-2 -4 6
-1 -4 1 5
-2 -3 -4 -3 6
0 -3 -2 -2 -3 5
-2 -3 -1 0 -1 -2 7
-2 -1 -3 -3 0 -4 -3 4
-1 -3 -1 1 -3 -2 -1 -3 4
-2 -1 -4 -3 0 -4 -3 1 -3 4
-1 -2 -3 -2 0 -3 -2 1 -2 2 5
-2 -3 1 0 -3 -1 0 -3 0 -4 -2 5
-1 -3 -2 -1 -4 -2 -2 -3 -1 -3 -3 -2 7
-1 -3 -1 2 -3 -2 0 -3 1 -2 -1 0 -1 5
-2 -4 -2 0 -3 -3 0 -3 2 -2 -2 -1 -2 1 5
1 -1 0 0 -3 0 -1 -3 0 -3 -2 0 -1 0 -1 4
0 -1 -1 -1 -2 -2 -2 -1 -1 -1 -1 0 -1 -1 -1 1 4
0 -1 -3 -3 -1 -3 -3 2 -2 1 0 -3 -3 -2 -3 -2 0 4
-3 -3 -4 -3 1 -3 -3 -3 -3 -2 -2 -4 -4 -2 -3 -3 -3 -3 10
-2 -3 -3 -2 3 -3 1 -2 -2 -1 -1 -2 -3 -2 -2 -2 -2 -1 2 6
"""
X = 20
#: Score bias that was added before rounding, in half bits.
BIAS = -0.2


def score_matrix() -> np.ndarray:
    """The 21 x 21 integer scores."""
    m = np.full((21, 21), -1)
    for i, row in enumerate(SCORES.split("\n")[1:-1]):
        for j, s in enumerate(row.split()):
            m[i, j] = m[j, i] = int(s)
    return m


def parse_matrix(text: str) -> np.ndarray:
    """Half-bit scores (21 x 21 doubles) of a published matrix file: comments, a header of letters, a row for each letter."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    letters, out = rows[0], np.full((21, 21), -1.0)
    if set(letters) - {"X"} != set(ALPHABET):
        raise ValueError("the matrix doesn't have the twenty residues")
    place = [ALPHABET.find(c) for c in letters]
    for row in rows[1:]:
        i = ALPHABET.find(row[0])
        for j, v in zip(place, row[1:]):
            out[i, j] = float(v)
    return out


def integer_scores(half_bits: np.ndarray) -> np.ndarray:
    """Half-bit scores plus the bias, rounded half away from zero."""
    return half_away(half_bits + BIAS).astype(int)


def conditional(half_bits: np.ndarray | None = None) -> np.ndarray:
    """P(a | b) of the joint distribution that the scores stand for."""
    s = (score_matrix()[:20, :20] - BIAS) if half_bits is None else half_bits[:20, :20]
    p = np.array(BACKGROUND) / sum(BACKGROUND)
    joint = np.outer(p, p) * 2.0 ** (s / 2)
    return joint / joint.sum(0)


def half_away(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def codes(seq: Column) -> Column:
    """An array of residue codes; letters other than the twenty are 20."""
    return F.transform(F.split(F.upper(seq), ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(21)) - 1)


CODE = np.full(256, X, np.int64)
for _k, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _k


def encode(seq: str) -> np.ndarray:
    return CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def letters(code: Column) -> Column:
    """The letter of a code; X for 20, a gap for anything else."""
    return F.when(code.between(0, 20), F.substring(F.lit(ALPHABET + "X"), code + 1, F.lit(1))).otherwise("-")


def residues_of(text: Column) -> Column:
    """The letters of any text, upper-cased."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def score(a: Column, b: Column) -> Column:
    """The integer score of two codes, a look-up in one literal array."""
    flat = F.array(*[F.lit(int(x)) for x in score_matrix().ravel()])
    return F.element_at(flat, a * 21 + b + 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.regexp_replace(F.translate(F.upper(seq), "ACGTU", "TGCAA"), "[^ACGT]", "N"))


def codon_letter(codon: Column) -> Column:
    """The residue of three bases, U as T; X if one isn't a base."""
    place = [F.instr(F.lit("TCAG"), F.translate(F.substring(F.upper(codon), k, 1), "U", "T")) - 1 for k in (1, 2, 3)]
    known = reduce(lambda a, b: a & b, [p >= 0 for p in place])
    return F.when(known, F.substring(F.lit(CODONS), place[0] * 16 + place[1] * 4 + place[2] + 1, F.lit(1))).otherwise("X")


def base_codes(nt: Column) -> Column:
    """The places of a strand's bases in T, C, A, G, from 0; -1 for anything else."""
    return F.transform(F.split(F.translate(F.upper(nt), "U", "T"), ""), lambda b: F.instr(F.lit("TCAG"), b) - 1)


def translated(places: Column, frame: Column) -> Column:
    """The residues of a strand read from base `frame` (0, 1, 2). places: a column of base_codes(), not an expression, which would be worked
    out again for each codon."""
    count = F.floor((F.size(places) - frame) / 3).cast("int")

    def one(k: Column) -> Column:
        a, b, c = (F.get(places, frame + k * 3 + j) for j in range(3))
        return F.when((a >= 0) & (b >= 0) & (c >= 0), F.substring(F.lit(CODONS), a * 16 + b * 4 + c + 1, F.lit(1))).otherwise("X")

    empty = F.array().cast("array<string>")
    return F.array_join(F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(empty), "")


def looks_nucleotide(seq: Column) -> Column:
    """Whether nine in ten letters are ACGTUN."""
    return (F.length(seq) > 0) & (F.length(F.regexp_replace(F.upper(seq), "[^ACGTUN]", "")) * 10 >= F.length(seq) * 9)


def log2(x: float) -> float:
    return math.log2(x)

"""Six frames and open reading frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mapped
from ..functions.residues import CODONS, base_codes, reverse_complement, translated
from ..plans.session import ship


def frames(nucleotides: DataFrame, key: str, nt: str = "nt") -> DataFrame:
    """key, frame (1, 2, 3, -1, -2, -3), aa, nt_len. The reverse strand is complemented once, not once a frame."""
    both = nucleotides.select(key, F.length(nt).alias("nt_len"), F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.upper(nt).alias("strand")), F.struct(F.lit(-1).alias("sign"), reverse_complement(F.col(nt)).alias("strand")))).alias("s"))
    strands = both.filter("nt_len > 0").select(key, "nt_len", "s.sign", base_codes(F.col("s.strand")).alias("strand"))
    each = strands.select(key, "nt_len", "sign", "strand", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shift"))
    return each.select(key, "nt_len", (F.col("sign") * (F.col("shift") + 1)).alias("frame"), translated(F.col("strand"), F.col("shift")).alias("aa"))


_BASE = np.full(256, -1, np.int64)
for _k, _b in enumerate("TCAG"):
    _BASE[ord(_b)] = _BASE[ord(_b.lower())] = _k
_BASE[ord("U")] = _BASE[ord("u")] = 0
#: The places of A, G, T, C: what stands against T, C, A, G on the other strand.
_AGAINST = np.array([2, 3, 0, 1, -1])
_AMINO = np.frombuffer(CODONS.encode(), np.uint8)


def _amino(bases: np.ndarray) -> np.ndarray:
    """The residue of the codon that begins at each base, X with an unknown base."""
    a, b, c = bases[:-2], bases[1:-1], bases[2:]
    return np.where((a >= 0) & (b >= 0) & (c >= 0), _AMINO[np.maximum(a * 16 + b * 4 + c, 0)], ord("X")).astype(np.uint8)


def orfs(nucleotides: DataFrame, key: str, nt: str = "nt", least: int = 20) -> DataFrame:
    """key, frame, nt_start (on the forward strand, from 0), aa: the stretches without a stop of `least` residues or more. A least of 0
    gives empty stretches between stops too."""
    ship(nucleotides.sparkSession)

    def kernel(part):
        _, data, off = part
        bases = _BASE[data]
        of, frames, starts, found = [], [], [], []
        for i, (lo, hi) in enumerate(zip(off.tolist(), off[1:].tolist())):
            size = hi - lo
            for sign, strand in ((1, bases[lo:hi]), (-1, _AGAINST[bases[lo:hi]][::-1])):
                amino = _amino(strand) if size > 2 else np.zeros(0, np.uint8)
                for shift in range(3 if size else 0):
                    aa = amino[shift::3]
                    stop = np.concatenate([[-1], np.flatnonzero(aa == ord("*")), [len(aa)]])
                    long = np.flatnonzero(np.diff(stop) - 1 >= least)
                    for begin, end in zip((stop[long] + 1).tolist(), stop[long + 1].tolist()):
                        at = shift + 3 * begin
                        of.append(i)
                        frames.append(sign * (shift + 1))
                        starts.append(at if sign > 0 else size - at - 3 * (end - begin))
                        found.append(aa[begin:end].tobytes().decode())
        yield {"of": np.array(of, np.int64), "frame": np.array(frames, np.int32), "nt_start": np.array(starts, np.int32), "aa": pa.array(found, pa.string())}

    return mapped(nucleotides, key, nt, kernel, "frame int, nt_start int, aa string")

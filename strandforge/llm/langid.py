"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 characters, lower-cased, hashed into BUCKETS) and texts for each language over all training texts; tasks count
their own rows, Spark sums the counts, and each language's log-probabilities become one row. They are broadcast as matrices of BUCKETS rows and
LANGUAGES columns, as many as there are languages for. Scoring adds up the rows of a text's n-grams and the languages' log-priors, matrix
after matrix, keeping the best language and the sum over all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, in_slices, mix, read, ship
from .toxicity import held_out

ORDERS, BUCKETS, SMOOTH = (1, 2, 3), 1 << 16, 0.5
#: Languages of one matrix, which takes 256 kB a language; more languages are more matrices.
LANGUAGES = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Block:
    """Some of the languages, in order of name: their log-priors and the broadcast matrix of their log-probabilities."""

    langs: list[str]
    prior: np.ndarray
    matrix: Broadcast


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, runs of anything but letters made one blank; each one's text; the number of letters of each text."""
    text = data.tobytes().decode()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(np.searchsorted(lead, off), np.arange(len(cp)), "right") - 1
    letter = _letters()[cp]
    low = np.where(letter, _small()[cp], 32)
    blank = ~letter
    first = np.append(True, doc[1:] != doc[:-1]) if len(cp) else np.zeros(0, bool)
    keep = letter | first | ~np.append(False, blank[:-1])[: len(cp)]
    return low[keep], doc[keep], np.bincount(doc[letter], minlength=len(off) - 1)


_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _tables["letter"]


def _small() -> np.ndarray:
    if "small" not in _tables:
        _tables["small"] = np.array([ord(s) if len(s := chr(c).lower()) == 1 else c for c in range(0x110000)], np.uint32)
    return _tables["small"]


def ngrams(cp: np.ndarray, doc: np.ndarray):
    """For each order the hashed n-grams and their texts; none crosses two texts."""
    code = cp.astype(np.uint64)
    for n in ORDERS:
        count = max(0, len(cp) - n + 1)
        h = np.full(count, np.uint64(n), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : k + count]
        same = doc[:count] == doc[n - 1 :][:count]
        yield (mix(h[same]) & np.uint64(BUCKETS - 1)).astype(np.int64), doc[:count][same]


def _vector(counts: pa.Table) -> pa.Table:
    """A language's texts and log-probabilities from its (gram, n); gram -1 is the number of its texts."""
    gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    row = np.full(BUCKETS, SMOOTH)
    row[gram[gram >= 0]] += n[gram >= 0]
    row = np.log(row / row.sum()).astype(np.float32)
    return pa.table({"lang": [counts.column("lang")[0].as_py()], "texts": [int(n[gram < 0].sum())], "row": pa.array([row.tobytes()], pa.binary())})


def fitted(docs: DataFrame, text: str = "text", lang: str = "lang", languages: int = LANGUAGES) -> list[Block]:
    """What is learned from all rows of docs with a text and a language, in blocks of so many languages; none if there is no such row."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        total: dict[str, np.ndarray] = {}  # the last place counts texts

        def told():
            for x, c in total.items():
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(np.where(some < BUCKETS, some, -1)), pa.array(c[some])], ["lang", "gram", "n"])
            total.clear()

        for part, data, off in in_slices(batches, "text"):
            cp, doc, _ = characters(data, off)
            here, of = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            if len(total) + len(here) > LANGUAGES:
                yield from told()
            for x in here:
                total.setdefault(x, np.zeros(BUCKETS + 1, np.int64))
            for k, m in enumerate(np.bincount(of)):
                total[here[k]][BUCKETS] += m
            for gram, d in ngrams(cp, doc):
                order = np.argsort(of[d], kind="stable")
                ends = np.searchsorted(of[d][order], np.arange(len(here) + 1))
                for k in range(len(here)):
                    total[here[k]][:BUCKETS] += np.bincount(gram[order[ends[k] : ends[k + 1]]], minlength=BUCKETS)
        yield from told()

    scratch = Scratch(spark)
    summed = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    vectors = scratch.save(summed.groupBy("lang").applyInArrow(_vector, "lang string, texts long, row binary"))
    known = sorted((r["lang"], r["texts"]) for r in vectors.select("lang", "texts").collect())
    texts = sum(n for _, n in known)
    blocks = []
    for at in range(0, len(known), languages):
        part = known[at : at + languages]
        held = {r["lang"]: r["row"] for r in vectors.filter(F.col("lang").between(part[0][0], part[-1][0])).collect()}
        matrix = np.stack([np.frombuffer(held[x], np.float32) for x, _ in part], axis=1)
        blocks.append(Block([x for x, _ in part], np.log([n / texts for _, n in part]), spark.sparkContext.broadcast(np.ascontiguousarray(matrix))))
    scratch.drop()
    return blocks


def _judged(block: Block, first: bool):
    """Rows with the best of the languages so far, its log-likelihood and the logarithm of the sum of all likelihoods."""

    def of(batches):
        matrix = block.matrix.value
        for rows, data, off in in_slices(batches, "text", 1 << 19):
            cp, doc, letters = characters(data, off)
            total = np.tile(block.prior, (len(letters), 1))
            for gram, d in ngrams(cp, doc):
                if len(d):
                    at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    total[d[at]] += np.add.reduceat(matrix[gram], at, dtype=np.float64)
            top = total.argmax(1)
            best = total[np.arange(len(top)), top]
            whole = best + np.log(np.exp(total - best[:, None]).sum(1))
            lang = [block.langs[k] if n else UNKNOWN for k, n in zip(top.tolist(), letters.tolist())]
            if not first:
                was, sum_was = rows.column("best").to_numpy(), rows.column("whole").to_numpy()
                lang = [new if b > w else old for new, old, b, w in zip(lang, rows.column("lang_pred").to_pylist(), best, was)]
                best, whole = np.maximum(best, was), np.logaddexp(whole, sum_was)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(lang, pa.string()), pa.array(best), pa.array(whole)], ["doc_id", "text", "lang_pred", "best", "whole"])

    return of


def languages(docs: DataFrame, model: list[Block], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the posterior, 0 to 1) of each row of docs. A text that is null or has no letter is `und` with score 0, as are
    all texts if nothing was learned; of languages that tie the first by name; rows that repeat are judged each, alike; other columns aren't read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not model:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for k, block in enumerate(model):
        rows = rows.mapInArrow(_judged(block, not k), f"doc_id {kind}, text string, lang_pred string, best double, whole double")
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.exp(F.col("best") - F.col("whole")))
    return rows.select("doc_id", "lang_pred", score.alias("score"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = languages(docs, fitted(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

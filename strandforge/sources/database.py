"""Sequence databases of several files: the data, where each entry lies, the same for headers, and a type; and what kind of input a path is.

`<db>` has each entry's text, a line break and a zero byte; `<db>.index` its key, offset and length, with those two bytes; `<db>.dbtype` four bytes;
`<db>_h` and `<db>_h.index` hold headers in the same way; `<db>.lookup` names entries and `<db>.source` files."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.residues import looks_nucleotide
from ..plans.session import Scratch, ship
from . import readers

# Types of databases, first bytes of compressed files.
AMINO, NUCLEOTIDE, GENERIC = 0, 1, 12
GZIP, PACKED = b"\x1f\x8b", {"bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
#: Entries that follow each other are read together, up to so many bytes.
TOGETHER = 4 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    system, at = _place(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def _first(path: str, n: int) -> bytes:
    system, at = _place(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read(n)


def detect(path: str) -> str:
    """`database`, `gzip` or `fasta`. A folder is taken for the parts of a FASTA file; what can't be read is an error that says why."""
    if _size(f"{path}.dbtype") is not None:
        return "database"
    system, at = _place(path)
    kind = system.get_file_info(at).type
    if kind == fs.FileType.Directory:
        return "fasta"
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path}: {path}.index exists, but {path}.dbtype is missing" if _size(f"{path}.index") is not None else f"{path}: no such file or database")
    head = _first(path, 6)
    if not head:
        raise ValueError(f"{path}: the file is empty")
    for name, magic in PACKED.items():
        if head.startswith(magic):
            raise ValueError(f"{path}: {name} isn't supported")
    return "gzip" if head.startswith(GZIP) else "fasta"


def _kind(path: str) -> int:
    head = _first(f"{path}.dbtype", 4)
    if len(head) < 4:
        raise ValueError(f"{path}.dbtype: four bytes are expected")
    raw = int.from_bytes(head, "little")
    if raw >> 31:
        raise ValueError(f"{path}: compressed databases aren't supported")
    if raw >> 16 & 0x7FFE or raw & 0xFFFF not in (AMINO, NUCLEOTIDE):
        raise ValueError(f"{path}: not a database of plain sequences")
    return raw & 0xFFFF


def _fail(wrong: Column, text: str, value: Column) -> Column:
    return F.when(wrong, F.raise_error(F.lit(text)).cast("string")).otherwise(value)


def _index(spark: SparkSession, path: str) -> DataFrame:
    """key, offset, length of a database's entries, checked: three numbers a line, no key twice, nothing beyond the data."""
    size, at = _size(path), f"{path}.index"
    if size is None:
        raise FileNotFoundError(f"{path}: no data file")
    f = F.split("value", "\t")
    bad = (F.size(f) != 3) | ~F.col("value").rlike(r"^\d{1,10}\t\d{1,18}\t\d{1,18}$")
    rows = spark.read.text(at).select(_fail(bad, f"{at}: a line isn't key, offset and length", F.col("value")).alias("value"))
    rows = rows.select(*[f[i].cast("long").alias(c) for i, c in enumerate(("key", "offset", "length"))])
    told = rows.agg(F.count("*").alias("n"), F.max("key").alias("k"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("length").alias("least")).first()
    if told["n"] and (told["k"] >= 1 << 32 or told["end"] > size or told["least"] < 1):
        raise ValueError(f"{at}: a key is too large or an entry lies beyond the {size} bytes of data")
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        raise ValueError(f"{at}: a key is there twice")
    return rows


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """key, text of each entry. Tasks read ranges of the file, in the order of offsets."""
    rows = _index(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _place(path)
        with system.open_input_file(at) as f:
            for batch in batches:
                key, off, size = (batch.column(c).to_numpy() for c in ("key", "offset", "length"))
                i = 0
                while i < len(key):
                    j, end = i + 1, off[i] + size[i]
                    while j < len(key) and off[j] >= off[i] and max(end, off[j] + size[j]) - off[i] <= TOGETHER:
                        end = max(end, off[j] + size[j])
                        j += 1
                    held = f.read_at(int(end - off[i]), int(off[i]))
                    texts = []
                    for k in range(i, j):
                        text = held[off[k] - off[i] : off[k] - off[i] + size[k]]
                        if not text.endswith(b"\0"):
                            raise ValueError(f"{path}: the entry {key[k]} doesn't end in a zero byte")
                        texts.append(text[:-1].removesuffix(b"\n").decode("utf-8", "replace"))
                    yield pa.RecordBatch.from_arrays([pa.array(key[i:j]), pa.array(texts, pa.string())], ["key", "text"])
                    i = j

    return rows.repartitionByRange("offset", "key").sortWithinPartitions("offset", "key").mapInArrow(run, "key long, text string")


def read(spark: SparkSession, path: str, nucleotide: bool | None = None) -> DataFrame:
    """key, id, header, seq of each entry; headers belong by key, and one that is missing or empty is the key. Letters are made capitals, blanks and one last
    `*` go; other characters, entries without residues and a database of the other kind than `nucleotide` asks for are errors."""
    kind = _kind(path)
    if nucleotide is not None and nucleotide != (kind == NUCLEOTIDE):
        raise ValueError(f"{path}: {'nucleotides' if nucleotide else 'proteins'} are expected")
    ship(spark)
    bare = F.regexp_replace(F.upper(F.regexp_replace("text", r"[\n\r \t]", "")), r"\*$", "")
    wrong = (bare == "") | bare.rlike(r"[^A-Z*]")
    seq = F.when(wrong, F.raise_error(F.concat(F.lit(f"{path}: not residues, entry "), F.col("key").cast("string"))).cast("string")).otherwise(bare)
    found = _entries(spark, path).select("key", seq.alias("seq"))
    named = F.lit(None).cast("string")
    if _size(f"{path}_h") is not None:
        found = found.join(_entries(spark, f"{path}_h").withColumnRenamed("text", "header"), "key", "left")
        named = F.when(F.trim("header") != "", F.col("header"))
    header = F.coalesce(named, F.col("key").cast("string"))
    return found.select("key", F.split(F.trim(header), r"\s+")[0].alias("id"), header.alias("header"), "seq")


def _before(df: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """df with the sum of each size over the rows before, in the order of __place: the sums of partitions run up, then each partition's own."""
    split = df.withColumns(sizes).withColumn("__part", F.shiftright("__place", 33))
    sums = split.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sizes])
    run, own = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("__part").orderBy("__place").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select("__part", *[F.coalesce(F.sum(f"__{c}").over(run), F.lit(0)).alias(f"__{c}") for c in sizes])
    both = split.join(F.broadcast(start), "__part")  # a row a partition
    return both.select(*df.columns, *sizes, *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"{c}_at") for c in sizes])


def write(sequences: DataFrame, order: str, path: str, header: str, nucleotide: bool = False, source: str = "input") -> int:
    """Writes sequences (header, seq), in the order of a unique column, as a database; their keys count from 0. Returns how many there are.

    Each file is one file, as the format wants it, on a file system that all machines mount. Tasks write their rows at known offsets, so a task that
    runs again writes the same. Names are given when all is written, the type's last."""
    spark = ship(sequences.sparkSession)
    scratch = Scratch(spark)
    rows = sequences.select(F.regexp_replace(F.coalesce(F.col(header).cast("string"), F.lit("")), "[\n\r\\x00]", " ").alias("header"), F.coalesce("seq", F.lit("")).alias("seq"), F.col(order).alias("__order"))
    rows = scratch.save(rows.orderBy("__order").drop("__order").withColumn("__place", F.monotonically_increasing_id()))
    size = lambda c: F.octet_length(c).cast("long")
    first = _before(rows, {"one": F.lit(1).cast("long"), "data": size("seq") + 2, "head": size("header") + 2})
    line = lambda c: F.concat_ws("\t", F.col("one_at").cast("string"), F.col(f"{c}_at").cast("string"), F.col(c).cast("string"))
    name = F.split(F.trim("header"), r"\s+")[0]
    texts = first.withColumns({"i": F.concat(line("data"), F.lit("\n")), "h": F.concat(line("head"), F.lit("\n")), "l": F.concat_ws("\t", F.col("one_at").cast("string"), name, F.lit("0\n"))})
    placed = scratch.save(_before(texts, {"index": size("i"), "hindex": size("h"), "lookup": size("l")}))
    streams = {"data": ("seq", "", b"\n\0"), "head": ("header", "_h", b"\n\0"), "index": ("i", ".index", b""), "hindex": ("h", "_h.index", b""), "lookup": ("l", ".lookup", b"")}
    ends = placed.agg(F.count("*").alias("n"), *[F.max(F.col(f"{c}_at") + F.col(c)).alias(c) for c in streams]).first()
    if ends["n"] >= 1 << 32:
        raise ValueError("keys are numbers of 32 bits")
    mark = f".{uuid.uuid4().hex}.part"
    for c, (_, suffix, _) in streams.items():
        with open(f"{path}{suffix}{mark}", "wb") as f:
            f.truncate(ends[c] or 0)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = {c: open(f"{path}{s}{mark}", "r+b") for c, (_, s, _) in streams.items()}
        for part in batches:
            for c, (text, _, end) in streams.items():
                run, to = [], None
                for at, value in zip(part[f"{c}_at"], part[text]):
                    held = value.encode() + end
                    if at != to:
                        files[c].write(b"".join(run))
                        files[c].seek(at)
                        run, to = [], at
                    run.append(held)
                    to += len(held)
                files[c].write(b"".join(run))
            yield pd.DataFrame({"n": [len(part)]})
        for f in files.values():
            f.flush()
            os.fsync(f.fileno())
            f.close()

    wrote = placed.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
    scratch.drop()
    if wrote != ends["n"]:
        raise RuntimeError(f"{path}: wrote {wrote} of {ends['n']} entries")
    if os.path.exists(f"{path}.dbtype"):
        os.remove(f"{path}.dbtype")
    for _, suffix, _ in streams.values():
        os.replace(f"{path}{suffix}{mark}", f"{path}{suffix}")
    for suffix, held in (("_h.dbtype", GENERIC.to_bytes(4, "little")), (".source", f"0\t{source}\n".encode()), (".dbtype", (NUCLEOTIDE if nucleotide else AMINO).to_bytes(4, "little"))):
        with open(f"{path}{suffix}{mark}", "wb") as f:
            f.write(held)
        os.replace(f"{path}{suffix}{mark}", f"{path}{suffix}")
    return ends["n"]


def load(spark: SparkSession, path: str, nucleotide: bool = False) -> tuple[DataFrame, list[str]]:
    """ordinal, id, header, seq of a database or FASTA file of whatever kind path is, and warnings. No sequence at all is an error, as is a database of the
    other kind; FASTA that looks like the other kind is a warning."""
    kind, warnings = detect(path), []
    if kind == "database":
        found = read(spark, path, nucleotide).withColumnRenamed("key", "ordinal")
        unnamed = found.filter("header = CAST(ordinal AS STRING)").count()
        if unnamed:
            warnings.append(f"{path}: {unnamed} entries have no header; their keys name them")
    else:
        found = readers.fasta(spark, path)
    told = found.agg(F.count("*").alias("n"), F.sum(looks_nucleotide(F.col("seq")).cast("int")).alias("looks")).first()
    if not told["n"]:
        raise ValueError(f"{path}: no sequences")
    if kind != "database" and not nucleotide and told["looks"] == told["n"]:
        warnings.append(f"{path}: the sequences look like nucleotides, proteins are expected")
    return found, warnings

"""Parity-sketch join: groups of documents whose shingle sets have a Jaccard similarity of num/den or more.

A document's distinct shingles are hashed to 64 bits. Every shingle flips one bit of a wide sketch of K blocks, so the
parity of two documents' sketches differs in no more bits than their sets' symmetric difference has members, which for
linked documents of n and m shingles is at most d = (n + m)(den - num)/(den + num).

* Size bands. Band b holds sets of 4**b to 4**(b+1)-1 shingles and fixes K; a set near the top of a band also enters the next,
  so that any two sets whose sizes allow a link meet in the larger one's band.
* Pigeonhole. d flipped bits leave all but d blocks as they were. A block is 2**64 bits wide and so kept as the XOR of its
  set positions (a bit flipped twice vanishes, as in the sketch). With all blocks in one order that both documents
  share, the first d+1 of each must have one in common. Any such order gives whole results; this one puts blocks with the most
  rare shingles first, so that a passage which thousands of documents share leads to no candidates unless it is most of a document. A
  document with too few blocks that aren't empty also emits its band's empty block. No limit is set on a block's documents.
* Frequent shingles, which the order needs, are counted over all documents as those found more than once among about WINDOW shingles of
  distinct sets; the most frequent ones, HOT at most (16 MB), are broadcast.
* Crowded blocks. A sample of the texts shows the blocks (CROWDED at most) that very many sets share; their members are dealt out under SUBS
  numbers and their aggregates merged. A crowded block that the sample misses is sorted in one task, with the same result.
* Buckets of the same members are one: documents that share a passage share many blocks.
* Stars, then the rest. In a block's bucket every set is held against the smallest, the largest and a drawn one, which settles
  buckets of three and nearly all of groups of copies: sets of one component need no more comparison. Buckets of several components get TURNS turns
  of more stars, all of a turn at once. What is left, sets of different
  components that share a bucket and weren't compared, is compared in full. So no link between components is lost, and groups of
  copies need a few comparisons a member. Equal sets are one node from the start.
* Verify. Narrow sketches (4 to 1 bits a shingle; in the last comparison 16 to 4) drop pairs whose Hamming distance is over d; what stays is counted exactly,
  from texts that a bitmap of bounded size (16 MB) picks before they are shuffled.

A set's identity is a 64-bit digest of its members, a shingle's a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import GOLD, Scratch, cut, in_slices, mix, read, ship, slice_hashes

WORDS, NUM, DEN = 5, 75, 100
WIDE = 16
#: One text in SAMPLE shows crowded blocks: those with LEAST_CROWDED of its sets and 1/CROWDED of its rows.
SAMPLE, LEAST_CROWDED, CROWDED, SUBS = 64, 16, 4096, 64
#: The drawn set of a bucket is the one nearest to this number.
DRAW = 0x5DEECE66D1A4B3C7
#: Turns of further stars for buckets of several components, and drawn sets of each.
TURNS, DRAWS = 2, 3
#: Digests of sets that a task remembers, to emit equal sets once.
REMEMBER = 1 << 18
HOT, LEAST_HOT, WINDOW = 2_000_000, 4, 1 << 20
#: Bits of the bitmap of documents whose sets are needed.
PICK_BITS = 1 << 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EDGES = 4 ** np.arange(1, 32, dtype=np.int64).clip(max=30)


def word_bounds(sep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs of bytes that aren't separators; a run never crosses two texts."""
    n = len(sep)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = sep[:-1], sep[1:]
    start = np.flatnonzero(~sep & (before | first[:n]))
    end = np.flatnonzero(~sep & (after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' distinct k-word shingles as (text, hash), sorted, and the size of each set."""
    texts = len(off) - 1
    data = _LOWER[data]
    start, end, doc = word_bounds(_SPACE[data], off)
    word = slice_hashes(data, start, end)
    count = np.bincount(doc, minlength=texts)
    at = np.cumsum(count) - count
    docs, hashes = [], []
    for size in range(1, k + 1):
        if size < k:
            here = at[count == size]
        else:
            here = np.arange(max(0, len(word) - k + 1))
            here = here[doc[here] == doc[here + k - 1]]
        h = np.full(len(here), np.uint64(size), np.uint64)
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[here + j]
        docs.append(doc[here])
        hashes.append(mix(h))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    d, h = d[new], h[new]
    return d, h, np.bincount(d, minlength=texts)


def digests(d: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A digest of each set; 0 for an empty one."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        total, parity = np.add.reduceat(mix(h), at), np.bitwise_xor.reduceat(h, at)
        out[some] = mix(mix(total + GOLD) ^ mix(parity ^ n[some].astype(np.uint64)) * np.uint64(3))
    return out.view(np.int64)


def bands(n: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(takes part, band, most flipped bits) of each set, once for its own band and once for the next."""
    own = np.searchsorted(_EDGES, n, "right")
    upper = _EDGES[own]
    most = n * den // num
    yield n > 0, own, (n + np.minimum(most, upper - 1)) * (den - num) // (den + num)
    yield (n > 0) & (most >= upper), own + 1, (n + most) * (den - num) // (den + num)


def block_keys(d: np.ndarray, h: np.ndarray, n: np.ndarray, num: int, den: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the blocks by which a set looks for partners. hot: the frequent shingles, sorted."""
    docs, keys = [], []
    scarce = np.ones(len(h), np.int64)
    if len(hot):
        scarce[hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h] = 0
    for part, band, most in bands(n, num, den):
        rows = part[d]
        dd, hh, rare = d[rows], h[rows], scarce[rows]
        if not len(dd):
            continue
        blocks = np.maximum(64, 5 * 4 ** band[dd] // 2).astype(np.uint64)
        block = ((hh >> np.uint64(32)) * blocks) >> np.uint64(32)  # the hashes are sorted, so a block's stand together
        new = np.ones(len(dd), bool)
        new[1:] = (dd[1:] != dd[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        parity, full, of = np.bitwise_xor.reduceat(mix(hh + GOLD), at), np.diff(at, append=len(dd)), dd[at]
        salt = mix(band[of].astype(np.uint64) + np.uint64(1))
        key = mix(parity ^ mix(block[at] + salt))
        order = np.lexsort((key, -full, -np.add.reduceat(rare, at), of))
        of, key = of[order], key[order]
        held = np.bincount(of, minlength=len(n))
        rank = np.arange(len(of)) - np.repeat((np.cumsum(held) - held)[held > 0], held[held > 0])
        take = rank <= most[of]
        docs.append(of[take])
        keys.append(key[take])
        few = np.flatnonzero(part & (held <= most))
        docs.append(few)
        keys.append(mix(band[few].astype(np.uint64) * GOLD + np.uint64(77)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def narrow(h: np.ndarray, band: int, scale: int = 4) -> list[int]:
    """The parity sketch of scale * 4**band bits, as 64-bit words."""
    bits = max(64, scale * 4**band)
    at = ((mix(h ^ GOLD) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


NODE = "n long, sid long, band int, own array<long>, next array<long>, often array<struct<h: long, c: long>>"


def _nodes(k: int, num: int, den: int):
    ints = pa.list_(pa.int64())
    often = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))

    def tally(held: list[np.ndarray]) -> list[dict]:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return [{"h": int(x), "c": int(y)} for x, y in zip(h[c > 1].view(np.int64), c[c > 1])]

    def of(batches):
        held: list[np.ndarray] = []
        within: set[int] = set()
        kind = None
        for rows, data, off in in_slices(batches, "text"):
            kind = rows.column("doc_id").type
            d, h, n = shingle_sets(data, off, k)
            sid, at = digests(d, h, n), np.append(0, np.cumsum(n))
            band, more = np.searchsorted(_EDGES, n, "right"), np.zeros(len(n), bool)
            for part, _, _ in list(bands(n, num, den))[1:]:
                more = part
            own, further = [], []
            for i, x in enumerate(sid.tolist()):
                mine = h[at[i] : at[i + 1]]
                own.append(narrow(mine, int(band[i])) if n[i] else None)
                further.append(narrow(mine, int(band[i]) + 1) if more[i] else None)
                if n[i] and x not in within:
                    within.add(x)
                    held.append(mine)
            seen: list = [None] * len(n)
            if sum(map(len, held)) > WINDOW:
                seen[0] = tally(held)
                held, within = [], set()
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n), pa.array(sid), pa.array(band.astype(np.int32)), pa.array(own, ints), pa.array(further, ints), pa.array(seen, often)],
                ["doc_id", "n", "sid", "band", "own", "next", "often"],
            )
        if held:  # a row without a document carries the last tally
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.array([-1]), pa.array([0]), pa.array([0], pa.int32()), pa.array([None], ints), pa.array([None], ints), pa.array([tally(held)], often)],
                ["doc_id", "n", "sid", "band", "own", "next", "often"],
            )

    return of


def _keys(k: int, num: int, den: int, hot, crowded: np.ndarray):
    """key, sub, sid: the blocks by which each distinct set looks for partners; sub is 0 but for crowded blocks (sorted keys)."""

    def of(batches):
        seen: set[int] = set()
        for _, data, off in in_slices(batches, "text"):
            d, h, n = shingle_sets(data, off, k)
            sid = digests(d, h, n)
            fresh = np.ones(len(n), bool)
            for i, x in enumerate(sid.tolist()):
                if x in seen:
                    fresh[i] = False
                else:
                    seen.add(x)
            if len(seen) > REMEMBER:
                seen.clear()
            if not fresh.all():
                here = fresh[d]
                d, h, n = d[here], h[here], np.where(fresh, n, 0)
            doc, key = block_keys(d, h, n, num, den, hot.value)
            whose, sub = sid[doc], np.zeros(len(doc), np.int32)
            if len(crowded):
                many = crowded[np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)] == key
                sub[many] = whose[many] % SUBS + 1
            for at in range(0, len(doc), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(sub[part]), pa.array(whose[part])], ["key", "sub", "sid"])

    return of


def _sets(k: int):
    def of(batches):
        for _, data, off in in_slices(batches, "text"):
            d, h, n = shingle_sets(data, off, k)
            ends = np.append(0, np.cumsum(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(digests(d, h, n)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["sid", "members"])

    return of


def _sketches(k: int, num: int, den: int, scale: int):
    ints = pa.list_(pa.int64())

    def of(batches):
        for _, data, off in in_slices(batches, "text"):
            d, h, n = shingle_sets(data, off, k)
            at, band = np.append(0, np.cumsum(n)), np.searchsorted(_EDGES, n, "right")
            more = list(bands(n, num, den))[1][0]
            sets = [h[at[i] : at[i + 1]] for i in range(len(n))]
            own = [narrow(x, int(b), scale) if len(x) else None for x, b in zip(sets, band)]
            further = [narrow(x, int(b) + 1, scale) if m else None for x, b, m in zip(sets, band, more)]
            yield pa.RecordBatch.from_arrays([pa.array(digests(d, h, n)), pa.array(n), pa.array(band.astype(np.int32)), pa.array(own, ints), pa.array(further, ints)], ["sid", "n", "band", "own", "next"])

    return of


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids. A bitmap drops nearly all others before the join shuffles texts."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(PICK_BITS))
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("map", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    likely = docs.join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col("bucket")).filter(F.getbit(byte, (place % 8).cast("int")) == 1)
    return likely.select(docs.columns).join(ids, "doc_id", "left_semi")


#: How often edges are hooked before their labels are found.
HOOKS = 3


def hooked(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same ends, fewer of them: all smaller neighbours of an end, and the end itself, are tied to the smallest one
    of these alone. So members that share their stars keep an edge each, and the stars' own edges are few."""
    least = F.min("a").over(W.partitionBy("b"))
    tied = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").select("a", "b", least.alias("m"))
    return tied.select("m", F.explode(F.array("a", "b")).alias("b")).filter("m != b").select(F.col("m").alias("a"), "b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, comp) for each end of edges (a, b): comp is the smallest v that can be reached.

    The edges are hooked first, so that what follows grows with the ends and not with the edges between them. Every round takes the least label among neighbours and then that label's own label, so paths halve. Labels only
    fall, so a round that leaves their sum as it was is the last."""
    edges = edges.filter("a != b")
    for _ in range(HOOKS):
        edges = hooked(edges)
    both = scratch.save(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct())
    labels, was = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("comp")), None
    labels = scratch.save(labels)
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "comp"), "w").select("v", "comp").union(labels).groupBy("v").agg(F.min("comp").alias("comp"))
        jump = near.select(F.col("v").alias("comp"), F.col("comp").alias("far"))
        seen = Observation()
        after = near.join(jump, "comp", "left").select("v", F.coalesce("far", "comp").alias("comp"))
        labels = scratch.save(after.observe(seen, F.sum(F.col("comp").cast("decimal(38)")).alias("total")))
        total = seen.get["total"]
        if total == was:
            return labels
        was = total


def _side(reps: DataFrame, x: str) -> DataFrame:
    return reps.select(F.col("sid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "band", "own", "next")])


def _close(num: int, den: int, a: str = "a", b: str = "b") -> Column:
    """Whether the sizes and the narrow sketches of two sides allow a link."""
    top = F.greatest(f"band_{a}", f"band_{b}")
    words = [F.when(F.col(f"band_{x}") == top, F.col(f"own_{x}")).otherwise(F.col(f"next_{x}")) for x in (a, b)]
    apart = F.aggregate(F.zip_with(*words, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (n * num <= m * den) & (m * num <= n * den) & (apart * (den + num) <= (n + m) * (den - num))


def _verified(close: DataFrame, docs: DataFrame, reps: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, their members counted."""
    needed = close.select(F.col("a").alias("sid")).union(close.select("b")).distinct()
    ids = scratch.save(reps.join(needed, "sid", "left_semi").select("doc_id"))
    sets = scratch.save(_picked(docs, ids).select("text").mapInArrow(_sets(k), "sid long, members array<long>"))
    for x in "ab":
        close = close.join(sets.select(F.col("sid").alias(x), F.col("members").alias(f"members_{x}")), x)
    shared, total = F.size(F.array_intersect("members_a", "members_b")), F.size("members_a") + F.size("members_b")
    return scratch.save(close.filter(shared * den >= (total - shared) * num).select("a", "b").distinct())


def _drawn(turn: int, j: int) -> int:
    """The number that a turn's j-th drawn set is nearest to."""
    return DRAW * (2 * (turn * DRAWS + j) + 3) & (1 << 63) - 1


def _pair(p: str, q: str) -> list:
    return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b")]


def _packed(column: str):
    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(column).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["packed"])

    return of


def _longs(df: DataFrame, column: str) -> np.ndarray:
    """A column of 64-bit numbers, sorted, sent to the driver as blocks of bytes."""
    blocks = df.select(column).mapInArrow(_packed(column), "packed binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["packed"], np.int64) for r in blocks]]))


def _frequent(nodes: DataFrame, scratch: Scratch) -> np.ndarray:
    """The hashes of the most frequent shingles, HOT at most."""
    often = scratch.save(nodes.select(F.explode("often").alias("x")).groupBy("x.h").agg(F.sum("x.c").alias("c")).filter(F.col("c") >= LEAST_HOT))
    octave = F.floor(F.log2("c") * 8) / 8
    room, least = HOT, float("inf")
    for r in often.groupBy(octave.alias("octave")).agg(F.count("*").alias("k")).orderBy(F.desc("octave")).collect():  # a few hundred rows at most
        if (room := room - r["k"]) < 0:
            break
        least = r["octave"]
    return np.sort(_longs(often.filter(octave >= least), "h").view(np.uint64))


def _buckets(raw: DataFrame, k: int, num: int, den: int, hot, scratch: Scratch) -> DataFrame:
    """key, sid, m, centre, last, drawn: the members of each bucket of two sets or more, with its size and three of its members."""
    kind = "key long, sub int, sid long"
    some = raw.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_keys(k, num, den, hot, np.zeros(0, np.int64)), kind)
    tally = scratch.save(some.groupBy("key").agg(F.count("*").alias("m")))
    rows = tally.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    crowded = _longs(tally.filter(F.col("m") >= max(LEAST_CROWDED, rows // CROWDED)), "key")
    facts = [F.min("sid").alias("centre"), F.max("sid").alias("last"), F.min(F.col("sid").bitwiseXOR(F.lit(DRAW))).alias("near"), F.count("sid").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("parity")]
    by_key = W.partitionBy("key", "sub")
    told = raw.select("text").mapInArrow(_keys(k, num, den, hot, crowded), kind)
    told = told.select("*", *[F.max("sid").over(by_key).alias("last"), F.min("sid").over(by_key).alias("centre"), F.min(F.col("sid").bitwiseXOR(F.lit(DRAW))).over(by_key).alias("near"), F.count("sid").over(by_key).alias("m"), F.bit_xor(F.xxhash64("sid")).over(by_key).alias("parity")])
    told = told.filter("sub > 0 OR centre != last").select("key", "sub", "sid", "centre", "last", "near", "m", "parity")
    if len(crowded):
        told = scratch.save(told)
        many = told.filter("sub > 0").select("key", "sid")
        merged = many.groupBy("key").agg(*facts)  # a row for each crowded block
        told = told.filter("sub = 0").drop("sub").union(many.join(F.broadcast(merged), "key").filter("centre != last").select("key", "sid", "centre", "last", "near", "m", "parity"))
    same = F.xxhash64("m", "parity").alias("key")
    return scratch.save(told.select(same, "sid", "m", "centre", "last", F.col("near").bitwiseXOR(F.lit(DRAW)).alias("drawn")).distinct())


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased. With fewer than k words the whole sequence is one
    shingle. Null, empty and blank texts have no shingles and link with nothing. A set that only rows with a null doc_id have links with nothing but
    itself, and its component_id is null. Other columns aren't read."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark)
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nodes = scratch.save(raw.mapInArrow(_nodes(k, num, den), f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, {NODE}"))
    hot = spark.sparkContext.broadcast(_frequent(nodes, scratch))
    buckets = _buckets(raw, k, num, den, hot, scratch)
    hot.unpersist()
    alone = F.struct(F.col("doc_id").isNull(), "doc_id", "n", "band", "own", "next")
    reps = nodes.filter("n > 0").join(buckets.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min(alone).alias("r"))
    reps = scratch.save(reps.select("sid", "r.doc_id", "r.n", "r.band", "r.own", "r.next"))

    def links(pairs: DataFrame) -> DataFrame:
        close = scratch.save(pairs.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b").filter(_close(num, den)).select("a", "b"))
        return _verified(close, raw, reps, scratch, k, num, den)

    stars = buckets.select("sid", F.explode(F.array_distinct(F.array("centre", "last", "drawn"))).alias("star")).filter("sid != star")
    edges = links(stars.select(*_pair("sid", "star")).distinct())
    labels, known = components(edges, scratch), buckets.filter("m > 3")
    for turn in range(TURNS + 1):
        placed = scratch.save(known.join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid")))
        draws = [F.min(F.col("sid").bitwiseXOR(F.lit(_drawn(turn, j)))).bitwiseXOR(F.lit(_drawn(turn, j))) for j in range(DRAWS)]
        # one more from the component that comes last: draws from all of a bucket are mostly of its largest one
        stars = F.array_distinct(F.array(*draws, F.max(F.struct("comp", "sid"))["sid"])).alias("stars")
        split = scratch.save(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), stars).filter("low != high").select("key", "stars"))
        if turn == TURNS or split.isEmpty():
            break
        pairs = placed.join(split, "key").select("sid", "comp", F.explode("stars").alias("star"))
        pairs = pairs.join(labels.select(F.col("v").alias("star"), F.col("comp").alias("other")), "star", "left").filter(F.col("comp") != F.coalesce("other", "star"))
        found = links(pairs.select(*_pair("sid", "star")).distinct())
        if found.isEmpty():
            break
        edges = edges.union(found)
        labels = components(edges, scratch)
    rest = placed.filter("sid != centre AND sid != last AND sid != drawn").join(split.select("key"), "key", "left_semi").select("key", "sid", "comp")
    rest = scratch.save(rest)
    ids = scratch.save(reps.join(rest.select("sid").distinct(), "sid", "left_semi").select("doc_id"))
    wide = scratch.save(_picked(raw, ids).select("text").mapInArrow(_sketches(k, num, den, WIDE), "sid long, n long, band int, own array<long>, next array<long>"))
    p, q = (rest.select("key", F.col("sid").alias(x), F.col("comp").alias(f"comp_{x}")).join(_side(wide, x), x) for x in "ab")
    close = scratch.save(p.join(q, "key").filter("a < b AND comp_a != comp_b").filter(_close(num, den)).select("a", "b").distinct())
    found = _verified(close, raw, reps, scratch, k, num, den)
    if not found.isEmpty():
        labels = components(edges.union(found), scratch)
    placed = nodes.filter("n >= 0").join(labels.withColumnRenamed("v", "sid"), "sid", "left").select("doc_id", "n", F.coalesce("comp", "sid").alias("comp"))
    placed = cut(placed)
    scratch.drop()
    first = placed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(first, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one row of each group does: of the smallest doc_id, a null one after all others; of rows that repeat
    it, one. Rows without words stay. Rows are told apart by a number of their own that is saved with them, so ids may repeat or be null."""
    scratch, number = Scratch(ship(docs.sparkSession)), "__row"
    while number in docs.columns:
        number += "_"
    rows = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()))
    ids = rows.select(F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("id"), F.col(number).alias("row")).alias("id"), F.col(text).alias("text"))
    drop = cut(jaccard_groups(ids, "id").filter("doc_id != component_id").select(F.col("doc_id.row").alias(number)))
    return rows.join(drop, number, "left_anti").select(docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))

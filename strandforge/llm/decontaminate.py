"""Benchmark decontamination with DataFrame functions only.

The benchmark's n-word windows become a hash set, buckets of (digests; words, items), which Spark hands to all tasks with the plan. Every
document is cut into words once; each of its windows is digested, looked up in its bucket, and a hit is compared word by word with the bucket's windows. All
this happens within the document's row, so no window becomes a row and no document is shuffled or joined. A set of more than
MOST_BYTES is used in parts of about that size, one pass over the documents each, with the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cut, read

N = 10
#: Bytes of windows that one pass hands to all tasks (the driver sees them once).
MOST_BYTES = 32 << 20

#: What separates words: every ASCII character but digits and letters.
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null. lower() does the same on pure ASCII and is faster."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, _NOT_WORD), lambda w: w != "")


def windows(items: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """The distinct windows of the items: size, digest, words, items (the ids, sorted, of all items that have it)."""
    cut_up = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    sized = cut_up.withColumn("size", F.least(F.size("w"), F.lit(n)))
    each = sized.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("words"))
    return each.groupBy("size", "words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("digest", F.xxhash64("words"))


def _set(part: DataFrame, buckets: int) -> DataFrame:
    """One row with the hash set of these windows: d, the digests of each bucket, and e, its (words, items)."""
    held = part.groupBy(F.pmod("digest", F.lit(buckets)).alias("b")).agg(F.collect_list("digest").alias("d"), F.collect_list(F.struct("words", "items")).alias("e"))
    all_of = part.sparkSession.range(buckets).join(held, F.col("id") == F.col("b"), "left").agg(F.array_sort(F.collect_list(F.struct("id", "d", "e"))).alias("s"))
    return all_of.select(F.struct(F.transform("s", lambda x: x["d"]).alias("d"), F.transform("s", lambda x: x["e"]).alias("e")).alias("set"))


def _hits_in(held: Column, sizes: list[int], buckets: int) -> Column:
    """(at, size, items) of the windows of column w, from place 1, that the set has."""
    bucket = lambda of, d: F.get(of, F.pmod(d, F.lit(buckets)).cast("int"))

    def of_size(z: Column, size: int) -> Column:
        window = lambda i: F.slice("w", i, size)
        last = F.size("w") - (size - 1)
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        likely = F.filter(places, lambda i: F.exists(F.array(F.xxhash64(window(i))), lambda d: F.array_contains(bucket(z["d"], d), d)))
        same = lambda i: F.filter(bucket(z["e"], F.xxhash64(window(i))), lambda x: x["words"] == window(i))
        found = F.transform(likely, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.flatten(F.transform(same(i), lambda x: x["items"])).alias("items")))
        return F.filter(found, lambda x: F.size(x["items"]) > 0)

    # the set is bound once: a plan that named it twice would copy it into every row
    return F.get(F.transform(F.array(held), lambda z: F.concat(*[of_size(z, s) for s in sizes])), F.lit(0))


def marked(docs: DataFrame, items: DataFrame, n: int, text: str, item_id: str, item_text: str, most: int) -> DataFrame:
    """docs with w, the words of each row, and found, the places where windows of items occur."""
    win = cut(windows(items, n, item_id, item_text))
    sizes = sorted(r["size"] for r in win.select("size").distinct().collect())  # n values at most
    none = F.array().cast(f"array<struct<at:int,size:int,items:{win.schema['items'].dataType.simpleString()}>>")
    # filters stay above this one (a row's number isn't known before), else the words would be made anew for each window
    rows = docs.select("*", words(F.col(text)).alias("w"), F.monotonically_increasing_id().alias("here")).filter("here >= 0").drop("here")
    if not sizes:
        return rows.withColumn("found", none)
    count, size = win.agg(F.count("*"), F.sum(16 + F.octet_length(F.array_join("words", " ")) + 16 * F.size("items"))).first()
    parts = -(-size // most)
    buckets = 1 << max(0, count // parts).bit_length()
    for k in range(parts):
        part = win.filter(F.pmod(F.shiftright("digest", 32), F.lit(parts)) == k)
        found = _hits_in(F.col("set"), sizes, buckets)
        rows = rows.select("*", _set(part, buckets).scalar().alias("set")).withColumn("now", found).drop("set")
        rows = rows.withColumn("found", F.concat("found", "now") if k else F.col("now")).drop("now")
        if parts > 1:
            rows = Scratch(docs.sparkSession).save(rows)
    return rows


def hits(docs: DataFrame, items: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, text, n_words, n_hit (words inside windows that occur), items (ids of the items whose
    windows occur, sorted as strings), covered (the places of the hit words, from 1).

    An item of fewer than n words, but not none, is one window. Items and documents that are null or have no words give no
    hits; rows that repeat a doc_id, or have none, are rows of their own. Only the named columns are read, so other names can't clash."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = marked(plain, items, n, "text", item_id, item_text, most)
    covered = F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    ids = F.aggregate("found", F.array().cast("array<string>"), lambda s, x: F.array_union(s, F.transform(x["items"], lambda y: y.cast("string"))))
    return rows.select("doc_id", "text", F.size("w").alias("n_words"), covered.alias("covered"), F.array_sort(ids).alias("items")).withColumn("n_hit", F.size("covered"))


def clean_documents(docs: DataFrame, items: DataFrame, n: int = N, text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs. Each row is judged by itself, so ids don't matter."""
    held = docs.select(F.struct("*").alias("whole"), F.col(text).alias("text"))
    rows = marked(held, items, n, "text", "item_id", "text", most)
    return rows.filter(F.size("found") == 0).select("whole.*")


def without_spans(docs: DataFrame, items: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text of each row of docs, every hit word and what separates it from the next word removed."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = hits(docs, items, n, doc_id, text)
    gaps = F.split("text", word, -1)
    own = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    kept = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: ~F.array_contains("covered", i))
    pieces = F.transform(kept, lambda i: F.concat(F.element_at("w", i), F.element_at("gaps", i + 1)))
    cleaned = F.concat(F.element_at("gaps", 1), F.array_join(pieces, ""))
    return found.withColumn("w", own).withColumn("gaps", gaps).select("doc_id", F.when(F.col("n_hit") > 0, cleaned).otherwise(F.col("text")).alias("text"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
dw AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM b), LATERAL (SELECT unnest(range(1, greatest(len(w) - size + 2, 1))) AS i)),
h AS (SELECT r, i, size, item_id FROM dw JOIN bw USING (size, win)),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

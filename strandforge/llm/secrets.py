"""Secret scans: patterns, then linking of what only counts together, with DataFrame functions only.

Strong spans (assignments, access identifiers, long hexadecimal strings) are reported by themselves. A weak secret
(a long string of mixed characters) or an endpoint alone is mostly noise: an interval join over scopes of SCOPE code points reports a weak
secret only if an access identifier begins within the scope, and an endpoint only if an access identifier and some secret do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cut, read
from .spans import spans

SCOPE = 400
KINDS = ("assign", "access", "hex", "secret", "endpoint")

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of 20 characters or more
HEX = r"[0-9a-f]{24,}"
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{32,128}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|s3|ftp|jdbc:[a-z]+|redis|mongodb|amqp)://[^\s\x22'<>]+"


def base_spans(text: Column) -> Column:
    """The strong spans. A match that is too short is dropped, but what it covers isn't searched again."""
    assign = F.filter(spans(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= 6)
    return F.concat(assign, spans(text, ACCESS, "access"), spans(text, HEX, "hex"))


def _order(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))


def _said(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(found, _order))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: doc_id, base (strong spans) and linked (weak ones that complementary parts confirm).

    Null text is empty. Rows that repeat a doc_id are rows of their own; other columns aren't read."""
    scratch = Scratch(docs.sparkSession)
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("row", F.monotonically_increasing_id())
    weak = F.when(F.col("t").contains("AKIA"), F.concat(spans(F.col("t"), WEAK, "secret"), spans(F.col("t"), ENDPOINT, "endpoint"))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    scanned = scratch.save(raw.select("row", "doc_id", bare(base_spans(F.col("t"))).alias("base"), bare(weak).alias("weak")))

    scoped = lambda c: F.floor(F.col(c) / scope)
    parts = scanned.select("row", F.explode("base").alias("s")).select("row", F.col("s.kind").alias("part"), F.col("s.start").alias("at"))
    parts = parts.withColumn("scope", scoped("at"))
    ids = parts.filter("part = 'access'")
    loose = scanned.select("row", F.explode("weak").alias("s")).select("row", "s.*").withColumn("here", scoped("start"))
    loose = loose.withColumn("scope", F.explode(F.array(F.col("here") - 1, F.col("here"), F.col("here") + 1)))
    near = (F.col("x.row") == F.col("y.row")) & (F.col("x.scope") == F.col("y.scope")) & (F.abs(F.col("x.start") - F.col("y.at")) <= scope)
    drop = ("here", "scope")
    secret = loose.filter("kind = 'secret'").alias("x").join(ids.alias("y"), near, "left_semi").drop(*drop).dropDuplicates(["row", "start", "end"])
    others = parts.filter("part != 'access'").select("row", "at", "scope").union(secret.select("row", F.col("start").alias("at"), F.floor(F.col("start") / scope)))
    by_id = loose.filter("kind = 'endpoint'").alias("x").join(ids.alias("y"), near, "left_semi").drop(*drop).dropDuplicates(["row", "start", "end"])
    by_id = by_id.withColumn("here", scoped("start")).withColumn("scope", F.explode(F.array(F.col("here") - 1, F.col("here"), F.col("here") + 1)))
    endpoint = by_id.alias("x").join(others.alias("y"), near, "left_semi").drop(*drop).dropDuplicates(["row", "start", "end"])
    linked = cut(secret.union(endpoint).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked")))
    out = cut(scanned.select("row", "doc_id", "base").join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("linked")))
    scratch.drop()
    return out


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _said(F.concat("base", "linked")).alias("spans"),
    )

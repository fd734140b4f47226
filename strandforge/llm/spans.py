"""Where patterns match, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """(kind, start, end, value) of the leftmost non-overlapping matches, in code points, end exclusive; value is a group's text.

    A text is its gaps (split) and its matches in turn, so a match starts after all gaps and matches before it. Texts without
    a match cost one search."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    each = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("size"), value.alias("value"))
    none = F.array().cast(SPAN)

    def add(s, x):
        start = s["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.when(x["size"].isNull(), s).otherwise(F.struct((start + x["size"]).alias("at"), F.array_append(s["out"], span).alias("out")))

    walked = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"])
    return F.when(text.rlike(pattern), walked).otherwise(none)

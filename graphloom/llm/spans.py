"""Matches of patterns in whole texts with their positions, by SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTEXT = 32  # characters kept on both sides of a match


@dataclass(frozen=True)
class Generator:
    """A kind of match: its pattern, and a cheaper condition on the text without which there is no match."""

    kind: str
    pattern: str
    needs: str | None = None  # a plain string that the text holds
    like: str | None = None  # a regular expression that it matches
    lead: str | None = None  # the start of the pattern, which stands before the value and isn't part of it


def _matches(text: Column, g: Generator) -> Column:
    def each(m: Column) -> Column:
        before, after = (lambda i: F.get(m["parts"], i)), (lambda i: F.get(m["parts"], i + 1))
        lead = lambda v: F.regexp_extract(v, "^(?:" + g.lead + ")", 0) if g.lead else F.lit("")

        def fields(v: Column, i: Column, start: Column) -> Column:
            value = F.substr(v, F.length(start) + 1) if g.lead else v
            context = F.right(F.concat(F.right(before(i), F.lit(CONTEXT)), start), F.lit(CONTEXT)) if g.lead else F.right(before(i), F.lit(CONTEXT))
            return F.struct(F.lit(g.kind).alias("kind"), i.alias("i"), (F.length(before(i)) + F.length(start)).alias("gap"), value.alias("value"), context.alias("before"), F.left(after(i), F.lit(CONTEXT)).alias("after"))

        return F.transform(m["values"], lambda v, i: fields(v, i, lead(v)))

    pattern = (g.lead or "") + g.pattern
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("parts"))
    whole = F.transform(F.array(both), each)  # so that the text is split once and not for each match
    there = F.lit(True)
    if g.needs:
        there &= F.contains(text, F.lit(g.needs))
    if g.like:
        there &= text.rlike(g.like)
    return F.when(there, F.flatten(whole)).otherwise(F.array())


def matched(docs: DataFrame, generators: list[Generator], text: str = "text") -> DataFrame:
    """docs without its text, with an array found: all matches of each generator from left to right, none inside another of its kind."""
    found = F.concat(*(_matches(F.coalesce(F.col(text), F.lit("")), g) for g in generators))
    return docs.withColumn("found", found).drop(text)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """One row per match of rows (key, ..., found): the other columns, kind, start, end, value, before, after; in code points, end exclusive."""
    each = rows.withColumn("m", F.explode("found")).select(*(c for c in rows.columns if c != "found"), "m.*")
    end = F.sum(F.col("gap") + F.length("value")).over(W.partitionBy(key, "kind").orderBy("i"))
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("gap", "i")

"""Named relations as tests of a nine-character DE-9IM matrix and the dimensions of both geometries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("contains", "coveredby", "covers", "crosses", "equals", "intersects", "overlaps", "touches", "within")


def _cell(im: Column, i: int) -> Column:
    return F.substring(im, i + 1, 1)


def relations(im: Column, ds: Column, dt: Column) -> dict[str, Column]:
    """The nine relations and disjoint; ds and dt are the dimensions of source and target."""
    full = lambda i: _cell(im, i) != "F"
    disjoint = im.rlike("^FF.FF")
    met = ~disjoint
    crosses = F.when(ds < dt, full(0) & full(2)).when(ds > dt, full(0) & full(6)).when((ds == 1) & (dt == 1), _cell(im, 0) == "0").otherwise(False)
    inner = F.when(ds == 1, _cell(im, 0) == "1").otherwise(full(0))
    return {
        "contains": im.rlike("^[012].....FF.$"),
        "coveredby": met & im.rlike("^..F..F...$"),
        "covers": met & im.rlike("^......FF.$"),
        "crosses": crosses,
        "equals": (ds == dt) & im.rlike("^[012].F..FFF.$"),
        "intersects": met,
        "overlaps": (ds == dt) & inner & full(2) & full(6),
        "touches": ~((ds == 0) & (dt == 0)) & (_cell(im, 0) == "F") & (full(1) | full(3) | full(4)),
        "within": im.rlike("^[012].F..F...$"),
        "disjoint": disjoint,
    }


def named(im: str, ds: int, dt: int) -> dict[str, bool]:
    """`relations` of one matrix, without Spark."""
    full = [c != "F" for c in im]
    fits = lambda pattern: re.search(pattern, im) is not None
    met = not fits("^FF.FF")
    crosses = full[0] and full[2] if ds < dt else full[0] and full[6] if ds > dt else ds == dt == 1 and im[0] == "0"
    return {
        "contains": fits("^[012].....FF.$"),
        "coveredby": met and fits("^..F..F...$"),
        "covers": met and fits("^......FF.$"),
        "crosses": crosses,
        "equals": ds == dt and fits("^[012].F..FFF.$"),
        "intersects": met,
        "overlaps": ds == dt and (im[0] == "1" if ds == 1 else full[0]) and full[2] and full[6],
        "touches": not ds == dt == 0 and not full[0] and (full[1] or full[3] or full[4]),
        "within": fits("^[012].F..F...$"),
        "disjoint": not met,
    }


def with_relations(pairs: DataFrame) -> DataFrame:
    """`pairs` (im, s_dim, t_dim) with a boolean column for each of the nine relations."""
    found = relations(F.col("im"), F.col("s_dim"), F.col("t_dim"))
    return pairs.withColumns({n: found[n] for n in NAMES})


def holds(relation: str, im: Column, ds: Column, dt: Column) -> Column:
    found = relations(im, ds, dt)
    return found["intersects"] if relation == "DE9IM" else found[relation]


def counts(pairs: DataFrame) -> DataFrame:
    """One row: how many pairs have each relation, how many were verified, how many have any."""
    ready = with_relations(pairs)
    out = [F.count_if(n).alias(n) for n in NAMES]
    return ready.agg(*out, F.count("*").alias("verifications"), F.count_if("intersects").alias("qualified_pairs"))


def total_relations(counted: DataFrame) -> DataFrame:
    return counted.select("*", sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0])).alias("total_relations"))

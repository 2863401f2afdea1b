"""Decomposition and finer envelopes as DataFrame operations; the kernel runs on Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import envelope as E

ENVELOPE = "struct<minx:double,miny:double,maxx:double,maxy:double>"


def _mapped(df: DataFrame, name: str, kind: str, work) -> DataFrame:
    @F.pandas_udf(kind)
    def run(raw):
        import pandas as pd

        from ..functions import geometry as G

        return pd.Series([None if r is None else work(G, G.from_wkb(bytes(r))) for r in raw])

    return df.withColumn(name, run("wkb"))


def with_segments(df: DataFrame, t: E.Theta, how: str = "grid") -> DataFrame:
    """`df` with `segments`: WKB of the parts of each geometry, none larger than a tile."""
    x, y = t.x, t.y
    return _mapped(df, "segments", "array<binary>", lambda G, g: [G.to_wkb(p) for p in G.decompose(g, x, y, how)])


def with_fine_envelopes(df: DataFrame, t: E.Theta) -> DataFrame:
    """`df` with `envs`: envelopes that cover each geometry more tightly than `env` alone."""
    x, y = t.x, t.y
    names = ("minx", "miny", "maxx", "maxy")
    return _mapped(df, "envs", f"array<{ENVELOPE}>", lambda G, g: [dict(zip(names, e, strict=True)) for e in G.refine_envelopes(g, x, y)])


def flatten_collections(df: DataFrame) -> DataFrame:
    """A row for each single-part geometry; other columns repeat."""
    return _mapped(df, "parts", "array<binary>", lambda G, g: [G.to_wkb(p) for p in G.flatten(g)]).withColumn("wkb", F.explode("parts")).drop("parts")

"""Synthetic datasets: copies of entities under other coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import envelope as E


def _draw(seed: int, first: int, digits: int) -> Column:
    """A number that only depends on seed, id and copy."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("copy").cast("string")).cast("binary"))
    return F.conv(F.substring(told, first, digits), 16, 10).cast("bigint")


def perturbed(df: DataFrame, times: int, low: float = 0.5, high: float = 2.0, seed: int = 0) -> DataFrame:
    """`times` + 1 copies of each entity (`copy` from 0): moved up, moved down or scaled by a number of its own from `low` to `high`.

    The same on every run and however rows are dealt. WKB, if there is any, moves with the envelope.
    """
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times))))
    shift = F.lit(low) + (_draw(seed, 1, 4) % 1024) / 1024.0 * (high - low)
    drawn = copies.withColumns({"__shift": shift, "__how": _draw(seed, 5, 2) % 3})

    def moved(c: Column) -> Column:
        s, how = F.col("__shift"), F.col("__how")
        return F.when(how == 0, c + s).when(how == 1, c - s).otherwise(c * s)

    e = F.col("env")
    out = drawn.withColumn("env", E.box(*[moved(e[c]) for c in ("minx", "miny", "maxx", "maxy")]))
    if "wkb" in df.columns:

        @F.pandas_udf("binary")
        def run(raw, shift, how):
            import pandas as pd

            from ..functions import geometry as G

            return pd.Series([None if r is None else G.to_wkb(G.mapped(G.from_wkb(bytes(r)), (lambda c, s=s: c + s, lambda c, s=s: c - s, lambda c, s=s: c * s)[h])) for r, s, h in zip(raw, shift, how, strict=True)])

        out = out.withColumn("wkb", run("wkb", "__shift", "__how"))
    return out.drop("__shift", "__how")


def texts(df: DataFrame) -> DataFrame:
    """Rows (wkt, id) of entities with WKB; the id tells the copy."""

    @F.pandas_udf("string")
    def run(raw):
        import pandas as pd

        from ..functions import geometry as G

        return pd.Series([None if r is None else G.to_wkt(G.from_wkb(bytes(r))) for r in raw])

    return df.select(run("wkb").alias("wkt"), F.concat_ws("_", "copy", "id").alias("id"))

"""Interlinking: tile-keyed candidates without duplicates, then exact verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import envelope as E
from ..functions import matrix as M
from ..functions import orders
from ..plans.scratch import written
from . import decompose

#: Each grid level's tiles are so many times wider than those of the level below.
LEVEL = 4


def theta(source: DataFrame, option: str = "avg", scale: float = 1.0) -> E.Theta:
    """Tile size from the envelopes (`env`) of `source`: avg, avg2 (half of avg), min (above zero), max, or none (1, 1)."""
    if option == "none":
        return E.Theta() * scale
    w, h = E.width(F.col("env")), E.height(F.col("env"))
    pick = {"avg": F.avg, "avg2": F.avg, "max": F.max, "min": lambda c: F.min(F.when(c > 0, c))}[option]
    r = source.agg(pick(w).alias("x"), pick(h).alias("y")).first()
    half = 0.5 if option == "avg2" else 1.0
    return E.Theta((r["x"] or 1.0) * half or 1.0, (r["y"] or 1.0) * half or 1.0) * scale


@dataclass(frozen=True)
class Grid:
    """Tile size, and the grid levels that the entities of both sides need."""

    theta: E.Theta
    levels: tuple[int, ...] = (0,)


def grid(source: DataFrame, target: DataFrame, option: str = "avg", scale: float = 1.0, most: int = 6) -> Grid:
    """`theta` and the levels from one pass over both sides."""
    w, h, mine = E.width(F.col("env")), E.height(F.col("env")), F.col("mine")
    both = source.select("env", F.lit(True).alias("mine")).unionByName(target.select("env", F.lit(False).alias("mine")))
    pick = {"avg": F.avg, "avg2": F.avg, "max": F.max, "min": lambda c: F.min(F.when(c > 0, c)), "none": F.avg}[option]
    r = both.agg(pick(F.when(mine, w)).alias("x"), pick(F.when(mine, h)).alias("y"), F.max(w).alias("w"), F.max(h).alias("h")).first()
    half = 0.5 if option == "avg2" else 1.0
    t = (E.Theta() if option == "none" else E.Theta((r["x"] or 1.0) * half or 1.0, (r["y"] or 1.0) * half or 1.0)) * scale
    span = max((r["w"] or 0.0) / t.x, (r["h"] or 0.0) / t.y, 1.0)
    return Grid(t, tuple(range(min(most, max(0, math.ceil(math.log(span, LEVEL)) - 1)) + 1)))


def _level(env: Column, t: E.Theta, most: int) -> Column:
    """The lowest grid level on which an envelope spans at most about LEVEL tiles an axis."""
    span = F.greatest(E.width(env) / t.x, E.height(env) / t.y, F.lit(1.0))
    return F.least(F.greatest(F.ceil(F.log(span) / F.log(F.lit(float(LEVEL)))) - 1, F.lit(0)), F.lit(most)).cast("int")


def _factor(level: Column, levels: list[int]) -> Column:
    """How many times wider a level's tiles are than those of level 0."""
    return F.pow(F.lit(float(LEVEL)), level) if levels[-1] else F.lit(1.0)


def _tiled(df: DataFrame, t: E.Theta, levels: list[int], source: bool) -> DataFrame:
    """Rows for each tile of an entity on its own level and on those in use above it, in lanes.

    Lane 0 meets sources on their own level with targets of that level and below; lane 1 the other sources with
    targets on their own level. So wide tiles hold only what some large entity needs.
    """
    used = F.array(*[F.lit(n) for n in levels])
    levelled = df.withColumn("level", _level(F.col("env"), t, levels[-1]))
    dealt = levelled.withColumn("grid", F.explode(F.filter(used, lambda g: g >= F.col("level"))))
    own = F.col("grid") == F.col("level")
    lanes = F.when(own, F.array(F.lit(0))).otherwise(F.array(F.lit(1))) if source else F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    if len(levels) == 1:
        lanes = F.array(F.lit(0))
    factor = _factor(F.col("grid"), levels)
    e = F.col("env")
    r = F.struct(
        F.floor(e["minx"] / (factor * t.x)).alias("x1"), F.floor(e["miny"] / (factor * t.y)).alias("y1"), F.floor(e["maxx"] / (factor * t.x)).alias("x2"), F.floor(e["maxy"] / (factor * t.y)).alias("y2")
    )
    return dealt.withColumn("tile", F.explode(E.tiles(r))).withColumn("lane", F.explode(lanes)).select("*", "tile.tx", "tile.ty").drop("tile")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def candidates(source: DataFrame, target: DataFrame, t: E.Theta | Grid, relation: str = "DE9IM", temporal: bool = False, fine: bool = False, levels: int = 6, parts: int = 0) -> DataFrame:
    """Pairs of entities (id, env, ...) whose envelopes can have `relation`: columns s_* and t_*, each pair once.

    Both sides are dealt to the tiles of a grid in levels, large entities to wide tiles, so no entity has more than a
    few tiles a level; an equi-join on (lane, level, tile) at the larger of both levels meets each pair in one tile or more,
    and the pair answers only in that of the low corner of their intersection. The levels are those of a `Grid`; for a
    bare tile size a pass over the sides finds them, over the source alone if the target is a stream.
    Both sides are shuffled: Spark judges a side by its files' size, which says nothing of its rows for each tile, and
    would send millions of them through the driver.
    `temporal`: entities must lie less than two days apart (`ts`); `fine`: some of their parts (`envs`) must meet; `parts`: no entity has
    more of them, an entity that has fails (0: not known).
    """
    if relation == "disjoint":
        raise ValueError("disjoint entities share no tile; relate(..., 'disjoint') makes all other pairs")
    if isinstance(t, Grid):
        t, used = t.theta, list(t.levels)
    else:
        level = _level(F.col("env"), t, levels).alias("level")
        sides = source.select(level) if target.isStreaming else source.select(level).union(target.select(level))
        used = list(range((sides.agg(F.max("level")).first()[0] or 0) + 1))
    if fine and parts:
        source, target = (df.where(F.when(F.coalesce(F.size("envs") <= parts, F.lit(True)), True).otherwise(F.raise_error(F.lit(f"an entity has more than {parts} parts")).cast("boolean"))) for df in (source, target))
    s, u = _prefixed(_tiled(source, t, used, True), "s_"), _prefixed(_tiled(target, t, used, False), "t_")
    a, b = F.col("s_env"), F.col("t_env")
    factor = _factor(F.col("s_grid"), used)
    once = (F.floor(F.greatest(a["minx"], b["minx"]) / (factor * t.x)) == F.col("s_tx")) & (F.floor(F.greatest(a["miny"], b["miny"]) / (factor * t.y)) == F.col("s_ty"))
    met = (F.col("s_lane") == F.col("t_lane")) & (F.col("s_grid") == F.col("t_grid")) & (F.col("s_tx") == F.col("t_tx")) & (F.col("s_ty") == F.col("t_ty"))
    test = E.intersects(a, b) & once  # comparisons first: most pairs of a tile fail them
    if relation not in ("touches", "DE9IM"):
        test = test & E.check(a, b, relation)
    if temporal:
        test = test & E.near_days(F.col("s_ts"), F.col("t_ts"))
    if fine:
        test = test & E.fine_intersects(a, b, F.col("s_envs"), F.col("t_envs"), parts)
    pairs = s.hint("merge").join(u, met & test)
    return pairs.drop(*[f"{p}{c}" for p in "st" for c in ("_level", "_grid", "_lane", "_tx", "_ty")])


def dirty_candidates(entities: DataFrame, t: E.Theta, **options) -> DataFrame:
    """Candidates of a dataset with itself, each unordered pair once."""
    return candidates(entities, entities, t, **options).where("s_id < t_id")


def _boxes_only(pairs: DataFrame) -> bool:
    return {"s_is_box", "t_is_box"} <= set(pairs.columns) and "s_wkb" not in pairs.columns


def _sure_boxes(pairs: DataFrame) -> DataFrame:
    """Pairs of boxes; anything else fails, as without WKB it can't be verified."""
    missing = F.raise_error(F.lit("entities that aren't boxes need WKB to be verified")).cast("boolean")
    return pairs.where(F.when(F.col("s_is_box") & F.col("t_is_box"), True).otherwise(missing))


def formed(entities: DataFrame) -> DataFrame:
    """Entities (env, wkb) with `fills`: true if the geometry is all of its envelope, else null; never null in the schema if all are.

    They are written once, so that their WKB is made and looked at once, whatever the branches of a plan.
    """
    if "wkb" not in entities.columns or "fills" in entities.columns:
        return entities

    @F.pandas_udf("boolean")
    def run(raw, x1, y1, x2, y2):
        import pandas as pd

        columns = (raw, x1, y1, x2, y2)
        return pd.Series([(r is not None and orders.fills(bytes(r), *e)) or None for r, *e in zip(*columns, strict=True)], dtype=object)

    out = written(entities.withColumn("fills", run("wkb", *[f"env.{c}" for c in ("minx", "miny", "maxx", "maxy")])), "formed")
    return out if out.where("fills is null").head(1) else out.withColumn("fills", F.lit(True))


def _formed(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (source, target) if source.isStreaming or target.isStreaming else (formed(source), formed(target))


def formed_in_parts(source: DataFrame, target: DataFrame, t: E.Theta) -> tuple[DataFrame, DataFrame]:
    """Both sides `formed`, with finer envelopes (`envs`).

    If all entities are all of their envelope no plan asks for `envs`, so none are made; else they are written once as well.
    """
    sides = [formed(df) for df in (source, target)]
    fine = [decompose.with_fine_envelopes(df, t) for df in sides]
    source, target = [written(df, "parts") for df in fine] if any(df.schema["fills"].nullable for df in sides) else fine
    return source, target


def _ordered(pairs: DataFrame) -> DataFrame:
    """`pairs` with `order` (see functions.orders), null where a geometry isn't all of its envelope; not nullable if all are."""
    if not {"s_fills", "t_fills"} <= set(pairs.columns):
        return pairs
    number = orders.order(F.col("s_env"), F.col("t_env"))
    if pairs.schema["s_fills"].nullable or pairs.schema["t_fills"].nullable:
        return pairs.withColumn("order", F.when(F.col("s_fills") & F.col("t_fills"), number))
    return pairs.withColumn("order", number)


def verify(pairs: DataFrame) -> DataFrame:
    """`pairs` with `im`: by columns alone for boxes (s_is_box, t_is_box), else by the exact kernel.

    The kernel runs on Arrow batches of WKB; for entities that are all of their envelope (s_fills, t_fills; see `formed`) it has
    judged each order of their coordinates. Without WKB every entity must be a box; a pair with another one fails.
    """
    return _judged(pairs).drop("order")


def _judged(pairs: DataFrame) -> DataFrame:
    """`verify`, and `order` where entities have `fills`."""
    if _boxes_only(pairs):
        return _sure_boxes(pairs).withColumn("im", E.box_matrix(F.col("s_env"), F.col("t_env")))
    pairs = _ordered(pairs)
    sure, im = F.lit(False), F.lit(None).cast("string")
    if {"s_is_box", "t_is_box"} <= set(pairs.columns):
        sure, im = F.coalesce(F.col("s_is_box") & F.col("t_is_box"), F.lit(False)), E.box_matrix(F.col("s_env"), F.col("t_env"))
    if "order" in pairs.columns:
        seen = orders.matrix_of(F.col("order"))
        if not (pairs.schema["s_fills"].nullable or pairs.schema["t_fills"].nullable):
            return pairs.withColumn("im", seen)
        known = F.col("order").isNotNull()
        sure, im = known | sure, F.when(known, seen).otherwise(im)

    @F.pandas_udf("string")
    def kernel(s, t):
        import pandas as pd

        from ..functions import geometry as G

        left, right = ([bytes(x) for x in side] for side in (s, t))
        raw = list({*left, *right})
        shapes = dict(zip(raw, G.prepared([G.from_wkb(x) for x in raw]), strict=True))  # each geometry of the batch once
        return pd.Series([G.relate_shapes(shapes[a], shapes[b]) for a, b in zip(left, right, strict=True)])

    quick = {"s_is_box", "order"} & set(pairs.columns)
    rest = pairs.where(~sure) if quick else pairs
    # The kernel takes longer than a shuffle of its input, and a join with a small side leaves pairs in the few partitions
    # of a scan: a target's pairs go to 16 places, so that a task still meets most geometries more than once.
    dealt = rest.repartition(F.col("t_id"), F.pmod(F.xxhash64("s_id"), F.lit(16)))
    checked = dealt.withColumn("im", kernel.asNondeterministic()("s_wkb", "t_wkb"))  # so that no filter above runs it again
    return pairs.where(sure).withColumn("im", im).unionByName(checked) if quick else checked


def with_relations(pairs: DataFrame, by_parts: bool = False) -> DataFrame:
    """`pairs` verified, with `im` and a boolean for each relation; `by_parts`: as `relate_decomposed` does."""
    judged, drop = _judged_by_parts(pairs) if by_parts else _judged(pairs), []
    if _boxes_only(pairs):
        found = E.box_relations(F.col("s_env"), F.col("t_env"))
    else:
        found = M.relations(F.col("im"), F.col("s_dim"), F.col("t_dim"))
        if "order" in judged.columns:
            judged, drop = judged.withColumn("bits", orders.bits_of(F.col("order"))), ["order", "bits"]
            seen = orders.relations_of(F.col("bits"))
            if pairs.schema["s_fills"].nullable or pairs.schema["t_fills"].nullable:
                found = {n: F.when(F.col("bits").isNotNull(), seen[n]).otherwise(found[n]) for n in M.NAMES}
            else:  # such geometries meet if their envelopes do, which a filter of pairs can ask before anything else
                found = seen | {"intersects": E.intersects(F.col("s_env"), F.col("t_env"))}
    return judged.withColumns({n: found[n] for n in M.NAMES}).drop(*drop)


def de9im(source: DataFrame, target: DataFrame, t: E.Theta | Grid, **options) -> DataFrame:
    """Verified pairs (source_id, target_id, im and a boolean for each relation)."""
    source, target = _formed(source, target)
    pairs = candidates(source, target, t, **options)
    return with_relations(pairs).select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), "im", "s_dim", "t_dim", *M.NAMES)


def relate(source: DataFrame, target: DataFrame, relation: str, t: E.Theta | Grid, **options) -> DataFrame:
    """Pairs (source_id, target_id) that have a relation; DE9IM stands for not disjoint.

    Disjoint pairs are all pairs but those that intersect: nearly |source| x |target| rows, so ask for them on small sides.
    """
    if relation == "disjoint":
        met = relate(source, target, "intersects", t, **options)
        every = source.select(F.col("id").alias("source_id")).crossJoin(target.select(F.col("id").alias("target_id")))
        return every.join(met, ["source_id", "target_id"], "left_anti")
    source, target = _formed(source, target)
    pairs = candidates(source, target, t, relation=relation, **options)
    if _boxes_only(pairs):
        good = _sure_boxes(pairs).where(E.box_relations(F.col("s_env"), F.col("t_env"))["intersects" if relation == "DE9IM" else relation])
    else:
        good = verify(pairs).where(M.holds(relation, F.col("im"), F.col("s_dim"), F.col("t_dim")))
    return good.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"))


def relate_decomposed(pairs: DataFrame) -> DataFrame:
    """`pairs` with `im`, from entities with `segments` (WKB of their parts): only those pairs go to the kernel of which some parts' envelopes (`envs`) meet.

    The others are disjoint, and their matrix follows from the dimensions. Same result as `verify`.
    """
    return _judged_by_parts(pairs).drop("order")


def _judged_by_parts(pairs: DataFrame) -> DataFrame:
    """`relate_decomposed`, and `order` where entities have `fills`."""
    if {"s_fills", "t_fills"} <= set(pairs.columns) and not (pairs.schema["s_fills"].nullable or pairs.schema["t_fills"].nullable):
        return _judged(pairs)  # no pair needs the kernel, so none is made twice or tested by parts
    near = E.fine_intersects(F.col("s_env"), F.col("t_env"), F.col("s_envs"), F.col("t_envs"))
    edge = lambda d: F.when(F.col(d) == 0, "F").otherwise((F.col(d) - 1).cast("string"))
    apart = F.concat(F.lit("FF"), F.col("s_dim").cast("string"), F.lit("FF"), edge("s_dim"), F.col("t_dim").cast("string"), edge("t_dim"), F.lit("2"))
    # A closed line has no boundary, so lines that are apart still go to the kernel.
    sure = (F.col("s_dim") != 1) & (F.col("t_dim") != 1) & ~near
    return _judged(pairs.where(~sure)).unionByName(_ordered(pairs.where(sure)).withColumn("im", apart))


def rule_based(pairs: DataFrame) -> DataFrame:
    """Compatibility: `pairs` with `im`, the matrices of their parts (`segments`) added up in the order of how their envelopes meet.

    Parts whose envelopes contain each other come first, those of the same extent on one axis last; parts that don't
    meet end the run, as does a sum that is both equals and crosses or overlaps. Inexact by design: cells of parts say
    less than those of the whole.
    """

    @F.pandas_udf("string")
    def run(s, t):
        import pandas as pd

        from ..functions import geometry as G

        return pd.Series([G.rule_based([G.from_wkb(bytes(x)) for x in a], [G.from_wkb(bytes(x)) for x in b]) for a, b in zip(s, t, strict=True)])

    return pairs.withColumn("im", run("s_segments", "t_segments"))


def verifications(pairs: DataFrame, most: int = 100_000) -> DataFrame:
    """Each target with the sources that it must be verified against; `most` or so in a row, the rest in further ones."""
    counted = pairs.groupBy("t_id").agg(F.ceil(F.count("*") / most).alias("rows"))
    dealt = pairs.select("t_id", "s_id").join(counted, "t_id").withColumn("row", F.pmod(F.xxhash64("s_id"), F.col("rows")))
    return dealt.groupBy(F.col("t_id").alias("target_id"), "row").agg(F.sort_array(F.collect_list("s_id")).alias("source_ids"), F.count("*").alias("n")).drop("row")


def partition_totals(pairs: DataFrame, by: Column) -> DataFrame:
    """For each partition `by`: its verifications and the most points of an entity in them."""
    return pairs.groupBy(by.alias("pid")).agg(F.count("*").alias("verifications"), F.max(F.greatest("s_npoints", "t_npoints")).alias("most_points"))


def unlinked(entities: DataFrame, links: DataFrame, side: str = "source_id") -> DataFrame:
    """Entities without any link."""
    return entities.join(links.select(F.col(side).alias("id")).distinct(), "id", "left_anti")


def theta_join(spark, source_view: str, target_view: str, relation: str, t: E.Theta | Grid, compat: bool = False) -> DataFrame:
    """The SQL front end: `SELECT ... WHERE ST_<relation>(a, b)` over two views, run as the tile join.

    `compat` takes covers, coveredby, disjoint and DE9IM for intersects.
    """
    known = {"intersects", "contains", "within", "touches", "crosses", "overlaps", "equals"}
    return relate(spark.table(source_view), spark.table(target_view), relation if relation in known or not compat else "intersects", t)

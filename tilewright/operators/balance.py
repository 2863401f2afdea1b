"""Load balancing of verifications, and statistics of datasets and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import envelope as E
from ..plans.scratch import written


def costs(pairs: DataFrame) -> DataFrame:
    """Verification cost of each target: its points times its candidates."""
    return pairs.groupBy("t_id").agg((F.max("t_npoints") * F.count("*")).alias("cost"))


def split_skewed(pairs: DataFrame, limit: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(cheap, skewed): pairs of targets whose cost's z-score (population deviation) is above `limit` are skewed."""
    by = written(costs(pairs), "costs")
    r = by.agg(F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("sd")).first()
    sd = r["sd"] or 0.0
    heavy = by.where((F.col("cost") - F.lit(r["mean"] or 0.0)) / F.lit(sd) > limit) if sd else by.limit(0)
    keys = heavy.select("t_id")
    return pairs.join(keys, "t_id", "left_anti"), pairs.join(keys, "t_id", "left_semi")


def redistribute(pairs: DataFrame, partitions: int) -> DataFrame:
    """Pairs dealt evenly by a hash of both ids, so that one target's pairs spread over all tasks."""
    return pairs.repartition(partitions, F.xxhash64("s_id", "t_id"))


def segment_batches(pairs: DataFrame, batch: int = 256) -> DataFrame:
    """Sources grouped by the set of target segments that they touch (`segments`), `batch` of them at a time.

    A window counts each set's sources, so the pairs are made and dealt once.
    """
    ready = pairs.select("t_id", "s_id", F.sort_array("segments").alias("segment_set"))
    batches = F.ceil(F.count("*").over(Window.partitionBy("t_id", "segment_set")) / batch)
    dealt = ready.withColumn("batch", F.pmod(F.pmod(F.xxhash64("s_id"), F.lit(1 << 16)), batches))
    return dealt.groupBy("t_id", "segment_set", "batch").agg(F.collect_list("s_id").alias("s_ids"))


def segment_sets(pairs: DataFrame) -> DataFrame:
    """For each target and set of its segments: the sources that touch just those; a set of sets stands for the trie of prefixes."""
    return pairs.groupBy("t_id", F.array_sort("segments").alias("segment_set")).agg(F.sort_array(F.collect_list("s_id")).alias("s_ids"))


def set_sizes(pairs: DataFrame) -> DataFrame:
    """`segment_sets` with the number of sources (`n`) in place of the sources, counted before the shuffle."""
    return pairs.groupBy("t_id", F.sort_array("segments").alias("segment_set")).agg(F.count("*").alias("n"))


def balanced_sets(sets: DataFrame, points: int = 1, average: int = 20_000, buffer: int = 5_000) -> DataFrame:
    """`segment_sets` or `set_sizes` with `into`: a set whose cost (sources times segments times `points`) is under average - buffer moves its sources
    into the cheapest set of the target that holds one segment more, as long as both cost less than average + buffer.

    So small sets are verified together, against some segments that they don't touch.
    """
    sets = written(sets, "sets")
    cost = (F.col("n") if "n" in sets.columns else F.size("s_ids")) * F.size("segment_set") * points
    small = sets.withColumn("cost", cost).where(F.col("cost") < average - buffer)
    wider = sets.select("t_id", F.col("segment_set").alias("wider"), cost.alias("wider_cost"))
    near = small.join(wider.hint("merge"), "t_id").where((F.size("wider") == F.size("segment_set") + 1) & (F.size(F.array_except("segment_set", "wider")) == 0))
    total = F.col("cost") + F.col("wider_cost")
    chosen = near.where(total < average + buffer).groupBy("t_id", "segment_set").agg(F.min_by("wider", F.struct("wider_cost", "wider")).alias("into"))
    return sets.join(chosen.hint("merge"), ["t_id", "segment_set"], "left").withColumn("into", F.coalesce("into", "segment_set"))


def execute_batches(batches: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Verified pairs of `segment_batches`: a row each, with `im`; a batch is a unit of the shuffle, not a list in a task."""
    from . import interlink

    rows = batches.select("t_id", F.explode("s_ids").alias("s_id"))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return interlink.verify(rows.join(side(source, "s").hint("merge"), "s_id").join(side(target, "t").hint("merge"), "t_id"))


def borders(parts: DataFrame, t: E.Theta | None = None) -> DataFrame:
    """Partitions (pid, border) in tiles, if `t` is given, with the outermost sides pushed out past the next whole number."""
    ready = parts.withColumn("border", E.scaled(F.col("border"), t)) if t else parts
    b = F.col("border")
    whole = ready.agg(*[f(b[c]).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])
    out = ready.join(F.broadcast(whole.select(F.struct("*").alias("all"))))  # one row
    low = lambda c: F.when(b[c] == F.col("all")[c], F.floor(b[c]) - 1.0).otherwise(b[c])
    high = lambda c: F.when(b[c] == F.col("all")[c], F.ceil(b[c]) + 1.0).otherwise(b[c])
    return out.select("pid", E.box(low("minx"), low("miny"), high("maxx"), high("maxy")).alias("border"))


def partition_report(source: DataFrame, target: DataFrame, pid, t: E.Theta | None = None) -> DataFrame:
    """For each partition (`pid`, a column of the entities): sources, targets, its border, and how many borders there are."""
    e = F.col("env")
    both = source.select("env", pid.alias("pid"), F.lit(1).alias("s")).unionByName(target.select("env", pid.alias("pid"), F.lit(0).alias("s")))
    sizes = both.groupBy("pid").agg(F.sum("s").alias("sources"), F.sum(1 - F.col("s")).alias("targets"), E.box(F.min(e["minx"]), F.min(e["miny"]), F.max(e["maxx"]), F.max(e["maxy"])).alias("border"))
    out = sizes.select("pid", "sources", "targets").join(borders(sizes.select("pid", "border"), t), "pid")
    return out.join(F.broadcast(out.agg(F.count_distinct("border").alias("unique_borders"))))


def statistics(source: DataFrame, target: DataFrame, t: E.Theta, threshold: float = 10.0) -> DataFrame:
    """One row: counts, Cartesian size, shares of entities wider or taller than theta times `threshold`, a tile's area."""
    def of(df: DataFrame, p: str) -> DataFrame:
        wide, tall = E.width(F.col("env")) > t.x * threshold, E.height(F.col("env")) > t.y * threshold
        return df.agg(F.count("*").alias(f"{p}_count"), (F.count_if(wide) / F.greatest(F.count("*"), F.lit(1))).alias(f"{p}_wide"), (F.count_if(tall) / F.greatest(F.count("*"), F.lit(1))).alias(f"{p}_tall"))

    both = of(source, "source").join(of(target, "target"))
    return both.withColumns({"cartesian": F.col("source_count") * F.col("target_count"), "tile_area": F.lit(t.x * t.y)})


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows and extent of each physical partition."""
    e = F.col("env")
    return df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n"), E.box(F.min(e["minx"]), F.min(e["miny"]), F.max(e["maxx"]), F.max(e["maxy"])).alias("border"))

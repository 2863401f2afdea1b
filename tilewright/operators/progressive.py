"""Progressive interlinking: weights of candidate pairs, schedules under a budget, evaluation of schedules."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import envelope as E
from ..plans.scratch import written

#: Names of the interface.
WEIGHTS = ("CF", "JS", "PEARSON_X2", "MBRO", "ISP")
SCHEMES = ("SIMPLE", "COMPOSITE", "HYBRID", "THIN_MULTI_COMPOSITE")
ALGORITHMS = ("PROGRESSIVE_GIANT", "DYNAMIC_PROGRESSIVE_GIANT", "GEOMETRY_CENTRIC", "TOPK", "RECIPROCAL_TOPK", "RANDOM", "EARLY_STOPPING")

#: Up to so many pairs are taken from the best ones of each task, without a sort of all pairs.
TAKEN = 1 << 16


def total_blocks(source: DataFrame, t: E.Theta) -> float:
    """Tiles of the extent of `source`, per axis one more than the extent's width in tiles."""
    r = source.agg(F.min("env.minx").alias("x1"), F.min("env.miny").alias("y1"), F.max("env.maxx").alias("x2"), F.max("env.maxy").alias("y2")).first()
    if r["x1"] is None:
        return 0.0
    return (r["x2"] / t.x - r["x1"] / t.x + 1) * (r["y2"] / t.y - r["y1"] / t.y + 1)


def weight(name: str, t: E.Theta, blocks: float, compat: bool = False) -> Column:
    """A pair's weight; `compat` truncates JS to a whole number as integer division does."""
    a, b = F.col("s_env"), F.col("t_env")
    cb = E.common_tiles(a, b, t).cast("double")
    sb, tb = E.tile_count(a, t).cast("double"), E.tile_count(b, t).cast("double")
    either = sb + tb - cb  # tiles of the source or the target
    if name == "JS":
        share = F.when(either != 0, cb / either).otherwise(0.0)
        return F.floor(share).cast("double") if compat else share
    if name == "PEARSON_X2":
        # Sums are of whole numbers, so exact in any order; the shortest are taken, as the JVM never compiles a method of over 8000 bytes.
        v01, v10, v11 = tb - cb, sb - cb, F.floor(F.lit(float(blocks)) - either).cast("double")
        rows, cols = (tb, v10 + v11), (sb, v01 + v11)
        n = tb + rows[1]
        total = F.lit(0.0)
        for i, j, v in ((0, 0, cb), (0, 1, v01), (1, 0, v10), (1, 1, v11)):
            expected = rows[i] * cols[j] / n
            total = total + F.pow(v - expected, F.lit(2.0)) / expected
        sound = (cb >= 0) & (v01 >= 0) & (v10 >= 0) & (v11 >= 0) & (rows[0] > 0) & (rows[1] > 0) & (cols[0] > 0) & (cols[1] > 0)
        return F.when(sound, total).otherwise(0.0)
    if name == "MBRO":
        inner = E.area(E.common(a, b))
        union = E.area(a) + E.area(b) - inner
        return F.when(union > 0, inner / union).otherwise(0.0)
    if name == "ISP":
        return F.lit(1.0) / (F.col("s_npoints") + F.col("t_npoints"))
    return cb


def weighted(pairs: DataFrame, t: E.Theta, blocks: float, main: str = "JS", secondary: str | None = None, scheme: str = "SIMPLE", compat: bool = False) -> DataFrame:
    """`pairs` with mw, sw and lw, and `rank_key`: what a scheme orders by, the best first."""
    if scheme == "THIN_MULTI_COMPOSITE":
        names = ("JS", "CF", "MBRO")
    else:
        names = (main, secondary, None)
    zero = F.lit(0.0)
    columns = {c: weight(n, t, blocks, compat) if n else zero for c, n in zip(("mw", "sw", "lw"), names, strict=True)}
    return ranked(pairs.withColumns(columns), scheme)


def _key(scheme: str, mw, sw, lw, zero) -> tuple:
    """What a scheme orders by, the best first."""
    return {"SIMPLE": (mw, zero, zero), "COMPOSITE": (mw, sw, zero), "HYBRID": (mw * sw, zero, zero), "THIN_MULTI_COMPOSITE": (mw, sw, lw)}[scheme]


def ranked(pairs: DataFrame, scheme: str) -> DataFrame:
    key = _key(scheme, F.col("mw"), F.col("sw"), F.col("lw"), F.lit(0.0))
    return pairs.withColumn("rank_key", F.struct(*[k.alias(n) for k, n in zip(key, ("a", "b", "c"), strict=True)]))


def best_first(compat: bool = False) -> list[Column]:
    """Order of verification; ties by ids, so that it's the same on every run. `compat`: by `counter`, the higher first."""
    return [F.desc("rank_key"), *([F.desc("counter")] if compat else [F.asc("s_id"), F.asc("t_id")])]


def placed(pairs: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first `budget` pairs in an order, with their place in `rank` (1 is first).

    Range-partitioned and sorted, counted for each partition, and offset by the counts: no task holds all of them.
    For a budget of up to TAKEN each task keeps its best ones alone, so that the others are never sorted or written.
    """
    spot = F.monotonically_increasing_id()
    first = pairs.orderBy(*order)
    first = first.limit(budget) if budget <= TAKEN else first
    sorted_ = written(first.withColumn("spot", spot), "sorted")
    part = F.shiftright("spot", 33)
    offsets, before = [], 0
    for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    spark = pairs.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "part bigint, before bigint"))
    out = sorted_.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("before") + F.col("spot").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return out.where(F.col("rank") <= budget).drop("spot", "part", "before")


def schedule(pairs: DataFrame, algorithm: str, budget: int, sources: int = 0, targets: int = 0, seed: int = 0) -> DataFrame:
    """The `budget` pairs to verify, with their place in `rank` (1 is first).

    RANDOM orders by a hash (MD5) of the seed and both ids; GEOMETRY_CENTRIC has no order of its own and is refused; TOPK keeps the k best pairs of each source and each target, RECIPROCAL_TOPK
    those among the k best of both; the others take the best pairs overall.
    """
    if algorithm not in ALGORITHMS or algorithm == "GEOMETRY_CENTRIC":
        raise ValueError(f"no schedule for {algorithm!r}")
    if algorithm == "RANDOM":
        pairs = pairs.withColumn("rank_key", F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s_id").cast("string"), F.col("t_id").cast("string")).cast("binary")).alias("a")))
    if algorithm in ("TOPK", "RECIPROCAL_TOPK"):
        if algorithm == "TOPK":
            k_s = k_t = (budget // max(1, sources + targets) + 1) * 2
        else:
            k_s, k_t = (budget // max(1, sources) + 1) * 2, (budget // max(1, targets) + 1) * 2
        pairs = _nearest(pairs, k_s, k_t, algorithm == "RECIPROCAL_TOPK", budget)
    return placed(pairs, best_first(), budget)


def _nearest(pairs: DataFrame, k_s: int, k_t: int, both: bool, budget: int) -> DataFrame:
    """Pairs among the `k_s` best of their source or (`both`: and) the `k_t` best of their target, at least the first `budget` of them.

    All orders are the same, so among the best n pairs of all, each has the places that it has among all pairs of its
    source and its target. If `budget` of the best few qualify, no others are needed; else all pairs are ranked.
    """
    def near(some: DataFrame) -> DataFrame:
        of = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(*best_first()))
        placed_ = some.withColumns({"of_s": of("s_id"), "of_t": of("t_id")})
        by_s, by_t = F.col("of_s") <= k_s, F.col("of_t") <= k_t
        return placed_.where(by_s & by_t if both else by_s | by_t).drop("of_s", "of_t")

    if 4 * budget <= TAKEN:
        some = written(pairs.orderBy(*best_first()).limit(TAKEN), "best")
        if some.count() < TAKEN or near(some).count() >= budget:
            return near(some)
    return near(pairs)


def dynamic(scheduled: DataFrame, groups: list[str], scheme: str = "COMPOSITE", compat: bool = False) -> DataFrame:
    """Verification order when each related pair boosts the queued pairs of its source and its target.

    `scheduled` holds mw, sw, lw (or not) and related (0/1) and is split by `groups`; in a group a heap with lazy deletion
    gives the best pair by `scheme` next, where mw and sw count 1 + matches times. A group's queue is bounded by its
    budget. `compat` leaves out the last pair.
    """
    keep = [f for f in scheduled.schema.names]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["s_id", "t_id"], ignore_index=True)
        matches = [0] * len(part)
        of: dict[tuple, list[int]] = {}
        for i, (s, t) in enumerate(zip(part.s_id, part.t_id, strict=True)):
            of.setdefault(("s", s), []).append(i)
            of.setdefault(("t", t), []).append(i)
        mw, sw = part.mw.tolist(), part.sw.tolist()
        lw = part.lw.tolist() if "lw" in part else [0.0] * len(part)
        key = lambda i: (*(-k for k in _key(scheme, mw[i] * (1 + matches[i]), sw[i] * (1 + matches[i]), lw[i], 0.0)), i)
        heap = [key(i) for i in range(len(part))]
        heapq.heapify(heap)
        order, done = [], set()
        while heap:
            k = heapq.heappop(heap)
            i = k[-1]
            if i in done or k != key(i):
                continue
            done.add(i)
            order.append(i)
            if part.related[i]:
                for j in {*of[("s", part.s_id[i])], *of[("t", part.t_id[i])]} - done:
                    matches[j] += 1
                    heapq.heappush(heap, key(j))
        order = order[:-1] if compat else order
        out = part.iloc[order].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[[*[k for k in keep if k != "rank"], "rank"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scheduled.schema if f.name != "rank")
    return scheduled.groupBy(*groups).applyInPandas(run, f"{fields}, rank int")


def early_stopping(verified: DataFrame, batch: int = 10_000, violations: int = 3, precision: float = 0.1) -> DataFrame:
    """The verified pairs (rank, related) up to where precision gave out.

    The first batch fixes the least number of matches, ceil(precision * its matches); a later batch below it is a
    violation, and that many in a row end the run after their last batch. Batches are counted by grouped sums.
    """
    by = F.floor((F.col("rank") - 1) / batch)
    sums = verified.groupBy(by.alias("batch")).agg(F.sum(F.col("related").cast("int")).alias("n")).orderBy("batch")
    least, streak, stop = None, 0, None
    for r in sums.toLocalIterator():
        if least is None:
            least = math.ceil(precision * r["n"])
            continue
        streak = streak + 1 if r["n"] < least else 0
        if streak == violations:
            stop = r["batch"]
            break
    return verified if stop is None else verified.where(F.floor((F.col("rank") - 1) / batch) <= stop)


def stop_early(scheduled: DataFrame, verify, batch: int = 10_000, violations: int = 3, precision: float = 0.1) -> DataFrame:
    """`early_stopping` that verifies as it goes: `verify` adds `related` to scheduled pairs (rank), twice as many batches at a time, until the run ends."""
    last = scheduled.agg(F.max("rank")).first()[0] or 0
    done, wave, out = 0, max(1, violations + 1), None
    while done < last or out is None:
        part = written(verify(scheduled.where((F.col("rank") > done) & (F.col("rank") <= done + wave * batch))), "verified")
        out = part if out is None else out.unionByName(part)
        done, wave = done + wave * batch, wave * 2
        kept = early_stopping(out, batch, violations, precision)
        if kept is not out:
            return kept
    return out


def evaluate(verified: DataFrame, budgets: list[int], total: int) -> DataFrame:
    """For each budget: verified, qualifying, recall, precision and progressive geometry recall of the pairs (rank, related).

    A related pair of rank r counts in the running sums from r to the budget, so all budgets come from one pass of sums.
    """
    rank, related = F.col("rank").cast("long"), F.col("related").cast("long")
    each = F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])).alias("budget")
    sums = verified.select(rank.alias("rank"), related.alias("related"), each).where(F.col("rank") <= F.col("budget"))
    part = sums.groupBy("budget").agg(F.count("*").alias("verified"), F.sum("related").alias("qualifying"), F.sum(F.col("related") * (1 - F.col("rank"))).alias("less"))
    n, most = F.col("verified"), F.least(F.lit(total), F.col("verified"))
    area = F.col("qualifying") * n + F.col("less")
    out = part.select(
        "budget", "verified", F.coalesce("qualifying", F.lit(0)).alias("qualifying"), F.coalesce(F.try_divide("qualifying", most), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide("qualifying", n), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(area, most * n), F.lit(0.0)).alias("pgr"),
    )
    none = verified.sparkSession.createDataFrame([(b,) for b in budgets], "budget bigint").join(out.select("budget"), "budget", "left_anti")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("verified", "qualifying")] + [F.lit(0.0).alias(c) for c in ("recall", "precision", "pgr")]
    return out.unionByName(none.select("budget", *zero))


def evaluate_run(verified: DataFrame, algorithm: str, budgets: list[int], total: int) -> DataFrame:
    """The evaluation that an algorithm's run has: an early stop is judged once, as far as it came; others at each budget."""
    if algorithm == "EARLY_STOPPING":
        n = verified.count()
        return evaluate(verified, [min(n, max(budgets))] if n else [0], total)
    return evaluate(verified, budgets, total)


def optimal(budget: int, total: int) -> dict[str, float]:
    """The best that any schedule can reach: all qualifying pairs first."""
    if not budget or not total:
        return {"recall": 0.0, "precision": 0.0, "pgr": 0.0}
    q = min(budget, total)
    area = q * (q + 1) / 2 + max(0, budget - total) * total
    return {"recall": 1.0, "precision": q / budget, "pgr": area / (min(total, budget) * budget)}


def grid_search(verified: DataFrame, batches: list[int], precisions: list[float], violations: list[int]) -> list[dict]:
    """Early stopping over all combinations, the most precise first; the pairs are verified once, and their ranks counted for each combination."""
    out = []
    for b in batches:
        for p in precisions:
            for v in violations:
                r = early_stopping(verified, b, v, p).agg(F.count("*").alias("n"), F.sum(F.col("related").cast("long")).alias("q")).first()
                out.append({"batch": b, "precision_limit": p, "violations": v, "verified": r["n"], "qualifying": r["q"] or 0, "precision": (r["q"] or 0) / r["n"] if r["n"] else 0.0})
    return sorted(out, key=lambda r: -r["precision"])

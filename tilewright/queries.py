"""Registered queries over fixtures derived from the TPC-H-like tables, and the same results as plain SQL.

The fixtures hold boxes, points and axis-parallel segments on multiples of 0.25, so all sums are exact.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import envelope as E
from .functions import matrix as M
from .operators import balance, decompose, interlink, progressive
from .sources import readers

BIG = 10_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(df: DataFrame, key: str, mx: int, my: int, w: str, h: str, ts: str = "CAST(NULL AS timestamp)") -> DataFrame:
    x, y = f"((CAST({key} AS bigint) * {mx}) % 4001) * 0.25D", f"((CAST({key} AS bigint) * {my}) % 3989) * 0.25D"
    sized = df.selectExpr(f"CAST({key} AS bigint) AS id", f"{x} AS x", f"{y} AS y", f"CAST({w} AS double) AS w", f"CAST({h} AS double) AS h", f"{ts} AS ts")
    return sized.select("id", E.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("env"), F.lit(5).alias("npoints"), F.lit(2).alias("dim"), F.lit(True).alias("is_box"), "ts")


def parcels(spark, d):
    return _boxes(_table(spark, d, "part"), "p_partkey", 7919, 104729, "2 + p_size % 23", "2 + (p_size * 3) % 17")


def zones(spark, d, stretch: str = "1"):
    return _boxes(_table(spark, d, "customer"), "c_custkey", 6007, 15013, f"(3 + c_nationkey % 29) * {stretch}", f"(3 + (c_nationkey * 5) % 19) * {stretch}")


def targets(spark, d):
    """Zones and twins: every 50th parcel again under another id."""
    twins = parcels(spark, d).where("id % 50 = 0").withColumn("id", F.col("id") + BIG)
    return zones(spark, d).unionByName(twins)


def points(spark, d):
    return _boxes(_table(spark, d, "events"), "event_id", 7919, 104729, "0", "0", "CAST(ts AS timestamp)").withColumns({"npoints": F.lit(1), "dim": F.lit(0), "is_box": F.lit(False)})


def dated_parcels(spark, d):
    when = "CAST(date_add(DATE'2024-01-01', CAST(p_partkey % 30 AS int)) AS timestamp)"
    return _boxes(_table(spark, d, "part"), "p_partkey", 7919, 104729, "2 + p_size % 23", "2 + (p_size * 3) % 17", when)


def segments(spark, d):
    key = "CAST(o_orderkey AS bigint)"
    rows = _table(spark, d, "orders").selectExpr(f"{key} AS id", f"(({key} * 7919) % 4001) * 0.25D AS x", f"(({key} * 104729) % 3989) * 0.25D AS y", f"CAST(2 + {key} % 31 AS double) AS n")
    flat = F.col("id") % 2 == 0
    x2, y2 = F.when(flat, F.col("x") + F.col("n")).otherwise(F.col("x")), F.when(flat, F.col("y")).otherwise(F.col("y") + F.col("n"))
    wkt = F.format_string("LINESTRING (%s %s, %s %s)", "x", "y", x2, y2)
    return rows.select("id", E.box(F.col("x"), F.col("y"), x2, y2).alias("env"), F.lit(2).alias("npoints"), F.lit(1).alias("dim"), F.lit(False).alias("is_box"), wkt.alias("wkt"))


def _with_wkb(df: DataFrame) -> DataFrame:
    """Entities with WKB of their box, or of `wkt` if they have it; dealt to all tasks first, as few files may hold them."""
    df, e = df.repartition("id"), F.col("env")
    box = F.format_string("POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))", *[e[c] for p in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")) for c in p])
    return df.withColumn("wkb", readers.parsed(F.col("wkt") if "wkt" in df.columns else box)["wkb"]).drop("wkt")


def _links(spark, d):
    s, t = parcels(spark, d), targets(spark, d)
    return interlink.de9im(s, t, interlink.grid(s, t))


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["de9im_counts"](spark, "/root/testdata/sf0.001")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _sql_boxes(table: str, key: str, mx: int, my: int, w: str, h: str, more: str = "") -> str:
    return f"SELECT *, x1 + w AS x2, y1 + h AS y2 FROM (SELECT CAST({key} AS BIGINT) AS id, ((CAST({key} AS BIGINT) * {mx}) % 4001) * CAST(0.25 AS DOUBLE) AS x1, ((CAST({key} AS BIGINT) * {my}) % 3989) * CAST(0.25 AS DOUBLE) AS y1, CAST({w} AS DOUBLE) AS w, CAST({h} AS DOUBLE) AS h{more} FROM {table})"


PARCELS = _sql_boxes("part", "p_partkey", 7919, 104729, "2 + p_size % 23", "2 + (p_size * 3) % 17", ", DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS day")
ZONES = _sql_boxes("customer", "c_custkey", 6007, 15013, "3 + c_nationkey % 29", "3 + (c_nationkey * 5) % 19")
POINTS = _sql_boxes("events", "event_id", 7919, 104729, "0", "0", ", CAST(ts AS DATE) AS day")
WITH = f"WITH parcels AS ({PARCELS}), zones AS ({ZONES}), targets AS (SELECT id, x1, y1, x2, y2 FROM zones UNION ALL SELECT id + {BIG}, x1, y1, x2, y2 FROM parcels WHERE id % 50 = 0)"
MEET = "s.x1 <= t.x2 AND s.x2 >= t.x1 AND s.y1 <= t.y2 AND s.y2 >= t.y1"
INNER = "s.x1 < t.x2 AND s.x2 > t.x1 AND s.y1 < t.y2 AND s.y2 > t.y1"
HAS = "s.x1 <= t.x1 AND s.x2 >= t.x2 AND s.y1 <= t.y1 AND s.y2 >= t.y2"
IN = "t.x1 <= s.x1 AND t.x2 >= s.x2 AND t.y1 <= s.y1 AND t.y2 >= s.y2"
SQL_RELATION = {
    "contains": HAS, "coveredby": IN, "covers": HAS, "crosses": "false", "equals": f"{HAS} AND {IN}", "intersects": MEET,
    "overlaps": f"{INNER} AND NOT ({HAS}) AND NOT ({IN})", "touches": f"{MEET} AND NOT ({INNER})", "within": IN,
}
QUOTED = ", ".join(f'"{n}"' for n in M.NAMES)
PAIRS = f"{WITH}, pairs AS (SELECT s.id AS source_id, t.id AS target_id, {', '.join(f'({c}) AS "{n}"' for n, c in SQL_RELATION.items())} FROM parcels s, targets t WHERE {MEET})"


@query(f"{PAIRS} SELECT {', '.join(f'count(*) FILTER (WHERE "{n}") AS "{n}"' for n in M.NAMES)}, count(*) AS verifications, count(*) FILTER (WHERE intersects) AS qualified_pairs, {' + '.join(f'count(*) FILTER (WHERE "{n}")' for n in M.NAMES)} AS total_relations FROM pairs")
def de9im_counts(spark, d):
    return M.total_relations(M.counts(_links(spark, d)))


@query(f"{PAIRS} SELECT source_id, target_id, {QUOTED} FROM pairs")
def de9im_pairs(spark, d):
    return _links(spark, d).select("source_id", "target_id", *M.NAMES)


def _relation(name: str):
    @query(f"{PAIRS} SELECT source_id, target_id FROM pairs WHERE \"{'intersects' if name == 'DE9IM' else name}\"", f"relate_{name.lower()}")
    def run(spark, d):
        s, t = parcels(spark, d), targets(spark, d)
        return interlink.relate(s, t, name, interlink.grid(s, t))


for _name in ("contains", "covers", "coveredby", "equals", "intersects", "overlaps", "touches", "within", "DE9IM"):
    _relation(_name)


@query(f"{WITH} SELECT 'avg' AS option, avg(x2 - x1) AS x, avg(y2 - y1) AS y FROM parcels UNION ALL SELECT 'avg2', 0.5 * avg(x2 - x1), 0.5 * avg(y2 - y1) FROM parcels UNION ALL SELECT 'max', max(x2 - x1), max(y2 - y1) FROM parcels UNION ALL SELECT 'min', min(x2 - x1), min(y2 - y1) FROM parcels UNION ALL SELECT 'none', 1.0, 1.0")
def theta_options(spark, d):
    s = parcels(spark, d)
    rows = [(o, (t := interlink.theta(s, o)).x, t.y) for o in ("avg", "avg2", "max", "min", "none")]
    return spark.createDataFrame(rows, "option string, x double, y double")


@query(f"WITH points AS ({POINTS}), zones AS ({ZONES}) SELECT s.id AS source_id, t.id AS target_id, ({INNER}) AS within FROM points s, zones t WHERE {MEET}")
def points_in_zones(spark, d):
    z = zones(spark, d)
    p = points(spark, d)
    pairs = interlink.candidates(p, z, interlink.grid(z, p))
    s, t = F.col("s_env"), F.col("t_env")
    inner = (s["minx"] > t["minx"]) & (s["minx"] < t["maxx"]) & (s["miny"] > t["miny"]) & (s["miny"] < t["maxy"])
    return pairs.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), inner.alias("within"))


@query(f"WITH points AS ({POINTS}), parcels AS ({PARCELS}) SELECT s.id AS source_id, t.id AS target_id FROM points s, parcels t WHERE {MEET} AND abs(date_diff('day', s.day, t.day)) < 2")
def points_near_in_time(spark, d):
    p = dated_parcels(spark, d)
    q = points(spark, d)
    pairs = interlink.candidates(q, p, interlink.grid(p, q), temporal=True)
    return pairs.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"))


SEGMENTS = "SELECT id, x1, y1, CASE WHEN id % 2 = 0 THEN x1 + n ELSE x1 END AS x2, CASE WHEN id % 2 = 0 THEN y1 ELSE y1 + n END AS y2 FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, ((CAST(o_orderkey AS BIGINT) * 7919) % 4001) * CAST(0.25 AS DOUBLE) AS x1, ((CAST(o_orderkey AS BIGINT) * 104729) % 3989) * CAST(0.25 AS DOUBLE) AS y1, CAST(2 + o_orderkey % 31 AS DOUBLE) AS n FROM orders)"


@query(f"WITH segments AS ({SEGMENTS}), zones AS ({ZONES}) SELECT s.id AS source_id, t.id AS target_id, ({INNER} AND {IN}) AS within, ({INNER} AND NOT ({IN})) AS crosses, (NOT ({INNER})) AS touches FROM segments s, zones t WHERE {MEET}")
def segments_by_kernel(spark, d):
    """Lines against boxes, verified by the exact kernel."""
    z = zones(spark, d)
    s = segments(spark, d)
    links = interlink.de9im(_with_wkb(s), _with_wkb(z), interlink.grid(z, s))
    return links.where("intersects").select("source_id", "target_id", "within", "crosses", "touches")


@query(f"{WITH} SELECT s.id AS source_id, t.id AS target_id FROM parcels s, parcels t WHERE {MEET} AND s.id < t.id")
def dirty_self_join(spark, d):
    s = parcels(spark, d)
    return interlink.dirty_candidates(s, interlink.grid(s, s)).select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"))


@query(f"{PAIRS} SELECT id FROM parcels WHERE id NOT IN (SELECT source_id FROM pairs)")
def unlinked_parcels(spark, d):
    return interlink.unlinked(parcels(spark, d), _links(spark, d)).select("id")


@query(f"{PAIRS} SELECT target_id, list_sort(list(source_id)) AS source_ids, count(*) AS n FROM pairs GROUP BY target_id")
def verifications_by_target(spark, d):
    s, t = parcels(spark, d), targets(spark, d)
    return interlink.verifications(interlink.candidates(s, t, interlink.grid(s, t)))


_TILES = "(ceil({e}.x2 / 8) - floor({e}.x1 / 8) + 1) * (ceil({e}.y2 / 8) - floor({e}.y1 / 8) + 1)"
_COMMON = "(least(ceil(s.x2 / 8), ceil(t.x2 / 8)) - greatest(floor(s.x1 / 8), floor(t.x1 / 8)) + 1) * (least(ceil(s.y2 / 8), ceil(t.y2 / 8)) - greatest(floor(s.y1 / 8), floor(t.y1 / 8)) + 1)"
_AREA = "(least(s.x2, t.x2) - greatest(s.x1, t.x1)) * (least(s.y2, t.y2) - greatest(s.y1, t.y1))"
WEIGHED = f"""{WITH}, extent AS (SELECT (max(x2) / 8 - min(x1) / 8 + 1) * (max(y2) / 8 - min(y1) / 8 + 1) AS blocks FROM parcels),
raw AS (SELECT s.id AS source_id, t.id AS target_id, CAST({_COMMON} AS DOUBLE) AS cf, CAST({_TILES.format(e='s')} AS DOUBLE) AS sb, CAST({_TILES.format(e='t')} AS DOUBLE) AS tb, blocks,
  {_AREA} / ((s.x2 - s.x1) * (s.y2 - s.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {_AREA}) AS mbro, ({INNER}) AS related FROM parcels s, targets t, extent WHERE {MEET}),
cells AS (SELECT *, cf / (sb + tb - cf) AS js, cf AS v00, tb - cf AS v01, sb - cf AS v10, floor(blocks - (sb + tb - cf)) AS v11 FROM raw)"""
EIGHT = E.Theta(8.0, 8.0)


def _eights(s, t) -> interlink.Grid:
    """Tiles of eight by eight, on the levels that the entities need."""
    return replace(interlink.grid(s, t, "none", 8.0), theta=EIGHT)


def _weighed(spark, d, **options):
    s, t = parcels(spark, d), targets(spark, d)
    pairs = interlink.candidates(s, t, _eights(s, t))
    return progressive.weighted(pairs, EIGHT, progressive.total_blocks(s, EIGHT), **options)


_CHI = " + ".join(f"power({v} - ({r}) * ({c}) / n, 2) / (({r}) * ({c}) / n)" for v, r, c in (("v00", "v00 + v01", "v00 + v10"), ("v01", "v00 + v01", "v01 + v11"), ("v10", "v10 + v11", "v00 + v10"), ("v11", "v10 + v11", "v01 + v11")))


@query(f"{WEIGHED} SELECT source_id, target_id, cf, round(js, 9) AS js, round(mbro, 9) AS mbro, 0.1 AS isp, round(CASE WHEN v00 + v01 > 0 AND v10 + v11 > 0 AND v00 + v10 > 0 AND v01 + v11 > 0 THEN {_CHI} ELSE 0 END, 6) AS pearson FROM (SELECT *, v00 + v01 + v10 + v11 AS n FROM cells)")
def pair_weights(spark, d):
    s, t = parcels(spark, d), targets(spark, d)
    pairs = interlink.candidates(s, t, _eights(s, t))
    n = progressive.total_blocks(s, EIGHT)
    w = {k.lower(): progressive.weight(k, EIGHT, n) for k in ("CF", "JS", "MBRO", "ISP")}
    out = {k: F.round(c, 9) if k in ("js", "mbro") else c for k, c in w.items()}
    return pairs.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), *[c.alias(k) for k, c in out.items()], F.round(progressive.weight("PEARSON_X2", EIGHT, n), 6).alias("pearson"))


BUDGET = 300
_RANKS = {
    "progressive_giant": "SELECT source_id, target_id FROM (SELECT *, row_number() OVER (ORDER BY js DESC, source_id, target_id) AS r FROM cells) WHERE r <= 300",
    "progressive_composite": "SELECT source_id, target_id FROM (SELECT *, row_number() OVER (ORDER BY cf DESC, js DESC, source_id, target_id) AS r FROM cells) WHERE r <= 300",
    "progressive_hybrid": "SELECT source_id, target_id FROM (SELECT *, row_number() OVER (ORDER BY js * mbro DESC, source_id, target_id) AS r FROM cells) WHERE r <= 300",
    "progressive_thin": "SELECT source_id, target_id FROM (SELECT *, row_number() OVER (ORDER BY js DESC, cf DESC, mbro DESC, source_id, target_id) AS r FROM cells) WHERE r <= 300",
}


def _progressive(name: str, **options):
    @query(f"{WEIGHED} {_RANKS[name]}", name)
    def run(spark, d):
        return progressive.schedule(_weighed(spark, d, **options), "PROGRESSIVE_GIANT", BUDGET).select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"))


_progressive("progressive_giant", main="JS")
_progressive("progressive_composite", main="CF", secondary="JS", scheme="COMPOSITE")
_progressive("progressive_hybrid", main="JS", secondary="MBRO", scheme="HYBRID")
_progressive("progressive_thin", scheme="THIN_MULTI_COMPOSITE")
_TOP = "sizes AS (SELECT (SELECT count(*) FROM parcels) AS n_s, (SELECT count(*) FROM targets) AS n_t), placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY js DESC, target_id) AS of_s, row_number() OVER (PARTITION BY target_id ORDER BY js DESC, source_id) AS of_t FROM cells)"


def _top(algorithm: str, where: str):
    @query(f"{WEIGHED}, {_TOP} SELECT source_id, target_id FROM (SELECT *, row_number() OVER (ORDER BY js DESC, source_id, target_id) AS r FROM placed, sizes WHERE {where}) WHERE r <= 300", algorithm.lower())
    def run(spark, d):
        chosen = progressive.schedule(_weighed(spark, d), algorithm, BUDGET, parcels(spark, d).count(), targets(spark, d).count())
        return chosen.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"))


_top("TOPK", "of_s <= (300 // (n_s + n_t) + 1) * 2 OR of_t <= (300 // (n_s + n_t) + 1) * 2")
_top("RECIPROCAL_TOPK", "of_s <= (300 // n_s + 1) * 2 AND of_t <= (300 // n_t + 1) * 2")


def _verified(spark, d, algorithm: str = "PROGRESSIVE_GIANT", budget: int = BUDGET):
    chosen = progressive.schedule(_weighed(spark, d, secondary="MBRO"), algorithm, budget)
    return interlink.verify(chosen).select("s_id", "t_id", "mw", "sw", "rank", F.col("im").rlike("^2").cast("int").alias("related"))


@query(f"{WEIGHED} SELECT s_id, t_id, rank FROM (SELECT source_id AS s_id, target_id AS t_id, row_number() OVER (ORDER BY md5('0:' || source_id || ':' || target_id) DESC, source_id, target_id) AS rank FROM cells) WHERE rank <= 300")
def random_schedule(spark, d):
    return _verified(spark, d, "RANDOM").select("s_id", "t_id", "rank")


_BEST = "PARTITION BY step, pid ORDER BY mw * (1 + m) DESC, sw * (1 + m) DESC, s_id, t_id"
_HEAP = f"""base AS (SELECT source_id AS s_id, target_id AS t_id, js AS mw, mbro AS sw, CAST(related AS INT) AS related, target_id % 4 AS pid FROM (SELECT *, row_number() OVER (ORDER BY js DESC, source_id, target_id) AS r FROM cells) WHERE r <= 300),
run AS (SELECT 0 AS step, base.*, 0 AS m FROM base UNION ALL
  SELECT step + 1, s_id, t_id, mw, sw, related, pid, m + CASE WHEN best.q = 1 AND (s_id = best.s OR t_id = best.t) THEN 1 ELSE 0 END FROM (SELECT *, first_value({{'s': s_id, 't': t_id, 'q': related}}) OVER ({_BEST}) AS best FROM run) WHERE NOT (s_id = best.s AND t_id = best.t))"""


@query(f"{WEIGHED.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_HEAP} SELECT s_id, t_id, pid, related, step + 1 AS rank FROM (SELECT *, row_number() OVER ({_BEST}) AS k FROM run) WHERE k = 1")
def dynamic_schedule(spark, d):
    """Related pairs boost those of their entities, in four groups of targets."""
    ready = _verified(spark, d).withColumn("pid", F.pmod("t_id", F.lit(4))).drop("rank")
    return progressive.dynamic(ready, ["pid"]).select("s_id", "t_id", "pid", "related", "rank")


_STEPS = "ranked AS (SELECT *, row_number() OVER (ORDER BY js DESC, source_id, target_id) AS r FROM cells), run AS (SELECT r, CAST(related AS INT) AS q, sum(CAST(related AS INT)) OVER (ORDER BY r) AS found FROM ranked WHERE r <= 300)"


@query(f"{WEIGHED}, {_STEPS}, total AS (SELECT count(*) FILTER (WHERE related) AS n FROM cells) SELECT CAST(b AS BIGINT) AS budget, count(*) AS verified, CAST(sum(q) AS BIGINT) AS qualifying, round(sum(q) / least(any_value(n), count(*)), 9) AS recall, round(sum(q) / count(*), 9) AS precision, round(sum(found) / (least(any_value(n), count(*)) * count(*)), 9) AS pgr FROM run, total, (VALUES (100), (200), (300)) v(b) WHERE r <= b GROUP BY b")
def schedule_quality(spark, d):
    s, t = parcels(spark, d), targets(spark, d)
    total = interlink.candidates(s, t, interlink.grid(s, t)).where(E.inner(F.col("s_env"), F.col("t_env"))).count()
    out = progressive.evaluate(_verified(spark, d), [100, 200, 300], total)
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "precision", "pgr")})


_RUN = "ranked AS (SELECT source_id AS s_id, target_id AS t_id, row_number() OVER (ORDER BY js DESC, source_id, target_id) AS rank, CAST(related AS INT) AS related FROM cells), run AS (SELECT *, (rank - 1) // 100 AS batch FROM ranked WHERE rank <= 1800), sums AS (SELECT batch, sum(related) AS n FROM run GROUP BY batch), least AS (SELECT n AS n FROM sums WHERE batch = 0), bad AS (SELECT s.batch, s.n < l.n AS low FROM sums s, least l WHERE s.batch > 0), stops AS (SELECT min(a.batch) AS batch FROM bad a JOIN bad b ON b.batch = a.batch - 1 WHERE a.low AND b.low)"


@query(f"{WEIGHED}, {_RUN} SELECT s_id, t_id, rank, related FROM run, stops WHERE run.batch <= coalesce(stops.batch, run.batch)")
def early_stopping(spark, d):
    return progressive.early_stopping(_verified(spark, d, budget=1800), batch=100, violations=2, precision=1.0).select("s_id", "t_id", "rank", "related")


_BIG_ZONES = _sql_boxes("customer", "c_custkey", 6007, 15013, "(3 + c_nationkey % 29) * CASE WHEN c_custkey % 97 = 0 THEN 20 ELSE 1 END", "(3 + (c_nationkey * 5) % 19) * CASE WHEN c_custkey % 97 = 0 THEN 20 ELSE 1 END")


@query(f"WITH parcels AS ({PARCELS}), zones AS ({_BIG_ZONES}), costs AS (SELECT t.id AS t_id, 5 * count(*) AS cost FROM parcels s, zones t WHERE {MEET} GROUP BY t.id), z AS (SELECT avg(cost) AS m, stddev_pop(cost) AS sd FROM costs) SELECT t_id, cost FROM costs, z WHERE (cost - m) / sd > 3")
def skewed_targets(spark, d):
    s = parcels(spark, d)
    z = zones(spark, d, "CASE WHEN c_custkey % 97 = 0 THEN 20 ELSE 1 END")
    pairs = interlink.candidates(s, z, interlink.grid(s, z))
    _, skewed = balance.split_skewed(pairs)
    return balance.costs(skewed)


@query(f"{WITH}, th AS (SELECT avg(x2 - x1) AS x, avg(y2 - y1) AS y FROM parcels) SELECT (SELECT count(*) FROM parcels) AS source_count, (SELECT avg(CASE WHEN p.x2 - p.x1 > th.x * 1.5 THEN 1.0 ELSE 0 END) FROM parcels p, th) AS source_wide, (SELECT avg(CASE WHEN p.y2 - p.y1 > th.y * 1.5 THEN 1.0 ELSE 0 END) FROM parcels p, th) AS source_tall, (SELECT count(*) FROM zones) AS target_count, (SELECT avg(CASE WHEN p.x2 - p.x1 > th.x * 1.5 THEN 1.0 ELSE 0 END) FROM zones p, th) AS target_wide, (SELECT avg(CASE WHEN p.y2 - p.y1 > th.y * 1.5 THEN 1.0 ELSE 0 END) FROM zones p, th) AS target_tall, (SELECT count(*) FROM parcels) * (SELECT count(*) FROM zones) AS cartesian, (SELECT x * y FROM th) AS tile_area")
def dataset_statistics(spark, d):
    s = parcels(spark, d)
    return balance.statistics(s, zones(spark, d), interlink.theta(s), threshold=1.5)


@query(f"{PAIRS} SELECT '<' || source_id || '> <' || iri || '> <' || target_id || '> .' AS value FROM ({' UNION ALL '.join(f'SELECT source_id, target_id, {chr(39)}{p}{chr(39)} AS iri FROM pairs WHERE "{n}"' for n, p in readers.PROPERTIES.items())})")
def rdf_triples(spark, d):
    return readers.triples(_links(spark, d))


@query(f"WITH zones AS ({ZONES}) SELECT id, CAST((ceil(x2 / 8) - floor(x1 / 8)) * (ceil(y2 / 8) - floor(y1 / 8)) AS INTEGER) AS n_segments FROM zones")
def decomposed_segments(spark, d):
    """Zones cut on the grid."""
    z = _with_wkb(zones(spark, d))
    return decompose.with_segments(z, EIGHT).select("id", F.size("segments").alias("n_segments"))


@query(f"{PAIRS}, cut AS (SELECT p.target_id AS t_id, p.source_id AS s_id, floor(greatest(s.x1, t.x1) / 8) = floor(least(s.x2, t.x2) / 8) AS narrow FROM pairs p JOIN parcels s ON s.id = p.source_id JOIN targets t ON t.id = p.target_id) SELECT t_id, narrow, count(*) AS pairs FROM cut GROUP BY ALL")
def balanced_batches(spark, d):
    """Sources by the columns of tiles that they share with a target, in batches."""
    s, t = parcels(spark, d), targets(spark, d)
    both = E.common(F.col("s_env"), F.col("t_env"))
    shared = F.sequence(F.floor(both["minx"] / 8), F.floor(both["maxx"] / 8))
    pairs = interlink.candidates(s, t, interlink.grid(s, t)).withColumn("segments", shared)
    batches = balance.segment_batches(balance.redistribute(pairs, 8), batch=2)
    return batches.groupBy("t_id", (F.size("segment_set") == 1).alias("narrow")).agg(F.sum(F.size("s_ids")).alias("pairs"))

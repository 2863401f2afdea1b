from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from tilewright import queries as Q
from tilewright import queries_more  # noqa: F401
from tilewright.functions import envelope as E
from tilewright.functions import geometry as G
from tilewright.operators import decompose, interlink, progressive
from tilewright.plans import jobs
from tilewright.plans.config import Dataset, Job, parse
from tilewright.sources import readers
from tilewright.streaming.interlink import link_stream

SLOW = {"segments_by_kernel"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("part", "customer", "events", "orders", "supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (str, bool)) or v is None else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, data, duck, name):
    df = Q.QUERIES[name](spark, data)
    sql = duck.sql(Q.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    at = [sql.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() >= 0


def test_box_matrix_is_the_kernel(spark):
    spans = [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    boxes = [(a, c, b, d) for a, b in spans for c, d in spans]
    rows = [(i, *map(float, b)) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double").select("id", E.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("e"))
    pairs = df.alias("a").join(df.alias("b")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), E.box_matrix(F.col("a.e"), F.col("b.e")).alias("im")).collect()
    shape = lambda b: ("POLYGON", [[[(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]]])
    for r in pairs:
        assert r["im"] == G.relate(shape(boxes[r["i"]]), shape(boxes[r["j"]])), (boxes[r["i"]], boxes[r["j"]])


def test_large_entities_meet_small_ones(spark):
    rows = [(i, float(i % 40), float(i // 40), float(i % 40) + (400.0 if i % 97 == 0 else 1.0), float(i // 40) + 1.0) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double").select("id", E.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("env"))
    got = [(r.s_id, r.t_id) for r in interlink.candidates(df, df, E.Theta(1.0, 1.0)).collect()]
    expected = {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert len(got) == len(set(got)) and set(got) == expected


def side(spark, rows, box=True):
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    return df.select("id", E.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("env"), F.lit(5).alias("npoints"), F.lit(2).alias("dim"), F.lit(box).alias("is_box"))


def test_no_relation_is_silently_empty(spark):
    a, b = side(spark, [(1, 0.0, 0.0, 2.0, 2.0), (2, 5.0, 5.0, 6.0, 6.0)]), side(spark, [(3, 1.0, 1.0, 3.0, 3.0), (4, 5.0, 5.0, 6.0, 6.0)])
    got = {(r.source_id, r.target_id) for r in interlink.relate(a, b, "disjoint", E.Theta()).collect()}
    assert got == {(1, 4), (2, 3)}
    with pytest.raises(ValueError):
        interlink.candidates(a, b, E.Theta(), relation="disjoint")
    with pytest.raises(Exception, match="WKB"):
        interlink.relate(a, side(spark, [(3, 1.0, 1.0, 3.0, 3.0)], box=False), "intersects", E.Theta()).collect()
    a.createOrReplaceTempView("some_a")
    b.createOrReplaceTempView("some_b")
    joined = {c: {(r.source_id, r.target_id) for r in interlink.theta_join(spark, "some_a", "some_b", "covers", E.Theta(), compat=c).collect()} for c in (False, True)}
    assert joined == {False: {(2, 4)}, True: {(1, 3), (2, 4)}}
    with pytest.raises(ValueError):
        progressive.schedule(a.limit(0), "GEOMETRY_CENTRIC", 5)


def test_stream_is_linked_like_a_batch(spark, tmp_path):
    source = side(spark, [(i, float(i), 0.0, i + 1.5, 2.0) for i in range(20)])
    targets = side(spark, [(100 + i, i * 0.5, 1.0, i * 0.5 + (30.0 if i == 7 else 0.4), 1.5) for i in range(40)])
    targets.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(targets.schema).parquet(str(tmp_path / "in"))
    links = link_stream(source, stream, "intersects", interlink.theta(source))
    links.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    expected = {tuple(r) for r in interlink.relate(source, targets, "intersects", interlink.theta(source)).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected and len(expected) > 40


def test_dynamic_follows_the_scheme(spark):
    rows = [(1, 1, 0.9, 0.1, 0.0, 1, 0), (2, 2, 0.8, 0.9, 0.5, 0, 0), (1, 3, 0.5, 0.2, 0.9, 0, 0), (3, 4, 0.8, 0.9, 0.7, 0, 0)]
    df = spark.createDataFrame(rows, "s_id int, t_id int, mw double, sw double, lw double, related int, pid int")
    order = {s: [r.t_id for r in progressive.dynamic(df, ["pid"], s).orderBy("rank").collect()] for s in progressive.SCHEMES}
    assert order == {"SIMPLE": [1, 3, 2, 4], "COMPOSITE": [1, 3, 2, 4], "HYBRID": [2, 4, 3, 1] if 0.5 * 0.2 > 0.9 * 0.1 else [2, 4, 1, 3], "THIN_MULTI_COMPOSITE": [1, 3, 4, 2]}


def test_ties_by_counter(spark):
    df = spark.createDataFrame([(1, 5, 9, 0.5), (2, 6, 8, 0.5), (3, 7, 7, 0.7)], "counter int, s_id int, t_id int, mw double")
    ready = progressive.ranked(df.withColumns({"sw": F.lit(0.0), "lw": F.lit(0.0)}), "SIMPLE")
    assert [r.counter for r in ready.orderBy(*progressive.best_first(compat=True)).collect()] == [3, 2, 1]


def test_ranks_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("s_id"), F.col("id").alias("t_id"), (F.col("id") % 17 * 1.0).alias("mw")).withColumns({"sw": F.lit(0.0), "lw": F.lit(0.0)})
    got = progressive.schedule(progressive.ranked(df.repartition(7), "SIMPLE"), "PROGRESSIVE_GIANT", 1200).orderBy("rank").collect()
    expected = sorted(((r.mw, r.s_id, r.t_id) for r in df.collect()), key=lambda r: (-r[0], r[1], r[2]))[:1200]
    assert [(r.mw, r.s_id, r.t_id) for r in got] == expected and [r["rank"] for r in got] == list(range(1, 1201))


def test_decomposed_and_mixed_kinds_are_the_kernel(spark):
    texts = ["POINT (1 1)", "MULTIPOINT ((0 0), (9 9))", "LINESTRING (0 0, 8 8, 8 0, 0 0)", "LINESTRING (0 9, 9 0)", "POLYGON ((0 0, 9 0, 9 9, 7 9, 7 2, 2 2, 2 9, 0 9, 0 0))", "POLYGON ((3 3, 5 3, 5 5, 3 5, 3 3))"]
    rows = readers.entities(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, wkt string"))
    parts = decompose.with_fine_envelopes(rows, E.Theta(2.0, 2.0))
    pairs = interlink.candidates(parts, parts, E.Theta(2.0, 2.0))
    for r in interlink.relate_decomposed(pairs).select("s_id", "t_id", "im").collect():
        assert r.im == G.relate(G.from_wkt(texts[int(r.s_id)]), G.from_wkt(texts[int(r.t_id)])), r


def test_every_entry_point(spark, tmp_path):
    box = lambda x, y, n: f"POLYGON (({x} {y}, {x + n} {y}, {x + n} {y + n}, {x} {y + n}, {x} {y}))"
    (tmp_path / "a.tsv").write_text("".join(f"{box(i, i % 3, 2)}\ta{i}\n" for i in range(12)))
    (tmp_path / "b.tsv").write_text("".join(f"{box(i + 0.5, i % 2, 1)}\tb{i}\n" for i in range(12)))
    a, b = (Dataset(str(tmp_path / f"{n}.tsv"), "1", "0") for n in "ab")
    job = Job(a, b, budget=20, scheme="COMPOSITE", secondary_weight="MBRO", batch_size=5)
    rows = {n: f(spark, job).collect() for n, f in jobs.ENTRIES.items()}
    assert rows["batch"] == rows["balanced"] and rows["batch"][0]["intersects"] == len(rows["relation"]) == len(rows["sql"]) > 20
    assert [r["rank"] for r in sorted(rows["progressive"], key=lambda r: r["rank"])] == list(range(1, 21))
    assert rows["evaluation"][0]["verified"] == 20 and len(rows["stopping"]) == 3 and len(rows["generate"]) == 24 and len(rows["timings"]) == 2
    for algorithm in ("DYNAMIC_PROGRESSIVE_GIANT", "EARLY_STOPPING", "TOPK", "RECIPROCAL_TOPK", "RANDOM"):
        assert jobs.evaluation(spark, replace(job, algorithm=algorithm)).collect()[0]["verified"] > 0
    for entity in ("DECOMPOSED_ENTITY", "INDEXED_DECOMPOSED_ENTITY"):
        assert jobs.batch(spark, replace(job, entity=entity, decomposition=1.0)).collect() == rows["batch"]
    with pytest.raises(ValueError):
        parse(["-source", "x.unknown", "-pa", "TOPK"])
    assert parse(["-source", str(tmp_path), "-pa", "TOPK"]).source.problems() == []


def test_dynamic_boost(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0.0, 1, 0), (2, 2, 0.8, 0.0, 0, 0), (1, 3, 0.5, 0.0, 0, 0)], "s_id int, t_id int, mw double, sw double, related int, pid int")
    order = [(r.s_id, r.t_id) for r in progressive.dynamic(df, ["pid"]).orderBy("rank").collect()]
    assert order == [(1, 1), (1, 3), (2, 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("POINT (1 2)\tx\np1\nPOLYGON ((0 0, 1 0, 1 1, 0 0))\ty\nPOINT EMPTY\tz\n")
    assert [r.id for r in readers.read_dataset(spark, str(tmp_path / "a.tsv"), "1", "0").orderBy("id").collect()] == ["x", "y"]
    (tmp_path / "b.nt").write_text('<http://x/1> <http://g> "POINT (3 4)"^^<http://w> .\n<http://x/2> <http://h> "POINT (3 4)" .\n')
    (row,) = readers.read_dataset(spark, str(tmp_path / "b.nt"), "", "<http://g>").collect()
    assert row.id == "http://x/1" and row.env.minx == 3.0
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"k":"7"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{"k":"8"},"geometry":{"type":"Point","coordinates":[1,1]}}]}')
    got = {r.id: (r.dim, r.npoints) for r in readers.read_dataset(spark, str(tmp_path / "c.geojson"), "k", "").collect()}
    assert got == {"7": (2, 4), "8": (0, 1)}
    one = lambda k: f'{{"type":"Feature","properties":{{"k":"{k}"}},"geometry":{{"type":"Point","coordinates":[{k},1]}}}}'
    (tmp_path / "d.geojson").write_text('{"type":"FeatureCollection",\n"features":[\n' + ",\n".join(map(one, range(5))) + "\n]}")
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[' + one(1).replace(",", ",\n") + "]}")
    (tmp_path / "f.geojson").write_text("\n".join(map(one, range(3))) + "\n\n")
    for name, n in (("d", 5), ("e", 1), ("f", 3)):
        assert [r.id for r in readers.read_dataset(spark, str(tmp_path / f"{name}.geojson"), "k", "").orderBy("id").collect()] == [str(k) for k in ([1] if n == 1 else range(n))]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("source: {path: a.tsv, realIdField: 1, geometryField: 0}\ntarget: {path: b.tsv, realIdField: 1, geometryField: 0}\nrelation: contains\nconfigurations: {partitions: 8, budget: 10}\n")
    job = parse(["-c", str(tmp_path / "c.yaml"), "-b", "20", "-ws", "HYBRID"])
    assert (job.relation, job.partitions, job.budget, job.scheme, job.source.id_field) == ("contains", 8, 20, "HYBRID", "1")
    with pytest.raises(ValueError):
        parse(["-relation", "near"])

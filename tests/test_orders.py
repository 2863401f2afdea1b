"""Pairs of geometries that are all of their envelope: the kernel judges each order of coordinates once."""

import random
import re

from pyspark.sql import functions as F

from tilewright import queries as Q
from tilewright import queries_more  # noqa: F401  registers its queries with the library's
from tilewright.functions import envelope as E
from tilewright.functions import geometry as G
from tilewright.functions import matrix as M
from tilewright.functions import orders
from tilewright.operators import decompose, interlink
from tilewright.sources import readers

FILLING = ("POINT (1 2)", "LINESTRING (1 2, 5 2)", "LINESTRING (1 7, 1 2)", "POLYGON ((0 0, 0 3, 4 3, 4 0, 0 0))", "POLYGON ((4 3, 0 3, 0 0, 4 0, 4 3))")
OTHER = (
    "LINESTRING (0 0, 3 4)", "LINESTRING (0 0, 1 0, 3 0)", "MULTIPOINT ((0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 1 3, 0 0))",
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTILINESTRING ((0 0, 3 0))", "LINESTRING (0 0, 3 0, 3 3, 0 3, 0 0)",
)


def _wkt(rng):
    x, y = rng.randint(0, 5), rng.randint(0, 5)
    u, v = x + rng.randint(1, 4), y + rng.randint(1, 4)
    ring = [(x, y), (u, y), (u, v), (x, v)]
    ring = ring[rng.randint(0, 3) :] + ring
    ring = ring[:4][:: rng.choice((1, -1))]
    text = lambda ps: ", ".join(f"{a} {b}" for a, b in ps)
    flat = [(x, y), rng.choice(((u, y), (x, v)))][:: rng.choice((1, -1))]
    return rng.choice((f"POINT ({x} {y})", f"LINESTRING ({text(flat)})", f"POLYGON (({text([*ring, ring[0]])}))"))


def _entities(spark, texts):
    return readers.entities(spark.createDataFrame(list(enumerate(texts)), "id bigint, wkt string")).withColumn("id", F.col("id").cast("bigint"))


def test_what_fills_its_envelope():
    for text in (*FILLING, *OTHER):
        g = G.from_wkt(text)
        assert orders.fills(G.to_wkb(g), *G.envelope(g)) == (text in FILLING), text
    g = G.from_wkt(FILLING[3])
    assert not orders.fills(G.to_wkb(g), 0.0, 0.0, 4.0, 9.0)


def test_the_relations_of_judged_orders(spark):
    """Without Spark and with it: the same relations for every matrix and the dimensions of its geometries."""
    rows = [(im, ds, dt) for im in sorted({im for im, _ in orders.judged()}) for ds in range(3) for dt in range(3)]
    frame = M.with_relations(spark.createDataFrame(rows, "im string, s_dim int, t_dim int"))
    for r in frame.collect():
        told = M.named(r.im, r.s_dim, r.t_dim)
        assert all(told[n] == r[n] for n in M.NAMES), r


def test_all_pairs_as_by_the_kernel(spark):
    """Lines, points and rectangles against each other, and among geometries that still go to the kernel."""
    rng = random.Random(5)
    filling = [_wkt(rng) for _ in range(60)]
    for left, right in ((filling, filling[::-1]), ([*filling, *OTHER], [*OTHER, *filling])):
        s, t = _entities(spark, left), _entities(spark, right)
        got = interlink.de9im(s, t, interlink.grid(s, t)).collect()
        shapes = [[G.from_wkt(x) for x in side] for side in (left, right)]
        seen = {(r.source_id, r.target_id): r for r in got}
        assert len(seen) == len(got)
        for i, a in enumerate(shapes[0]):
            for j, b in enumerate(shapes[1]):
                want = G.relate(a, b)
                if (i, j) not in seen:
                    assert want.startswith("FF") and want[3:5] == "FF"
                    continue
                told = M.named(want, G.dimension(a), G.dimension(b))
                assert seen[i, j].im == want, (left[i], right[j])
                assert all(seen[i, j][n] == told[n] for n in M.NAMES), (left[i], right[j])


def test_no_pair_takes_its_wkb_along(spark, data):
    """Pairs of such entities are neither shuffled nor sent to Python, and entities are shuffled without WKB."""
    for name in ("points_by_kernel", "polygons_by_kernel", "lines_by_kernel", "segments_by_kernel"):
        plan = Q.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "wkb" not in plan.split("Scan parquet")[0], name
        assert plan.count("Exchange hashpartitioning") == 2, name


def test_parts_are_asked_only_for_the_kernel(spark, data):
    """Pairs of such entities are made once, and have the matrices that their parts and the kernel give."""
    plan = Q.QUERIES["decomposed_links"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "ArrowEvalPython" not in plan
    s, z = (interlink.formed(decompose.with_fine_envelopes(Q._with_wkb(df).withColumn("is_box", F.lit(False)), queries_more.EIGHT)) for df in (Q.segments(spark, data), Q.zones(spark, data)))
    pairs = interlink.candidates(s, z, interlink.grid(z, s))
    told = lambda p: sorted(tuple(r) for r in interlink.relate_decomposed(p).select("s_id", "t_id", "im").collect())
    assert told(pairs) == told(pairs.drop("s_fills", "t_fills"))


def test_decomposed_links_look_up_their_relations(spark, data):
    """Their relations follow from the order of coordinates; no matrix is read as text, and the JVM compiles the join's code."""
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = Q.QUERIES["decomposed_links"](spark, data)._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "RLIKE" not in plan.toString()
    joins = [p for p in code.split("== Subtree") if "SortMergeJoin" in p.split("Generated code")[0]]
    assert joins and all(int(n) <= 8000 for p in joins for n in re.findall(r"maxMethodCodeSize:(\d+)", p))


def test_relations_by_parts(spark):
    """The same as without parts, for entities that fill their envelope, others, and both."""
    rng = random.Random(7)
    filling = [_wkt(rng) for _ in range(40)]
    for left, right in ((filling, filling[::-1]), ([*filling, *OTHER], [*OTHER, *filling])):
        s, t = (interlink.formed(decompose.with_fine_envelopes(_entities(spark, side), E.Theta(2.0, 2.0))) for side in (left, right))
        pairs = interlink.candidates(s, t, interlink.grid(s, t))
        told = lambda **by: sorted(tuple(r) for r in interlink.with_relations(pairs, **by).select("s_id", "t_id", "im", *M.NAMES).collect())
        assert told() == told(by_parts=True)


def test_an_order_is_cast_once_for_each_axis(spark):
    """A checked cast of each sign takes longer than all the rest of a pair."""
    box = lambda n: E.box(*[F.col(f"{n}{i}") for i in range(4)])
    frame = spark.createDataFrame([(0.0,) * 8], ", ".join(f"{n}{i} double" for n in "ab" for i in range(4)))
    plan = frame.select(orders.order(box("a"), box("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(") == 2


def test_finer_envelopes_are_made_only_for_the_kernel(spark, data, monkeypatch):
    """Lines and boxes that are all of their envelope get none; with other geometries, all entities have them."""
    seen, real = [], interlink.written
    monkeypatch.setattr(interlink, "written", lambda df, name: seen.append(df.columns) or real(df, name))
    plan = Q.QUERIES["decomposed_links"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 2 and "envs" not in [*seen[0], *seen[1]] and "ArrowEvalPython" not in plan
    for df in interlink.formed_in_parts(_entities(spark, [*FILLING, *OTHER]), _entities(spark, FILLING), E.Theta(1.0, 1.0)):
        assert "envs" in seen[-1] and df.count() and df.where("envs is null or size(envs) = 0").count() == 0


def test_rectangles_are_valid_at_once():
    """Rings of four edges along the axes that turn at each corner, and no others."""
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    for k in range(4):
        turned = ring[k:] + ring[:k]
        for r in (turned, turned[::-1]):
            assert G._is_rectangle([*r, r[0]]) and G.is_valid(("POLYGON", [[[*r, r[0]]]]))
    for bad in ([(0, 0), (1, 0), (3, 0), (2, 0)], [(0, 0), (4, 0), (4, 0), (0, 0)], [(0, 0), (4, 3), (4, 0), (0, 3)], [(0, 0), (4, 0), (0, 0), (4, 0)]):
        assert not G._is_rectangle([*bad, bad[0]]) and not G.is_valid(("POLYGON", [[[*bad, bad[0]]]]))

"""What large tables need: joins without broadcasts, schedules without a sort of all pairs, balance without lists."""

import re

import pytest
from pyspark.sql import functions as F

from tilewright import queries as Q
from tilewright import queries_more as QM
from tilewright.functions import envelope as E
from tilewright.operators import balance, interlink, progressive


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_never_broadcast(spark, data):
    """The files are small, but their rows for each tile need not be."""
    for name in ("pair_weights", "fine_pairs", "indexed_pairs", "polygons_by_kernel", "points_by_kernel", "executed_batches"):
        assert "BroadcastHashJoin" not in _plan(Q.QUERIES[name](spark, data)), name


def test_most_pairs_of_a_tile_are_only_compared(spark, data):
    """Whether envelopes meet is asked before which tile answers, and tiles of one level need no power."""
    for name in ("pair_weights", "fine_pairs", "points_by_kernel"):
        join = _plan(Q.QUERIES[name](spark, data)).split("SortMergeJoin", 1)[1].split("\n")[0]
        assert "<=" in join and join.index("<=") < join.index("FLOOR") and "POWER" not in join, name


def test_pairs_are_compiled(spark, data):
    """The JVM never compiles a method of over 8000 bytes, and Spark no join with lambdas; pairs then take many times as long."""
    for name in ("pair_weights", "fine_pairs"):
        spark.conf.set("spark.sql.adaptive.enabled", False)
        try:
            plan = Q.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan()
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        joins = [p for p in code.split("== Subtree") if "SortMergeJoin" in p.split("Generated code")[0]]
        assert joins and all(int(n) <= 8000 for p in joins for n in re.findall(r"maxMethodCodeSize:(\d+)", p)), name


def test_parts_known_to_be_few(spark):
    """The same as by lambdas, for no part to two; more than told are an error, never left out."""
    box = lambda x: E.box(x, F.lit(0.0), x + F.pmod("id", F.lit(3)), F.lit(2.0))
    envs = F.slice(F.array(box(F.col("x")), box(F.col("x") + 6)), F.lit(1), F.pmod("id", F.lit(4)).cast("int") % 3)
    of = lambda k: spark.range(40).withColumn("x", (F.col("id") * k % 23).cast("double")).select("id", E.box(F.col("x"), F.lit(0.0), F.col("x") + 9, F.lit(2.0)).alias("env"), envs.alias("envs"))
    theta, a, b = E.Theta(4.0, 4.0), F.col("s_envs"), F.col("t_envs")
    told = lambda pairs, n: sorted(str(tuple(r)) for r in pairs.select("s_id", "t_id", E.first_meeting(a, b, n), *E.fine_reference_point(F.col("s_env"), F.col("t_env"), a, b, theta, n), E.fine_common_tiles(a, b, theta, n)).collect())
    s, t = of(7), of(11)
    found = told(interlink.candidates(s, t, theta, fine=True), 0)
    assert found and found == told(interlink.candidates(s, t, theta, fine=True, parts=2), 2)
    with pytest.raises(Exception, match="more than 1 parts"):
        interlink.candidates(s, t, theta, fine=True, parts=1).collect()


def _rows(spark, n=40):
    """Pairs with many ties of their weight."""
    return spark.range(n * n).select((F.col("id") % n).alias("s_id"), F.floor(F.col("id") / n).alias("t_id"), F.struct((F.pmod(F.xxhash64("id"), F.lit(5)) / 5.0).alias("a")).alias("rank_key"))


def _spied(monkeypatch):
    sizes, real = [], progressive.written

    def spy(df, name):
        out = real(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(progressive, "written", spy)
    return sizes


def test_a_small_budget_writes_no_other_pairs(spark, monkeypatch):
    sizes, pairs = _spied(monkeypatch), _rows(spark)
    got = [tuple(r) for r in progressive.placed(pairs, progressive.best_first(), 30).orderBy("rank").select("s_id", "t_id", "rank").collect()]
    every = sorted((-r.rank_key.a, r.s_id, r.t_id) for r in pairs.collect())
    assert got == [(s, t, i + 1) for i, (_, s, t) in enumerate(every[:30])]
    assert sizes == [30]
    monkeypatch.setattr(progressive, "TAKEN", 10)  # the sort of all pairs gives the same
    assert got == [tuple(r) for r in progressive.placed(pairs, progressive.best_first(), 30).orderBy("rank").select("s_id", "t_id", "rank").collect()]


def test_top_pairs_of_entities_come_from_the_best_of_all(spark, monkeypatch):
    """The best pairs tell who is near, as long as enough of them are; else all pairs are ranked."""
    sizes, pairs = _spied(monkeypatch), _rows(spark)
    every = sorted((-r.rank_key.a, r.s_id, r.t_id) for r in pairs.collect())
    for algorithm, budget, join in (("TOPK", 20, any), ("RECIPROCAL_TOPK", 20, all), ("RECIPROCAL_TOPK", 70, all)):
        k_s, k_t = ((budget // 80 + 1) * 2,) * 2 if algorithm == "TOPK" else ((budget // 40 + 1) * 2,) * 2
        of_s, of_t, want = {}, {}, []
        for _, s, t in every:
            of_s[s], of_t[t] = of_s.get(s, 0) + 1, of_t.get(t, 0) + 1
            if join((of_s[s] <= k_s, of_t[t] <= k_t)):
                want.append((s, t))
        for taken in (80, 200, 1 << 16):
            monkeypatch.setattr(progressive, "TAKEN", taken)
            sizes.clear()
            got = progressive.schedule(pairs, algorithm, budget, 40, 40).orderBy("rank")
            assert [(r.s_id, r.t_id) for r in got.collect()] == want[:budget], (algorithm, taken)
            assert max(sizes) <= max(taken, budget) or taken < 4 * budget


def _touching(spark):
    return spark.range(400).select((F.col("id") % 7).alias("t_id"), F.col("id").alias("s_id"), F.sequence(F.col("id") % 3, F.col("id") % 3 + F.col("id") % 4).alias("segments"))


def test_sets_are_balanced_by_their_sizes_alone(spark):
    """Counts give what lists give, and each set's sources are never listed."""
    pairs, limits = _touching(spark), {"average": 40, "buffer": 15}
    told = lambda df: sorted((r.t_id, tuple(r.segment_set), tuple(r["into"])) for r in df.collect())
    listed, counted = (balance.balanced_sets(f(pairs), **limits) for f in (balance.segment_sets, balance.set_sizes))
    assert told(listed) == told(counted)
    assert any(a != b for _, a, b in told(counted))
    assert "collect_list" not in _plan(balance.set_sizes(pairs))


def test_batches_make_their_pairs_once(spark):
    pairs = _touching(spark)
    rows = balance.segment_batches(pairs, batch=4)
    assert _plan(rows).count("Range (") == 1
    got = sorted((r.t_id, s, tuple(r.segment_set)) for r in rows.collect() for s in r.s_ids)
    assert got == sorted((r.t_id, r.s_id, tuple(r.segments)) for r in pairs.collect())


def test_costs_are_counted_once(spark, data, monkeypatch):
    seen, real = [], balance.written
    monkeypatch.setattr(balance, "written", lambda df, name: seen.append(name) or real(df, name))
    pairs = QM._candidates(spark, data)
    _, skewed = balance.split_skewed(pairs, 1.0)
    assert seen == ["costs"]
    cost = {r.t_id: r.cost for r in balance.costs(pairs).collect()}
    mean = sum(cost.values()) / len(cost)
    sd = (sum((c - mean) ** 2 for c in cost.values()) / len(cost)) ** 0.5
    assert {r.t_id for r in skewed.collect()} == {t for t, c in cost.items() if c > mean + sd}


def test_interiors_of_boxes_meet_as_the_matrix_says(spark):
    rows = [(a, a + w, b, b + v) for a in range(6) for w in (1, 3) for b in range(6) for v in (1, 3)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    x = df.select(E.box(F.lit(2.0), F.lit(2.0), F.lit(4.0), F.lit(4.0)).alias("s"), E.box(*[F.col(c).cast("double") for c in "acbd"]).alias("t")).where(E.intersects(F.col("s"), F.col("t")))
    told = x.select(E.inner(F.col("s"), F.col("t")).alias("inner"), E.box_matrix(F.col("s"), F.col("t")).startswith("2").alias("im")).collect()
    assert {r.inner for r in told} == {True, False} and all(r.inner == r.im for r in told)

"""Entry points: batch, single-relation and progressive interlinking, and statistics, from a job specification."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..operators import balance, decompose, generator, interlink, progressive
from ..sources import readers
from .config import Dataset, Job
from .scratch import written


def load(spark: SparkSession, d: Dataset, predicate: str | None = None) -> DataFrame:
    return readers.read_dataset(spark, d.path, d.id_field or "", d.geometry_field or predicate or "", d.date_field, d.date_pattern, d.file_type)


def inputs(spark: SparkSession, job: Job):
    """Source and target entities as the job wants them, the tile size, and options of the candidate join."""
    source, target = load(spark, job.source, job.geometry_predicate), load(spark, job.target, job.geometry_predicate)
    g = interlink.grid(source, target, job.theta)
    options = {"temporal": job.entity == "SPATIOTEMPORAL_ENTITY"}
    if job.approximation == "FINEGRAINED_ENVELOPES" or job.entity in ("DECOMPOSED_ENTITY", "INDEXED_DECOMPOSED_ENTITY"):
        fine = g.theta * (job.decomposition or 1.0)
        source, target = (decompose.with_fine_envelopes(d, fine) for d in (source, target))
        options["fine"] = True
    return source, target, g, options


def batch(spark: SparkSession, job: Job) -> DataFrame:
    """Counts of all relations, one row; writes the links as RDF if the job exports."""
    source, target, g, options = inputs(spark, job)
    links = interlink.de9im(source, target, g, **options)
    if job.export:
        readers.write_rdf(links, job.export)
    return M.total_relations(M.counts(links))


def single_relation(spark: SparkSession, job: Job) -> DataFrame:
    source, target, g, options = inputs(spark, job)
    pairs = interlink.relate(source, target, job.relation, g, **options)
    if job.export:
        readers.write_ntriples(pairs, job.export)
    return pairs


def scheduled(spark: SparkSession, job: Job) -> DataFrame:
    """The pairs of the job's schedule, in order (`rank`)."""
    source, target, g, options = inputs(spark, job)
    pairs = interlink.candidates(source, target, g, **options)
    blocks = progressive.total_blocks(source, g.theta)
    weighted = progressive.weighted(pairs, g.theta, blocks, job.main_weight, job.secondary_weight, job.scheme)
    return progressive.schedule(weighted, job.algorithm, job.budget or 3000, source.count(), target.count())


def progressive_links(spark: SparkSession, job: Job) -> DataFrame:
    """Verified pairs of the schedule, in order (`rank`), with `related`."""
    def verify(pairs: DataFrame) -> DataFrame:
        return interlink.verify(pairs).withColumn("related", M.holds(job.relation, F.col("im"), F.col("s_dim"), F.col("t_dim")).cast("int"))

    chosen = scheduled(spark, job)
    if job.algorithm == "EARLY_STOPPING":
        return progressive.stop_early(chosen, verify, job.batch_size, job.violations, job.precision_limit)
    if job.algorithm == "DYNAMIC_PROGRESSIVE_GIANT":
        parts = job.partitions if job.partitions > 0 else int(spark.conf.get("spark.sql.shuffle.partitions"))
        slim = verify(chosen).select("s_id", "t_id", "mw", "sw", "lw", "related", F.pmod(F.xxhash64("t_id"), F.lit(parts)).alias("pid"))
        return progressive.dynamic(slim, ["pid"], job.scheme)
    return verify(chosen)


def balanced(spark: SparkSession, job: Job) -> DataFrame:
    """Counts of all relations, one row; the pairs of costly targets are dealt evenly before they are verified."""
    source, target, g, options = inputs(spark, job)
    cheap, skewed = balance.split_skewed(interlink.candidates(source, target, g, **options))
    parts = job.partitions if job.partitions > 0 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    verified = interlink.verify(cheap.unionByName(balance.redistribute(skewed, parts)))
    return M.total_relations(M.counts(verified))


def evaluation(spark: SparkSession, job: Job, budgets: list[int] | None = None) -> DataFrame:
    """Recall, precision and progressive geometry recall of the job's schedule; `qp` gives the number of qualifying pairs, else all candidates are verified for it."""
    total = job.qualifying_pairs
    if total is None:
        source, target, g, options = inputs(spark, job)
        total = interlink.relate(source, target, job.relation, g, **options).count()
    verified = progressive_links(spark, job)
    return progressive.evaluate_run(verified, job.algorithm, budgets or [job.budget or 3000], total)


def stopping_evaluation(spark: SparkSession, job: Job, batches: list[int] | None = None, precisions: list[float] | None = None, violations: list[int] | None = None) -> DataFrame:
    """Early stopping under all combinations of its settings, the most precise first."""
    verified = written(progressive_links(spark, replace(job, algorithm="PROGRESSIVE_GIANT")).select("rank", "related"), "verified")
    rows = progressive.grid_search(verified, batches or [job.batch_size], precisions or [job.precision_limit], violations or [3, 4, 5])
    return spark.createDataFrame([tuple(r.values()) for r in rows], "batch bigint, precision_limit double, violations bigint, verified bigint, qualifying bigint, precision double")


def sql_comparison(spark: SparkSession, job: Job) -> DataFrame:
    """The single relation by the SQL front end, for comparison with `single_relation`."""
    source, target, g, _ = inputs(spark, job)
    source.createOrReplaceTempView("source_entities")
    target.createOrReplaceTempView("target_entities")
    return interlink.theta_join(spark, "source_entities", "target_entities", job.relation, g)


def generate(spark: SparkSession, job: Job, times: int = 1) -> DataFrame:
    """Copies of the source under other coordinates, as WKT and id; written if the job exports."""
    out = generator.texts(generator.perturbed(load(spark, job.source, job.geometry_predicate), times))
    if job.export:
        out.write.mode("overwrite").option("sep", "\t").csv(job.export)
    return out


def timed(steps: dict[str, Callable[[], DataFrame]]) -> list[tuple[str, float]]:
    """Seconds that each step takes to plan and run; rows go nowhere."""
    out = []
    for name, step in steps.items():
        began = time.perf_counter()
        step().write.format("noop").mode("overwrite").save()
        out.append((name, time.perf_counter() - began))
    return out


def timings(spark: SparkSession, job: Job) -> DataFrame:
    """Seconds of scheduling alone and of scheduling with verification."""
    steps = {"scheduling": lambda: scheduled(spark, job), "verification": lambda: progressive_links(spark, job)}
    return spark.createDataFrame(timed(steps), "step string, seconds double")


def statistics(spark: SparkSession, job: Job) -> DataFrame:
    source, target, g, _ = inputs(spark, job)
    return balance.statistics(source, target, g.theta)


#: Entry points by name; without one the job's own settings tell.
ENTRIES = {"batch": batch, "relation": single_relation, "progressive": progressive_links, "balanced": balanced, "evaluation": evaluation, "stopping": stopping_evaluation, "sql": sql_comparison, "generate": generate, "statistics": statistics, "timings": timings}


def main(arguments: list[str] | None = None) -> None:
    import sys

    from .config import parse

    given = sys.argv[1:] if arguments is None else arguments
    name, given = (given[1], given[2:]) if given[:1] == ["-entry"] else (None, given)
    job = parse(given)
    spark = SparkSession.builder.getOrCreate()
    run = ENTRIES[name] if name else statistics if job.stats else progressive_links if job.budget else batch if job.relation == "DE9IM" else single_relation
    run(spark, job).show(truncate=False)


if __name__ == "__main__":
    main()

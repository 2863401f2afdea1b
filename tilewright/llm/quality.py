"""Quality: a document classifier's evidence, shrunk through site and path posteriors by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, prepare, quoted, slices, written
from .urls import BoostedTrees
from .words import count_distinct, split_words

LEAST = 1e-3
#: Columns that `score_quality` adds.
ADDED = ("doc_score", "site_score", "path_score", "quality_score", "keep")


STYLE = ("log_length", "upper", "symbols", "digits", "word_length", "variety", "lines")
#: Kinds of bytes: A-Z, 0-9, other ASCII signs but point and comma, line feeds, first bytes of a character.
_KINDS = np.zeros((5, 256), np.int64)
_KINDS[0, 65:91] = 1
_KINDS[1, 48:58] = 1
_KINDS[2, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = 1
_KINDS[3, 10] = 1
_KINDS[4, [b for b in range(256) if b & 0xC0 != 0x80]] = 1


def style(texts: list[str]) -> np.ndarray:
    """Measures of each whole text's form, a row for each; the empty text has them too."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    n = len(raw)
    sizes = np.array([len(r) for r in raw], np.int64)
    joined = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    counts = np.zeros((5, n))
    if len(full):
        for k in range(5):
            counts[k, full] = np.add.reduceat(_KINDS[k].astype(np.int32)[joined], begin[full])
    upper, digits, symbols, lines, chars = counts
    hashes, of = split_words(raw, lower=False)
    words = np.maximum(np.bincount(of, minlength=n), 1)
    variety = count_distinct(hashes, of, n) / words**0.8
    size = np.maximum(chars, 1)
    return np.stack([np.log1p(chars), upper / size, symbols / size, digits / size, size / words, variety, lines / words], 1)


def with_style(docs: DataFrame) -> DataFrame:
    """`docs` with a column `__style`: an array of the measures."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                x = style([t or "" for t in part.column(at).to_pylist()])
                yield pa.record_batch([*part.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*part.schema.names, "__style"])

    return docs.mapInArrow(run, f"{quoted(docs)}, __style array<double>")


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(p / (1 - p))


def fit_style(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> BoostedTrees:
    """A classifier of `style` from labelled documents; the first `most_labelled` labels by a hash of their id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = F.broadcast(first_by_hash(known, known.count(), most_labelled, "doc_id"))
    rows = with_style(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y")).select("y", "__style").collect()
    x = np.array([r["__style"] for r in rows], float).reshape(len(rows), len(STYLE))
    return BoostedTrees(rounds=40).fit(list(STYLE), x, np.array([r["y"] for r in rows], float))


def concentration(groups: DataFrame, mean: float, parents: int = 1) -> float:
    """Prior strength by the moments of group means around those of their `parents` (column m): large if groups differ no more than chance would have them."""
    far = F.col("s") / F.col("n") - F.col("m")
    r = groups.agg(F.sum(far * far).alias("between"), F.avg(F.col("m") * (1 - F.col("m")) / F.col("n")).alias("noise"), F.count("*").alias("k")).first()
    free = r["k"] - parents
    spread = max((r["between"] or 0.0) / free - (r["noise"] or 0.0) if free > 0 else 0.0, 1e-4)
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 1e4))


def score_quality(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", threshold: float = 0.5, weight: float = 0.5, without: tuple[str, ...] = ()) -> DataFrame:
    """`docs`, without the columns named in `without`, with doc_score, site_score, path_score, quality_score and keep.

    doc_score is the classifier's probability of good quality. Sites (`site`) and their paths (`site`, `path`) get
    posteriors from sums over all documents: a path's mean shrinks toward its site's, the site's toward the global
    mean; the strengths come from the spread of sites and, within sites, of paths. quality_score adds the path's log odds against the global
    ones, times `weight`, to the document's; keep means `threshold` or more.

    Null text: as empty. Null site or path: a group of its own. Without labels every doc_score is 0.5. Repeated rows
    count as often as they stand; labels that repeat a document: the lowest counts. Empty tables: empty. Columns of
    `docs` named like the added ones are replaced. Groups are summed with partial sums first, so a site with a third of
    all rows is one row a task; the scored
    documents are written once to the shared folder, and not shuffled unless the table of paths is too large to broadcast.
    """
    model = fit_style(docs, labels)
    keys = {"__site": F.coalesce(F.col(site).cast("string"), F.lit("")), "__path": F.coalesce(F.col(path).cast("string"), F.lit(""))}
    doc_score = model.column({k: F.col("__style")[i] for i, k in enumerate(STYLE)})
    scored = with_style(docs.drop("doc_score", "__style")).withColumns(keys | {"doc_score": doc_score}).drop("__style")
    scored = written(scored.select(*[c for c in scored.columns if c not in without]), "scored")
    paths = written(scored.groupBy("__site", "__path").agg(F.sum("doc_score").alias("s"), F.count("*").alias("n")), "paths")
    sites = paths.groupBy("__site").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = sites.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    n_sites = sites.count()
    middle = sites.agg(F.avg(F.col("s") / F.col("n"))).first()[0] or mean
    around = paths.join(sites.select("__site", (F.col("s") / F.col("n")).alias("m")), "__site")  # a site's paths differ around its own mean
    for_sites, for_paths = concentration(sites.withColumn("m", F.lit(float(middle))), mean), concentration(around, mean, n_sites)
    sites = sites.select("__site", ((F.col("s") + for_sites * mean) / (F.col("n") + for_sites)).alias("site_score"))
    posteriors = paths.join(sites, "__site").select("__site", "__path", "site_score", ((F.col("s") + for_paths * F.col("site_score")) / (F.col("n") + for_paths)).alias("path_score"))
    joined = scored.drop("site_score", "path_score", "quality_score", "keep").join(posteriors, ["__site", "__path"], "left")
    odds = logit(F.col("doc_score")) + weight * (logit(F.col("path_score")) - logit(F.lit(float(mean))))
    out = joined.withColumn("quality_score", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("quality_score") >= threshold)
    return out.drop("__site", "__path")

"""URL filters: host and path rules first, then gradient-boosted trees over lexical features. Columns only on the main path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules of the query, as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features, numbers all; `suffix` (the host's last label) stands beside them."""
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    chars = F.split(text, "")
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    share = F.transform(F.array_distinct(chars), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return {
        "length": size.cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(digits, size), F.lit(0.0)),
        "entropy": F.when(size > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))).otherwise(0.0),
        "parameters": (F.size(F.split(text, "[?&][^=&#?]+="))-1).cast("double"),
        "host_labels": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
        "host_hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
    }


class BoostedTrees:
    """Binary gradient boosting with trees of depth two over binned features; `column` scores natively."""

    def __init__(self, rounds: int = 30, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.rounds, self.rate, self.bins, self.least = rounds, rate, bins, least
        self.base, self.trees, self.names = 0.0, [], []

    def fit(self, names: list[str], x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.names, self.trees = names, []
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        bin_of = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree = self._grow(bin_of, cuts, g, h, np.ones(len(y), bool), 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _leaf(self, g, h, rows):
        return float(self.rate * g[rows].sum() / (h[rows].sum() + self.least))

    def _grow(self, bin_of, cuts, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gs = np.cumsum(np.bincount(bin_of[j, rows], g[rows], len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(bin_of[j, rows], h[rows], len(c) + 1))[:-1]
            gain = gs**2 / (hs + self.least) + (total_g - gs) ** 2 / (total_h - hs + self.least) - total_g**2 / (total_h + self.least)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] is None:
            return self._leaf(g, h, rows)
        left = rows & (bin_of[best[1]] <= best[2])
        right = rows & ~left
        if depth == 1:
            return best[1], float(cuts[best[1]][best[2]]), self._leaf(g, h, left), self._leaf(g, h, right)
        return best[1], float(cuts[best[1]][best[2]]), self._grow(bin_of, cuts, g, h, left, depth - 1), self._grow(bin_of, cuts, g, h, right, depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._apply(tree[2], x), self._apply(tree[3], x))

    def column(self, values: dict[str, Column]) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(values[self.names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, most_labelled: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """`pages` (page_id, url, more) with host, path, rule, block_score and verdict (allow or block).

    The longest fitting rule decides; without one the trees do: block at `threshold` or more. They learn from
    `labelled` (url, blocked 0/1), or from the urls of `pages` that a rule decides. The fit reads `most_labelled` or
    fewer different ones of those rows, the first by a hash of the url. The rate of blocked urls of each suffix is summed
    over all labelled rows, of every suffix, and joined; suffixes without a label get the prior.

    Null url, or one without `://`: host and path empty, no rule, judged by the trees. Empty tables: empty. Without
    labelled rows every score is one half of the prior's logit 0: 0.5. Repeated rows: each for itself, fitted once.
    Very long urls: whole. Columns of `pages` named like the added ones are replaced.
    """
    host, path = split_url(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "__ruled": verdict})
    if labelled is None:
        known = rows.where("rule is not null").select("url", "host", "path", (F.col("__ruled") == "block").cast("int").alias("y"))
    else:
        known = labelled.select("url", host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y")).where("y is not null")
    suffix = F.element_at(F.split(F.col("host"), r"\."), -1)
    rates = written(known.groupBy(suffix.alias("__suffix")).agg(F.count("*").alias("n"), F.sum("y").alias("s")), "suffixes")
    whole = rates.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = whole["s"] / whole["n"] if whole["n"] else 0.5
    rate = (F.col("s") + 10 * prior) / (F.col("n") + 10)
    # Twice as many by the hash as are wanted; only those are ordered.
    place = F.xxhash64("url")
    near = known.where(F.pmod(place, F.lit(1 << 20)) <= 2 * most_labelled / max(whole["n"] or 0, 1) * (1 << 20)).distinct()
    sample = near.orderBy(place, "url", "y").limit(most_labelled)
    found = features(F.col("url"), F.col("host"), F.col("path"))
    rates = rates.select("__suffix", rate.alias("__suffix_rate"))
    fit = sample.withColumn("__suffix", suffix).join(rates, "__suffix").select("y", F.col("__suffix_rate").alias("suffix_rate"), *[c.alias(k) for k, c in found.items()]).orderBy(place, "url", "y").collect()
    y = np.array([r["y"] for r in fit], float)
    names = [*found, "suffix_rate"]
    x = np.array([[*[r[k] for k in found], r["suffix_rate"]] for r in fit], float).reshape(len(fit), len(names))
    model = BoostedTrees().fit(names, x, y)
    rated = rows.withColumn("__suffix", suffix).join(rates, "__suffix", "left")
    ready = rated.withColumns({f"__{k}": c for k, c in found.items()} | {"__suffix_rate": F.coalesce("__suffix_rate", F.lit(float(prior)))})
    scored = ready.withColumn("block_score", model.column({k: F.col(f"__{k}") for k in names}))
    judged = F.coalesce(F.col("__ruled"), F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.withColumn("verdict", judged).drop("__ruled", "__suffix", *[f"__{k}" for k in names])

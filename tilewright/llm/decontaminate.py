"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity. Columns only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

SHINGLE = 5
#: Bits of each block; a radius of r leaves some block with at most r // len(BLOCKS) differing bits.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
WORDS = r"[^\p{L}\p{N}]+"

#: Shingles of items, with their items' lengths, that are sent to every task, at most (about 30 MB); more are joined by a shuffle.
MOST_SENT = 1_000_000

_SIMHASH = (
    "aggregate(sequence(0, 63), 0L, (f, j) -> f | CASE WHEN "
    "2 * aggregate({h}, 0, (n, x) -> n + CAST(shiftright(x, j) & 1L AS int)) > size({h}) THEN shiftleft(1L, j) ELSE 0L END)"
)
#: Multiset similarity: the sum of the lower counts by the sum of the higher ones; plain sets need no counting.
_SIMILARITY = """
CASE WHEN size(array_distinct(a)) = size(a) AND size(array_distinct(b)) = size(b)
THEN size(array_intersect(a, b)) / size(array_union(a, b))
ELSE aggregate(
  transform(array_union(a, b), x -> struct(size(filter(a, y -> y = x)) AS m, size(filter(b, y -> y = x)) AS n)),
  struct(0 AS lower, 0 AS higher),
  (s, c) -> struct(s.lower + least(c.m, c.n) AS lower, s.higher + greatest(c.m, c.n) AS higher),
  s -> s.lower / s.higher) END
"""


def worded(rows: DataFrame) -> DataFrame:
    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return fixed(rows, "words", F.filter(F.split(lowered, WORDS), lambda w: w != ""))


def shingled(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """`rows` (words) with `hashes`: a 64-bit value for each run of `width` words, in order, repeats included."""
    parts = ", ".join(f"get(words, i + {j})" for j in range(width))
    runs = f"CASE WHEN size(words) < {width} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(words) - {width}), i -> xxhash64({parts})) END"
    return fixed(rows, "hashes", F.expr(runs)).drop("words")


def fixed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """`rows` with a column that is computed once: no filter or projection above has its expression copied in."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def least_shared(n: Column, size: Column, similarity: float) -> Column:
    """Shingles of a window that stand in an item of `n`, at least, if the two have that similarity; a text of `size` < n is one window."""
    return F.greatest(F.lit(1), F.ceil(similarity * (n + F.least(n, size)) / (1 + similarity) - 1e-9)).cast("int")


def block_values(fingerprint: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for k, bits in enumerate(BLOCKS):
        out.append((k, f"shiftrightunsigned({fingerprint}, {at}) & {(1 << bits) - 1}L"))
        at += bits
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20) -> DataFrame:
    """Rows (doc_id, item_id, similarity, hamming, window_start, window_words): each item that a document repeats.

    A document's windows are as long as an item, in words, and hold as many shingles of items of that length as
    `similarity` cannot do without. Of those only the ones that end in such a shingle, or start the text, are tried: any
    other has one to its left that is no worse, so an item's best window, the first of equals, is among them. Each
    window's SimHash is matched with those of all items of its length: blocks of the fingerprint, with up to radius // 7 bits flipped on the items' side, find every item within
    `radius`; then the multiset similarity of the shingles, at least `similarity`, decides. The best window of each
    item stays. (Copies of 0.8 differ in 10 of 64 bits on average; 20 is 3.5 standard deviations more.)

    Documents are scanned for each shingle width (five words; fewer only for shorter items) and joined with the items'
    shingles, which go to every task if `MOST_SENT` or fewer, counted first. What matches is shuffled, and no text, but
    those of the documents that have a window to try, read again.

    Null or empty texts: no rows. An item of fewer than five words is one shingle as a whole. Very long texts: all their
    windows. Repeated rows count once, ids that stand for different texts keep their best window. Empty tables: empty.
    Other columns are left out, so none clashes.
    """
    texts = worded(benchmark.select("item_id", "text").where("text is not null")).where("size(words) > 0")
    texts = written(texts.select("item_id", "words").distinct(), "items")
    widths = sorted(r["w"] for r in texts.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("w")).distinct().collect()) or [SHINGLE]
    out = None
    for width in widths:
        of_width = texts.where(F.least(F.size("words"), F.lit(SHINGLE)) == width)
        found = _leaks(docs, shingled(of_width, width), width, similarity, radius)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(docs: DataFrame, items: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    items = written(items.select("item_id", "hashes").distinct(), "items")
    index = items.select(F.size("hashes").alias("n"), F.explode("hashes").alias("h")).distinct()
    index = written(index, "index")
    base = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key")).where("text is not null")
    words = shingled(worded(base.select("key", "text")), width).select("key", F.size("hashes").alias("size"), F.posexplode("hashes").alias("pos", "h"))
    found = words.join(F.broadcast(index) if index.count() <= MOST_SENT else index, "h")
    lined = found.groupBy("key", "n").agg(F.sort_array(F.collect_set("pos")).alias("p"), F.max("size").alias("size"))
    lined = fixed(lined, "need", least_shared(F.col("n"), F.col("size"), similarity)).where("size(p) >= need")
    starts = F.expr("transform(p, (x, i) -> IF(get(p, i - need + 1) > x - n, greatest(0, x - n + 1), NULL))")
    windows = lined.select("key", "n", F.explode(F.array_distinct(starts)).alias("start")).where("start is not null")
    windows = written(windows.groupBy("key").agg(F.collect_set(F.struct("n", "start")).alias("windows")), "windows")
    again = shingled(worded(base.join(windows, "key").dropDuplicates(["key"])), width)
    placed = again.select("key", "doc_id", "hashes", F.inline("windows"))
    placed = fixed(placed, "a", F.expr("slice(hashes, start + 1, n)")).drop("hashes")
    marked = fixed(placed, "f", F.expr(_SIMHASH.format(h="a")))
    theirs = items.select("item_id", F.size("hashes").alias("n"), F.col("hashes").alias("b"), F.expr(_SIMHASH.format(h="hashes")).alias("g"))
    flips = radius // len(BLOCKS)

    def masks(bits: int) -> str:
        every = [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)]
        return "array(" + ", ".join(f"{m}L" for m in every) + ")"

    near = " UNION ALL ".join(
        f"SELECT item_id, n, b, g, {k} AS block, ({value}) ^ mask AS value FROM {{theirs}} LATERAL VIEW explode({masks(bits)}) m AS mask"
        for (k, value), bits in zip(block_values("g"), BLOCKS, strict=True)
    )
    near = docs.sparkSession.sql(near, theirs=theirs)
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.expr(v).alias("value")) for k, v in block_values("f")])).alias("o")
    keyed = marked.select("*", own).select("key", "doc_id", "n", "start", "a", "f", "o.block", "o.value")
    met = keyed.join(near, ["n", "block", "value"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    pairs = fixed(met.dropDuplicates(["key", "n", "start", "item_id"]), "similarity", F.expr(_SIMILARITY))
    best = pairs.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("similarity", F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("hamming"), F.col("start").alias("window_start"), (F.col("n") + width - 1).alias("window_words")), F.struct("similarity", -F.col("start"))).alias("w")
    )
    return best.select("doc_id", "item_id", "w.*")

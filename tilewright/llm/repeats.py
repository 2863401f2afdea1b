"""Repeated byte strings: column-wise construction of a collection's transform and common prefixes around shared anchors."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, slices, written
from .words import mix

U = np.uint64
#: Bytes of an anchor; every string of the wanted length contains the anchors that it answers to.
GRAM = 64


def anchors(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, anchor hashes, anchor places, first and last window starts, for all windows of `length` bytes.

    A window's anchor is the place of its least GRAM-byte hash, the leftmost one of equals: a matter of its bytes alone.
    Neighbouring windows that share an anchor make one row; places count from the text's start.
    """
    sizes = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8)
    none = np.zeros(0, np.int64)
    width = length - GRAM + 1
    if len(b) < length:
        return none, none.astype(U), none, none, none
    h, k = mix(b.astype(U) + U(1)), 1
    while k < GRAM:
        h = mix(h[: len(h) - k] * U(0x9E3779B97F4A7C15) + h[k:] + U(k))
        k *= 2
    low = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    k = 1
    while 2 * k <= width:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
    least = (low & U(0xFFFFFFFF)).astype(np.int64)  # for the window that starts here
    begin = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    of = np.repeat(np.arange(len(raw)), count)
    if not len(starts):
        return none, none.astype(U), none, none, none
    place = least[starts]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    base = begin[of[first]]
    return of[first], h[place[first]], place[first] - base, starts[first] - base, starts[last] - base


def repeated_columns(strings: list[bytes], centres: list[int], length: int) -> list[np.ndarray]:
    """Which starts of each string begin `length` bytes that another string has at the same distance from its centre.

    The strings lie with their centres in one column. From the last column to the first, one symbol of each string is
    put before its suffix: a stable sort by that symbol turns the order of the suffixes into that of the longer ones,
    and the least common prefix over the old ranks between two neighbours, plus one, is their new common prefix. The
    column's symbols in the order of their suffixes are its segment of the collection's transform. Only suffixes of one
    column can share a window, so each column's segment stands for itself.

    Order and common prefixes live in two sequential files: a round reads one from its start to its end and writes the
    other, and the files change places. What a round finds with a common prefix of `length` is a repeat.
    """
    m = len(strings)
    right = max(len(s) - c for s, c in zip(strings, centres, strict=True))
    left = max(centres)
    cells = np.zeros((left + right, m), np.uint16)
    for i, (s, c) in enumerate(zip(strings, centres, strict=True)):
        cells[left - c : left - c + len(s), i] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    found = np.zeros((left + right, m), bool)
    with tempfile.TemporaryFile() as now, tempfile.TemporaryFile() as then:
        now.write(np.arange(m, dtype=np.int32).tobytes() + bytes(4 * m))
        for j in range(left + right - 1, -1, -1):
            now.seek(0)
            order, common = (np.frombuffer(now.read(4 * m), np.int32) for _ in range(2))
            symbols = cells[j, order]
            rank = np.argsort(symbols, kind="stable")
            symbols = symbols[rank]
            new = np.zeros(m, np.int32)
            same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] > 0))
            if len(same):
                a, z = rank[same] + 1, rank[same + 1]
                level = np.log2(z - a + 1).astype(np.int64)
                low, table = np.empty(len(same), np.int32), common
                for v in range(int(level.max()) + 1):
                    if v:
                        table = np.minimum(table[: -(1 << (v - 1))], table[1 << (v - 1) :])
                    at = level == v
                    low[at] = np.minimum(table[a[at]], table[z[at] - (1 << v) + 1])
                new[same + 1] = np.minimum(low + 1, length)
            full = new >= length
            found[j, order[rank[full | np.append(full[1:], False)]]] = True
            then.seek(0)
            then.write(order[rank].tobytes())
            then.write(new.tobytes())
            now, then = then, now
    return [found[left - c : left - c + len(s), i] for i, (s, c) in enumerate(zip(strings, centres, strict=True))]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


#: A group's strings: what they belong to (anchor and digest of the whole context), how often they stand in the texts,
#: the anchor's place in the string, and the string's place in the context.
_STRINGS = "ah bigint, f1 bigint, f2 bigint, g1 bigint, g2 bigint, d1 bigint, d2 bigint, c bigint, centre int, off int, context binary"
_GROUP, _STRING = ["g1", "g2"], ["g1", "g2", "d1", "d2"]


def _keys() -> list:
    """A row's content in 128 bits: repeated rows share it, different texts under one id don't."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]


def _narrowed(rows: DataFrame, length: int, step: int) -> DataFrame:
    """Strings cut into those of `step` neighbouring window starts, in groups that share what all these windows hold."""

    def cut(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "context"):
                out: list[list] = [[] for _ in range(8)]
                for i, (ah, centre, off, text) in enumerate(zip(*(part.column(k).to_pylist() for k in ("ah", "centre", "off", "context")), strict=True)):
                    last = len(text) - length
                    for chunk in range((centre - last) // step, centre // step + 1):
                        high, low = centre - chunk * step, centre - chunk * step - step + 1
                        a, z = max(0, low), min(last, high)
                        whole = text[a : z + length]
                        g = np.frombuffer(digest(ah.to_bytes(8, "little", signed=True) + chunk.to_bytes(8, "little", signed=True) + text[high : low + length]), np.int64)
                        d = np.frombuffer(digest(whole), np.int64)
                        for column, x in zip(out, (i, int(g[0]), int(g[1]), int(d[0]), int(d[1]), centre - a, off + a, whole), strict=True):
                            column.append(x)
                of = pa.array(out[0], pa.int64())
                kept = [part.column(k).take(of) for k in ("ah", "f1", "f2")]
                yield pa.record_batch([*kept, *[pa.array(x, pa.int64()) for x in out[1:5]], part.column("c").take(of), *[pa.array(x, pa.int32()) for x in out[5:7]], pa.array(out[7], pa.binary())], names=[n.split()[0] for n in _STRINGS.split(", ")])

    return rows.mapInArrow(cut, _STRINGS)


def _settled(kinds: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows (g1, g2, d1, d2, lo, hi): the windows of each string that its group's strings repeat, by `repeated_columns`."""

    def columns(group: pa.Table) -> pa.Table:
        strings, centres, c = (group.column(k).to_pylist() for k in ("context", "centre", "c"))
        twins = [i for i, n in enumerate(c) if n > 1]  # a string that stands more than once meets itself
        flags = repeated_columns(strings + [strings[i] for i in twins], centres + [centres[i] for i in twins], length)
        found = [runs(flags[i]) for i in range(len(strings))]
        of = pa.array(np.repeat(np.arange(len(strings)), [len(lo) for lo, _ in found]))
        spans = [np.concatenate([np.zeros(0, np.int32), *[f[k].astype(np.int32) for f in found]]) for k in (0, 1)]
        return pa.table([*[group.column(k).take(of) for k in _STRING], *map(pa.array, spans)], names=[*_STRING, "lo", "hi"])

    dealt = kinds.withColumn("bucket", F.pmod(F.xxhash64(*_GROUP), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(columns, "g1 bigint, g2 bigint, d1 bigint, d2 bigint, lo int, hi int")


def repeated_windows(docs: DataFrame, length: int = 400, most_in_group: int = 4096) -> DataFrame:
    """Rows (k1, k2, lo, hi): starts lo to hi of windows of `length` bytes that also start elsewhere; the key is of (doc_id, text).

    1. Each text's windows are dealt to anchors (`anchors`); a row holds the anchor's hash and a 128-bit digest of the
       whole context, from its first window to the end of its last.
    2. Anchors whose hash stands alone have no repeat. Of any other, one context of each digest goes to the anchor's
       group, with a twin if it stands more than once.
    3. `repeated_columns` finds the windows that the group repeats; they hold for all contexts of the digest.
    4. Groups of more than `most_in_group` strings are narrowed first: an eighth of the windows at a time, then a 64th,
       then each by itself, and only strings that agree on all that these windows share stay together. So no task
       gathers an unbounded group, whatever texts share, and the same transform settles each.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*_keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                keys = [np.array(part.column(k).to_pylist(), np.int64) for k in (0, 1)]
                raw = [t.encode("utf-8") for t in part.column(2).to_pylist()]
                of, hashes, at, s0, s1 = anchors(raw, length)
                digest = xxhash.xxh3_128_digest
                whole = b"".join([digest(raw[i][a : z + length]) for i, a, z in zip(of.tolist(), s0.tolist(), s1.tolist(), strict=True)])
                f = np.frombuffer(whole, np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [pa.array(x) for x in (hashes.view(np.int64), f[:, 0].copy(), f[:, 1].copy(), keys[0][of], keys[1][of], at.astype(np.int32), s0.astype(np.int32), s1.astype(np.int32))],
                    names=["ah", "f1", "f2", "k1", "k2", "at", "s0", "s1"],
                )

    rows = written(docs.mapInArrow(scan, "ah bigint, f1 bigint, f2 bigint, k1 bigint, k2 bigint, at int, s0 int, s1 int"), "anchors")
    shared = written(rows.groupBy("ah").agg(F.count("*").alias("c")).where("c > 1").select("ah"), "anchors")  # so that the join below is a plain one, whose hot keys can be split
    met = written(rows.join(shared, "ah"), "shared")
    discard(rows, shared)
    kinds = written(met.groupBy("ah", "f1", "f2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "at", "s0", "s1")).alias("one")).select("ah", "f1", "f2", "c", "one.*"), "kinds")
    start, size = F.col("s0") + 1, F.col("s1") - F.col("s0") + length
    context = F.substring(F.col("text").cast("binary"), start, size).alias("context")
    held = kinds.join(docs, ["k1", "k2"]).select("ah", "f1", "f2", F.col("ah").alias("g1"), F.lit(0).cast("long").alias("g2"), F.col("f1").alias("d1"), F.col("f2").alias("d2"), "c", (F.col("at") - F.col("s0")).alias("centre"), F.lit(0).alias("off"), context)
    now = written(held.dropDuplicates(["ah", "f1", "f2"]), "contexts")  # a repeated row brings its contexts twice
    discard(kinds)

    found = []
    width = length - GRAM + 1
    for step in dict.fromkeys((0, -(-width // 8), -(-width // 64), 1)):
        strings = now
        if step:
            now = written(_narrowed(now, length, step), "strings")
            strings = now.groupBy(*_STRING).agg(F.sum("c").alias("c"), F.min(F.struct("centre", "context")).alias("one")).select(*_STRING, "c", "one.*")
        sizes = strings.groupBy(*_GROUP).agg(F.count("*").alias("n"))
        large = written(sizes.where(F.col("n") > most_in_group).select(*_GROUP), "large")
        rest = strings.join(large, _GROUP, "left_anti")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), now.count() // 1000 + 1)
        told = written(_settled(rest, length, buckets), "settled")
        found.append(told.join(now.select(*_STRING, "ah", "f1", "f2", "off"), _STRING).select("ah", "f1", "f2", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi")))
        if large.isEmpty():
            break
        now = written(now.join(large, _GROUP, "left_semi"), "contexts")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return met.select("ah", "f1", "f2", "k1", "k2", "s0").join(every, ["ah", "f1", "f2"]).select("k1", "k2", (F.col("s0") + F.col("lo")).alias("lo"), (F.col("s0") + F.col("hi")).alias("hi"))

def covered(size: int, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows starting at lo to hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    fresh = np.concatenate([[True], lo[1:] > end[:-1]])
    return lo[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(lo) - 1)]


def remove_repeats(docs: DataFrame, length: int = 400, **options) -> DataFrame:
    """Rows (doc_id, text, n_bytes, n_removed, n_spans, starts, ends, kept): what stays of each text, and what was cut.

    Texts are UTF-8 bytes; every byte is removed that lies in a string of `length` bytes which also starts elsewhere,
    in the same text or another. Strings are judged on the input. kept holds the other bytes, joined; starts and ends
    are those of the removed runs.

    Null or empty text: nothing removed, kept empty. Very long texts: whole. Repeated rows are repeats of each other.
    Null doc_id: as any id. Empty table: empty. Other columns are left out.
    """
    found = repeated_windows(docs, length, **options).groupBy("k1", "k2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), *_keys())

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                kept, sizes, removed, starts, ends = [], [], [], [], []
                for text, lo, hi in zip(part.column("text").to_pylist(), part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8")
                    a, z = covered(len(raw), np.array(lo), np.array(hi), length) if lo else (np.zeros(0, int), np.zeros(0, int))
                    bounds = [0, *[x for pair in zip(a.tolist(), z.tolist(), strict=True) for x in pair], len(raw)]
                    kept.append(b"".join(raw[i:j] for i, j in zip(bounds[::2], bounds[1::2], strict=True)))
                    sizes.append(len(raw))
                    removed.append(int((z - a).sum()))
                    starts.append(a.tolist())
                    ends.append(z.tolist())
                longs = pa.list_(pa.int64())
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in starts], pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())],
                    names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"],
                )

    joined = keyed.join(found, ["k1", "k2"], "left").select("doc_id", "text", "lo", "hi")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {id_type}, text string, n_bytes bigint, n_removed bigint, n_spans bigint, starts array<bigint>, ends array<bigint>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, tuple[int, int, int, str]]:
    """The same by a table of all windows, for small inputs: (n_bytes, n_removed, n_spans, kept_sha256) by id."""
    seen: dict[bytes, int] = {}
    for raw in texts.values():
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for key, raw in texts.items():
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[key] = (len(raw), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(rest).hexdigest())
    return out

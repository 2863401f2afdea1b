"""N-gram Jaccard join: inverted lists of each set's rarest members find candidates, T-occurrence search with divided lists links them."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Groups, components, discard, prepare, slices, written
from .words import mix, split_words

U = np.uint64
#: Cells of the table of member counts: 4 MB as it is sent to the tasks, whatever the input. Its parts are summed apart.
CELL_BITS, PARTS = 22, 64
#: Bits of a sketch, least and most.
SKETCH_BITS = (64, 4096)
#: Rows of the posting stream that are looked at together; holders of a shingle whose sketches are compared, at most.
ROWS_AT_ONCE, MOST_HOLDERS = 50_000, 4096


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of `width` words; of the whole sequence if it is shorter."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words, of = split_words(raw)
    n = len(words)
    sizes = np.bincount(of, minlength=len(raw))
    begin = np.cumsum(sizes) - sizes
    grams = np.zeros(max(n - width + 1, 0), U)
    for k in range(width):
        grams = mix(grams + U(k + 1)) ^ words[k : n - width + 1 + k] if len(grams) else grams
    grams = mix(grams)
    out = []
    for b, s in zip(begin.tolist(), sizes.tolist(), strict=True):
        if s >= width:
            out.append(np.unique(grams[b : b + s - width + 1]))
        elif s:
            h = U(s)
            for w in words[b : b + s]:
                h = mix(np.array([h], U))[0] ^ w
            out.append(mix(np.array([h ^ U(0xABCDEF)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(64 - CELL_BITS)).astype(np.int64)


def member_levels(rows: DataFrame, width: int) -> np.ndarray:
    """For each cell of the hash space, how common its members are: 0 to 255, eight levels to each doubling.

    All documents count. Tasks emit their counts in PARTS compressed parts, which are added part by part as they stream in;
    only the levels, a byte a cell, reach the driver.
    """
    size = (1 << CELL_BITS) // PARTS

    def count(batches):
        total = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                total += np.bincount(cells_of(np.concatenate(sets)), minlength=len(total)).astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        used = [k for k in range(PARTS) if total[k * size : (k + 1) * size].any()]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([pack(total[k * size : (k + 1) * size].tobytes()) for k in used], pa.binary())], names=["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpack(blob), np.uint32).astype(np.int64)
        levels = {k: np.minimum(8 * np.log2(np.maximum(v, 1)), 255).astype(np.uint8).tobytes() for k, v in sums.items()}
        yield pa.record_batch([pa.array(list(levels), pa.int32()), pa.array(list(levels.values()), pa.binary())], names=["part", "levels"])

    summed = rows.mapInArrow(count, "part int, counts binary").repartition(PARTS, "part").mapInArrow(add, "part int, levels binary")
    out = np.zeros((PARTS, size), np.uint8)
    for r in summed.collect():
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def rarest(sets: list[np.ndarray], levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of each set by which others find it, and the sets' places.

    Two sets that link share ceil(p * n) members or more, n the size of either. So if all sets order their members alike,
    the first n - ceil(p * n) + 1 of each hold a common one. The rarest come first; what many unrelated sets share comes last.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([np.zeros(0, U), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((tokens, levels[cells_of(tokens)], owner))
    tokens = tokens[order]
    wanted = np.where(sizes > 0, sizes + (-percent * sizes // 100) + 1, 0)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < wanted[owner]
    return tokens[keep], owner[keep]


def merge_skip(lists: list[list[int]], least: int):
    """Pairs (id, count) of the ids that stand in `least` or more of some ascending lists: a heap merge that skips.

    If the least id of all lists stands in too few of them, the `least` - 1 lists with the lowest heads are moved on, by
    binary search, to the head that then is lowest: nothing below it can stand in enough lists.
    """
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        low = top + 1
        if len(popped) >= least:
            yield top, len(popped)
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            low = max(low, heap[0][0])
        for k in popped:
            at[k] = bisect_left(lists[k], low, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def t_occurrence(sets: list[np.ndarray], percent: int, long_share: float = 0.02) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets whose Jaccard similarity is `percent` or more.

    Each set in turn asks the inverted lists of its members for the later sets that occur T times or more, T its least
    overlap. Sets that it's joined with already, or whose size rules a link out, leave the lists. Of the rest the L longest
    are set aside (L as DivideSkip chooses it); the short ones are merged by a heap (`merge_skip`), and what reaches T - L
    is probed for in each long list by binary search.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.append(edge, len(tokens)))
    values = tokens[edge]
    groups, links = Groups(n), []
    root = np.arange(n)
    for q in range(n - 1):
        if groups.left == 1:
            break
        least = -(-percent * int(sizes[q]) // 100)
        may = (sizes * 100 >= sizes[q] * percent) & (sizes[q] * 100 >= sizes * percent) & (root != root[q])
        may[: q + 1] = False
        if not least or not may.any():
            continue
        at = np.searchsorted(values, sets[q])
        at = at[length[at] > 1]
        if len(at) < least:
            continue
        spans = length[at]
        take = np.arange(int(spans.sum())) + np.repeat(edge[at] - np.cumsum(spans) + spans, spans)
        ids, number = owner[take], np.repeat(np.arange(len(at)), spans)
        ids, number = ids[may[ids]], number[may[ids]]
        left = np.bincount(number, minlength=len(at))
        lists = [x.tolist() for x in np.split(ids, np.cumsum(left)[:-1]) if len(x)]
        if len(lists) < least:
            continue
        lists.sort(key=len)
        aside = min(least - 1, int(least / (long_share * np.log2(len(lists[-1]) + 1) + 1)))
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        new = []
        for r, overlap in merge_skip(short, least - aside):
            for x in long_:
                k = bisect_left(x, r)
                overlap += k < len(x) and x[k] == r
            if 100 * overlap >= percent * (sizes[q] + sizes[r] - overlap) and groups.join(q, r):
                new.append(r)
        if new:
            links += [(q, r) for r in new]
            root[np.isin(root, root[[q, *new]])] = groups.find(q)
    return links


def _search(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the `texts` (id, text, task) of each task; one id's texts are one document."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted({*zip(group.column("id").to_pylist(), group.column("text").to_pylist(), strict=True)}, key=lambda r: (r[0], r[1] or ""))
        sets = shingle_sets([t for _, t in rows], width)
        links = [(rows[i][0], rows[j][0]) for i, j in t_occurrence(sets, percent)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return texts.groupBy("task").applyInArrow(run, "a bigint, b bigint")


def odd_sketch(members: np.ndarray) -> bytes:
    """A bit for each cell of the hash space: is its number of members odd? Two sets differ in no fewer members than bits."""
    bits = SKETCH_BITS[0]
    while bits < min(2 * len(members), SKETCH_BITS[1]):
        bits *= 2
    cells = (mix(members ^ U(0x2545F4914F6CDD1D)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=bits) & 1 == 1, bitorder="little").tobytes()


def near_by_sketch(ids: list[int], sizes: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches don't rule a link out.

    Sketches of sets that may link are of one length or of twice that; the longer one is folded.
    """
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    width = np.array([len(sketches[i]) for i in order]) // 8
    own, folded = {}, {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        table = np.frombuffer(b"".join(sketches[order[i]] for i in at), np.uint64).reshape(-1, w)
        own[w], folded[w] = (int(at[0]), table), (int(at[0]), table[:, : w // 2] ^ table[:, w // 2 :] if w > 1 else table)
    groups, root, out = Groups(len(ids)), np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        if groups.left == 1:
            break
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        w = int(width[i])
        mine = own[w][1][i - own[w][0]]
        new = []
        for low, table in [own[w], *([folded[2 * w]] if 2 * w in folded else [])]:
            a, z = max(i + 1, low), min(end, low + len(table))
            may = a + np.flatnonzero(root[a:z] != root[i]) if a < z else np.zeros(0, np.int64)
            if len(may):
                differ = np.bitwise_count(table[may - low] ^ mine).sum(1, dtype=np.int64)
                new += [j for j in may[differ * (100 + percent) <= (100 - percent) * (sizes[i] + sizes[may])].tolist() if groups.join(i, j)]
        if new:
            out += [(ids[order[i]], ids[order[j]]) for j in new]
            root[np.isin(root, root[[i, *new]])] = groups.find(i)
    return out


def holder_groups(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending (key, id) rows: for each key with two ids or more a number that depends on its set of ids alone, where its rows start, and how many they are."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    number = mix(np.add.reduceat(mix(ids.astype(U)), first) + count.astype(U)).view(np.int64)
    many = count > 1
    return number[many], first[many], count[many]


def shared_holders(batches):
    """Sets of documents that share a shingle, from (key, id) rows in order: rows (g, a) of the members of set g, each set about once.

    Of a shingle with more than MOST_HOLDERS documents, links (a, b) to the first of them, with g null, stand for all.
    """
    seen: set[int] = set()
    keys, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot = None  # the key whose holders are linked to their first one, kept as the only row

    def rows(g, a, b):
        return pa.record_batch([pa.array(g, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["g", "a", "b"])

    def links(at: int, n: int):
        return rows([None] * (n - 1), ids[at + 1 : at + n], np.full(n - 1, ids[at]))

    def work(last: bool):
        nonlocal keys, ids, hot
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[fresh], ids[fresh]
        end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        if end:
            numbers, starts, counts = holder_groups(keys[:end], ids[:end])
            chosen = []
            for g, at, n in zip(numbers.tolist(), starts.tolist(), counts.tolist(), strict=True):
                if n > MOST_HOLDERS or keys[at] == hot:
                    yield links(at, n)
                elif g not in seen:
                    seen.add(g)
                    chosen.append((g, at, n))
            if chosen:
                n = np.array([c[2] for c in chosen])
                take = np.arange(int(n.sum())) + np.repeat(np.array([c[1] for c in chosen]) - np.cumsum(n) + n, n)
                yield rows(np.repeat(np.array([c[0] for c in chosen]), n), ids[take], pa.nulls(len(take)))
            if len(seen) > 1_000_000:
                seen.clear()
        keys, ids = keys[end:], ids[end:]
        if len(keys) > MOST_HOLDERS:
            yield links(0, len(keys))
            hot, keys, ids = keys[0], keys[:1], ids[:1]

    parts, held = [], 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= ROWS_AT_ONCE:
            keys, ids = np.concatenate([keys, *[k for k, _ in parts]]), np.concatenate([ids, *[i for _, i in parts]])
            parts, held = [], 0
            yield from work(False)
    keys, ids = np.concatenate([keys, *[k for k, _ in parts]]), np.concatenate([ids, *[i for _, i in parts]])
    if len(keys):
        yield from work(True)


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, most_in_task: int = 256) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): the connected components of the similarity join of `docs` (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Two documents link if their sets of `width`
    word shingles have a Jaccard similarity of `percent` or more.

    1. A scan counts all documents' shingles in a table of fixed size, which only orders them (`member_levels`).
    2. A second scan yields each set's digest, sketch and postings, the rarest shingles (`rarest`). Postings meet in one
       shuffle by shingle and stream past in order (`shared_holders`); holders of a shingle are candidates of each other
       unless sizes or sketches rule that out (`near_by_sketch`); where very many hold one, all are candidates of the first.
    3. The connected components of the candidates hold every true link. Equal sets are one document from there on.
    4. Each component goes to one task (small ones share tasks), or, if it has more than `most_in_task` documents, to
       several, each with the component's first document; what is not in the component's largest part after that is
       searched against all of it, block by block. So no link is lost, and no task holds an unbounded group.

    doc_id is the key: repeated rows of one id count once in links and come back each; different texts under one id are
    one document with all their links, and each row has its own n_shingles. Null or empty text, or no words: n_shingles 0,
    a component of its own. Fewer than `width` words: one shingle, the whole sequence. Very long texts: whole. Null
    doc_id: never linked. Empty table: empty. Other columns are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = member_levels(rows, width)

    def scan(batches):
        first: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                sets = shingle_sets(part.column(1).to_pylist(), width)
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield batch_of(doc_id=ids, n=[len(s) for s in sets], sig=sigs, sketch=[odd_sketch(s) for s in sets])
                if len(first) > 100_000:
                    first.clear()
                # Of equal sets in a task one is enough: they are linked by their digest.
                known = [(i, s) for i, s, sig in zip(ids, sets, sigs, strict=True) if i is not None and first.setdefault(sig, i) == i]
                keys, owner = rarest([s for _, s in known], levels, percent)
                if len(keys):
                    yield batch_of(key=keys.view(np.int64), id=np.array([i for i, _ in known], np.int64)[owner])

    scanned = written(rows.mapInArrow(scan, "doc_id bigint, n bigint, sig binary, sketch binary, key bigint, id bigint"), "scanned")
    postings = scanned.where("key is not null").select("key", "id").repartition("key").sortWithinPartitions("key", "id")
    met = written(postings.mapInArrow(shared_holders, "g bigint, a bigint, b bigint"), "met")

    def compare(batches):
        held = None

        def edges(t: pa.Table):
            numbers = t.column("g").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])).tolist()
            ids, sizes, sketches = t.column("a").to_pylist(), t.column("n").to_numpy(), t.column("sketch").to_pylist()
            out = [p for a, z in zip(starts, [*starts[1:], len(ids)], strict=True) for p in near_by_sketch(ids[a:z], sizes[a:z], sketches[a:z], percent)]
            return pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

        for batch in batches:  # a set's rows are together; the last set of a batch may go on in the next
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            numbers = held.column("g").to_numpy()
            end = int(np.searchsorted(numbers, numbers[-1])) if len(numbers) else 0
            if end:
                yield edges(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield edges(held)

    sketches = scanned.where("sig is not null and doc_id is not null").select(F.col("doc_id").alias("a"), "n", "sketch")
    asked = met.where("g is not null").select("g", "a").distinct().join(sketches, "a").select("g", "a", "n", "sketch")
    passed = asked.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "a bigint, b bigint")

    members = scanned.where("sig is not null").select("doc_id", "n", "sig")
    first = written(members.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "first")
    of = written(members.join(first, "sig", "left").select("doc_id", "n", "rep"), "classes")
    equal = of.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    near = components(met.where("g is null").select("a", "b").unionByName(passed).unionByName(equal))
    grouped = written(near.join(first.select(F.col("rep").alias("node")).distinct(), "node"), "candidates")
    discard(scanned, met, first, near)
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / most_in_task).cast("int"))
    placed = written(grouped.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "placed")
    discard(grouped)
    small = placed.where(F.col("size") <= most_in_task // 8).count() // most_in_task + 1
    # The only shuffle of all texts; those of candidates are kept, for both searches. The same plan at every size.
    held = written(rows.withColumnRenamed("doc_id", "id").join(placed.withColumnRenamed("node", "id").hint("merge"), "id"), "held")
    key = F.when(F.col("size") <= most_in_task // 8, F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(small)))).otherwise(F.concat_ws(":", "component", "part"))
    leads = held.where("id = component and parts > 1").select("id", "text", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to")).where("to != part")
    own = held.select("id", "text", key.alias("task")).unionByName(leads.select("id", "text", F.concat_ws(":", "component", "to").alias("task")))
    links = written(_search(own, width, percent), "links")
    found = [links]

    split = placed.where("parts > 1").select("node", "component", "parts", "part")
    if not split.isEmpty():
        parts = components(links)
        now = written(split.join(parts.withColumnRenamed("component", "joined"), "node", "left").withColumn("joined", F.coalesce("joined", "node")), "split")
        counts = now.groupBy("component", "joined").agg(F.count("*").alias("size"))
        largest = counts.groupBy("component").agg(F.max_by("joined", F.struct("size", -F.col("joined"))).alias("largest"))
        rest = now.join(largest, "component").where("joined != largest")
        blocks = rest.groupBy("component").agg(F.ceil(F.count("*") / most_in_task).cast("int").alias("blocks"))
        asking = rest.join(blocks, "component").select("node", "component", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asked = now.join(blocks, "component").select("node", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part")
        more = asking.unionByName(asked).select(F.col("node").alias("id"), F.concat_ws(":", "component", "block", "part").alias("task")).distinct()
        found.append(written(_search(held.select("id", "text").join(more.hint("merge"), "id"), width, percent), "links"))
        links = links.unionByName(found[-1])
        discard(parts, now)
    discard(held)
    several = of.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("doc_id")
    own_texts = of.join(several, "doc_id").where("rep is not null").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.unionByName(own_texts)).withColumnsRenamed({"node": "rep"})
    discard(placed, *found)
    return of.join(whole, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def batch_of(**columns) -> pa.RecordBatch:
    """A batch of the scan's schema with these columns, the others null."""
    n = len(next(iter(columns.values())))
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "sig": pa.binary(), "sketch": pa.binary(), "key": pa.int64(), "id": pa.int64()}
    return pa.record_batch([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest doc_id; repeated rows of it: one.

    Documents with a null doc_id stay.
    """
    kept = jaccard_groups(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id").dropDuplicates(["doc_id"])
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))

"""Packing: token sequences of a fixed length, cut at document or sentence ends where that costs least."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Tokens:
    """Token ids of a byte-level BPE file.

    A text is cut before each space that a non-space follows; no token of this vocabulary's pre-tokenizer crosses
    such a cut. The different words of a batch are encoded once, in one call, and dealt back to their places by array
    operations. Texts with other runs of spaces, and those that hold a special token's string, are encoded whole.
    """

    def __init__(self, path: str):
        import base64
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.odd = re.compile(r" (?:\s|$)")
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            import public_tokenizers

            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            self.spaced = np.zeros(max(merges.values()) + 1, bool)
            for token, i in merges.items():
                self.spaced[i] = token[:1] == b" "
        except OSError:  # a vocabulary without ranks: the tokenizer alone
            pass

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if self.fast is None or any(x in text for x in self.special):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
            elif not text or text[0].isspace() or self.odd.search(text):
                out[i] = np.array(self.fast.encode_ordinary(text), "<u4")
            else:
                plain.append(i)
        if plain:
            parts = pa.compute.split_pattern(pa.array([" " + texts[i] for i in plain], pa.large_string()), " ")
            coded = parts.values.dictionary_encode()
            which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            # The text's first word has no space before it: an empty word stands at each text's start, then the word.
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(w for w in words if w)), "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            sizes, begins = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            full = np.array([bool(w) for w in words])
            begins[full], sizes[full] = starts, np.diff(np.append(starts, len(ids)))
            bounds = parts.offsets.to_numpy()
            for i, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rest = which[a + 2 : b]
                n = sizes[rest]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                take = np.arange(total) + np.repeat(begins[rest] - ends + n, n)
                out[i] = np.concatenate([np.array(self.fast.encode_ordinary(words[which[a + 1]]), "<u4"), ids[take]])
        return out


def best_cuts(ends: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Cut points of a token stream: the path over `ends` (ascending, the last is the stream's end) of least cost.

    Each cut costs `costs`, each sequence its padding: window - length, none at a power of two. Consecutive ends are at
    most `window` apart. best(j) = cost(j) + window - j + min(best(i) + i) over the window is kept by a monotone queue;
    the power-of-two lengths are a few further transitions.
    """
    at = [0, *ends.tolist()]
    cost = [0.0, *costs.tolist()]
    n = len(at)
    best, back = [0.0] * n, [0] * n
    free = {1 << k for k in range(window.bit_length()) if 1 << k < window}
    # The transitions of those lengths: few ends lie so far apart, so all of them are found at once.
    spots = np.array(at)
    near = [np.searchsorted(spots, spots - w) for w in sorted(free)]
    there = [spots[k] == spots - w for k, w in zip(near, sorted(free), strict=True)]
    to = np.concatenate([np.flatnonzero(h) for h in there])
    order = np.argsort(to, kind="stable")
    since = np.concatenate([k[h] for k, h in zip(near, there, strict=True)])[order].tolist()
    first = np.searchsorted(to[order], np.arange(n + 1)).tolist()
    queue: deque[int] = deque([0])
    keys = [0.0] * n
    for j in range(1, n):
        p = at[j]
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        value = keys[i] + window - p
        if p - at[i] in free:  # kept exact by the transitions below
            value = best[i]
        for k in since[first[j] : first[j + 1]]:
            if best[k] <= value:
                value, i = best[k], k
        best[j], back[j] = value + cost[j], i
        keys[j] = best[j] + p
        while queue and keys[queue[-1]] >= keys[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def pack_block(docs: list[tuple[int, np.ndarray]], window: int, sentence_ids: np.ndarray, sentence_cost: float, hard_cost: float):
    """Pieces (doc_id, start, length, crc, doc tokens, sequence number, offset) of one block of documents, in order."""
    stream = np.concatenate([ids for _, ids in docs])
    doc_ends = np.cumsum([len(ids) for _, ids in docs])
    sentence = np.flatnonzero(np.isin(stream, sentence_ids)) + 1
    ends = np.union1d(sentence, doc_ends)
    gaps = np.diff(np.concatenate([[0], ends]))
    if (wide := np.flatnonzero(gaps > window // 4)).size:  # a sentence of its own length: cuts inside it too
        more = [np.arange(ends[i] - gaps[i] + window // 8, ends[i], window // 8) for i in wide]
        ends = np.union1d(ends, np.concatenate(more))
    costs = np.where(np.isin(ends, doc_ends), 0.0, np.where(np.isin(ends, sentence), sentence_cost, hard_cost))
    starts = doc_ends - [len(ids) for _, ids in docs]
    out, d, a = [], 0, 0
    for number, b in enumerate(best_cuts(ends, costs, window)):
        offset = 0
        while a < b:
            e = min(b, int(doc_ends[d]))
            out.append((docs[d][0], a - int(starts[d]), e - a, zlib.crc32(stream[a:e].astype("<u4").tobytes()), len(docs[d][1]), number, offset))
            offset += e - a
            a = e
            d += e == doc_ends[d]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, block_tokens: int = 1 << 18, sentence_cost: float = 2.0, hard_cost: float = 8.0) -> DataFrame:
    """Pack `docs` (doc_id, text) into sequences of at most `window` tokens, in the order of the input.

    Each document is its ids by the tokenizer file named `tokenizer` (of `public_tokenizers`, or a path), then `end_id`.
    Documents are laid end to end in blocks of about `block_tokens` (more only for a longer document); a dynamic
    program picks the cuts that cost least: one for each padded token, `sentence_cost` for a cut at a sentence's end,
    `hard_cost` inside one, nothing between documents. Every input split is packed by itself: no shuffle. A sequence's
    number is its split's number times 2**32 plus a count.

    Null text: as empty, one piece with `end_id` alone. Null doc_id: kept. Very long texts: cut over many sequences.
    Repeated rows: packed one by one. An empty table gives no rows; other columns are left out.
    """
    prepare(docs.sparkSession)

    def run(batches):
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
        tokens = Tokens(path)
        probe = [".", "!", "?", ".\n", "\n", "\n\n", "...", "!!", ".&&&"]
        sentence = np.unique([ids[0] for text in probe if len(ids := tokens.encode([text])[0]) == 1]).astype("<u4")
        base, count = TaskContext.get().partitionId() << 32, 0
        tail = np.array([end_id], "<u4")
        held, size = [], 0

        def flush():
            nonlocal held, size, count
            rows = pack_block(held, window, sentence, sentence_cost, hard_cost)
            columns = list(zip(*rows, strict=True))
            columns[5] = [base + count + x for x in columns[5]]
            count += rows[-1][5] + 1
            held, size = [], 0
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode(texts), strict=True):
                    held.append((doc, np.concatenate([ids, tail])))
                    size += len(ids) + 1
                    if size >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

"""Language identification: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, quoted, slices, written

#: Hashed dimensions of the byte n-grams, by n.
SIZES = {1: 256, 2: 2048, 3: 4096}
WIDTH = sum(SIZES.values())
#: Bytes that are ASCII and no letters count as a space.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def presence(texts: list[str]) -> np.ndarray:
    """Which n-grams stand in each whole text: a boolean row of WIDTH for each."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flags = np.zeros(len(raw) * WIDTH, bool)
    b = FOLD[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(raw), dtype=np.int64) * WIDTH, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(b))  # bytes to the text's end, this one included
    code, base = b.copy(), 0
    for n, size in SIZES.items():
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + b[n - 1 :] if len(code) > 1 else code[:0]
        k = len(code)
        spot = code if n == 1 else (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - size.bit_length() + 1)
        inside = left[:k] >= n
        flags[(row[:k] + base + spot)[inside]] = True
        base += size
    return flags.reshape(len(raw), WIDTH)


def spectrum(flags: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the blended kernel: the mean over n of shared n-grams by the geometric mean of both counts."""
    out, base = flags.astype(np.float32), 0
    for size in SIZES.values():
        part = out[:, base : base + size]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(SIZES))
        base += size
    return out


@dataclass
class Model:
    names: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the regressions' values."""
        v = 6.0 * ((x @ self.landmarks.T) @ self.weights)
        v = np.exp(v - v.max(1, keepdims=True))
        return v / v.sum(1, keepdims=True)


def fit(flags: np.ndarray, names: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    known = sorted(set(names))
    x = spectrum(flags)
    z = x[np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int)]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    phi = (x @ z.T).astype(np.float64) @ root
    y = np.where(np.array(names)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(phi.T @ phi + ridge * len(x) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(known, z, (root @ weights).astype(np.float32))


def identify(docs: DataFrame, learn: DataFrame, per_language: int = 500, landmarks: int = 128) -> DataFrame:
    """`docs` (doc_id, text, more) with lang_pred and score (0 to 1); learnt from `learn` (text, lang).

    The fit reads `per_language` different texts of each language at most, the first by a hash of the text; what
    reaches the driver is their n-gram bits. Every language of `learn` is learnt. Every text is judged whole, in batched
    matrix products.

    Null text, or one without a letter: `und`, score 0. Nothing to learn from: `und` for all. Null lang is not learnt.
    Null ids stay. Very long texts: a slice of their own. Repeated rows: each for itself, and learnt from once. Ties go
    to the first language by name. Empty tables: empty. Columns named like the added ones are replaced.
    """
    prepare(docs.sparkSession)
    known = learn.where("text is not null and lang is not null").select(F.col("text"), F.col("lang").cast("string").alias("lang"))
    # Four times as many by the hash as are wanted; then the first of each language, ordered, from what little is left.
    share = written(known.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * per_language / F.count("*")).alias("__share")), "shares")  # written: its size is known, so texts aren't shuffled for it
    near = known.withColumn("__place", F.xxhash64("text")).join(share, "lang").where(F.pmod("__place", F.lit(1_000_000)) < F.col("__share") * 1_000_000)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("__place", "text"))
    chosen = near.select("text", "lang", "__place").distinct().withColumn("__first", first).where(F.col("__first") <= per_language).select("text", "lang")

    def bits(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                packed = np.packbits(presence(part.column(0).to_pylist()), axis=1)
                yield pa.record_batch([pa.array([p.tobytes() for p in packed], pa.binary()), part.column(1).cast(pa.string())], names=["bits", "lang"])

    got = sorted((r["lang"], bytes(r["bits"])) for r in chosen.mapInArrow(bits, "bits binary, lang string").collect())
    got.sort(key=lambda r: hash_order(r[1]))
    if not got:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    flags = np.unpackbits(np.stack([np.frombuffer(r[1], np.uint8) for r in got]), axis=1)[:, :WIDTH].astype(bool)
    model = fit(flags, [r[0] for r in got], landmarks)

    added = [n for n in ("lang_pred", "score") if n in docs.columns]
    rows = docs.drop(*added).withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def judge(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text", 1_000_000):
                lettered = part.column(part.num_columns - 1).to_pylist()
                texts = [t if ok else "" for t, ok in zip(part.column(at).to_pylist(), lettered, strict=True)]
                s = model.scores(spectrum(presence(texts)))
                best = s.argmax(1)
                names = [model.names[k] if ok else "und" for k, ok in zip(best.tolist(), lettered, strict=True)]
                score = np.where(np.array(lettered, bool), s.max(1), 0.0).astype(float)
                yield pa.record_batch([*part.columns[:-1], pa.array(names), pa.array(score)], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(judge, f"{quoted(rows.drop('__letters'))}, lang_pred string, score double")


def hash_order(raw: bytes) -> bytes:
    import hashlib

    return hashlib.md5(raw).digest()

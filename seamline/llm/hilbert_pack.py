"""Packing along a space-filling curve.

A document's hashed token counts, scaled to length one, are projected to three dimensions with fixed normal
weights and squashed to 16 bits each; their Hilbert index is the document's place on the curve. The corpus is
range-sorted by it, in ranges of about equally many ids, and each range is filled gaplessly into sequences of
4096 ids, so neighbours on the curve share sequences. Only the last sequence of a range can be short; a range
holds millions of ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import stored
from .token_table import END_ID, token_table
from .wordbytes import mix64

DIMS, BITS, BUCKETS, SEED = 3, 16, 1024, 20240229
LENGTH = 4096
#: ids in a range, about, and documents that stand for it when the ranges are chosen
RANGE_IDS, SAMPLES = 1 << 23, 64
#: sequence numbers of a range begin at its number times this
STRIDE = 1 << 40


def hilbert_index(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``x`` (n points, d axes, each ``bits`` bits): bit by bit from
    the top, axes are flipped and exchanged so that the sub-cube is entered where the last one was left; a
    Gray code over the axes then gives the order of the sub-cubes."""
    axes = [c.astype(np.uint64) for c in x.T]
    d = len(axes)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for k in range(d):
            high = (axes[k] & q) != 0
            swap = np.where(high, np.uint64(0), (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[k] = axes[k] ^ swap if k else axes[0]
    for k in range(1, d):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = key << np.uint64(1) | ((a ^ turn) >> np.uint64(b)) & np.uint64(1)
    return key


_WEIGHTS: dict[int, tuple] = {}


def _weights(size: int):
    if size not in _WEIGHTS:
        h = mix64(np.arange(size, dtype=np.uint64) + np.uint64(SEED))
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        normal = np.random.Generator(np.random.PCG64(SEED)).standard_normal((BUCKETS, DIMS))
        _WEIGHTS[size] = (h % np.uint64(BUCKETS)).astype(np.int64), sign, normal
    return _WEIGHTS[size]


def curve_keys(ids: list[np.ndarray], size: int) -> np.ndarray:
    """The place on the curve of each document, from its ids (each below ``size``)."""
    bucket, sign, normal = _weights(size)
    at = np.zeros((len(ids), DIMS))
    for k, x in enumerate(ids):
        v = np.bincount(bucket[x], weights=sign[x], minlength=BUCKETS)
        at[k] = v @ normal / max(np.sqrt(v @ v), 1e-9)
    unit = (1 + at / (1 + np.abs(at))) / 2
    return hilbert_index(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)).astype(np.int64)


def _keyed(code, ids):
    return [("curve", pa.int64(), curve_keys(ids, max(code.size, END_ID + 1)))]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(dtype: str, length: int):
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def run(batches):
        at, now = 0, None
        for b in batches:
            rows = []
            for doc_id, raw, part in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    at, now = part * STRIDE * length, part
                ids = np.frombuffer(raw, dtype).astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - at % length)
                    rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), at // length, at % length))
                    start, at = start + n, at + n
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def range_ends(table: DataFrame, range_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(curve, tie) of the first document of each range but the first. Documents stand for the ids around them: each
    with a chance, by its hash, of its ids times ``SAMPLES`` over ``range_ids``, so about ``SAMPLES`` a range come to the
    driver, and weigh alike; longer ones always and by their ids."""
    share = F.col("n_tokens") * (SAMPLES / range_ids)
    chance = F.xxhash64(F.lit(SEED), "curve", "tie") / F.lit(2.0**64) + 0.5
    found = table.where(chance < share).select("curve", "tie", F.greatest(F.lit(1.0), share).alias("weight")).toArrow()
    curve, tie, weight = (found[c].to_numpy() for c in ("curve", "tie", "weight"))
    at = np.lexsort((tie, curve))
    full = np.floor(np.cumsum(weight[at]) / SAMPLES)
    ends = at[np.flatnonzero(full[1:] > full[:-1]) + 1]
    return curve[ends], tie[ends]


def range_of(curve: np.ndarray, tie: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of each document: how many range ends are at or before it."""
    low, high = np.searchsorted(ends[0], curve, "left"), np.searchsorted(ends[0], curve, "right")
    out = low.astype(np.int64)
    for place in np.unique(curve[low < high]):
        of = np.flatnonzero(curve == place)
        i, j = low[of[0]], high[of[0]]
        out[of] = i + np.searchsorted(ends[1][i:j], tie[of], "right")
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END_ID, length: int = LENGTH, range_ids: int = RANGE_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is packed, repeated rows each on their own; rows at one place on the curve follow
    one another by a hash of doc_id and ids, so that a place that many documents share is split between ranges.
    Null or empty texts are the end id alone. A text of any length is cut where a sequence is full. Sequence
    numbers ascend along the curve and are not dense. Columns besides doc_id and text are ignored; no rows,
    no pieces.
    """
    path = tokenizer or tokens.default_tokenizer()
    table = token_table(docs, path, end, _keyed, ", curve long")
    table = stored(table.withColumn("tie", F.xxhash64("doc_id", "ids")), "curve")
    ends = range_ends(table, range_ids)
    part = F.pandas_udf(lambda curve, tie: pd.Series(range_of(curve.to_numpy(), tie.to_numpy(), ends)), "long")
    ranged = table.withColumn("part", part("curve", "tie")).repartitionById(len(ends[0]) + 1, F.col("part").cast("int"))
    ordered = ranged.sortWithinPartitions("part", "curve", "tie", "doc_id")
    return ordered.select("doc_id", "ids", "part").mapInArrow(_packer(tokens.coder(path).dtype.str, length), _PIECE)

"""SimHash near-duplicates by an inverted index of positional bytes with count filtering.

A fingerprint is eight positional bytes. Two fingerprints at ``MAX_BITS`` = 2 or fewer differing bits differ
in at most two bytes, so they share at least six positional bytes: the guaranteed minimum of matches. The
index posts each different fingerprint under its positional bytes; of every pair that meets in a posting list
the shared positional bytes are tallied, pairs with six or more stay, and those are verified on all 64 bits.

Since a pair with six shared positions has one among any three, lists of three positions find it. A list
holds about a 256th of the fingerprints, so longer lists are split by a second positional byte, a third, and
so on, always among the positions where a pair can have its next shared byte.

Only different fingerprints enter the index; documents with equal ones are a class from the start.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sorted_store, worker
from .components import components
from .scratch import drop_stored, stored
from .wordbytes import MIX, mix64, texts_of

#: rows of hashes turned to bits at a time
_ROWS = 1 << 16
#: differing bits of a link, at most, and the positional bytes that it shares at least
MAX_BITS, LEAST_SHARED = 2, 6
#: fingerprints of a posting list, at most; longer lists are split by a further byte
BLOCK = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> bytes:
    """Eight bytes, most significant first. No word: zeros; fewer words than a shingle: one shingle of all."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    rows = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, rows), repeat(seed)))
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[k : k + _ROWS], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(hashes), _ROWS))
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _fingerprints(batches):
    for b in batches:
        fps = b"".join(map(fingerprint, texts_of(b)))
        yield pa.record_batch([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype("<i8"))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long. Null text: as if empty."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _mask(positions) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _first_sets(depth: int) -> list[int]:
    """Masks of the sets that the first ``depth`` shared positions of two fingerprints can be: if they share
    ``LEAST_SHARED`` or more, the k-th of these is at most k + 8 - LEAST_SHARED."""
    return [_mask(c) for c in combinations(range(8), depth) if all(p <= k + 8 - LEAST_SHARED for k, p in enumerate(c))]


def _finer(mask: int) -> list[int]:
    """Masks that split a list of six bytes whose other two are A and B: B besides, or A besides but for one bit.

    Two fingerprints of the list that link share B or differ in one bit of A at most, so they meet again. A new
    list has at most 512 fingerprints, whatever the input."""
    a, b = (p for p in range(8) if not mask >> 8 * p & 0xFF)
    return [mask | _mask([b]), *((mask | _mask([a])) ^ 1 << 8 * a + k for k in range(8))]


def _posted(fps: DataFrame, masks) -> DataFrame:
    """(mask, post, fp): every fingerprint under each mask, with the bytes that the mask keeps."""
    x = fps.select("fp", F.explode(masks).alias("mask"))
    return x.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("post"), "fp")


def _literals(masks: list[int]):
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _tally(a, b):
    """How many positional bytes two fingerprints share."""
    differ = a.bitwiseXOR(b)
    return sum(F.when(differ.bitwiseAND(F.lit(_signed(_mask([p])))) == 0, 1).otherwise(0) for p in range(8))


def _pairs(lists: DataFrame) -> DataFrame:
    """Links among the fingerprints of each list: tallied, kept from ``LEAST_SHARED`` shared bytes up, verified on all bits."""
    other = lists.select(F.col("mask").alias("mask_v"), F.col("post").alias("post_v"), F.col("fp").alias("v"))
    x = lists.withColumnRenamed("fp", "u").join(other, (F.col("mask") == F.col("mask_v")) & (F.col("post") == F.col("post_v")) & (F.col("u") < F.col("v")))
    x = x.select("u", "v", _tally(F.col("u"), F.col("v")).alias("tally")).where(F.col("tally") >= LEAST_SHARED)
    return x.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v")


def _first_depth(n: int) -> int:
    """The least depth at which lists of evenly spread bytes would fit a block."""
    depth = 1
    while depth < LEAST_SHARED and n > BLOCK << 8 * depth:
        depth += 1
    return depth


def links(fps: DataFrame, depth: int | None = None) -> DataFrame:
    """(u, v), u < v: all pairs of different fingerprints that differ in at most ``MAX_BITS`` bits, each at least once.

    The index starts with lists of ``depth`` bytes, as short as even bytes would make them. Fingerprints of lists
    that are longer than ``BLOCK`` all the same are posted again under one more byte, up to ``LEAST_SHARED``, and
    then by bits: the same links at any depth, and no list that grows with the input.
    """
    every = stored(fps.select("fp").distinct(), "different")
    depth = depth or _first_depth(every.count())
    found = []
    while True:
        lists = _posted(every, _literals(_first_sets(depth)))
        long = stored(lists.groupBy("mask", "post").count().where(F.col("count") > BLOCK).select("mask", "post"), "long_lists")
        if long.isEmpty():
            return reduce(DataFrame.unionByName, [*found, _pairs(lists)])
        found.append(_pairs(lists.join(long, ["mask", "post"], "left_anti")))
        lists = lists.join(long, ["mask", "post"], "left_semi")
        if depth == LEAST_SHARED:
            finer = F.create_map(*[x for m in _first_sets(depth) for x in (F.lit(_signed(m)), _literals(_finer(m)))])
            again = lists.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
            lists = again.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("post"), "fp")
            return reduce(DataFrame.unionByName, [*found, _pairs(lists)])
        every, depth = stored(lists.select("fp").distinct(), "in_long_lists"), depth + 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``; component_id is the smallest doc_id reachable by links.

    Nulls: a null text counts as empty; a null doc_id is never the smallest unless its whole component has
    none else. Repeated rows each keep their row. An empty table gives an empty one. Documents without a word
    have the fingerprint zero and link like any other. A bit that exactly half of the shingles set is 0. Texts
    of any length are taken whole, their bits summed in slices. Columns besides doc_id and text are ignored.
    Components of fingerprints that aren't alone are looked up in sorted files, so a group of copies of any size
    stays where its rows are.
    """
    own = stored(fingerprints(docs), "fingerprints")
    first = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    label = components(links(first))
    near = label.join(first, label["node"] == first["fp"]).select("node", "label", "first_id")
    least = stored(near.groupBy("label").agg(F.min("first_id").alias("least_id")), "least")
    near = label.join(least, "label").select("node", "least_id")
    # what a document is alone needs no telling
    told = first.join(near, first["fp"] == near["node"], "left").where("n > 1 or node is not null")
    told = told.select("fp", F.coalesce("least_id", "first_id").alias("value")).where("value is not null")
    store = sorted_store.write(told.mapInArrow(_keyed, "hash long, value long"), "components")
    for used in (first, label, least):
        drop_stored(used)

    def run(batches):
        worker.begin("simhash_bytes")
        for b in batches:
            value, hit = store.longs(_key(np.asarray(b.column(1))))
            found = pc.if_else(pa.array(hit), pa.array(value), b.column(0))
            yield pa.record_batch([*b.columns, found], names=["doc_id", "fp", "component_id"])

    return own.mapInArrow(run, "doc_id long, fp long, component_id long")


worker.keeps("simhash_bytes", lambda: None)


def _key(fp: np.ndarray) -> np.ndarray:
    return mix64(fp.view(np.uint64) + MIX)


def _keyed(batches):
    for b in batches:
        yield pa.record_batch([pa.array(_key(np.asarray(b.column(0))).view(np.int64)), b.column(1)], names=["hash", "value"])


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the row with the component's smallest doc_id.

    Of repeated rows with that doc_id one stays. Where a whole component has no doc_id, one row of each of
    its fingerprints stays. All columns are kept.
    """
    found = near_duplicates(docs)
    first = stored(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp").distinct(), "kept")
    ids = first.where("doc_id is not null").select("doc_id").distinct()
    named = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    loose = docs.where("doc_id is null").withColumn("_seamline_fp", F.pandas_udf(_fp_series, "long")("text"))
    wanted = first.where("doc_id is null").select(F.col("fp").alias("_seamline_fp"))
    loose = loose.join(wanted, "_seamline_fp", "left_semi").dropDuplicates(["_seamline_fp"])
    return named.select(*docs.columns).unionByName(loose.select(*docs.columns))


def _fp_series(texts: pd.Series) -> pd.Series:
    return pd.Series([int.from_bytes(fingerprint(None if t is None else t.encode()), "big", signed=True) for t in texts], dtype="int64")

"""Values of 64-bit hashes in sorted arrays, split by the hashes' first bits into files of the shared folder.

The store grows with what is put in; the driver knows a row a file. Workers map the files that they look
into where the folder is mounted, and read them elsewhere, keeping the last few.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .scratch import drop_stored, local_path, new_path, open_fs, stored, write_file

#: hashes in a file, about; more hashes make more files
SEGMENT = 1 << 18
#: files that a worker keeps mapped, or read where the shared folder isn't mounted
OPEN_MAPPED, OPEN_READ = 4096, 16

_OPEN: OrderedDict[str, tuple[np.ndarray, ...]] = OrderedDict()
worker.keeps("sorted_store", _OPEN.clear)


def _arrays(uri: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bytes of their values) of a file."""
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri]
    mounted = uri.startswith("file:")
    if mounted:
        raw = np.memmap(local_path(uri), np.uint8, "r")
    else:
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    while len(_OPEN) >= (OPEN_MAPPED if mounted else OPEN_READ):
        _OPEN.popitem(last=False)
    _OPEN[uri] = raw[: 8 * n].view("<u8"), raw[8 * n : 16 * n]
    return _OPEN[uri]


class Store:
    """What a worker needs to look hashes up: the number of bits that name a file, and the files' names and sizes."""

    def __init__(self, folder: str, bits: int, files: dict[int, tuple[str, int]]):
        self.folder, self.bits, self.files = folder, bits, files

    def __len__(self) -> int:
        return sum(n for _, n in self.files.values())

    def _found(self, wanted: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Of each wanted hash (unsigned): the values of the given kinds, zeros where it is absent, and whether it is there."""
        place, one = pd.factorize(wanted)
        order = np.argsort(one)
        one = one[order]
        out = [np.zeros(len(one), k) for k in (*kinds, "?")]
        of, starts = np.unique(one >> np.uint64(64 - self.bits), return_index=True)
        for s, i, j in zip(of.tolist(), starts, [*starts[1:], len(one)]):
            if s in self.files:
                h, raw = _arrays(*self.files[s])
                at = np.minimum(np.searchsorted(h, one[i:j]), len(h) - 1)
                hit = h[at] == one[i:j]
                begin = 0
                for k, values in zip(kinds, out):
                    size = len(h) * np.dtype(k).itemsize
                    values[i:j] = np.where(hit, raw[begin : begin + size].view(k)[at], 0)
                    begin += size
                out[-1][i:j] = hit
        back = np.empty(len(one), np.int64)
        back[order] = np.arange(len(one))
        return [x[back][place] for x in out]

    def values(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both numbers of each hash, 0 where it is absent."""
        a, b, _ = self._found(wanted, ("<f4", "<f4"))
        return a.astype(np.float64), b.astype(np.float64)

    def longs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the long of each hash, whether it is there)."""
        value, hit = self._found(wanted, ("<i8",))
        return value, hit


def _writer(folder: str):
    """Writes the rows of each segment, which stand together, as one file, named by the attempt that wrote it."""

    def run(batches):
        held, now = [], None

        def out():
            x = pa.Table.from_batches(held)
            h = x["hash"].to_numpy().view(np.uint64)
            at = np.argsort(h)
            uri = f"{folder}/{uuid.uuid4().hex}"
            kinds = {"a": "<f4", "b": "<f4", "value": "<i8"}
            write_file(uri, [h[at].astype("<u8").tobytes(), *(x[c].to_numpy()[at].astype(kinds[c]).tobytes() for c in x.column_names[2:])])
            held.clear()
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([uri]), pa.array([len(h)], pa.int64())], names=["segment", "uri", "n"])

        for b in batches:
            segments = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1).tolist(), len(segments)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and segments[i] != now:
                    yield out()
                now = int(segments[i])
                held.append(b.slice(i, j - i))
        if held:
            yield out()

    return run


def write(rows: DataFrame, name: str) -> Store:
    """A store of the rows (hash long, a double, b double) or (hash long, value long); no hash may stand twice."""
    spark = rows.sparkSession
    columns = ["value"] if "value" in rows.columns else ["a", "b"]
    rows = stored(rows.select("hash", *columns), name)
    bits = max(1, (rows.count() // SEGMENT).bit_length())
    folder = new_path(spark, f"{name}_store")
    x = rows.select(F.expr(f"shiftrightunsigned(hash, {64 - bits})").alias("segment"), "hash", *columns)
    x = x.repartition("segment").sortWithinPartitions("segment")
    files = x.mapInArrow(_writer(folder), "segment long, uri string, n long").collect()
    drop_stored(rows)
    return Store(folder, bits, {r["segment"]: (r["uri"], r["n"]) for r in files})

"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Code lengths come from the counts of all ids of the corpus (package-merge under a limit, so a table of
2**limit entries decodes). A file holds ids of documents in ascending doc_id order:

    magic | code lengths | blocks | document table | block table | fixed tail

A block has up to 65,536 ids and decodes by itself; in it, every 64th id has a checkpoint with its bit
offset, from which runs of 64 ids decode side by side, each step one table look-up for all runs.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import drop_stored, new_path, open_fs, stored, write_file
from .token_table import END_ID, token_table

MAGIC = b"SLHUF001"
LIMIT, BLOCK, RUN = 20, 1 << 16, 64
#: ids in a file
FILE_IDS = 1 << 22
_TAIL = struct.Struct("<QQQ8s")
_BLOCK = struct.Struct("<III")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count; 0 for the rest.

    Package-merge: level by level, the cheapest pairs of the level below join the single ids. How many single
    ids are among the items taken at a level tells how many of the rarest ids get one more bit there.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("the limit is too small for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.int64)
    level, levels = single, [np.ones(len(single), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        levels.append(by < len(single))
    take = 2 * len(single) - 2
    for is_single in reversed(levels):
        n = int(is_single[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        step = np.uint64(1) << (np.uint64(63) - lengths[order].astype(np.uint64))
        start = np.concatenate([[np.uint64(0)], np.cumsum(step)[:-1]])
        codes[order] = (start >> (np.uint64(63) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every ``limit`` bits that may come next."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(spans.sum())
    ids[:n], bits[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Counts, checkpoints (the bit offset of every 64th id) and bits of one block."""
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    starts = ends - n_bits
    word = starts >> 5
    window = codes[ids].astype(np.uint64) << (64 - (starts & 31) - n_bits).astype(np.uint64)
    words = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint32)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] |= np.bitwise_or.reduceat(window >> np.uint64(32), first).astype(np.uint32)
    words[word[first] + 1] |= np.bitwise_or.reduceat(window & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    marks = starts[::RUN].astype("<u4").tobytes()
    bits = words.astype(">u4").tobytes()
    return _BLOCK.pack(len(ids), len(marks), len(bits)) + marks + bits


def decode_blocks(blocks: list[bytes], table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The ids of some blocks, all runs of all blocks side by side."""
    by_bits, by_length = table
    starts, counts, bits, at = [], [], [], 0
    for b in blocks:
        n, marks, size = _BLOCK.unpack_from(b)
        mark = np.frombuffer(b, "<u4", marks // 4, _BLOCK.size).astype(np.int64)
        starts.append(mark + 8 * at)
        counts.append(np.minimum(RUN, n - RUN * np.arange(len(mark))))
        bits.append(b[_BLOCK.size + marks : _BLOCK.size + marks + size])
        at += size
    raw = np.frombuffer(b"".join([*bits, bytes(8)]), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, n = np.concatenate(starts), np.concatenate(counts)
    out = np.zeros((len(at), RUN), np.uint32)
    for k in range(RUN):
        ahead_of = (ahead[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[:, k] = by_bits[ahead_of]
        at = at + np.where(k + 1 < n, by_length[ahead_of], 0)
    return out[np.arange(RUN) < n[:, None]]


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zlib.compress(sink.getvalue().to_pybytes(), 1)


def file_chunks(rows, lengths: np.ndarray, totals: dict):
    """The bytes of a file of ``rows`` (doc_id, ids); fills ``totals``."""
    codes = canonical_codes(lengths)
    head = zlib.compress(lengths.tobytes())
    at = len(MAGIC) + 4 + len(head)
    yield MAGIC + struct.pack("<I", len(head)) + head
    doc_ids, sizes, places, waiting, held = [], [], [], [], 0
    for doc_id, ids in rows:
        doc_ids.append(doc_id)
        sizes.append(len(ids))
        waiting.append(ids)
        held += len(ids)
        while held >= BLOCK:
            flat = np.concatenate(waiting)
            for k in range(0, held // BLOCK * BLOCK, BLOCK):
                yield (block := encode_block(flat[k : k + BLOCK], codes, lengths))
                places.append(at)
                at += len(block)
            waiting = [flat[held // BLOCK * BLOCK :]]
            held %= BLOCK
    if held:
        yield (block := encode_block(np.concatenate(waiting), codes, lengths))
        places.append(at)
        at += len(block)
    docs = _ipc(pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(sizes, pa.int64())}))
    blocks = np.array([*places, at], "<u8").tobytes()
    yield docs + blocks + _TAIL.pack(at, at + len(docs), len(places), MAGIC)
    totals.update(n_docs=len(doc_ids), n_ids=sum(sizes))


class IdFile:
    """A file of this format, read by ranges."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        tail = self.f.read_at(_TAIL.size, size - _TAIL.size)
        docs_at, blocks_at, n, magic = _TAIL.unpack(tail)
        start = self.f.read_at(len(MAGIC) + 4, 0)
        if magic != MAGIC or start[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        (head,) = struct.unpack("<I", start[len(MAGIC) :])
        self.lengths = np.frombuffer(zlib.decompress(self.f.read_at(head, len(start))), np.uint8)
        self.docs = pa.ipc.open_stream(zlib.decompress(self.f.read_at(blocks_at - docs_at, docs_at))).read_all()
        self.places = np.frombuffer(self.f.read_at(8 * (n + 1), blocks_at), "<u8").astype(np.int64)
        self.table = decoding_table(self.lengths)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last``, the latter excluded."""
        a, b = int(self.places[first]), int(self.places[last])
        data = self.f.read_at(b - a, a)
        cuts = self.places[first : last + 1] - a
        return decode_blocks([data[s:e] for s, e in zip(cuts[:-1], cuts[1:])], self.table)

    def documents(self, at_once: int = 16):
        """(doc_id, ids) in the file's order."""
        left, block, n_blocks = np.zeros(0, np.uint32), 0, len(self.places) - 1
        for doc_id, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n"].to_pylist()):
            parts = [left]
            have = len(left)
            while have < n:
                more = self.ids(block, min(block + at_once, n_blocks))
                block = min(block + at_once, n_blocks)
                parts.append(more)
                have += len(more)
            flat = np.concatenate(parts) if len(parts) > 1 else left
            yield doc_id, flat[:n]
            left = flat[n:]

    def close(self) -> None:
        self.f.close()


def _counter(dtype: str, size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def id_counts(table: DataFrame, dtype: str, size: int) -> DataFrame:
    """(id, n) over all documents: at most ``size`` rows, and as many from each task."""
    part = table.select("ids").mapInArrow(_counter(dtype, size), "id long, n long")
    return part.groupBy("id").agg(F.sum("n").alias("n"))


def _writer(folder: str, lengths: np.ndarray, dtype: str):
    def run(batches):
        part, totals = TaskContext.get().partitionId(), {}
        rows = ((d, np.frombuffer(i, dtype)) for b in batches for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        first = next(rows, None)
        if first is None:
            return
        # a name of this attempt: the manifest that Spark keeps names the files of the attempts that it kept
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.ids"

        def all_rows():
            yield first
            yield from rows

        size = write_file(uri, file_chunks(all_rows(), lengths, totals))
        yield pa.record_batch([[part], [uri], [totals["n_docs"]], [totals["n_ids"]], [size]], names=["part", "uri", "n_docs", "n_ids", "n_bytes"])

    return run


def write_ids(docs: DataFrame, tokenizer: str | None = None, end: int = END_ID) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order (nulls first; rows of one doc_id in any order, by ids
    inside a file); gives the table of files (part, uri, n_docs, n_ids, n_bytes).

    To the driver come the counts of ids, at most as many as the vocabulary holds, and their sum.
    """
    path = tokenizer or tokens.default_tokenizer()
    code = tokens.coder(path)
    size, dtype = max(code.size, end + 1), code.dtype.str
    table = stored(token_table(docs, path, end), "ids")
    counts = np.zeros(size, np.int64)
    for r in id_counts(table, dtype, size).collect():
        counts[r["id"]] = r["n"]
    parts = max(1, -(-int(counts.sum()) // FILE_IDS))
    ordered = table.select("doc_id", "ids").repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    files = ordered.mapInArrow(_writer(new_path(docs.sparkSession, "id-files"), code_lengths(counts), dtype), "part long, uri string, n_docs long, n_ids long, n_bytes long")
    files = stored(files, "id-manifest")
    drop_stored(table)
    return files


def _reader(batches):
    for b in batches:
        for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f, rows = IdFile(uri), []
            for doc_id, ids in f.documents():
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            f.close()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. One row per file is summed in order."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    x = files.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return x.repartition(max(1, files.count())).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end: int = END_ID) -> DataFrame:
    """Write ``docs`` as token-id files and describe each document from what is read back.

    Null or empty texts have the end id alone. Rows with equal doc_id follow one another, in an order by hashes of
    their ids between files and by the ids inside a file, so their starts agree with the files; null doc_ids come
    first. A text of any length is written whole, in blocks. Columns besides doc_id and text are ignored; no rows,
    no files.
    """
    return read_digests(write_ids(docs, tokenizer, end))

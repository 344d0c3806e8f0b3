"""Words as UTF-8 bytes and hashed character n-grams, the parts that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: the characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = " \t\n\x0b\x0c\r"


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The text column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


#: bytes of texts that are taken apart at a time
AT_ONCE = 2 << 20


def parts(batch: pa.RecordBatch):
    """The batch in slices of about ``AT_ONCE`` bytes, so that lists of words stay small however many rows come."""
    step = max(1, batch.num_rows * AT_ONCE // max(1, batch.nbytes))
    for k in range(0, max(1, batch.num_rows), step):
        yield batch.slice(k, step)


def gathered(batches, rows: int):
    """The batches put together to ``rows`` or more, for rows of a few bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_slices(texts: list) -> list[slice]:
    """Slices of a list of texts (or nulls) of about ``AT_ONCE`` characters each."""
    step = max(1, len(texts) * AT_ONCE // max(1, sum(len(t) for t in texts if t)))
    return [slice(k, k + step) for k in range(0, len(texts), step)]


MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX2
    x ^= x >> np.uint64(27)
    x *= MIX
    x ^= x >> np.uint64(31)
    return x


def code_points(words: list[str], left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between the marks ``left`` and ``right``; and the index of the word of each."""
    marked = [left + w + right for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return flat, np.repeat(np.arange(len(marked)), np.fromiter(map(len, marked), np.int64, len(marked)))


def gram_hashes(flat: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, end position) of every ``order``-gram of code points inside one word."""
    n = len(flat) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = h * MIX + flat[k : k + n] + np.uint64(1)
    ends = np.arange(order - 1, order - 1 + n)
    inside = owner[:n] == owner[ends]
    return mix64(h[inside]), ends[inside]

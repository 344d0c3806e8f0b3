"""Documents as token ids, stored once for the operators that need them in another order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens

END_ID = 2


def _coded(path: str, end: int, more):
    """``more``: gives further columns (name, kind, values) from the ids of a batch's rows."""

    def run(batches):
        code = tokens.coder(path)
        for b in batches:
            ids = [code.encode_ids(t, end) for t in b.column(1).to_pylist()]
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(map(len, ids), pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
            for name, kind, values in more(code, ids) if more else ():
                cols[name] = pa.array(values, kind)
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return run


def token_table(docs: DataFrame, path: str, end: int = END_ID, more=None, schema: str = "") -> DataFrame:
    """(doc_id, n_tokens, ids): little-endian ids of each whole text with the end id; null text as empty."""
    return docs.select("doc_id", "text").mapInArrow(_coded(path, end, more), "doc_id long, n_tokens long, ids binary" + schema)

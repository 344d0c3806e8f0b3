"""Response parsers whose exact rules SQL lacks (balanced brackets, strict JSON), batch by batch in pandas UDFs."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .responses import _PHRASES

_PAIRS = {"{": "}", "[": "]"}
# fixed values: spellings of the labels
_WORDS = {"BORDER": "BORDER", "TRUE": "BORDER", "YES": "BORDER", "NOBORDER": "NOBORDER", "NO_BORDER": "NOBORDER", "FALSE": "NOBORDER", "NO": "NOBORDER"}


def label_of(value) -> str | None:
    return None if value is None else _WORDS.get(str(value).strip().upper())


def _balanced_end(s: str, at: int) -> int:
    """Where the bracket at ``at`` closes (only its own kind counts, strings don't), else -1."""
    depth = 0
    for m in re.finditer(f"[{re.escape(s[at] + _PAIRS[s[at]])}]", s[at:]):
        depth += 1 if m[0] == s[at] else -1
        if not depth:
            return at + m.end()
    return -1


def json_candidate(text: str | None) -> str | None:
    """The whole text if it begins with a bracket; else from its first bracket to where that closes."""
    s = (text or "").strip()
    m = re.search(r"[{\[]", s)
    if m is None:
        return None
    if m.start() == 0:
        return s
    end = _balanced_end(s, m.start())
    return s[m.start() : end] if end >= 0 else None


def json_object(text: str | None) -> dict | None:
    """The first balanced ``{}`` that parses as an object; the scan goes on after ones that don't parse."""
    s, at = text or "", 0
    while (at := s.find("{", at)) >= 0:
        end = _balanced_end(s, at)
        if end < 0:
            return None
        try:
            found = json.loads(s[at:end])
        except ValueError:
            at = end
            continue
        return found if isinstance(found, dict) else None
    return None


def _float(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def tolerant(text: str | None) -> tuple[str, float | None, bool, str, str]:
    """(label, confidence, parse_ok, parse_error, method)."""
    found = json_object(text)
    if found is not None and (label := label_of(found.get("label", ""))):
        return label, _float(found.get("confidence")), True, "", "json"
    word = re.search(r"\bNOBORDER\b", up := (text or "").upper()) or re.search(r"\bBORDER\b", up)
    if word:
        return word[0], None, True, "", "regex_fallback"
    return "NOBORDER", None, False, "no_json_or_label_token", "default_noborder"


def label_confidence(text: str | None) -> tuple[str, float | None]:
    """A label in any case, and the confidence of the JSON even if the label is the text's."""
    found = json_object(text) or {}
    up = (text or "").upper()
    word = re.search(r"\bNOBORDER\b", up) or re.search(r"\bBORDER\b", up)
    return label_of(found.get("label", "")) or (word[0] if word else "NOBORDER"), _float(found.get("confidence"))


def word_label(text: str | None) -> str | None:
    kept = [x.strip() for x in (text or "").splitlines() if x.strip()]
    for x in kept[:5]:
        if label := label_of(x):
            return label
    up = (text or "").upper()
    for word in ("NOBORDER", "BORDER"):
        if re.search(rf"\b{word}\b", up):
            return word
    return next((label for p, label in _PHRASES if re.search(p, (text or "").lower())), None)


def sentence_word(text: str | None) -> str | None:
    kept = [x.strip() for x in (text or "").splitlines() if x.strip()]
    for x in [*kept[:4], (text or "").strip()]:
        if re.search(r"\bNONE\b", x, re.I):
            return "NONE"
        if m := re.search(r"\b(\d+)\b", x):
            return m[1]
    return None


JSON_FAMILIES = frozenset("BCDEFGJKLMNOPQ")


@lru_cache(maxsize=8)
def _payload(text: str | None) -> tuple[object, str | None]:
    """(what the JSON candidate of a text holds, that as text); the text is None without JSON. Families ask in turn."""
    try:
        payload = json.loads(json_candidate(text) or "")
    except ValueError:
        return None, None
    return payload, json.dumps(payload, ensure_ascii=False)


def family_output(family: str, text: str | None) -> tuple[str | None, bool, str, str | None]:
    """(label, is_valid, error, payload as text) by the family's contract."""
    family = family.upper()
    if family == "H":
        word = sentence_word(text)
        if word is None:
            return None, False, "invalid_sentence_id_or_none", text
        return ("NOBORDER" if word == "NONE" else None), True, "", word
    if family == "A" and (label := word_label(text)):
        return label, True, "", text
    if family not in JSON_FAMILIES and family not in "AI":
        return None, False, f"unsupported_family:{family}", None
    payload, shown = _payload(text)
    if shown is None:
        return (None, False, "invalid_label", text) if family == "A" else (None, False, "json_parse_error", None)
    if family == "I":
        return (None, True, "", shown) if isinstance(payload, list) else (None, False, "json_not_array", shown)
    label = label_of(payload.get("label")) if isinstance(payload, dict) else None
    if label:
        return label, True, "", shown
    if family == "A":
        return None, False, "invalid_label", text
    return None, False, "missing_or_invalid_label" if isinstance(payload, dict) else "json_not_object", shown


def strict(text: str | None, family: str = "L") -> tuple[str, float | None, bool, str, str]:
    label, ok, error, payload = family_output(family, text)
    if ok and label:
        found = json.loads(payload) if family != "A" and payload else None
        return label, _float(found.get("confidence")) if isinstance(found, dict) else None, True, "", "strict"
    return "NOBORDER", None, False, error or "strict_parse_failed", "default_noborder"


def _udf(f, schema: str):
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [f(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return F.pandas_udf(run, schema)


_EVAL = "label string, confidence double, parse_ok boolean, parse_error string, parse_method string"


def candidate_col(c) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: json_candidate(t if isinstance(t, str) else None)), "string")(c)


def tolerant_col(c) -> Column:
    return _udf(tolerant, _EVAL)(c)


def strict_col(c, family: str = "L") -> Column:
    return _udf(lambda t: strict(t, family), _EVAL)(c)


def label_confidence_col(c) -> Column:
    return _udf(label_confidence, "label string, confidence double")(c)


def by_family(df: DataFrame, column: str, families: str) -> DataFrame:
    """The other columns of ``df`` and (family, label, is_valid, error, payload): what each of several families (letters)
    makes of a text, in one pass."""
    keep = [c for c in df.columns if c != column]
    kinds = {"family": pa.string(), "label": pa.string(), "is_valid": pa.bool_(), "error": pa.string(), "payload": pa.string()}

    def run(batches):
        for b in batches:
            rows = [(f, *family_output(f, t)) for t in b.column(len(keep)).to_pylist() for f in families]
            at = pa.array(np.repeat(np.arange(b.num_rows), len(families)))
            found = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(keep))), *(pa.array(c, k) for c, k in zip(found, kinds.values()))], names=[*keep, *kinds])

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T.BooleanType() if n == "is_valid" else T.StringType()) for n in kinds)])
    return df.select(*keep, column).mapInArrow(run, schema)


def family_col(c, family: str) -> Column:
    return _udf(lambda t: family_output(family, t), "label string, is_valid boolean, error string, payload string")(c)

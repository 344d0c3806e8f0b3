"""Quality rules with n-gram perplexity.

A text is the sequence of its characters, words joined by one space, so grams reach across words. All grams
of ``ORDER`` characters of all texts are counted in Spark per language, those of texts laden with symbols as
another register of the language, and from them a modified Kneser-Ney model is built (raw counts for the longest grams, numbers of different left neighbours below, three discounts
a length). Discounted counts and the totals of contexts are stored in the shared folder as sorted arrays of full
hashes, split by their first bits: the model grows with the corpus, and workers map the files that they look
into. A text's perplexity per character as prose of its language must lie in the language's band, whose ends are
set from the perplexities of all its texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sorted_store, worker
from .scratch import drop_stored, stored
from .wordbytes import MIX, SPACES, gathered, mix64, parts, text_slices, texts_of

ORDER = 5
START, END = "\x02" * (ORDER - 1), "\x03"
#: characters that are looked at together, and different grams that a task holds before it hands its counts on
PIECE, HELD = 1 << 18, 1_000_000
SYMBOLS = "#*$%&|<>"
#: base rules
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: the band: so many spreads (from the median to the outer percentile) below and above the median, in logarithms
LOW_SPREADS, HIGH_SPREADS, LOW_CUT, HIGH_CUT = 12.0, 12.0, 0.25, 0.75
#: a class of length with fewer texts has the band of its whole language; a language with fewer has spreads shrunk
#: towards those of all languages together, and these, in so small a table, towards PRIOR
LEAST_TEXTS, PRIOR = 100, 0.05
#: room for rounding where all texts are alike
ROUNDING = 1e-6
#: symbols in a hundred characters of words from which a text is of another register than its language's prose
SYMBOL_PERCENT = 2
#: the least share of a context's mass that goes to shorter grams, also after rounding
LEAST_BACK = 1e-9


# -- grams -------------------------------------------------------------------------------------------------


def _pieces(texts: list[list[bytes]]):
    """(code points, positions, texts) by pieces of ``PIECE`` positions: all positions of the texts (lists of words)
    and of their ends, with the index of the text of each. The character 0 counts as U+FFFF."""
    marked = [START + b" ".join(words).decode() + END for words in texts]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
    if not flat.all():
        flat = np.where(flat == 0, np.uint32(0xFFFF), flat)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    own, starts = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.cumsum(sizes) - sizes
    for k in range(0, len(flat), PIECE):
        at = np.arange(k, min(k + PIECE, len(flat)))
        of = own[at]
        inside = at - starts[of] >= ORDER - 1
        if inside.any():
            yield flat, at[inside], of[inside]


def _different(flat: np.ndarray, at: np.ndarray, times: bool) -> tuple[np.ndarray, np.ndarray]:
    """The different grams that end at some positions, as rows of code points; and how often each stands (``times``)
    or the row of each position."""
    low = at[0] - ORDER + 1
    window, ends = flat[low : at[-1] + 1], at - low
    used = np.zeros(0x110000, bool)
    used[window] = True
    alphabet = np.flatnonzero(used)
    bits = 64 // ORDER
    if len(alphabet) <= 1 << bits:
        number = np.zeros(0x110000, np.uint16)
        number[alphabet] = np.arange(len(alphabet))
        ids = number[window].astype(np.uint64)
        n = len(ids) - ORDER + 1
        key = ids[:n].copy()
        for k in range(1, ORDER):
            key <<= np.uint64(bits)
            key |= ids[k : k + n]
        key = key[ends - (ORDER - 1)]
        place, one = pd.factorize(key)
        mask = np.uint64((1 << bits) - 1)
        chars = np.stack([alphabet[one >> np.uint64(bits * (ORDER - 1 - k)) & mask] for k in range(ORDER)], axis=1)
    else:
        place, one = pd.factorize(_hash(np.stack([window[ends - (ORDER - 1 - k)] for k in range(ORDER)], axis=1), 0))
        first = np.empty(len(one), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        chars = np.stack([window[ends[first] - (ORDER - 1 - k)] for k in range(ORDER)], axis=1)
    return chars.astype("<u4"), np.bincount(place) if times else place


def _hash(chars: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.full(len(chars), chars.shape[1], np.uint64)
    for k in range(chars.shape[1]):
        h = h * MIX + chars[:, k] + np.uint64(1)
    return mix64(mix64(h) ^ np.uint64(salt))


def _register(lang: str, words: list[bytes]) -> str:
    """Whose grams a text's are: its language's, or if it is laden with symbols those of the language's other register."""
    chars = b"".join(words)
    return f"{lang}#" if 100 * sum(map(chars.count, SYMBOLS.encode())) > SYMBOL_PERCENT * len(chars.decode()) else lang


def _salt(key: str, length: int, kind: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{length}:{key}")


def _grams(batches):
    """(key, gram, n): the longest grams of a task's texts, counted together as long as ``HELD`` different ones allow."""
    worker.begin("kneser_ney")
    held: dict[str, list] = {}

    def settle():
        for key, found in held.items():
            chars = np.concatenate([c for c, _ in found])
            _, first, place = np.unique(_hash(chars, 0), return_index=True, return_inverse=True)
            held[key] = [(chars[first], np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64))]
        return sum(len(c) for x in held.values() for c, _ in x)

    def out():
        settle()
        for key, [(chars, n)] in held.items():
            for k in range(0, len(n), 100_000):
                grams = np.ascontiguousarray(chars[k : k + 100_000]).view(f"<U{ORDER}")[:, 0].tolist()
                yield pa.record_batch([pa.array([key] * len(grams), pa.string()), pa.array(grams), pa.array(n[k : k + 100_000])], names=["key", "gram", "n"])
        held.clear()

    rows = 0
    for b in (p for whole in batches for p in parts(whole)):
        by_key: dict[str, list] = {}
        for key, text in zip(b.column(0).to_pylist(), texts_of(b)):
            if text and (words := text.split()):
                by_key.setdefault(_register(key, words), []).append(words)
        for key, texts in by_key.items():
            for flat, at, _ in _pieces(texts):
                found = _different(flat, at, True)
                held.setdefault(key, []).append(found)
                rows += len(found[1])
                if rows >= 2 * HELD:
                    rows = settle()
                    if rows >= HELD:
                        yield from out()
                        rows = 0
    yield from out()


def _hashed(batches):
    """The salted hashes of each gram and of its context (all but the last character)."""
    for b in gathered(batches, 20_000):
        keys, lengths = b.column(0).dictionary_encode(), np.asarray(b.column(1))
        chars = np.array(b.column(2).to_pylist(), f"<U{ORDER}").view("<u4").reshape(-1, ORDER)
        code, names = np.asarray(keys.indices), keys.dictionary.to_pylist()
        out = np.zeros((2, len(chars)), np.uint64)
        for i, k in np.unique(np.stack([code, lengths]), axis=1).T.tolist():
            of = np.flatnonzero((code == i) & (lengths == k))
            out[0, of] = _hash(chars[of, :k], _salt(names[i], k, "gram"))
            out[1, of] = _hash(chars[of, : k - 1], _salt(names[i], k, "context"))
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array(h.view(np.int64)) for h in out), b.column(3)], names=["key", "length", "gram", "context", "n"])


def gram_table(docs: DataFrame, key: str = "lang") -> DataFrame:
    """(key, length, gram, context, n): adjusted counts of all different grams of all lengths, per language."""
    texts = docs.where("text is not null").select(F.coalesce(F.col(key), F.lit("")).alias("key"), "text")
    level = stored(texts.mapInArrow(_grams, "key string, gram string, n long").groupBy("key", "gram").agg(F.sum("n").alias("n")), "grams")
    both = level.select("key", F.lit(ORDER).alias("length"), "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("key", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        both = both.unionByName(level.select("key", F.lit(k).alias("length"), "gram", "n"))
    return both.mapInArrow(_hashed, "key string, length int, gram long, context long, n long")


# -- the model ---------------------------------------------------------------------------------------------


def _discounts(table: DataFrame) -> DataFrame:
    """(key, length, grams, cut1, cut2, cut3): what counts of 1, 2, and 3 or more lose, from how many grams stand 1, 2,
    3 and 4 times (1 where there is none)."""
    seen = [F.greatest(F.lit(1), F.count(F.when(F.col("n") == k, 1))).alias(f"n{k}") for k in range(1, 5)]
    x = table.groupBy("key", "length").agg(F.count(F.lit(1)).alias("grams"), *seen).withColumn("y", F.expr("n1 / (n1 + 2 * n2)"))
    cuts = [F.expr(f"least({k}, greatest(0.05D, {k} - {k + 1} * y * n{k + 1} / n{k}))").cast("double").alias(f"cut{k}") for k in (1, 2, 3)]
    return x.select("key", "length", "grams", *cuts)


class KneserNey:
    """Under salted hashes, in the shared folder: each gram's count less its discount, each context's total and the
    share that its discounts leave to shorter grams, and each language's number of different characters."""

    def __init__(self, store: sorted_store.Store):
        self.store = store

    def _log_p(self, key: str, chars: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each gram after the others; nan in a language that isn't known."""
        asked = [np.array([_salt(key, 0, "characters")], np.uint64)]
        for k in range(1, ORDER + 1):
            asked += [_hash(chars[:, ORDER - k : -1], _salt(key, k, "context")), _hash(chars[:, ORDER - k :], _salt(key, k, "gram"))]
        a, b = self.store.values(np.concatenate(asked))
        n = len(chars)
        p = np.full(n, 1 / (a[0] + 1) if a[0] else np.nan)
        for k in range(ORDER):
            total, back, count = a[1 + 2 * k * n :][:n], b[1 + 2 * k * n :][:n], a[1 + (2 * k + 1) * n :][:n]
            known = total > 0
            p[known] = count[known] / total[known] + np.maximum(back[known], LEAST_BACK) * p[known]
        return np.log(p)

    def scores(self, key: str, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability, characters and the end) of each text, given as words."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for flat, at, of in _pieces(texts):
            chars, row = _different(flat, at, False)
            total += np.bincount(of, weights=self._log_p(key, chars)[row], minlength=len(texts))
            n += np.bincount(of, minlength=len(texts))
        return total, n


def _language_size(batches):
    for b in batches:
        keys = [_salt(key, 0, "characters") for key in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), b.column(1), pa.array(np.zeros(len(keys)))], names=["hash", "a", "b"])


def train(docs: DataFrame, key: str = "lang") -> KneserNey:
    """The model of all texts. To the driver come names and sizes of the files."""
    table = stored(gram_table(docs, key), "levels")
    cuts = stored(_discounts(table), "discounts")
    cut = F.when(F.col("n") == 1, F.col("cut1")).when(F.col("n") == 2, F.col("cut2")).otherwise(F.col("cut3"))
    x = table.join(cuts, ["key", "length"]).withColumn("cut", cut)
    grams = x.select(F.col("gram").alias("hash"), (F.col("n") - F.col("cut")).alias("a"), F.lit(0.0).alias("b"))
    sums = x.groupBy("context").agg(F.sum("n").cast("double").alias("total"), F.sum("cut").alias("held"))
    contexts = sums.select(F.col("context").alias("hash"), F.col("total").alias("a"), (F.col("held") / F.col("total")).alias("b"))
    characters = cuts.where("length = 1").select("key", F.col("grams").cast("double")).mapInArrow(_language_size, "hash long, a double, b double")
    store = sorted_store.write(grams.unionByName(contexts).unionByName(characters), "kneser_ney")
    for used in (table, cuts):
        drop_stored(used)
    return KneserNey(store)


# -- texts -------------------------------------------------------------------------------------------------


def base_values(text: bytes | None) -> tuple[list[bytes], int, int, int, int, int]:
    """(words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return [], 0, 0, 0, 0, 0
    words, plain = text.split(), text.decode()
    word_chars = len(plain) - sum(map(plain.count, SPACES))
    lines = [x for x in plain.split("\n") if x.strip(SPACES)]
    return words, len(words), word_chars, sum(map(plain.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in windows of three words that stand twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = dict.fromkeys(words)
    if len(ids) == n:
        return 0
    ids = dict(zip(ids, range(len(ids))))
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, n)
    size = np.uint64(len(ids))
    if len(ids) < 1 << 21:
        windows = (x[:-2] * size + x[1:-1]) * size + x[2:]
    else:
        windows = np.unique(x[:-2] * size + x[1:-1], return_inverse=True)[1].astype(np.uint64) * size + x[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


worker.keeps("kneser_ney", lambda: None)


def perplexities(model: KneserNey, langs: list[str | None], texts: list[list[bytes]]) -> np.ndarray:
    """Perplexity per character (and end) of each list of words, as prose of its language, or where the language has
    none as its other register; nan without words or model."""
    worker.begin("kneser_ney")
    out = np.full(len(texts), np.nan)
    by_lang: dict[str, list[int]] = {}
    for k, (lang, words) in enumerate(zip(langs, texts)):
        if words:
            by_lang.setdefault(lang or "", []).append(k)
    for lang, rows in by_lang.items():
        total, n = model.scores(lang, [texts[k] for k in rows])
        if np.isnan(total).any():
            total, n = model.scores(f"{lang}#", [texts[k] for k in rows])
        out[rows] = np.exp(-total / n)
    return out


VALUES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, perplexity double"


def _rows(model: KneserNey, langs, texts) -> pd.DataFrame:
    base = [base_values(t) for t in texts]
    out = pd.DataFrame([x[1:] for x in base], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEATED_PERCENT * out["n_words"])
    out["perplexity"] = perplexities(model, langs, [x[0] for x in base])
    return out


def scores(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, lang, base values, base_failed, perplexity) of every row of ``docs``; a null lang is ''."""

    def run(batches):
        for b in (p for whole in batches for p in parts(whole)):
            langs = b.column(1).to_pylist()
            x = _rows(model, langs, texts_of(b))
            cols = [pa.array(x[c].to_numpy(), from_pandas=True) for c in x.columns]
            yield pa.record_batch([b.column(0), pa.array([v or "" for v in langs]), *cols], names=["doc_id", "lang", *x.columns])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id long, lang string, {VALUES}")


def bands(scored: DataFrame) -> DataFrame:
    """(lang, size, lowest, highest): the band of each language and class of length, and with size -1 that of
    the whole language, from the texts that pass the base rules."""
    x = scored.where("not base_failed and perplexity is not null").select("lang", _size("n_words").alias("size"), F.log("perplexity").alias("x"))
    x = x.withColumn("size", F.explode(F.array("size", F.lit(-1))))
    q = x.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", [LOW_CUT, 0.5, HIGH_CUT], 10_000).alias("q"))
    q = q.where((F.col("n") >= LEAST_TEXTS) | (F.col("size") == -1))
    low, mid, high = (F.col("q")[k] for k in range(3))
    q = stored(q.select("lang", "size", "n", mid.alias("mid"), (mid - low).alias("below"), (high - mid).alias("above")), "quantiles")
    pooled = [((F.sum(F.col("n") * F.col(c)) + LEAST_TEXTS * PRIOR) / (F.sum("n") + LEAST_TEXTS)).alias(f"{c}_all") for c in ("below", "above")]
    q = q.crossJoin(q.where("size = -1").agg(*pooled))
    own = F.least(F.lit(1.0), F.col("n") / LEAST_TEXTS)
    below, above = (F.greatest(own * F.col(c) + (1 - own) * F.col(f"{c}_all"), F.lit(ROUNDING)) for c in ("below", "above"))
    mid = F.col("mid")
    return q.select("lang", "size", F.exp(mid - LOW_SPREADS * below).alias("lowest"), F.exp(mid + HIGH_SPREADS * above).alias("highest"))


def _size(n_words: str):
    return F.floor(F.log2(F.greatest(F.col(n_words), F.lit(1)))).cast("int")


def _verdict(perplexity, lowest, highest):
    return F.coalesce((perplexity >= lowest) & (perplexity <= highest), F.lit(True))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity).

    One row per row of ``docs``, repeated ones too. A null text has no words and so fails the base rules. Documents
    without a language share the model and band of the language ''. Languages with fewer than ``LEAST_TEXTS`` texts
    have a band around their own median whose spreads are shrunk towards those of all languages. Ends of a band
    belong to it; where all texts have one perplexity the band is that, with room for rounding. Texts of any length
    are scored whole, piece by piece. Columns besides doc_id, text and lang are ignored; an empty table gives an
    empty one.
    """
    scored = stored(scores(docs, train(docs)), "scores")
    ends = stored(bands(scored), "bands")
    whole = ends.where("size = -1").select("lang", F.col("lowest").alias("low_all"), F.col("highest").alias("high_all"))
    x = scored.withColumn("size", _size("n_words")).join(ends, ["lang", "size"], "left").join(whole, "lang", "left")
    kept = ~F.col("base_failed") & _verdict(F.col("perplexity"), F.coalesce("lowest", "low_all"), F.coalesce("highest", "high_all"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "perplexity")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and lie in their language's band, as by ``judge``. A row's text is scored
    again beside its other columns, which is cheaper than shuffling the texts to join the verdicts; the bands, a row a
    language and class of length, come to the driver."""
    model = train(docs)
    limits = {(r["lang"], r["size"]): (r["lowest"], r["highest"]) for r in bands(scores(docs, model)).collect()}
    none = (0.0, float("inf"))

    def limit(lang, n_words):
        return limits.get((lang or "", max(n_words, 1).bit_length() - 1)) or limits.get((lang or "", -1), none)

    def run(langs: pd.Series, texts: pd.Series) -> pd.Series:
        langs = [v if isinstance(v, str) else None for v in langs]
        plain = [t.encode() if isinstance(t, str) else None for t in texts]
        x = pd.concat([_rows(model, langs[s], plain[s]) for s in text_slices(plain)] or [_rows(model, [], [])])
        ends = np.array([limit(v, n) for v, n in zip(langs, x["n_words"].tolist())]).reshape(-1, 2)
        p = x["perplexity"].to_numpy()
        inside = np.isnan(p) | ((p >= ends[:, 0]) & (p <= ends[:, 1]))
        return pd.Series(~x["base_failed"].to_numpy() & inside)

    return docs.where(F.pandas_udf(run, "boolean")("lang", "text"))

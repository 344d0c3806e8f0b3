"""Language identification by mixture inference.

Per language, character n-grams of the words of labelled documents are counted in Spark, each under its full
hash in sorted arrays in the shared folder; a word then has a likelihood in each language (trigrams backed off to
shorter grams). A document is a mixture of languages: expectation-maximisation over its words estimates the
proportions, and of the nested sets of its most likely languages the one with the best penalised likelihood is
kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sorted_store, worker
from .scratch import drop_stored, stored
from .wordbytes import code_points, gram_hashes, mix64, text_slices

#: lengths of grams, and characters that a language may have, for the mass of those not seen
LENGTHS, CHARACTERS = (1, 2, 3), 1 << 14
#: different words that a task holds while it counts, and different grams; words kept by a worker while it predicts, and scored at a time
COUNTED, GRAMS, HELD, SCORED = 60_000, 1_000_000, 250_000, 20_000
#: weight of a shorter gram's estimate, in occurrences
BACK_OFF = 4.0
#: proportions that change by less are settled
SETTLED = 1e-4
UNKNOWN = "und"


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _keys(words: list[str]):
    """For each length: (hashes, their ends), gram by gram; grams of one word follow one another; and the word of each
    character."""
    flat, owner = code_points(words, " ", " ")
    return {n: gram_hashes(flat, owner, n) for n in LENGTHS}, owner


def _salted(h: np.ndarray, lang: str, length: int) -> np.ndarray:
    return mix64(h ^ np.uint64(xxhash.xxh64_intdigest(f"{length}:{lang}")))


def _count_grams(batches):
    """(lang, hash, n): counts of salted grams, without language; and each language's characters in all, hash 0."""
    worker.begin("language_mixture")
    held: dict[str, Counter] = {}
    total: Counter = Counter()
    sums: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        h = np.concatenate([x for x, _ in sums])
        one, place = np.unique(h, return_inverse=True)
        return one, np.bincount(place, weights=np.concatenate([n for _, n in sums]), minlength=len(one))

    def settle():
        for lang, words in held.items():
            known = Counter()
            for w, c in words.items():
                if x := _letters(w):
                    known[x] += c
            if known:
                grams, owner = _keys(list(known))
                weight = np.fromiter(known.values(), np.float64, len(known))
                for n, (h, ends) in grams.items():
                    one, place = np.unique(h, return_inverse=True)
                    more = np.bincount(place, weights=weight[owner[ends]], minlength=len(one))
                    sums.append((_salted(one, lang, n), more))
                    if n == 1:
                        total[lang] += int(more.sum())
        held.clear()
        if sum(len(h) for h, _ in sums) >= 2 * GRAMS:
            sums[:] = [merged()]

    def out():
        if sums:
            h, n = merged()
            sums.clear()
            yield pa.record_batch([pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "hash", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) >= COUNTED:
                settle()
                if len(sums) == 1 and len(sums[0][0]) >= GRAMS:
                    yield from out()
    settle()
    yield from out()
    yield pa.record_batch([pa.array(total.keys(), pa.string()), pa.array([0] * len(total), pa.int64()), pa.array(total.values(), pa.int64())], names=["lang", "hash", "n"])


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out quarter; a row without doc_id belongs to neither."""
    return docs.where("lang is not null and text is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").select("lang", "text")


class MixtureModel:
    """The languages in alphabetical order, their numbers of characters, and the store of the counts of their grams."""

    def __init__(self, totals: dict[str, int], store: sorted_store.Store):
        self.langs, self.store, self.name = sorted(totals), store, store.folder
        self.totals = np.array([totals[x] for x in self.langs], np.float64)

    def _counts(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the different grams, a row a language; the column of each gram)."""
        one, place = np.unique(h, return_inverse=True)
        found, _ = self.store.values(np.concatenate([_salted(one, lang, length) for lang in self.langs]))
        return found.reshape(len(self.langs), len(one)), place

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log-likelihood of each word (letters only) in each language."""
        grams, owner = _keys(words)
        (h1, _), (h2, e2), (h3, e3) = (grams[n] for n in LENGTHS)
        (c1, k1), (c2, k2), (c3, k3) = (self._counts(n, h) for n, h in zip(LENGTHS, (h1, h2, h3)))
        total = self.totals[:, None]
        # the character at position e of a word, given the ones before it
        p1 = (c1[:, k1] + 0.5) / (total + 0.5 * CHARACTERS)
        p2 = (c2[:, k2] + BACK_OFF * p1[:, e2]) / (c1[:, k1[e2 - 1]] + BACK_OFF)
        at2 = np.full(len(owner), -1)
        at2[e2] = np.arange(len(e2))
        p3 = (c3[:, k3] + BACK_OFF * p2[:, at2[e3]]) / (c2[:, k2[at2[e3 - 1]]] + BACK_OFF)
        logs = np.zeros((len(self.langs), len(owner)))
        logs[:, e2] = np.log(p2)
        logs[:, e3] = np.log(p3)
        return np.stack([np.bincount(owner, weights=row, minlength=len(words)) for row in logs], axis=1).astype(np.float32)


def learn(docs: DataFrame) -> MixtureModel:
    """The model of ``training_rows``. To the driver come a row a language and a row a file of the store."""
    part = training_rows(docs).mapInArrow(_count_grams, "lang string, hash long, n long")
    got = stored(part.groupBy("lang", "hash").agg(F.sum("n").alias("n")), "gram_counts")
    totals = {r["lang"]: r["n"] for r in got.where("lang is not null").collect()}
    store = sorted_store.write(got.where("lang is null").select("hash", F.col("n").cast("double").alias("a"), F.lit(0.0).alias("b")), "language_grams")
    drop_stored(got)
    return MixtureModel(totals, store)


def mixtures(scores: np.ndarray, times: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of a mixture of the columns of ``scores`` for each document, whose rows begin at
    ``starts``; row k stands ``times[k]`` times. A document is left as it is once settled, whatever the others do."""
    n = np.add.reduceat(times, starts)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(times)]))
    # a row a language: sums over languages and over a document's words both go along memory
    scores = np.ascontiguousarray(scores.T)
    top = scores.max(axis=0)
    like = np.exp(scores - top)
    pi = np.full((len(scores), len(starts)), 1 / len(scores))
    docs, first, x, t, own = np.arange(len(starts)), starts, like, times, owner
    alive = np.ones(len(starts), bool)
    while alive.any():
        here = pi[:, docs]
        joint = x * here[:, own]
        joint *= t / joint.sum(axis=0)
        new = np.add.reduceat(joint, first, axis=1) / n[docs]
        change = np.abs(new - here).max(axis=0)
        pi[:, docs[alive]] = new[:, alive]
        alive &= change >= SETTLED
        if 2 * alive.sum() < len(alive) and alive.any():
            # the settled ones leave
            rows = alive[own]
            sizes = np.diff(np.r_[first, len(t)])[alive]
            docs, x, t = docs[alive], x[:, rows], t[rows]
            first, own, alive = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), np.ones(len(sizes), bool)
    return pi.T, np.add.reduceat(times * (np.log((like * pi[:, owner]).sum(axis=0)) + top), starts)


def choose_all(scores: np.ndarray, times: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, float]]]:
    """(language, proportion) of the chosen set of each document, largest first; ties go to the language first in the
    alphabet.

    Sets are the most likely language alone, with the second, and so on, as long as one more has half a word at
    least. A further language costs half the logarithm of the number of words.
    """
    scores = scores.astype(np.float64)
    sizes = np.diff(np.r_[starts, len(times)])
    n = np.add.reduceat(times, starts)
    pi, _ = mixtures(scores, times, starts)
    order = np.argsort(-pi, axis=1, kind="stable")
    best = [[(int(k), 1.0)] for k in order[:, 0]]
    value = np.add.reduceat(times * np.take_along_axis(scores, np.repeat(order[:, :1], sizes, axis=0), axis=1)[:, 0], starts)
    going = np.ones(len(starts), bool)
    for k in range(2, scores.shape[1] + 1):
        going &= pi[np.arange(len(pi)), order[:, k - 1]] * n >= 0.5
        docs = np.flatnonzero(going)
        if not len(docs):
            break
        rows = np.repeat(going, sizes)
        own = sizes[docs]
        some = np.take_along_axis(scores[rows], np.repeat(order[docs, :k], own, axis=0), axis=1)
        shares, like = mixtures(some, times[rows], np.cumsum(own) - own)
        worth = like - 0.5 * (k - 1) * np.log(np.maximum(n[docs], 2))
        for i in np.flatnonzero(worth > value[docs]):
            d = docs[i]
            value[d], best[d] = worth[i], list(zip(order[d, :k].tolist(), shares[i].tolist()))
    return [sorted(x, key=lambda x: (-x[1], x[0])) for x in best]


_WORKERS: dict[str, tuple[dict, list]] = {}
worker.keeps("language_mixture", _WORKERS.clear)


def predict_texts(model: MixtureModel, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """(language, its proportion, the chosen set as ``lang:proportion`` joined by commas) of each text."""
    worker.begin("language_mixture")
    if model.name not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[model.name] = ({}, [np.zeros((0, len(model.langs)), np.float32)])
    number, rows = _WORKERS[model.name]
    if len(number) >= HELD:
        number.clear()
        rows[0] = rows[0][:0]
    split = [t.lower().split() if t else [] for t in texts]
    new = list({w for ws in split for w in ws}.difference(number))
    if new:
        plain = [_letters(w) for w in new]
        kept = [x for x in plain if x]
        at = iter(range(len(rows[0]), len(rows[0]) + len(kept)))
        number.update((w, next(at) if x else -1) for w, x in zip(new, plain))
        if kept and model.langs:
            rows[0] = np.concatenate([rows[0], *(model.word_scores(kept[k : k + SCORED]) for k in range(0, len(kept), SCORED))])
    ids = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in split]
    doc = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
    flat = np.concatenate([*ids, np.zeros(0, np.int64)])
    doc, flat = doc[flat >= 0], flat[flat >= 0]
    out = [(UNKNOWN, 0.0, "")] * len(texts)
    if len(flat) and model.langs:
        pairs, times = np.unique(doc * len(rows[0]) + flat, return_counts=True)
        doc, flat = np.divmod(pairs, len(rows[0]))
        found, starts = np.unique(doc, return_index=True)
        for d, chosen in zip(found.tolist(), choose_all(rows[0][flat], times.astype(np.float64), starts)):
            out[d] = model.langs[chosen[0][0]], min(1.0, max(0.0, chosen[0][1])), ",".join(f"{model.langs[k]}:{p:.4f}" for k, p in chosen)
    return out


def with_language(docs: DataFrame, model: MixtureModel, name: str = "_seamline_language") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score, languages)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        plain = [t if isinstance(t, str) else None for t in texts]
        rows = [r for s in text_slices(plain) for r in predict_texts(model, plain[s])]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return docs.withColumn(name, F.pandas_udf(run, "lang_pred string, score double, languages string")("text"))


def identify(docs: DataFrame, model: MixtureModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row of ``docs``.

    A null text or one without letters is ``und`` with score 0, as is every text where no row could be
    learned from. A null doc_id isn't held out. Repeated rows each keep their row; columns besides doc_id,
    text and lang are ignored; an empty table gives an empty one. Of equally likely languages the first in the
    alphabet is predicted; texts of any length are taken whole, their words counted.
    """
    model = model or learn(docs)
    x = with_language(docs.select("doc_id", "text"), model, "language")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return x.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.languages")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is known, whatever the split between the languages of a text. Null and empty
    texts and those without letters go, and where no row has a language to learn from all go; repeated rows stay."""
    x = with_language(docs, learn(docs))
    return x.where(F.col("_seamline_language")["lang_pred"] != UNKNOWN).drop("_seamline_language")

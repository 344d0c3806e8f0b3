"""Secret scans by grammar inference.

Patterns with plain rules give base spans. The values they find are labelled credentials: from a bounded
sample of each kind a prefix tree is built, and states whose continuations are statistically compatible are
merged into a probabilistic automaton; the same is done for ordinary words. Compatible
states agree in the characters that follow and in how many are left, so an automaton keeps prefixes and
lengths of formats that have them, and has loops where formats vary. Every other run of eight or more
characters in the corpus is then a candidate: a credential if an automaton gives it a likelihood as it gives
its labelled strings, and a higher one than that of ordinary words. Numbers of few digits aren't credentials.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .scratch import drop_stored, stored
from .wordbytes import text_slices

KINDS = ("assign", "access", "hex")
FOUND = "format"
ORDINARY = "word"
_CHARS = "A-Za-z0-9+/_.=-"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_LONG = re.compile(f"(?<![{_CHARS}])[{_CHARS}]{{16,}}+")
_RUN = re.compile(f"[{_CHARS}]{{8,}}+")
#: ordinary strings: words, which teach an automaton, and what a rule tells: marks alone, and numbers of at most eight digits; single or joined by marks
_WORD = re.compile(r"[A-Za-z]+[0-9]{0,2}(?:[+/_.=-]+[A-Za-z]+[0-9]{0,2})*")
_NUMBER = re.compile(r"[0-9]{1,8}(?:[+/_.=-]+[0-9]{1,8})*|[+/_.=-]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: characters of a candidate, at least
LEAST_RUN = 8

#: labelled strings of each kind that automata are inferred from, at most, those with the least hash; longer strings teach nothing
SAMPLE, LONGEST = 1000, 256
#: significance of the tests of compatibility, and how many following characters they compare
ALPHA, LOOK = 0.05, 4
#: strings that states of different depth must hold, each, to be found alike: fewer can't tell lengths apart
SUPPORT = 20
#: nats by which a candidate must be likelier as a credential than as a word: in all, and a character as a share of what labelled strings gain
GAIN, GAIN_SHARE = 10.0, 0.5
#: a candidate's likelihood a character is that of labelled strings under automata of others, down to this quantile, but for one surprise of so many nats
QUANTILE, SURPRISE = 0.01, 12.0
#: verdicts that a worker keeps
HELD = 300_000


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Base spans as (start, end, kind, value), in order of start, then kind."""
    spans = []
    if (low := text.lower()) and any(w in low for w in _ASSIGN_WORDS):
        spans += [(*m.span(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in _LONG.finditer(text):
        a, b = run.span()
        part = run[0]
        if "AKIA" in part:
            spans += [(a + m.start(), a + m.end(), "access", m[0]) for m in _ACCESS.finditer(part) if len(m[0]) >= LEAST["access"]]
        if b - a >= LEAST["hex"]:
            spans += [(a + m.start(), a + m.end(), "hex", m[0]) for m in _HEX.finditer(part) if len(m[0]) >= LEAST["hex"]]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) if spans else spans


def trimmed(run: str) -> str:
    """A run without the dots around it, which belong to sentences."""
    return run.strip(".")


def candidates(text: str, spans) -> list[tuple[int, int]]:
    """Every run of ``LEAST_RUN`` or more characters outside the base spans, whole or what base spans leave of it."""
    out, at = [], 0
    for a, b in [*((a, b) for a, b, *_ in spans), (len(text), len(text))]:
        for m in _RUN.finditer(text, at, max(at, a)):
            run = m[0]
            start = m.start() + len(run) - len(run.lstrip("."))
            end = start + len(trimmed(run))
            if end - start >= LEAST_RUN:
                out.append((start, end))
        at = max(at, b)
    return out


# -- inference ---------------------------------------------------------------------------------------------

SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
#: classes of symbols that stand in for each other where a state has seen few; 0 is the end of a string
_CLASS = np.array([0] + [1 if c.isdigit() else 2 if c in "abcdef" else 3 if c.islower() else 4 if c in "ABCDEF" else 5 if c.isupper() else 6 + "+/_.=-".index(c) for c in SYMBOLS])
_CLASSES = int(_CLASS.max()) + 1
_CLASS_SIZE = np.bincount(_CLASS)
_CODE = np.zeros(128, np.uint8)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)


def _coded(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all strings, each followed by 0; first positions; lengths)."""
    flat = _CODE[np.frombuffer("\0".join([*values, ""]).encode("ascii"), np.uint8)]
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return flat, np.cumsum(sizes + 1) - sizes - 1, sizes


def _unlikely(k: int, n: int, q: float) -> bool:
    """Whether k or more of n at a chance of q each is less likely than ``ALPHA`` (Chernoff's bound)."""
    x = k / n
    if x <= q:
        return False
    return math.exp(-n * (x * math.log(x / q) + ((1 - x) * math.log((1 - x) / (1 - q)) if x < 1 else 0))) < ALPHA


def _unseen_alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether what the smaller sample has and the larger lacks (both as counts of values) is no more than the
    larger's values that stand once lead one to expect."""
    small, large = (a, b) if a.sum() <= b.sum() else (b, a)
    new, n, m = int(small[large == 0].sum()), int(small.sum()), int(large.sum())
    return not new or not _unlikely(new, n, min(1.0, (int((large == 1).sum()) + 1) / m))


class Automaton:
    """A probabilistic automaton inferred from strings: for each state and symbol (0 ends a string) the
    log-probability and the next state."""

    def __init__(self, values: list[str]):
        self._flat, starts, sizes = _coded(values)
        self._end = np.repeat(starts + sizes, sizes + 1)
        # a state is the positions that its strings have reached; tails that wait are not in a state yet
        self.states, self._depth, self._moves, self._waiting, self._queue = [], [], [], {}, []
        self._promote(starts, 0)
        while self._queue:
            depth, _, source, symbol = heapq.heappop(self._queue)
            tails = self._waiting.pop((source, symbol), None)
            if tails is None:
                continue
            near = sorted(range(len(self.states)), key=lambda r: (abs(self._depth[r] - depth), r))
            near = (r for r in near if self._depth[r] == depth or min(len(tails), len(self.states[r])) >= SUPPORT)
            at = next((r for r in near if self._alike(self.states[r], tails)), None)
            if at is None:
                at = self._promote(tails, depth)
            else:
                self._moves[source][symbol] = at
                self._join(at, tails)
            self._moves[source][symbol] = at
        self._tables()

    def _promote(self, tails: np.ndarray, depth: int) -> int:
        self.states.append(np.zeros(0, np.int64))
        self._depth.append(depth)
        self._moves.append({})
        self._join(len(self.states) - 1, tails)
        return len(self.states) - 1

    def _join(self, state: int, tails: np.ndarray) -> None:
        """Adds tails to a state, and what follows them to the states that it moves to, or to those that wait."""
        work = [(state, tails)]
        while work:
            s, x = work.pop()
            self.states[s] = np.concatenate([self.states[s], x])
            symbols = self._flat[x]
            for c in np.unique(symbols[symbols > 0]).tolist():
                onward = x[symbols == c] + 1
                if c in self._moves[s]:
                    work.append((self._moves[s][c], onward))
                else:
                    old = self._waiting.get((s, c))
                    self._waiting[s, c] = onward if old is None else np.concatenate([old, onward])
                    heapq.heappush(self._queue, (self._depth[s] + 1, -len(onward), s, c))

    def _alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the strings at ``a`` and at ``b`` go on alike: in how many characters are left, and in each of
        the next ones (Hoeffding's bound on shares, and no more lengths or classes that the other lacks than chance
        leaves unseen)."""
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(len(a)) + 1 / math.sqrt(len(b)))
        ends_a, ends_b = self._end[a], self._end[b]
        x, y = np.bincount(ends_a - a), np.bincount(ends_b - b)
        size = max(len(x), len(y))
        x, y = np.pad(x, (0, size - len(x))), np.pad(y, (0, size - len(y)))
        if np.abs(np.cumsum(x) / len(a) - np.cumsum(y) / len(b)).max() > bound or not _unseen_alike(x, y):
            return False
        for k in range(LOOK):
            x = np.bincount(self._flat[np.minimum(a + k, ends_a)], minlength=len(_CLASS))
            y = np.bincount(self._flat[np.minimum(b + k, ends_b)], minlength=len(_CLASS))
            if np.abs(x / len(a) - y / len(b)).max() > bound:
                return False
            if not _unseen_alike(*(np.bincount(_CLASS, weights=n, minlength=_CLASSES) for n in (x, y))):
                return False
        return True

    def _tables(self) -> None:
        """Symbols that a state has seen share its mass with the others of their classes, the more so the more
        kinds of symbols it has seen; what it never did goes where most of that class, or of all, go."""
        n = np.stack([np.bincount(self._flat[x], minlength=len(_CLASS)) for x in self.states])
        of_class = np.stack([np.bincount(_CLASS, weights=row, minlength=_CLASSES) for row in n])
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        back = ((of_class + 1 / _CLASSES) / (total + 1) / _CLASS_SIZE)[:, _CLASS]
        self.log_p = np.log((n + kinds * back) / (total + kinds))
        self.next = np.zeros(n.shape, np.int32)
        for s, moves in enumerate(self._moves):
            most = max(moves, key=lambda c: (n[s, c], -c), default=None)
            self.next[s] = s if most is None else moves[most]
            for c in sorted(moves, key=lambda c: (n[s, c], -c)):
                self.next[s, _CLASS == _CLASS[c]] = moves[c]
            for c, to in moves.items():
                self.next[s, c] = to
        self.states = len(self.states)
        del self._flat, self._end, self._moves, self._depth, self._waiting, self._queue

    def scores(self, values: list[str]) -> np.ndarray:
        """Log-likelihood of each string, its end included."""
        flat, starts, sizes = _coded(values)
        order = np.argsort(-sizes, kind="stable")
        starts, left = starts[order], sizes[order]
        state, out = np.zeros(len(values), np.int32), np.zeros(len(values))
        longest = int(left[0]) if len(left) else -1
        alive = np.searchsorted(-left, -np.arange(min(longest, LONGEST) + 1), side="right")
        for k, n in enumerate(alive.tolist()):
            c = flat[starts[:n] + k]
            out[:n] += self.log_p[state[:n], c]
            state[:n] = self.next[state[:n], c]
        for i in range(int((left > LONGEST).sum())):
            s, total = int(state[i]), 0.0
            for c in flat[starts[i] + LONGEST + 1 : starts[i] + left[i] + 1].tolist():
                total += self.log_p[s, c]
                s = self.next[s, c]
            out[i] += total
        back = np.empty(len(values))
        back[order] = out
        return back


def _unseen_scores(values: list[str]) -> np.ndarray:
    """Each string's log-likelihood under the automaton of the other half of them; a single one's under its own."""
    if len(values) < 2:
        return Automaton(values).scores(values)
    out = np.empty(len(values))
    for half in range(2):
        out[half::2] = Automaton(values[1 - half :: 2]).scores(values[half::2])
    return out


class Formats:
    """An automaton for each kind with labelled strings, and one for ordinary words; without either, no credentials."""

    def __init__(self, values: dict[str, list[str]]):
        values = {k: [v for v in x if len(v) <= LONGEST] for k, x in values.items()}
        self.ordinary = Automaton(sorted({v.lower() for v in values[ORDINARY]})) if values.get(ORDINARY) else None
        self.kinds = {k: Automaton(values[k]) for k in KINDS if values.get(k)}
        self.floors = {}
        for k in self.kinds:
            sizes = np.array(list(map(len, values[k]))) + 1
            own = _unseen_scores(values[k]) / sizes
            gain = own - self.word_scores(values[k]) / sizes if self.ordinary else own
            self.floors[k] = float(np.quantile(own, QUANTILE)), max(0.0, GAIN_SHARE * float(np.quantile(gain, QUANTILE)))
        self.name = hashlib.sha256(repr(sorted((k, x) for k, x in values.items() if x)).encode()).hexdigest()

    def word_scores(self, values: list[str]) -> np.ndarray:
        """Log-likelihood of each string as words, in small letters, capitals or with a capital first, or, at a bit a
        letter, in any mixture."""
        same = [v.islower() or v.isupper() or v[1:].islower() for v in values]
        letters = [sum(map(str.isalpha, v)) for v in values]
        return self.ordinary.scores([v.lower() for v in values]) - np.where(same, math.log(4), math.log(4) + math.log(2) * np.array(letters))

    def credentials(self, values: list[str]) -> np.ndarray:
        """Whether each string has a credential's format: a likelihood like that of its labelled strings, but for one
        surprise, and enough above that of words. What lies at a limit counts; numbers and marks that the rule tells never do."""
        out = np.zeros(len(values), bool)
        if self.ordinary is not None and values:
            plain = self.word_scores(values)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) + 1
            for k, automaton in self.kinds.items():
                x, (own, gain) = automaton.scores(values), self.floors[k]
                out |= (x >= own * sizes - SURPRISE) & (x - plain >= np.maximum(GAIN, gain * sizes))
            out &= [not _NUMBER.fullmatch(v) for v in values]
        return out


# -- Spark -------------------------------------------------------------------------------------------------


class _Least:
    """The ``size`` values with the least hashes of all that were added; equal hashes go by value."""

    def __init__(self, size: int):
        self.size, self.kept, self.limit = size, {}, 1 << 64

    def add(self, values) -> None:
        for v in values:
            if (h := xxhash.xxh64_intdigest(v)) <= self.limit:
                self.kept[v] = h
        if len(self.kept) > 4 * self.size:
            self.cut()

    def cut(self) -> None:
        least = sorted(self.kept.items(), key=lambda x: (x[1], x[0]))[: self.size]
        self.kept = dict(least)
        if len(least) == self.size:
            self.limit = least[-1][1]


def _labelled(sample: int):
    """The labelled strings of a task's texts that have the least hashes: values of base spans, and ordinary runs."""

    def run(batches):
        least = {k: _Least(sample) for k in (*KINDS, ORDINARY)}
        for b in batches:
            texts = b.column(0).to_pylist()
            for s in text_slices(texts):
                values, runs = {k: set() for k in least}, set()
                for text in texts[s]:
                    for *_, k, v in base_spans(text):
                        values[k].add(v)
                    runs.update(_RUN.findall(text))
                values[ORDINARY] = {r for r in map(trimmed, runs) if len(r) >= LEAST_RUN and _WORD.fullmatch(r)}
                for k, found in values.items():
                    least[k].add(v for v in found if len(v) <= LONGEST)
        for k, x in least.items():
            x.cut()
            rows = [[k] * len(x.kept), list(x.kept), [h - (1 << 63) for h in x.kept.values()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "hash"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from at most ``sample`` different labelled strings of each kind, those of the whole corpus with the
    least hashes. A task sends its own least ones, so at most ``sample`` rows a kind and task are shuffled."""
    found = docs.where("text is not null").select("text").mapInArrow(_labelled(sample), "kind string, value string, hash long")
    found = stored(found.distinct(), "labelled")
    values = {k: [r[0] for r in found.where(F.col("kind") == k).orderBy("hash", "value").limit(sample).select("value").collect()] for k in (*KINDS, ORDINARY)}
    drop_stored(found)
    return Formats(values)


_KNOWN: dict[str, dict[str, bool]] = {}
worker.keeps("credential_automata", _KNOWN.clear)


def find_formats(texts: list[str], formats: Formats) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text as (start, end, kind), in order of start, then kind."""
    worker.begin("credential_automata")
    if formats.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[formats.name] = {}
    known = _KNOWN[formats.name]
    if len(known) > HELD:
        known.clear()
    base = [base_spans(t) for t in texts]
    places = [None if spans else _RUN.findall(t) for t, spans in zip(texts, base)]
    places = [{trimmed(r) for r in runs} if runs is not None else {t[a:b] for a, b in candidates(t, spans)} for t, spans, runs in zip(texts, base, places)]
    new = sorted({r for runs in places for r in runs if len(r) >= LEAST_RUN}.difference(known))
    known.update(zip(new, formats.credentials(new).tolist()))
    out = []
    for t, spans, runs in zip(texts, base, places):
        plain = [s[:3] for s in spans]
        if any(map(known.get, runs)):
            more = [(a, b, FOUND) for a, b in candidates(t, spans) if known[t[a:b]]]
            out.append((plain, sorted([*plain, *more], key=lambda s: (s[0], (*KINDS, FOUND).index(s[2])))))
        else:
            out.append((plain, plain))
    return out


def all_spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text."""
    return find_formats([text], formats)[0]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Positions count code points, ends excluded; the span of an assignment is the whole match. Added spans
    have the kind ``format`` and touch no base span: what base spans leave of a run is a candidate of its own.
    A null text is as an empty one: no spans, and the SHA-256 of the empty string. Texts and runs of any length
    are scored whole. Where the corpus has no labelled credential nothing is added. Repeated rows each keep
    their row; columns besides doc_id and text are ignored; an empty table gives an empty one. Of states that
    are equally near in depth a tail joins the first; likelihoods at a limit count as credentials.
    """
    formats = formats or learn(docs)

    def run(batches):
        for b in batches:
            texts, rows = [t or "" for t in b.column(1).to_pylist()], []
            for s in text_slices(texts):
                for base, spans in find_formats(texts[s], formats):
                    counts = [sum(x[2] == k for x in base) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([b.column(0), *map(pa.array, cols, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by ``[secret]``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced in text; n_chars follows where text changed.

    A null text stays null, an empty one empty; a row without any span stays as it is, its n_chars included,
    right or wrong. Repeated rows are changed alike; an empty table gives an empty one.
    """
    formats = learn(docs)

    def run(texts: pd.Series) -> pd.Series:
        plain = [t if isinstance(t, str) else "" for t in texts]
        found = [x for s in text_slices(plain) for x in find_formats(plain[s], formats)]
        return pd.Series([redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, found)], dtype=object)

    x = docs.withColumn("_seamline_clean", F.pandas_udf(run, "string")("text"))
    n_chars = F.when(F.col("_seamline_clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length("_seamline_clean").cast("long"))
    return x.select(*[{"text": F.col("_seamline_clean").alias("text"), "n_chars": n_chars.alias("n_chars")}.get(c, F.col(c)) for c in docs.columns])

"""SentencePiece encoding and decoding with shared prefixes.

Different marked words are sorted, which walks their trie depth-first; the forward pass over a word begins
where it leaves the word before it, so a prefix that words share is worked out once.

For unigram models the forward state of a prefix is its best score (Viterbi). For BPE models the best-scored
cut isn't what the library gives, as merges go by rank; but there, too, a prefix has one last piece: the
piece such that it and the last piece of what stands before it stay apart when the two are merged by rank.
That piece is the forward state, and following it backwards gives the library's pieces. Which pairs stay
apart is worked out once a pair.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import worker
from .wordbytes import gathered

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: different words kept by a worker
HELD = 700_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; nested messages and strings as bytes."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and kind of a SentencePiece model file with byte fallback and no normalisation but marks."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = list(_fields(f.read()))
        trainer = dict(_fields(next(v for n, v in proto if n == 2)))
        self.unigram = trainer.get(3, 1) == 1
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = library.vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.scores, self.ids, self.shown, self.bytes = [], {}, [], {}
        for k in range(self.size):
            piece = library.id_to_piece(k)
            self.scores.append(library.get_score(k))
            if library.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(k) or library.is_unknown(k):
                self.shown.append(b"")
            else:
                self.ids[piece] = k
                self.shown.append(piece.encode())
        self.unknown = library.unk_id()
        self.longest = max(map(len, self.ids))
        # how long pieces are that end in these two characters, longest first
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                tails.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {t: (*sorted(n, reverse=True), 1) for t, n in tails.items()}
        self.run = max(k for k in range(1, self.longest + 1) if MARK * k in self.ids)
        self.rest_of_run = [[self.ids[p] for p in self.by_rank(MARK * k)] for k in range(self.run + 1)]
        if len(self.rest_of_run[self.run]) > 1:
            raise ValueError("marks don't merge into their longest piece")
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.worst = min(self.scores) - 10
        for probe in ("a  b\néﬁ \U0001f600", " x"):
            if self.encode_texts([probe])[0] != library.encode(probe):
                raise ValueError(f"a model with normalisation or options beyond marks: {path}")
        self.words.clear()

    # -- one word by rank, as the library does it
    def by_rank(self, word: str) -> list[str]:
        parts = list(word)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: str, b: str, key: int) -> bool:
        out = self.apart[key] = self.by_rank(a + b) == [a, b]
        return out

    def _char(self, c: str) -> list[int]:
        return [self.ids[c]] if c in self.ids else [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted different words that begin with one mark each."""
        ids, scores, size, apart, tails = self.ids, self.scores, self.size, self.apart, self.tails
        # of each prefix: its last piece (-1: a character without one), that piece's length, and its best score
        last, length, best = [size], [0], [0.0]
        out, before = [], ""
        for w in words:
            same = os.path.commonprefix((before, w)) if before else ""
            del last[len(same) + 1 :], length[len(same) + 1 :], best[len(same) + 1 :]
            for end in range(len(same) + 1, len(w) + 1):
                if w[end - 1] not in ids:
                    last.append(-1)
                    length.append(1)
                    best.append(best[end - 1] + self.worst)
                    continue
                found = (-1, 1, -np.inf)
                for n in tails.get(w[end - 2 : end], (1,)) if end > 1 else (1,):
                    start = end - n
                    k = ids.get(w[start:end]) if start >= 0 else None
                    if k is None:
                        continue
                    if self.unigram:
                        value = best[start] + scores[k]
                        if value > found[2]:
                            found = (k, end - start, value)
                        continue
                    p = last[start]
                    if p < 0 or p == size:
                        key = -1 - k
                        ok = apart.get(key)
                        if ok is None:
                            ok = apart[key] = self.by_rank(w[start:end]) == [w[start:end]]
                    else:
                        key = p * size + k
                        ok = apart.get(key)
                        if ok is None:
                            ok = self.stay_apart(w[start - length[start] : start], w[start:end], key)
                    if ok:
                        found = (k, end - start, 0.0)
                        break
                last.append(found[0])
                length.append(found[1])
                best.append(found[2])
            pieces, at = [], len(w)
            while at:
                pieces.append(last[at] if last[at] >= 0 else w[at - 1])
                at -= length[at]
            flat: list[int] = []
            for p in reversed(pieces):
                flat += self._char(p) if isinstance(p, str) else [p]
            out.append(flat)
            before = w
        return out

    def learn_words(self, new: list[str]) -> None:
        """Keep the ids of words (without their first mark) not seen before."""
        if len(self.words) + len(new) > HELD:
            self.words.clear()
        plain = sorted(MARK + w for w in new if not w.startswith(MARK))
        for w, x in zip(plain, self.encode_sorted(plain)):
            self.words[w[1:]] = array.array(self.code, x).tobytes()
        # several marks before a word: the last goes with the word if it merges with it; the others, of one rank
        # and below all else, merge from the left, so that the longest piece repeats and the rest follows
        several = sorted({MARK + w.lstrip(MARK) for w in new if w.startswith(MARK)})
        rest = dict(zip(several, self.encode_sorted(several)))
        for w in new:
            if w.startswith(MARK):
                body = w.lstrip(MARK)
                n, ids = len(w) - len(body), rest[MARK + body]
                if ids[0] == self.ids[MARK]:
                    n, ids = n + 1, ids[1:]
                runs = [self.ids[MARK * self.run]] * (n // self.run) + self.rest_of_run[n % self.run]
                self.words[w] = array.array(self.code, [*runs, *ids]).tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        """Marked words, each without its first mark."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [m[1:] for m in _MARKED.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text; null as empty."""
        split = [self.split(t or "") for t in texts]
        new = list({w for ws in split for w in ws}.difference(self.words))
        if len(self.words) + len(new) > HELD:
            self.words.clear()
            new = list({w for ws in split for w in ws})
        if new:
            self.learn_words(new)
        return [b"".join(map(self.words.__getitem__, ws)) for ws in split]

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, self.dtype).tolist() for x in self.encode_bytes(texts)]

    def decode(self, ids) -> str:
        """The text of ids: marks become spaces, the first one is dropped, invalid UTF-8 is replaced."""
        return b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


_MODELS: dict[str, PieceModel] = {}


worker.keeps("piece_trie", _MODELS.clear)


def piece_model(path: str) -> PieceModel:
    worker.begin("piece_trie")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


#: texts whose different words are sorted together
TOGETHER = 2000


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): little-endian piece ids of every whole text; null text as empty."""
    path = path or default_model()

    def run(batches):
        model = piece_model(path)
        for b in gathered(batches, TOGETHER):
            texts, ids = b.column(1).to_pylist(), []
            for k in range(0, len(texts), TOGETHER):
                ids += model.encode_bytes(texts[k : k + TOGETHER])
            yield pa.record_batch(
                [b.column(0), pa.array([len(x) // model.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from ``encode``'s rows."""
    path = path or default_model()

    def run(batches):
        model = piece_model(path)
        for b in batches:
            texts = [model.decode(np.frombuffer(x, model.dtype).tolist()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): each text encoded and decoded again; ids_crc32 is over the ids
    as little-endian unsigned 32-bit integers, round_trip whether the text came back.

    A null or empty text has no ids and comes back. Literal marks in a text come back as spaces. Of equally scored
    cuts of a word the one with the longest last piece is taken. Texts and words of any length are taken whole.
    Repeated rows each keep their row; columns besides doc_id and text are ignored; an empty table gives an empty one.
    """
    path = path or default_model()

    def run(batches):
        model = piece_model(path)
        for b in gathered(batches, TOGETHER):
            texts, rows = b.column(1).to_pylist(), []
            for k in range(0, len(texts), TOGETHER):
                some = texts[k : k + TOGETHER]
                for t, x in zip(some, model.encode_bytes(some)):
                    ids = np.frombuffer(x, model.dtype)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), model.decode(ids.tolist()) == (t or "")))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.record_batch([b.column(0), *map(pa.array, cols, [pa.int64(), pa.int64(), pa.bool_()])], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")

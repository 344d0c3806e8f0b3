"""Token ids of whole texts by the tokenizers library, with the ids of words kept between texts.

A tokenizer whose normaliser and pre-tokenizer never look across white space gives a text the ids of its
words, and those the ids of their pre-tokens, one after another. Distinct ones are few beside all, so each
Python worker keeps the ids of those that it has seen (bounded; emptied when full). Latin-1 texts are cut
into pre-tokens at once; other texts into words, of which those with characters for which the above isn't
evident, and all texts of other kinds of tokenizer, go to the library as they are.
"""

from __future__ import annotations

import array
import json
import os
import re

import numpy as np
import regex

from . import worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: words and pre-tokens kept by a worker
KEPT_WORDS, KEPT_PIECES = 200_000, 900_000
#: these end words for str.split, but aren't white space to the tokenizer
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_LATIN = regex.compile("[\x21-į]+")
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"

_CODERS: dict[str, "TokenCoder"] = {}


def coder(path: str) -> "TokenCoder":
    """This process's coder for the tokenizer file."""
    worker.begin("tokens")
    if path not in _CODERS:
        _CODERS[path] = TokenCoder(path)
    return _CODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if it is printable Latin-1, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def _drop() -> None:
    for c in _CODERS.values():
        c.words.clear()
        c.pieces.clear()


worker.keeps("tokens", _drop)


class _Words(dict):
    def __init__(self, owner: "TokenCoder"):
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self[word] = self.owner.word(word)
        return out


class _Pieces(dict):
    def __init__(self, owner: "TokenCoder"):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        out = self[piece] = self.owner.piece(piece)
        return out


class TokenCoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = self._by_words(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = {chr(b): s for b, s in _byte_letters().items()}
        self.latin, self.code = self._latin_pattern(), "H" if self.dtype.itemsize == 2 else "I"
        self.words, self.pieces = _Words(self), _Pieces(self)

    @staticmethod
    def _by_words(spec: dict):
        """The pre-token pattern, if the file describes a tokenizer that works word by word; else None."""
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            return None
        split, level = pre
        if not split.get("invert") or split.get("behavior") != "Removed" or level.get("use_regex") or level.get("add_prefix_space"):
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _latin_pattern(self):
        """The pre-token pattern for lower-case Latin-1 texts, its classes spelled out for the faster engine."""
        if self.pattern is None:
            return None
        plain = self.pattern.pattern
        for named, spelled in (("[^\\s\\p{L}\\p{N}]", rf"[^\s{_LETTER}{_NUMBER}]"), ("[\\p{L}]", f"[{_LETTER}]"), ("[\\p{N}]", f"[{_NUMBER}]")):
            plain = plain.replace(named, spelled)
        return None if "\\p" in plain else re.compile(plain)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        if not _LATIN.fullmatch(word) or any(s in word for s in self.special):
            return self._whole(word)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word.lower())))

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters.__getitem__, piece.encode().decode("latin-1")))
        return array.array(self.code, [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the text (null: none), each of ``dtype``."""
        if not text:
            return b""
        if self.pattern is None or _ODD_SPACE.search(text):
            return self._whole(text)
        if self.latin is not None and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return b"".join(map(self.pieces.__getitem__, self.latin.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode_ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        ids = np.frombuffer(self.encode(text), self.dtype)
        return ids if end is None else np.append(ids, self.dtype.type(end))

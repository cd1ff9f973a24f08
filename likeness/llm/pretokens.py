"""Byte-level BPE by a whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that give exactly their own id are
*whole tokens*. In a text each pre-token that is a whole token costs one table look-up, and only the
rest goes through the merges, once per distinct pre-token and task.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

import regex

# The pattern that splits text before the merges, as the vocabulary's library has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Up to this code point the standard library's pattern, which is faster, splits alike.
NEAR = 0x4FF

#: Pre-tokens that a task's table holds beside the whole tokens before it is emptied.
TABLE_ENTRIES = 1 << 18
#: Longer pre-tokens aren't kept in the table.
KEPT_LENGTH = 64


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that, encoded alone, are one pre-token and one token: string -> id.

    The size of the answer is bounded by the vocabulary.
    """
    tokenizer = _load(path)
    byte_of = {c: b for b, c in byte_alphabet().items()}
    split = regex.compile(PATTERN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts, ids = [], []
    for shown, token_id in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(byte_of[c] for c in shown).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        found = split.match(text)
        if text not in special and found and found.end() == len(text):
            texts.append(text)
            ids.append(token_id)
    alone = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {t: i for t, i, e in zip(texts, ids, alone) if e.ids == [i]}


def _ranges(last: int, wanted) -> str:
    """The inside of a character class: code points up to ``last`` that ``wanted`` takes."""
    parts, start = [], None
    for code in range(last + 2):
        inside = code <= last and wanted(code)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            parts.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(parts)


def _unassigned() -> str:
    """A character class of the code points that this Python's Unicode tables leave unassigned."""
    return "[" + _ranges(sys.maxunicode, lambda c: unicodedata.category(chr(c)) == "Cn") + "]"


def near_pattern() -> str:
    """``PATTERN`` for texts of code points up to ``NEAR``, with its classes written out."""
    letter = _ranges(NEAR, lambda c: unicodedata.category(chr(c))[0] == "L")
    number = _ranges(NEAR, lambda c: unicodedata.category(chr(c))[0] == "N")
    space = _ranges(NEAR, lambda c: unicodedata.category(chr(c))[0] == "Z" or chr(c) in "\t\n\v\f\r\x85")
    inside = {r"\p{L}+": f"[{letter}]+", r"\p{N}+": f"[{number}]+", r"[^\s\p{L}\p{N}]+": f"[^{space}{letter}{number}]+"}
    parts = PATTERN.split("|")
    words = [" ?" + inside[p[2:]] if p.startswith(" ?") else p for p in parts[:-2]]
    return "|".join([*words, rf"[{space}]+(?![^{space}])", f"[{space}]+"])


class PretokenTable(dict):
    """Pre-token -> its value, for one task. ``value`` makes it from a list of ids."""

    def __init__(self, path: str, whole: dict[str, int], value, entries: int = TABLE_ENTRIES):
        super().__init__()
        self._tokenizer = _load(path)
        self._model = self._tokenizer.model
        self._pre = self._tokenizer.pre_tokenizer
        self._near = re.compile(near_pattern()).findall
        self._beyond = re.compile(f"[^\\x00-\\u{NEAR:04x}]").search
        self._split = regex.compile(PATTERN).findall
        self._unsure = None
        self._alphabet = byte_alphabet()
        self._value = value
        self._whole = {text: value([token_id]) for text, token_id in whole.items()}
        self._entries = entries + len(self._whole)
        self.update(self._whole)
        added = self._tokenizer.get_added_tokens_decoder()
        self.special = {t.content: value([i]) for i, t in added.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, piece: str):
        shown = piece.encode("utf-8").decode("latin-1").translate(self._alphabet)
        out = self._value([t.id for t in self._model.tokenize(shown)])
        if len(piece) <= KEPT_LENGTH:
            self[piece] = out
        return out

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or not self._beyond(text):
            return self._near(text)
        # The pattern's library and the vocabulary's library may know different Unicode versions: a
        # text with characters new to this Python is split by the latter.
        self._unsure = self._unsure or regex.compile(_unassigned()).search
        if self._unsure(text):
            return [text[a:b] for _, (a, b) in self._pre.pre_tokenize_str(text)]
        return self._split(text)

    def values(self, text: str) -> list:
        """The values of a text's pre-tokens and special tokens, in order."""
        if self._special is None or not any(s in text for s in self.special):
            return list(map(self.__getitem__, self._pieces(text)))
        out = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(map(self.__getitem__, self._pieces(part)))
        return out

    def trim(self) -> None:
        """Forget what is beyond the bound; the whole tokens stay."""
        if len(self) > self._entries:
            self.clear()
            self.update(self._whole)


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()

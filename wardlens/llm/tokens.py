"""Token ids of whole texts with a public tokenizer, piece by piece and remembered inside a task."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice
from pickle import dumps, loads
from struct import pack
from unicodedata import is_normalized

import numpy as np
import regex

# A worker remembers the pieces of its last two generations, each of at most so many.
MEMO_PIECES = 600_000
# Between tasks a memo keeps at most so many.
RESTING_PIECES = 100_000

# A space after another character always ends a pre-token of these tokenizers, so pieces can be encoded one by one.
_PIECES = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
# White space beyond the four above may join the run before a space; texts with it are encoded whole.
_OTHER_SPACE = re.compile(
    "[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")

# Texts without these, and without a blank at either end, have single spaces and line ends alone: plain splitting cuts them.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r")

# The pre-token patterns of the two kinds of vocabulary files.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same for pieces in ASCII, in the standard module, which is faster.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII).findall
_ASCII_BYTES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall


@lru_cache(maxsize=1)
def _visible() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a printable character; the others are numbered from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(hidden)}


def uneven(text: str) -> bool:
    """Whether a text that is not empty has white space beyond single spaces and line ends between other characters."""
    return text[0] in " \n" or text[-1] in " \n" or any(blanks in text for blanks in _UNEVEN)


class _Memo(dict):
    """Remembers what it computed in two generations, so that common pieces stay and memory is bounded."""

    def __init__(self, compute: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.compute: Callable[[str], bytes] = compute
        self.older: dict[str, bytes] = {}
        self.most = most

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.compute(piece)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def packed(self, most: int) -> bytes:
        """Empties the memo; returns the pieces that came first in it, which are the common ones."""
        kept = dumps(dict(islice(chain(self.items(), self.older.items()), most)))
        self.clear()
        self.older = {}
        return kept


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``spaced`` tells whether white space is part of the tokens (then it stays with the piece after it) or is dropped.
    Ids are those of the tokenizer as its file describes it: a text that holds the string of an added token goes through
    it whole. In other texts the tokenizer's own model is asked directly for pre-tokens of plain pieces, which spares its
    bookkeeping of offsets; all other pieces go through its whole chain.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.untouched, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # the same ids for texts without such tokens, and faster
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values() if token.content]
        for tokenizer in (self.untouched, self.whole):
            tokenizer.no_padding()
            tokenizer.no_truncation()
        self.tokenize = self.whole.model.tokenize
        self.spaced = spaced
        chain = str(self.whole.pre_tokenizer)
        if spaced:
            known = chain == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" \
                and self.whole.normalizer is None
        else:
            known = f'pattern=Regex("{_WORD_PATTERN}"), behavior=Removed, invert=True), ByteLevel(' in chain \
                and "NFC(), Replace" in str(self.whole.normalizer)
        self.ascii_pre_tokens = _ASCII_BYTES if spaced else _ASCII_WORDS
        self.pre_tokens = regex.compile(_BYTE_PATTERN if spaced else _WORD_PATTERN).findall
        self.split = _PIECES.findall if spaced else str.split
        self.parts = _Memo(self._model_ids, MEMO_PIECES // 3)
        compute = self._plain if known else self._chain
        self.memo = _Memo(compute, MEMO_PIECES)
        self.after_space = _Memo(lambda word: compute(" " + word), MEMO_PIECES)

    def _chain(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model_ids(self, part: str) -> bytes:
        bare = part[1:] if part[0] == " " else part
        if bare.isascii() and bare.isprintable() and " " not in bare:
            shown = part if bare is part else "Ġ" + bare
        else:
            shown = part.encode().decode("latin-1").translate(_visible())
        ids = [token.id for token in self.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, piece: str) -> bytes:
        bare = piece[1:] if self.spaced and piece[0] == " " else piece
        if bare.isalpha() and (bare.isascii() or self.spaced and max(bare) < "ɐ"):
            return self._model_ids(piece if self.spaced else piece.lower())  # letters alone are one pre-token
        if piece.isascii():
            parts = self.ascii_pre_tokens(piece if self.spaced else piece.lower())
        elif self.spaced:
            parts = self.pre_tokens(piece)
        elif max(piece) < "ɐ" and is_normalized("NFC", piece):
            parts = self.pre_tokens(piece.lower())  # composed Latin text lower-cases letter by letter
        else:
            return self._chain(piece)
        return self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[part] for part in parts])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return np.asarray(self.untouched.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _OTHER_SPACE.search(text):
            return self._chain(text)
        if not self.spaced or uneven(text):
            return b"".join(map(self.memo.__getitem__, self.split(text)))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.memo[words[0]] + b"".join(map(self.after_space.__getitem__, words[1:])))
        return self.memo["\n"].join(lines)

    def rest(self) -> None:
        """Call at a task's end: a worker that waits, or serves another step, holds few pieces.

        All memos are emptied before any is filled again with copies, so what is kept does not hold scattered memory.
        """
        memos = self.memo, self.after_space, self.parts
        for memo, kept in zip(memos, [memo.packed(RESTING_PIECES) for memo in memos]):
            memo.older = loads(kept)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if (path, spaced) not in _encoders:
        _encoders[(path, spaced)] = Encoder(path, spaced)
    return _encoders[(path, spaced)]

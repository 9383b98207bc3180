"""Token ids of whole texts by the tokenizers library, quickly.

Both vocabularies cut a text into pieces before they merge anything, and pieces don't influence each other, so this encoder cuts
the text itself and hands each distinct piece to the library's own merge model. Texts with characters outside printable ASCII and
Latin-1 (where Python's and the library's character classes could differ), with what could be a special token, or of a vocabulary
of another kind are given to the library whole. The tests hold all of them against encoding the whole text by an untouched
tokenizer, special tokens' strings included.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

#: Bytes that one task's memory of pieces may take.
REMEMBERED_BYTES = 24 << 20
#: Bytes that it may take in a worker process whose tasks share it.
SHARED_BYTES = 96 << 20
#: Longer pieces aren't remembered.
LONGEST = 48

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SAFE = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
# The pieces into which the two public vocabularies cut a text, for the safe characters.
# Letters, the most frequent, are tried first.
_BYTE_PIECE = re.compile(rf" ?+[{_LETTER}]++|'(?:[stmd]|re|ve|ll)| ?+[^\s{_LETTER}{_DIGIT}]++| ?+[{_DIGIT}]++|\s+(?!\S)|\s+")
_WORD_PIECE = re.compile(rf"[{_LETTER}]++|'(?:[stmd]|re|ve|ll)|[^\s{_LETTER}{_DIGIT}]++|[{_DIGIT}]")


class Memo(dict):
    """Answers of f by text, within a number of bytes. Once its younger half is full, it becomes the older one, and what the older one
    held is forgotten, but for what was asked again meanwhile: frequent texts stay."""

    #: What an entry takes besides its characters: two object heads and its share of the table.
    ENTRY = 136

    def __init__(self, f, most: int = REMEMBERED_BYTES):
        super().__init__()
        self.f, self.most, self.held, self.older = f, most // 2, 0, {}

    def __missing__(self, key: str):
        value = self.older.pop(key, None)
        if value is None:
            value = self.f(key)
        if len(key) <= LONGEST:
            self.held += self.ENTRY + 2 * len(key)
            if self.held > self.most:
                self.older = dict(self)
                self.clear()
                self.held = self.ENTRY + 2 * len(key)
            self[key] = value
        return value


@functools.cache
def _stand_ins() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable and no space, else the next
    one from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [chr(others.get(b, b)) for b in range(256)]


def _safe(text: str) -> bool:
    """Only characters whose classes Python and the library share, and nothing that could be a special token."""
    try:
        return "<|" not in text and not text.encode("latin-1").translate(None, _SAFE)
    except UnicodeEncodeError:
        return False


@functools.cache
def _loaded(path: str) -> tuple[Tokenizer, str]:
    """The tokenizer and the kind of its cuts: of a fixed size, once for each worker process."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    normal, cut = made.get("normalizer"), made.get("pre_tokenizer") or {}
    kind = "other"
    if normal is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
        kind = "byte"
    elif normal and [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Sequence":
        kind = "word"
    return Tokenizer.from_file(path), kind


def _merger(tokenizer: Tokenizer, width: int) -> Callable[[str], bytes]:
    """ids of one piece by the library's merge model."""
    merge, stand_ins, kind = tokenizer.model.tokenize, _stand_ins(), "H" if width == 2 else "I"
    space = stand_ins[0x20]

    def merged(piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these, only the space isn't its own stand-in
            seen = piece.replace(" ", space)
        else:
            seen = "".join([stand_ins[b] for b in piece.encode()])
        ids = [t.id for t in merge(seen)]
        return struct.pack(f"<{len(ids)}{kind}", *ids)

    return merged


class Encoder:
    """ids of a text, without added special tokens, as little-endian numbers of `width` bytes. Make one for each task, or see shared."""

    def __init__(self, path: str, most: int = REMEMBERED_BYTES):
        self.tokenizer, self.kind = _loaded(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.find = (_WORD_PIECE if self.kind == "word" else _BYTE_PIECE).findall
        self.pieces = Memo(_merger(self.tokenizer, self.width), most)

    def _ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.kind == "other" or not _safe(text):
            return self._ask(text)
        return b"".join(map(self.pieces.__getitem__, self.find(text.lower() if self.kind == "word" else text)))


@functools.lru_cache(maxsize=1)
def shared(path: str, job: str, most: int = SHARED_BYTES) -> Encoder:
    """One encoder for all tasks of a job in this worker process: about half of a task's distinct pieces were in the tasks before.
    The next job's takes its place, so a process holds one, with `most` bytes of pieces."""
    return Encoder(path, most)


def wide(ids: bytes, width: int) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()

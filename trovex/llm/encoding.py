"""Token ids of whole texts, each distinct pre-token encoded once for each worker.

The ids are those of the tokenizers library.  Most pre-tokens of a corpus repeat, so a worker keeps the ids of those
it has met and gathers a text's ids from that table.  That holds for the two public vocabularies whose normaliser and
pre-tokens are stated below; any other vocabulary encodes whole texts by the library.  So do texts outside Latin-1, or
with the string of a special token, since the normaliser may join or fold characters there.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# What Unicode calls letters, numbers and white space within Latin-1.
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
# The pre-tokens of the two public vocabularies, within Latin-1.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
BYTE_PIECES = re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# Normaliser and pre-tokenizer of the two public vocabularies, as their files state them.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
BYTE_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
#: Distinct pre-tokens that a worker keeps, about 150 bytes each.
KEPT = 400_000


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is printable, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Pre-token -> its place in a growing table of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        rules = {k: stated.get(k) for k in BYTE_RULES}
        self.lowered = rules == WORD_RULES
        #: None where each text goes to the library whole.
        self.pieces = WORD_PIECES if self.lowered else BYTE_PIECES if rules == BYTE_RULES else None
        if stated.get("truncation") or stated.get("padding"):
            self.pieces = None
        self.model = self.whole.model
        self.letters = byte_letters()
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.flat: np.ndarray = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts: list[int] = []
        self.lens: list[int] = []
        self.at = (np.empty(0, np.int64), np.empty(0, np.int64))

    def __missing__(self, piece: str) -> int:
        ids = [x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts.append(self.used)
        self.lens.append(len(ids))
        self.used += len(ids)
        self[piece] = at = len(self.starts) - 1
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        if len(self) > KEPT:
            self.clear_all()
        places: list[np.ndarray | None] = []
        for text in texts:
            if self.pieces is None or "<|" in text or not fits_latin1(text):
                places.append(None)
                continue
            found = self.pieces.findall(text.lower() if self.lowered else text)
            places.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if len(self.starts) > len(self.at[0]):
            n = len(self.at[0])
            self.at = (np.concatenate([self.at[0], np.array(self.starts[n:], np.int64)]), np.concatenate([self.at[1], np.array(self.lens[n:], np.int64)]))
        starts, lens = self.at
        out = []
        for text, at in zip(texts, places, strict=True):
            if at is None:
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            n = lens[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(starts[at] - ends + n, n) + np.arange(total)])
        return out


def fits_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, Ids] = {}


def encoder(name: str) -> Ids:
    """This worker's encoder of a vocabulary: the path of a file, or the name of a public one, which is found where the worker runs."""
    if name not in _encoders:
        _encoders[name] = Ids(found(name))
    return _encoders[name]


def found(name: str) -> str:
    """The path of a vocabulary file."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())

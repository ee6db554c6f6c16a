"""Byte-level BPE by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary cannot be bridged by a merge, so the text may be cut
between the two. Texts are cut at all such pairs, each fragment is encoded by the tokenizers library on its own (once
per task for fragments that repeat), and the ids are joined. Cuts are left out where the library's word pattern could
look across them:

* after white space, because ``\\s+(?!\\S)`` looks at what follows (and after the few multi-byte characters whose first
  byte is shared with a white-space character);
* next to an apostrophe or one place later, because of the contractions;
* inside a UTF-8 character.

The string of an added token is found before any cut, as the library does.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import BYTE_BPE, map_rows

#: Fragments that each of the two generations of a cache keeps at most, and the longest that it keeps.
CACHE_ENTRIES = 120_000
CACHE_BYTES = 48
#: Marks that often end a word.
ENDINGS = ".,;:!?"
#: First bytes of the multi-byte characters among which some are white space.
SPACE_LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256 and up in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Bounded(dict):
    """Results by fragment, in two generations: the older is dropped when the younger is full. Keeps no long fragment."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.older: dict = {}

    def __missing__(self, fragment):
        out = self.older.get(fragment)
        if out is None:
            out = self.make(fragment)
        if len(fragment) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[fragment] = out
        return out


class FragmentCodec:
    """Encodes and decodes whole texts; the state is the vocabulary and two bounded caches."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.ids = _Bounded(self.fragment_ids)
        self.words = _Bounded(self.word_ids)
        self.decimals = _Bounded(lambda ids: ",".join(map(str, np.frombuffer(ids, "<u4").tolist())).encode())
        with open(path, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        alphabet = byte_alphabet()
        self.stand_in = {b: c for c, b in alphabet.items()}
        self.space = self.stand_in[ord(" ")]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        size = max([*vocabulary.values(), *added.values()], default=-1) + 1
        tokens = [b""] * size
        for token, number in vocabulary.items():
            tokens[number] = bytes(alphabet[c] for c in token)
        inside = np.zeros(65536, bool)
        for token in tokens:
            raw = np.frombuffer(token, np.uint8).astype(np.int64)
            inside[raw[:-1] * 256 + raw[1:]] = True
        for token, number in added.items():
            tokens[number] = token.encode()
        left, right = np.divmod(np.arange(65536), 256)
        quote = ord("'")
        #: True for byte pairs at which a text may be cut.
        self.cut = ~inside & (left > 0x20) & (left != 0x7F) & ((right & 0xC0) != 0x80) & (left != quote) & (right != quote)
        self.cut_bytes = self.cut.tobytes()
        #: Whether no token joins a word to a space or line feed behind it, or a line feed to a word.
        self.plain = not any(re.search(r"\S[ \n]|\n\S", t.decode("utf-8", errors="replace")) for t in tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def bounds(self, text: bytes) -> list[int]:
        """Places of the certain cuts of a text without added tokens."""
        b = np.frombuffer(text, np.uint8)
        pairs = b[:-1].astype(np.uint16) << 8
        pairs |= b[1:]
        at = np.flatnonzero(self.cut[pairs]) + 1
        before, earlier = b[at - 1], b[np.maximum(at - 2, 0)]
        bad = earlier == ord("'")
        if (wide := before >= 0x80).any():
            lead = np.where(earlier >= 0xC0, earlier, b[np.maximum(at - 3, 0)])
            bad |= wide & SPACE_LEADS[lead]
        return at[~bad].tolist()

    def fragments(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        at = self.bounds(text)
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]

    def spell(self, word: str) -> bytes:
        """Ids of one word of the library's pattern, given in the byte alphabet."""
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def fragment_ids(self, raw: bytes) -> bytes:
        """Ids of a fragment that begins and ends at certain cuts, or at an end of the text."""
        text = raw.decode("utf-8")
        word = text.removeprefix(" ")
        if word.isalpha() and max(word) < "\u0250":
            # Letters with at most one space before them are one word of the pattern, whatever the version of Unicode.
            return self.spell(raw.decode("latin-1").translate(self.stand_in))
        if 1 < len(raw) <= CACHE_BYTES and "'" not in text and word.split() == [word]:
            # No white space but the one in front: certain cuts are found by the table alone.
            for i in range(len(raw) - 1, 0, -1):
                if self.cut_bytes[raw[i - 1] << 8 | raw[i]]:
                    return self.ids[raw[:i]] + self.ids[raw[i:]]
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word_ids(self, piece: str) -> bytes:
        """Ids of a word with the space before it, or of a line feed and the word that follows it."""
        if piece.isascii() and piece.isalpha():
            return self.spell(self.space + piece)
        if piece[0] == "\n":
            return self.ids[b"\n"] + self.ids[piece[1:].encode()]
        head, last = piece[:-1], piece[-1]
        if head.isalpha() and last in ENDINGS and self.cut_bytes[head[-1].encode()[-1] << 8 | ord(last)]:
            return self.words[head] + self.ids[last.encode()]
        return self.fragment_ids(b" " + piece.encode())

    def pieces(self, text: str) -> list[bytes]:
        """Ids of the successive fragments of a text without added tokens."""
        if self.plain and text.replace("\n", " ") == " ".join(text.split()) and text[0] != "\n":
            first, *rest = text.replace("\n", " \n").split(" ")
            return [self.ids[first.encode()], *map(self.words.__getitem__, rest)]
        return list(map(self.ids.__getitem__, self.fragments(text.encode())))

    def encode_parts(self, text: str) -> list[bytes]:
        """Ids of the successive fragments of a whole text."""
        parts = [(False, text)] if text else []
        for token in self.added:
            parts = [x for known, p in parts for x in ([(known, p)] if known or token not in p else _around(p, token))]
        out: list[bytes] = []
        for known, part in parts:
            out += [self.added[part]] if known else self.pieces(part)
        return out

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids. Null and empty texts have none."""
        return b"".join(self.encode_parts(text.decode("utf-8", errors="replace"))) if text else b""

    def decode(self, ids: bytes) -> str:
        """Text of the ids, added tokens included; broken UTF-8 becomes replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def decode_bytes(self, ids: bytes) -> bytes:
        if not ids:
            return b""
        number = np.frombuffer(ids, "<u4")
        lengths = self.lengths[number]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[number] - (ends - lengths), lengths)
        return self.blob[shift + np.arange(ends[-1])].tobytes()


def _around(text: str, token: str) -> list[tuple[bool, str]]:
    parts = text.split(token)
    out = [(False, parts[0])]
    for part in parts[1:]:
        out += [(True, token), (False, part)]
    return [x for x in out if x[1]]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> FragmentCodec:
    """One codec per worker process and vocabulary."""
    return FragmentCodec(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(key, ids): the ids of every whole text as packed little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; null keys and repeated rows stay. Other columns are left out.
    """

    def make():
        encoder = codec(path)
        return lambda body: (encoder.encode(body),)

    return map_rows(df, [key], text, [T.StructField("ids", T.BinaryType())], make)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = BYTE_BPE, name: str = "text") -> DataFrame:
    """(key, text): the texts of packed ids. Null ids count as none."""

    def make():
        decoder = codec(path)
        return lambda body: (decoder.decode(body or b""),)

    return map_rows(df, [key], ids, [T.StructField(name, T.StringType())], make)


def encode_digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of encoding a whole text and of decoding its ids again."""
    extra = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def make():
        both = codec(path)

        def digest(body):
            parts = both.encode_parts(body.decode("utf-8", errors="replace")) if body else []
            ids = b"".join(parts)
            decimals = b",".join(map(both.decimals.__getitem__, parts))
            decoded = both.decode(ids).encode()
            return len(ids) // 4, hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return digest

    return map_rows(df, [key], text, extra, make)


def piece_crc(ids: bytes, start: int, length: int) -> int:
    """CRC-32 of a run of packed ids."""
    return zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])

"""Counts of a whole text that the quality operators share."""

from __future__ import annotations

from itertools import chain

import numpy as np

#: The symbols that count, and the ASCII white space that parts words.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

#: Classes of the character histogram.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other_mark", "beyond_ascii", "control")


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 0x80:
        return 8
    if char == "\n":
        return 4
    if char.isspace() and byte in WHITE:
        return 3
    if byte < 0x20 or byte == 0x7F:
        return 9
    if char.isalpha():
        return 1 if char.isupper() else 0
    if char.isdigit():
        return 2
    if char in ".,;:?'\"-()":
        return 5
    return 6 if byte in SYMBOLS else 7


CLASS_OF = np.array([_class_of(b) for b in range(256)])
_CONTINUES = np.array([(b & 0xC0) == 0x80 for b in range(256)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_WHITE = np.isin(np.arange(256), list(WHITE))


def byte_counts(body: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(body, np.uint8), minlength=256)


def class_counts(per_byte: np.ndarray) -> np.ndarray:
    """Code points by class; a multi-byte character counts once, as beyond ASCII."""
    starts = np.where(_CONTINUES, 0, per_byte)
    return np.bincount(CLASS_OF, starts, minlength=len(CLASSES)).astype(np.int64)


def word_chars(per_byte: np.ndarray) -> int:
    return int(per_byte[~_CONTINUES & ~_WHITE].sum())


def symbols(per_byte: np.ndarray) -> int:
    return int(per_byte[_SYMBOL].sum())


def duplicate_lines(body: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(distinct words, words that stand in a window of three that occurs twice or more)."""
    numbers = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    if len(words) < 4:
        return len(numbers), 0
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    size = len(numbers)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three numbers would not fit one long
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return size, 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : j + len(windows)] |= twice
    return size, int(covered.sum())


def word_shares(words: list[bytes], places: dict[bytes, int], size: int) -> np.ndarray:
    """Counts of the listed words, lower-cased and without marks at their ends; the last count is of all other words."""
    counts = np.zeros(size + 1, np.int64)
    found = [p for p in map(places.get, words) if p is not None]
    np.add.at(counts, found, 1)
    counts[size] = len(words) - len(found)
    return counts


def bare_words(body: bytes) -> list[bytes]:
    """Lower-cased words (ASCII) without marks at their ends."""
    return [w for w in (x.strip(b".,;:!?\"'()#*$%&|<>") for x in body.lower().split()) if w]


def flatten(parts) -> list:
    return list(chain.from_iterable(parts))

"""Minimal acyclic transducers: sorted terms in, lexicographic ordinals out, for many terms of a text at once.

A transducer is an automaton without equal states: states that accept the same endings are one. Every transition carries how
many terms sort before those behind it, so the sum along a term's path is the term's place in the order of bytes. Several languages
share the states of one transducer and have a root each.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bytes of a term: letters A-Z and a-z, and every byte of a character beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Builder:
    """Takes (language, term) in the order of bytes; equal neighbours count once. No state is ever made that has an equal."""

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.counts: list[int] = []
        self.final: list[bool] = []
        self.keys: list[int] = []
        self.targets: list[int] = []
        self.skips: list[int] = []
        self.roots: dict[str, int] = {}
        self.sizes: dict[str, int] = {}
        self.lows: dict[str, bytes] = {}
        self._lang: str | None = None
        self._term = b""
        self._path: list[list] = []

    def _settle(self, node: list) -> int:
        """The number of a state that takes no more transitions."""
        final, edges = node
        name = (final, *edges)
        state = self.states.get(name)
        if state is None:
            state = self.states[name] = len(self.counts)
            before = int(final)
            for byte, target in edges:
                self.keys.append(state << 8 | byte)
                self.targets.append(target)
                self.skips.append(before)
                before += self.counts[target]
            self.counts.append(before)
            self.final.append(final)
        return state

    def _settle_down_to(self, depth: int) -> None:
        while len(self._path) > depth + 1:
            state = self._settle(self._path.pop())
            self._path[-1][1].append((self._term[len(self._path) - 1], state))

    def add(self, lang: str, term: bytes) -> None:
        if lang != self._lang:
            self._close()
            self._lang, self._term, self._path = lang, b"", [[False, []]]
            self.lows[lang] = term
        elif term == self._term:
            return
        shared, most = 0, min(len(term), len(self._term))
        while shared < most and term[shared] == self._term[shared]:
            shared += 1
        self._settle_down_to(shared)
        self._path += ([False, []] for _ in range(len(term) - shared))
        self._path[-1][0] = True
        self._term = term

    def _close(self) -> None:
        if self._lang is not None:
            self._settle_down_to(0)
            root = self.roots[self._lang] = self._settle(self._path.pop())
            self.sizes[self._lang] = self.counts[root]

    def done(self) -> Transducer:
        self._close()
        self._lang = None
        order = np.argsort(np.array(self.keys, np.int64))
        # Ordinals run through all languages in the order they came in.
        bases = dict(zip(self.sizes, np.cumsum([0, *self.sizes.values()]).tolist(), strict=False))
        return Transducer(
            np.array(self.keys, np.int64)[order], np.array(self.targets, np.int32)[order], np.array(self.skips, np.int64)[order],
            np.array(self.final, bool), self.roots, bases, self.lows,
        )


class Transducer:
    """Sorted (state, byte) keys with target and skip of each transition, final states, and a root, base and least term for each language."""

    def __init__(self, keys, targets, skips, final, roots, bases, lows):
        self.keys, self.targets, self.skips, self.final = keys, targets, skips, final
        self.roots, self.bases, self.lows = roots, bases, lows

    @classmethod
    def of(cls, terms: Iterable[tuple[str, bytes]]) -> Transducer:
        builder = Builder()
        for lang, term in terms:
            builder.add(lang, term)
        return builder.done()

    def ordinals(self, lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of the term in each data[start:end], read in lower case; -1 where there is no such term.

        All terms step through the automaton together, a byte at a time.
        """
        found = np.full(len(starts), -1, np.int64)
        root = self.roots.get(lang)
        if root is None or not len(self.keys):
            return found
        which, at, stop = np.arange(len(starts)), starts, ends
        state, ordinal = np.full(len(starts), root, np.int64), np.full(len(starts), self.bases[lang], np.int64)
        last = len(self.keys) - 1
        while len(which):
            key = state << 8 | LOWER[data[at]]
            edge = np.minimum(np.searchsorted(self.keys, key), last)
            there = self.keys[edge] == key
            state, ordinal = self.targets[edge].astype(np.int64), ordinal + self.skips[edge]
            at = at + 1
            ended = at == stop
            accepted = there & ended & self.final[state]
            found[which[accepted]] = ordinal[accepted]
            on = there & ~ended
            which, at, stop, state, ordinal = which[on], at[on], stop[on], state[on], ordinal[on]
        return found


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the terms in a buffer of texts that ``offsets`` cut; no term crosses a cut."""
    inside = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each term in lower case as a number that sorts like them; shorter terms are filled with zeros."""
    head = np.zeros(len(starts), np.uint64)
    for k in range(8):
        there = starts + k < ends
        byte = np.zeros(len(starts), np.uint64)
        byte[there] = LOWER[data[starts[there] + k]]
        head = head << np.uint64(8) | byte
    return head


class Shelf:
    """Transducers of consecutive ranges of the vocabulary, with the ordinal at which each begins."""

    def __init__(self, parts: list[tuple[int, Transducer]]):
        self.by_lang: dict[str, list[tuple[int, Transducer]]] = {}
        for base, part in parts:
            for lang in part.roots:
                self.by_lang.setdefault(lang, []).append((base, part))
        self.lows = {
            lang: np.array([int.from_bytes(p.lows[lang][:8].ljust(8, b"\0"), "big") for _, p in held], np.uint64)
            for lang, held in self.by_lang.items()
        }

    def ordinals(self, lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        held = self.by_lang.get(lang, [])
        found = np.full(len(starts), -1, np.int64)
        if not held:
            return found
        low = high = np.zeros(len(starts), np.int64)
        if len(held) > 1:
            # A range whose least term begins like a term may hold it, and so may the one before.
            head = heads(data, starts, ends)
            low = np.maximum(np.searchsorted(self.lows[lang], head, "left") - 1, 0)
            high = np.maximum(np.searchsorted(self.lows[lang], head, "right") - 1, 0)
        for n, (base, part) in enumerate(held):
            asked = np.flatnonzero((low <= n) & (n <= high)) if len(held) > 1 else np.arange(len(starts))
            if len(asked):
                got = part.ordinals(lang, data, starts[asked], ends[asked])
                found[asked[got >= 0]] = base + got[got >= 0]
        return found

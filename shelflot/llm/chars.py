"""Letters of many texts as one array, and hashed character sequences inside their words."""

from __future__ import annotations

from functools import cache

import numpy as np

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(1, 17)], np.uint64)


@cache
def letters_and_digits() -> np.ndarray:
    """For every code point whether it is a letter or a digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


class Words:
    """The words (runs of letters and digits, in lower case) of a list of texts.

    ``codes`` holds all characters, everything between words as 1; an event is a character of a
    word or the 1 that ends it. ``place`` is an event's place in its word, ``word`` the number of
    its word, ``word_text`` the text that a word comes from.
    """

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        joined = " " + "".join([t + " " for t in lowered])
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters_and_digits()[raw]
        self.codes = np.where(inside, raw, 1).astype(np.uint32)
        step = np.diff(inside.astype(np.int8))
        self.starts = np.flatnonzero(step == 1) + 1
        ends = np.flatnonzero(step == -1) + 1
        self.lengths = ends - self.starts
        events = self.lengths + 1
        self.first_event = np.cumsum(events) - events
        total = int(events.sum())
        self.word = np.repeat(np.arange(len(events)), events)
        self.place = (np.arange(total) - np.repeat(self.first_event, events)).astype(np.int32)
        self.at = np.repeat(self.starts, events) + self.place
        bounds = 1 + np.cumsum([0] + [len(t) + 1 for t in lowered])
        self.word_text = np.searchsorted(bounds, self.starts, side="right") - 1
        self.n_texts = len(texts)
        self.words_per_text = np.bincount(self.word_text, minlength=len(texts)).astype(np.int64)

    def keys(self, first: int, last: int) -> np.ndarray:
        """A 64-bit number for each event, from the characters ``first`` to ``last`` places before it.

        Characters before the mark that begins the word are left out, and so is their number.
        """
        out = np.zeros(len(self.at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(first, last + 1):
                seen = self.codes[np.maximum(self.at - j, 0)].astype(np.uint64)
                seen[self.place + 1 < j] = 0
                out += (seen + np.uint64(j)) * _FACTORS[j]
                out ^= out >> np.uint64(29)
            return mixed(out)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        keys = keys ^ (keys >> np.uint64(32))
        keys = keys * np.uint64(0xD6E8FEB86659FD93)
        return keys ^ (keys >> np.uint64(32))


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by their owner."""
    return np.bincount(owner, weights=values, minlength=n)

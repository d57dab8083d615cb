"""Values of words over whole Arrow text columns: each different word of a batch is valued once, in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from panelwright.llm.common import text_bytes, worker_cache
from panelwright.llm.shingles import _WEIGHT, segment_hashes, word_starts

#: Words kept from batch to batch in one Python worker, and bytes of text that are valued at a time.
KEPT_WORDS, STEP_BYTES = 250_000, 2 << 20


class WordValues:
    """value(words) -> an array of width numbers for each of these lower-case words; words that differ only in the case of A-Z share them."""

    def __init__(self, width: int, value: Callable[[list[str]], np.ndarray]) -> None:
        self.width, self.value = width, value
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.table = np.zeros((1 << 12, self.width))

    def part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all words in order, n + 1 offsets of the rows' words)."""
        if len(self.slot) > KEPT_WORDS:
            self.clear()
        starts = word_starts(data, offsets)
        keys, first, inverse = np.unique(segment_hashes(data, starts, len(data), _WEIGHT), return_index=True, return_inverse=True)
        bounds, slots, get = np.append(starts, len(data)), np.empty(len(keys), np.int64), self.slot.get
        new, at = [], len(self.slot)
        for i, key in enumerate(keys.tolist()):
            k = get(key)
            if k is None:
                lo = bounds[first[i]]
                hi = min(bounds[first[i] + 1], offsets[np.searchsorted(offsets, lo, "right")])
                new.append(data[lo:hi].tobytes().rstrip(b" \t\n\x0b\x0c\r").decode("utf-8", "replace").lower())
                k = self.slot[key] = len(self.slot)
            slots[i] = k
        if new:
            while at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(new)] = self.value(new)
        return self.table[slots[inverse.reshape(-1)]], np.searchsorted(starts, offsets)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, values, offsets) for one part of the column after the other; null: no words."""
        data, offsets = text_bytes(column)
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
            yield a, b, *self.part(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b


def kept_values(name: str, width: int, value: Callable[[list[str]], np.ndarray]) -> WordValues:
    """This Python worker's table for the model of this name; a new model replaces the old one's table."""
    kept = worker_cache("words")
    if kept.get("name") != name:
        kept["name"], kept["values"] = name, WordValues(width, value)
    return kept["values"]

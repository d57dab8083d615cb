"""Token ids of whole Arrow text columns, equal to those of the tokenizers library on each whole text.

Where a tokenizer never merges across white space, its ids of a text are those of the text's chunks in order. The
chunks of a batch are hashed with numpy; each different chunk is encoded by the library once and kept in a bounded
cache of the Python worker. Texts with other white space than 0x09-0x0D and 0x20, with control characters 0x1C-0x1F,
or with "<|", which may begin a special token, are encoded whole, as are all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from panelwright.llm.common import text_bytes, worker_cache
from panelwright.llm.shingles import _SPACE, _WEIGHT, segment_hashes, word_starts

CACHE_CHUNKS = 800_000
CACHE_STEMS = 200_000
#: Bytes of text that are encoded at a time.
STEP_BYTES = 2 << 20
_PLAIN = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"( ?[{_LETTERS}]+)([.,;:!?|]*)")


def _byte_characters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable, else from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """One tokenizer with its cache of chunks."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        before = kind.get("pre_tokenizer") or {}
        names = [x.get("type") for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in before.get("pretokenizers", []) if x.get("type") == "Split"]
        spaces_kept = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and kind.get("normalizer") is None
        spaces_dropped = names == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and r"[\p{L}]+|" in splits[0]["pattern"].get("Regex", "")
        self.kind = "kept" if spaces_kept else "dropped" if spaces_dropped else "whole"
        self.characters = _byte_characters()
        self.clear()

    def clear(self) -> None:
        self.slot = np.zeros(0, np.uint64)  # sorted hashes of the known chunks; a chunk's index is its slot in begin and length
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.stems: dict[str, bytes] = {}

    def _stem(self, chunk: str) -> bytes:
        if self.kind == "dropped":
            chunk = chunk.lower()
        found = self.stems.get(chunk)
        if found is None:
            ids = [x.id for x in self.model.tokenize("".join([self.characters[b] for b in chunk.encode()]))]
            found = self.stems[chunk] = np.array(ids, np.uint32).tobytes()
        return found

    def _ids(self, chunk: str) -> bytes:
        m = _SIMPLE.fullmatch(chunk)
        if not m:
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, np.uint32).tobytes()
        end = m[2]
        if not end:
            return self._stem(m[1])
        if (tail := self.stems.get(end)) is None:
            tail = self.stems[end] = np.array(self.whole.encode(end, add_special_tokens=False).ids, np.uint32).tobytes()
        return self._stem(m[1]) + tail

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key, its place among the known ones, and whether it is known."""
        at = np.searchsorted(self.slot, keys)
        known = at < len(self.slot)
        known[known] = self.slot[at[known]] == keys[known]
        return at, known

    def _add(self, at: np.ndarray, keys: np.ndarray, chunks: list[str]) -> None:
        """Learns new chunks with rising keys, which belong at these places among the known ones."""
        found = [self._ids(chunk) for chunk in chunks]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = self.used + np.cumsum(lengths)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : ends[-1]] = np.frombuffer(b"".join(found), np.uint32)
        self.used = int(ends[-1])
        self.slot = np.insert(self.slot, at, keys)
        self.begin = np.insert(self.begin, at, ends - lengths)
        self.length = np.insert(self.length, at, lengths)
        if len(self.stems) > CACHE_STEMS:
            self.stems = {}

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = word_starts(data, offsets)
        if self.kind == "dropped":
            return words
        rows = np.zeros(len(data) + 1, bool)
        rows[offsets] = True
        space = _SPACE[data]
        marks = rows[:-1].copy()
        after = words[(words > 0) & ~rows[words]]  # words with white space before them in their row
        last = after - 1
        marks[words] = True
        marks[after] = data[last] != 32  # a blank goes with its word
        marks[last] = True  # else the last white space character stands alone
        marks[1:] |= space[1:] & ~space[:-1]  # a run of white space begins
        return np.flatnonzero(marks)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> str:
        if hi == len(data) or self.kind == "dropped":
            hi = min(hi, int(offsets[np.searchsorted(offsets, lo, "right")]))
        raw = data[lo:hi].tobytes()
        return (raw.rstrip(b" \t\n\x0b\x0c\r") if self.kind == "dropped" else raw).decode("utf-8", "replace")

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        if len(data) > 1:
            low, nxt = data[:-1], data[1:]
            at.append(np.flatnonzero((low == 0x3C) & (nxt == 0x7C)))
            at.append(np.flatnonzero((low == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))))
            at += [np.flatnonzero((low == a) & (nxt == b)) for a, b in ((0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x81), (0xE3, 0x80), (0xEF, 0xBB))]
            three = np.flatnonzero((low[:-1] == 0xE2) & (nxt[:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
            third = data[three + 2]
            at.append(three[(third <= 0x8B) | ((third >= 0xA8) & (third <= 0xAF))])
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return odd

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        odd = np.ones(n, bool) if self.kind == "whole" else self._odd_rows(data, offsets)
        if not odd.all():
            if len(self.slot) > CACHE_CHUNKS:
                self.clear()
            starts = self._chunks(data, offsets)
            keys = segment_hashes(data, starts, len(data), _WEIGHT if self.kind == "dropped" else _PLAIN)
            uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            at, known = self._find(uniq)
            if not known.all():
                new = np.flatnonzero(~known)
                bounds = np.append(starts, len(data))
                self._add(at[new], uniq[new], [self._chunk(data, offsets, int(bounds[k]), int(bounds[k + 1])) for k in first[new].tolist()])
                at, _ = self._find(uniq)
            slots = at[inverse.reshape(-1)]
            lengths = self.length[slots]
            ends = np.cumsum(lengths)
            ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[slots] - ends + lengths, lengths)]
            at = np.append(0, ends)[np.searchsorted(starts, offsets)]
            if not odd.any():
                return ids, at
        parts = []
        for i in range(n):
            parts.append(np.array(self.whole.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) if odd[i] else ids[at[i] : at[i + 1]])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])

    def rows(self, column: pa.Array):
        """(ids of all rows of a part of the column, the part's n + 1 offsets), part by part; null: empty."""
        data, offsets = text_bytes(column)
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
            yield self._part(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for the file, kept from task to task."""
    kept = worker_cache("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]

"""Byte-pair merges of many words at once, for vocabularies given as tokenizer JSON.

``Merger.merge`` takes symbol ids of many words and applies each word's merges in rank order, leftmost
first, one merge per word and round, on flat arrays. Words beyond ``LONG`` symbols go through a heap
instead, so one very long word costs n log n.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

LONG = 160
_NONE = np.int64(1 << 60)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Merger:
    """Merge rules of one vocabulary: (left id, right id) -> (rank, merged id), in an open hash table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.ids
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = (left << 32) | right
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self._mask = (1 << 18) - 1
        self._keys = np.full(self._mask + 1, -1, np.int64)
        self._ranks = np.full(self._mask + 1, _NONE, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self._keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self._keys[slot[put]], self._ranks[slot[put]] = keys[todo[put]], todo[put]
            todo, slot = todo[~put], (slot[~put] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(46)).astype(np.int64) & self._mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a huge number."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._ranks[slot], _NONE)
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            slot_on = (slot[on] + 1) & self._mask
            slot[on] = slot_on
            found = self._keys[slot_on]
            hit = found == keys[on]
            out[on[hit]] = self._ranks[slot_on[hit]]
            on = on[~hit & (found != -1)]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of all words, flat, and the number of ids of each. ``lengths``: symbols per word, none 0."""
        if not len(lengths):
            return symbols[:0], lengths[:0]
        starts = np.cumsum(lengths) - lengths
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word numbers, their lengths, their ids
        for w in np.flatnonzero(lengths > LONG):
            got = self._merge_long(symbols[starts[w] : starts[w] + lengths[w]].tolist())
            done.append((np.array([w]), np.array([len(got)]), np.array(got, symbols.dtype)))
        word = np.flatnonzero(lengths <= LONG)
        own = np.repeat(lengths <= LONG, lengths)
        sym, size = symbols[own], lengths[word]
        last = np.cumsum(size) - 1
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[last] = _NONE
        while len(word):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, begin)
            live = best < _NONE
            if not live.all():
                stay = np.repeat(live, size)
                done.append((word[~live], size[~live], sym[~stay]))
                sym, rank, word, size, best = sym[stay], rank[stay], word[live], size[live], best[live]
                if not len(word):
                    break
                begin = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(begin, at, "right") - 1
            at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]  # the leftmost of each word
            sym[at] = self.made[best]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            end = np.zeros(len(sym), bool)
            end[begin + size - 1] = True
            end[at] |= end[at + 1]
            sym, rank, end = sym[keep], rank[keep], end[keep]
            at -= np.arange(len(at))  # one symbol fewer for each earlier merge
            size = size - 1
            begin = np.cumsum(size) - size
            inner = at > begin
            redo = np.concatenate((at, at[inner] - 1))
            redo = redo[~end[redo]]
            rank[at] = _NONE
            rank[redo] = self.ranks(sym[redo], sym[redo + 1])
        order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
        sizes = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
        return flat[at], sizes

    def _merge_long(self, sym: list[int]) -> list[int]:
        """One word by a heap of (rank, position) over a linked list."""
        rank_of, made = self.rank_of, self.made
        n = len(sym)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank_of.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = int(made[r])
            gone[j] = True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank_of.get(sym[x] << 32 | sym[y])) is not None:
                    heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [s for s, g in zip(sym, gone) if not g]


class ByteWords:
    """Ids of byte words under a byte-level vocabulary, merged exactly."""

    def __init__(self, merger: Merger) -> None:
        letters = byte_letters()
        self.merger = merger
        self.first = np.array([merger.ids[c] for c in letters], np.int32)
        self.final = np.array([merger.ids[c + merger.suffix] for c in letters], np.int32) if merger.suffix else self.first

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers; no word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[raw]
        if self.merger.suffix:
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.final[raw[ends]]
        ids, sizes = self.merger.merge(symbols, lengths)
        data = ids.astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

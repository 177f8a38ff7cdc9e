"""Ids of words, remembered in flat arrays by the words' hashes."""

from __future__ import annotations

import numpy as np

from marketloom.llm.text_arrays import Words, same_ranges


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` entries, doubled as often as it takes."""
    while size > len(array):
        array = np.concatenate((array, np.zeros_like(array)))
    return array


class WordCache:
    """Remembers the ids of words; ``bound`` words at most, then it starts anew.

    Subclasses tell the ids of new words in ``_encoded``.
    """

    def __init__(self, bound: int) -> None:
        self.bound = bound
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int | bytes, int] = {}  # by hash; words whose hash another word has, by their bytes
        self.letters, self.end = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 12, dtype=np.int64)  # the words' bytes, and where each ends
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.first = np.zeros(1 << 12, dtype=np.int64)  # place of a word's ids in self.ids

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        raise NotImplementedError

    def _learn(self, keys: list[int | bytes], words: list[bytes]) -> None:
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            flat, sizes = self._encoded([w.decode("utf-8", "replace") for w in part])
            n, own = len(self.known), np.frombuffer(b"".join(part), dtype=np.uint8)
            self.ids = _grown(self.ids, self.used + len(flat))
            self.first, self.end = _grown(self.first, n + len(part) + 1), _grown(self.end, n + len(part) + 1)
            self.letters = _grown(self.letters, int(self.end[n]) + len(own))
            self.ids[self.used : self.used + len(flat)] = flat
            self.first[n + 1 : n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
            self.letters[self.end[n] : self.end[n] + len(own)] = own
            self.end[n + 1 : n + 1 + len(part)] = self.end[n] + np.cumsum([len(w) for w in part])
            self.used += len(flat)
            self.known.update(zip(keys[low : low + 4096], range(n, n + len(part)), strict=True))

    def ids_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, for each text the ids before it, and the total).

        Words meet by their hashes, and their bytes are compared with those of
        the word that has the hash; others are looked up by their bytes.
        """
        raw = words.data.tobytes()
        values, where, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys: list[int | bytes] = values.tolist()
        if len(self.known) + len(keys) > self.bound:
            self._forget()
        least = where[inverse]
        odd = np.flatnonzero(~same_ranges(words.data, words.start, words.end, words.data, words.start[least], words.end[least]))
        for i in odd.tolist():
            word = raw[words.start[i] : words.end[i]]
            if word not in keys[len(values) :]:
                keys.append(word)
                where = np.append(where, i)
            inverse[i] = len(values) + keys[len(values) :].index(word)
        index = np.fromiter((self.known.get(k, -1) for k in keys), dtype=np.int64, count=len(keys))
        plain = np.flatnonzero(index[: len(values)] >= 0)
        at = index[plain]
        same = same_ranges(words.data, words.start[where[plain]], words.end[where[plain]], self.letters[: self.end[len(self.known)]], self.end[at], self.end[at + 1])
        for i in plain[~same].tolist():
            keys[i] = raw[words.start[where[i]] : words.end[where[i]]]
            index[i] = self.known.get(keys[i], -1)
        new = np.flatnonzero(index < 0)
        if len(new):
            spans = zip(words.start[where[new]].tolist(), words.end[where[new]].tolist(), strict=True)
            index[new] = len(self.known) + np.arange(len(new))
            self._learn([keys[i] for i in new.tolist()], [raw[a:b] for a, b in spans])
        index = index[inverse]
        first, size = self.first[index], self.first[index + 1] - self.first[index]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return ids, before[words.at]

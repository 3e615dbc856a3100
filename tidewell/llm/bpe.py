"""Byte-level BPE by corpus-level merge replay, with public vocabularies read in place."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from functools import cached_property, lru_cache

import numpy as np

from tidewell.llm.finding import Finder

#: Folder of the public vocabularies on every machine; a parameter everywhere, never copied.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"


def _pattern(letters: str, digits: str, space: str) -> str:
    # The pattern that splits text before the merges
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"


#: A chunk's distinct words stay known to later chunks of a task, until there are so many.
KNOWN_WORDS = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [], 256
    for byte in range(256):
        if byte in printable:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class MergeTable:
    """The merges of one vocabulary as sorted arrays: pair of ids to rank and to the merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (self.left << 32) | self.right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        letters = _byte_letters()
        self.of_byte = np.array([ids[letter] for letter in letters], np.int64)
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        #: The bytes of a token that aren't special, by id.
        self.n_bytes = np.zeros(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            self.n_bytes[i] = len(token) if all(c in byte_of for c in token) else 0
        #: The bytes of all tokens that aren't special, and how many the longest has.
        self.tokens = frozenset(bytes(map(byte_of.__getitem__, token)) for token, i in ids.items() if self.n_bytes[i])
        self.longest = max(map(len, self.tokens))
        self._dict = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(self.left, self.right, self.merged, strict=True))}

    @cached_property
    def longest_from(self) -> dict[bytes, int]:
        """The bytes of the longest token that begins with two given bytes."""
        found: dict[bytes, int] = {}
        for token in self.tokens:
            if len(token) > 1:
                found[token[:2]] = max(len(token), found.get(token[:2], 1))
        return found

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, flat, and the offsets of each word.

        All words lie in one array of symbols with links to the neighbours. An inverted index holds,
        for each mergeable pair, the positions where it stands. Merges are taken in rank order; each
        visits only its own positions, and only the pairs with touched neighbours are entered anew.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbol = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], -1)  # the last is beyond every word
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filled = lengths > 0
        after[ends[filled] - 1] = n
        before[(ends - lengths)[filled]] = n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            hit = rank >= 0
            at, rank = at[hit], rank[hit]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for k, r in enumerate(rank[np.append(0, cut)].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(at[bounds[k] : bounds[k + 1]])

        enter(np.flatnonzero(after[:n] != n))
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping places every second one, from the left
                linked = np.append(False, after[at[:-1]] == at[1:])
                run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self.merged[r], -2
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            enter(np.concatenate([ahead[ahead != n], at[beyond != n]]))
        alive = symbol[:n] >= 0
        total = np.append(0, np.cumsum(alive))
        return symbol[:n][alive], total[np.append(0, ends)]

    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one word, for the odd word that comes alone."""
        if len(word) > 96:
            return self.replay([word])[0].tolist()
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            best = min(((self._dict[pair][0], k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self._dict), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self._dict[ids[k], ids[k + 1]][1]]
        return ids


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(maxsize=1)
def _finder() -> Finder:
    return Finder(_pattern)


class _Places(dict):
    """The place of each word in order of first sight; asking for a new word gives it the next one."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class CorpusEncoder:
    """Encodes chunks of texts: splits them to words, replays the merges once over the chunk's new distinct words."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self._split = _finder()
        self._reset()

    def _reset(self) -> None:
        self.place = _Places()
        self.ids = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.sizes: list[int] = []

    def words(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The words of each text as places in the table of known words, which afterwards holds them all."""
        if len(self.place) > KNOWN_WORDS:
            self._reset()
        place, known = self.place, len(self.place)
        found = []
        for text in texts:
            words = self._split(text) if text else []
            found.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        if len(place) > known:
            fresh = [word.encode("utf-8", "surrogatepass") for word in list(place)[known:]]
            ids, offsets = self.table.replay(fresh)
            self.starts = np.concatenate([self.starts, offsets[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.sizes += np.diff(offsets).tolist()
        return found

    def gather(self, words: np.ndarray) -> np.ndarray:
        """The token ids of a sequence of words."""
        return self.gather_all([words])[0]

    def gather_all(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of several sequences of words, one after the other, and the offsets of each."""
        words = np.concatenate(found) if found else np.zeros(0, np.int64)
        n = self.starts[words + 1] - self.starts[words]
        ends = np.append(0, np.cumsum(n))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[words] - ends[:-1], n)].astype(np.int32)
        return ids, ends[np.append(0, np.cumsum([len(w) for w in found], dtype=np.int64))]

    def totals(self, found: list[np.ndarray]) -> list[int]:
        """The number of tokens of each sequence of words."""
        words = np.concatenate(found) if found else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(self.starts[words + 1] - self.starts[words]))
        return np.diff(ends[np.append(0, np.cumsum([len(w) for w in found], dtype=np.int64))]).tolist()

    def count(self, text: str) -> int:
        """The number of tokens of a short text."""
        get, sizes, total = self.place.get, self.sizes, 0
        for word in self._split(text):
            at = get(word)
            total += len(self.table.merge_word(word.encode("utf-8", "surrogatepass"))) if at is None else sizes[at]
        return total

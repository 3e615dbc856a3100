"""Evaluation texts that leak into a corpus, by CGK embedding and bit-sampling LSH."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.finding import Finder
from tidewell.llm.tokenizing import chunks

#: Consecutive words that make a passage; a shorter item must stand whole.
PASSAGE_WORDS = 12
#: Word edits that a window may differ by, for each six of its words.
EDITS_PER_SIX = 1
#: Random walks, samplings of each, and coordinates of a sampling.
WALKS, SAMPLINGS, COORDINATES = 4, 3, 4
SEED = 20_160_104
#: Items are taken in blocks of so many words, whose texts are broadcast. An index takes about 400 bytes a word, and a
#: worker keeps so many of them; with more blocks it takes the corpus in larger parts, so that indexing again is rare.
BLOCK_WORDS, KEPT_BLOCKS = 200_000, 2
PART_ROWS, PART_BYTES = 2_000, 16 << 20
#: Documents that the exhaustive search takes at once.
RECALL_ROWS = 200

_COLUMNS = ["doc_id", "item_id", "distance", "n_windows", "first_word", "last_word"]
_END = np.array([-1], np.int64)
SCHEMA = "doc_id bigint, item_id bigint, distance int, n_windows bigint, first_word bigint, last_word bigint"


@lru_cache(maxsize=1)
def _finder() -> Finder:
    return Finder(lambda letters, digits, _: f"[{letters}{digits}]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text: maximal runs of letters and digits, in lower case."""
    return _finder()(text.lower()) if text else []


def edits_allowed(size: int) -> int:
    return size // 6 * EDITS_PER_SIX


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of symbols spread over all bits."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Walk:
    """One random walk of windows of ``size`` words and its samplings.

    The walk reads a window with a pointer. At each step it puts out the symbol under the pointer,
    then moves on or stays, by a random bit that depends on step and symbol alone. Two windows a few
    edits apart soon read alike again, so their outputs differ in few places.
    """

    size: int
    seed: int
    n_symbols: int
    samples: list[np.ndarray] = field(init=False)
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        random = np.random.default_rng([SEED, self.size, self.seed])
        self.samples = [np.sort(random.choice(2 * self.size, min(COORDINATES, 2 * self.size), replace=False)) for _ in range(SAMPLINGS)]
        steps = max(int(s[-1]) for s in self.samples) + 1
        self.bits = random.integers(0, 2, (steps, self.n_symbols + 1), dtype=np.int8)

    def keys(self, windows: np.ndarray) -> list[np.ndarray]:
        """A 64-bit key of each window, for each sampling."""
        n = len(windows)
        padded = np.concatenate([windows, np.full((n, 1), self.n_symbols, windows.dtype)], axis=1).ravel()
        row, pointer = np.arange(n) * (self.size + 1), np.zeros(n, np.int64)
        keys = [np.zeros(n, np.uint64) for _ in self.samples]
        for step, bits in enumerate(self.bits):
            symbol = padded[row + pointer]
            for key, sample in zip(keys, self.samples, strict=True):
                if step in sample:
                    key += _mixed(symbol.astype(np.uint64) + np.uint64(step << 32) + np.uint64(1))
            pointer = np.minimum(pointer + bits[symbol], self.size)
        return keys


@dataclass
class WindowIndex:
    """The windows of all items of one size, with sorted keys for every sampling of every walk."""

    size: int
    windows: np.ndarray
    item: np.ndarray
    walks: list[Walk]
    sorted_keys: list[np.ndarray]
    rows: list[np.ndarray]

    @classmethod
    def build(cls, size: int, windows: np.ndarray, item: np.ndarray, n_symbols: int) -> WindowIndex:
        walks = [Walk(size, seed, n_symbols) for seed in range(WALKS)]
        keys = [key for walk in walks for key in walk.keys(windows)]
        order = [np.argsort(key, kind="stable") for key in keys]
        return cls(size, windows, item, walks, [key[o] for key, o in zip(keys, order, strict=True)], order)

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a given window and an indexed one that share a key."""
        pairs = [np.zeros(0, np.int64)]
        keys = (key for walk in self.walks for key in walk.keys(windows))
        for key, own, rows in zip(keys, self.sorted_keys, self.rows, strict=True):
            low, high = np.searchsorted(own, key, "left"), np.searchsorted(own, key, "right")
            n = high - low
            hit = np.flatnonzero(n)
            n = n[hit]
            at = np.arange(int(n.sum())) + np.repeat(low[hit] - (np.cumsum(n) - n), n)
            pairs.append(np.repeat(hit, n) * len(self.windows) + rows[at])
        both = np.sort(np.concatenate(pairs))
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        return both // len(self.windows), both % len(self.windows)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distance of the rows of ``a`` and ``b``, or ``most + 1`` if it is larger, in a band of the table.

    Pairs whose whole band is beyond ``most`` are dropped on the way; nearly all are after a few words.
    """
    n, size = a.shape
    width = 2 * most + 1
    result = np.full(n, most + 1, np.int16)
    alive = np.arange(n)
    above = np.full((width, n), most + 1, np.int16)
    above[most:] = np.arange(most + 1)[:, None]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(1, size + 1):
        row = np.full(above.shape, most + 1, np.int16)
        for k in range(max(0, most - i), min(width, size - i + most + 1)):
            j = i + k - most
            if j == 0:
                row[k] = min(i, most + 1)
                continue
            best = above[k] + (a[i - 1] != b[j - 1])
            if k + 1 < width:
                best = np.minimum(best, above[k + 1] + 1)
            if k:
                best = np.minimum(best, row[k - 1] + 1)
            row[k] = np.minimum(best, most + 1)
        above = row
        if i % (most + 2) == 0 and i < size:
            able = above.min(axis=0) <= most
            alive, above, a, b = alive[able], above[:, able], a[:, able], b[:, able]
    result[alive] = above[most]
    return result


@dataclass
class ItemIndex:
    """Windows of a block of items: the size of a passage, or the whole item if it is shorter. Symbol 0 is any foreign word."""

    symbols: dict[str, int]
    sizes: list[WindowIndex]
    item_ids: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, list[str]]], passage: int = PASSAGE_WORDS) -> ItemIndex:
        symbols: dict[str, int] = {}
        for _, words in items:
            for word in words:
                symbols.setdefault(word, len(symbols) + 1)
        by_size: dict[int, tuple[list, list]] = {}
        for k, (_, words) in enumerate(items):
            size = min(passage, len(words))
            if size:
                own = np.array([symbols[w] for w in words], np.int64)
                windows, item = by_size.setdefault(size, ([], []))
                windows.append(np.lib.stride_tricks.sliding_window_view(own, size))
                item.append(np.full(len(own) - size + 1, k, np.int64))
        sizes = [WindowIndex.build(size, np.concatenate(w), np.concatenate(i), len(symbols) + 1) for size, (w, i) in sorted(by_size.items())]
        return cls(symbols, sizes, np.array([i for i, _ in items], np.int64))

    def stream(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts' words, each text closed by an end, and where each text begins."""
        symbol, parts, starts, at = self.symbols.get, [], np.zeros(len(texts), np.int64), 0
        for k, own in enumerate(texts):
            starts[k] = at
            parts.append(np.fromiter(map(symbol, own, repeat(0)), np.int64, len(own)))
            parts.append(_END)
            at += len(own) + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), starts

    def search(self, texts: list[str | None]) -> pd.DataFrame:
        """The items found in each text, with the least distance, the number of windows and their place."""
        return self.search_words([words_of(text) for text in texts])

    def search_words(self, texts: list[list[str]]) -> pd.DataFrame:
        """The same for texts that are given as words."""
        stream, starts = self.stream(texts)
        # the end of a text counts as more foreign words than any window may hold, so no window reaches beyond it
        foreign = np.append(0, np.cumsum(np.where(stream < 0, 1 << 20, stream == 0)))
        found = []
        for index in self.sizes:
            most = edits_allowed(index.size)
            if len(stream) < index.size:
                continue
            # each foreign word takes an edit, so a window with more of them than edits allowed can't match
            able = np.flatnonzero(foreign[index.size :] - foreign[: -index.size] <= most)
            view = np.lib.stride_tricks.sliding_window_view(stream, index.size)
            for low in range(0, len(able), 50_000):
                place = able[low : low + 50_000]
                windows = view[place]
                left, right = index.candidates(windows)
                for first in range(0, len(left), 500_000):
                    a, b = left[first : first + 500_000], right[first : first + 500_000]
                    distance = edit_distances(windows[a], index.windows[b], most)
                    good = distance <= most
                    found.append(
                        pd.DataFrame({"place": place[a[good]], "item": index.item[b[good]], "distance": distance[good], "size": index.size})
                    )
        if not found:
            return pd.DataFrame({c: [] for c in ("text", *_COLUMNS[1:])}, dtype=np.int64)
        hits = pd.concat(found, ignore_index=True)
        hits["text"] = np.searchsorted(starts, hits["place"], "right") - 1
        hits["first_word"] = hits["place"] - starts[hits["text"].to_numpy()]
        hits["last_word"] = hits["first_word"] + hits["size"] - 1
        grouped = hits.groupby(["text", "item"]).agg(
            distance=("distance", "min"), n_windows=("place", "nunique"), first_word=("first_word", "min"), last_word=("last_word", "max")
        )
        grouped = grouped.reset_index()
        grouped["item_id"] = self.item_ids[grouped["item"].to_numpy(np.int64)]
        return grouped

    def exhaustive(self, texts: list[list[str]]) -> dict[tuple[int, int], int]:
        """The least distance for each text and item that match, without any embedding: what ``search`` is measured against.

        With ``e`` edits allowed, one of ``e + 1`` parts of an item's window stands unchanged in a matching window of the
        text, moved by ``e`` words at most. Every place where a part of any window stands so is verified.
        """
        stream, starts = self.stream(texts)
        found: dict[tuple[int, int], int] = {}
        for index in self.sizes:
            most = edits_allowed(index.size)
            bounds = [index.size * k // (most + 1) for k in range(most + 2)]
            parts: dict[tuple[int, bytes], list[int]] = {}
            for row, window in enumerate(index.windows):
                for k in range(most + 1):
                    parts.setdefault((k, window[bounds[k] : bounds[k + 1]].tobytes()), []).append(row)
            pairs: set[tuple[int, int]] = set()
            for k in range(most + 1):
                n = bounds[k + 1] - bounds[k]
                for at in range(len(stream) - n + 1):
                    for row in parts.get((k, stream[at : at + n].tobytes()), ()):
                        pairs.update((at - bounds[k] + shift, row) for shift in range(-most, most + 1))
            pairs = {(at, row) for at, row in pairs if 0 <= at <= len(stream) - index.size}
            if not pairs:
                continue
            place, row = np.array(sorted(pairs), np.int64).T
            windows = np.lib.stride_tricks.sliding_window_view(stream, index.size)[place]
            inside = (windows >= 0).all(axis=1)
            place, row, windows = place[inside], row[inside], windows[inside]
            for low in range(0, len(place), 500_000):
                distance = edit_distances(windows[low : low + 500_000], index.windows[row[low : low + 500_000]], most)
                text = np.searchsorted(starts, place[low : low + 500_000], "right") - 1
                for t, item, d in zip(text.tolist(), self.item_ids[index.item[row[low : low + 500_000]]].tolist(), distance.tolist(), strict=True):
                    if d <= most:
                        found[t, item] = min(d, found.get((t, item), d))
        return found


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items, partition by partition, in blocks of a bounded number of words. A longer item is a block by itself."""
    block, size = [], 0
    rows = items.select(items[item_id].cast("bigint").alias("item_id"), items[text].cast("string").alias("text")).dropna()
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    if block:
        yield block


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = PASSAGE_WORDS
) -> DataFrame:
    """Documents with the items of which they hold a passage, exactly or nearly.

    A passage is ``passage`` consecutive words of an item, or the whole item if it is shorter; words
    are runs of letters and digits in lower case, so case, punctuation, markup and line breaks make no
    difference. ``distance`` is the least number of word edits between a passage and a window of the
    document of the same number of words: 0 if the passage stands there exactly, else up to one edit
    for each six words. ``n_windows`` windows match, from ``first_word`` to ``last_word`` (0-based).

    Null and empty texts, texts without words, and null ids of items match nothing; an empty table on
    either side gives no rows. A null document id stays null. Items that repeat each other are all reported. Repeated document ids
    are brought to one row for each item, as are repeated item ids. Other columns are pruned.

    The windows of the items are embedded by several CGK walks over words, which map edit distance to
    Hamming distance, and each embedding is sampled at a few coordinates to a key. Windows of the
    documents that share a key with an item's are verified by exact edit distance. Equal windows share
    every key, so exact passages are all found; near ones are found with the recall that walks and
    samplings give. The items' texts are broadcast in blocks of bounded size, which workers index when they first need
    them. Documents are read once, however many blocks there are, and never shuffled.
    """
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(block) for block in item_blocks(items, item_id, item_text)]
    if not shared:
        return spark.createDataFrame([], SCHEMA)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, ItemIndex] = OrderedDict()

        def index(k: int) -> ItemIndex:
            if k not in kept:
                if len(kept) >= KEPT_BLOCKS:
                    kept.popitem(last=False)
                kept[k] = ItemIndex.build(shared[k].value, passage)
            return kept[k]

        few = len(shared) <= KEPT_BLOCKS
        for table in (pa.Table.from_batches([b]) for b in batches) if few else chunks(batches, 1, PART_BYTES):
            for low in range(0, table.num_rows, PART_ROWS if few else table.num_rows):
                part = table.slice(low, PART_ROWS) if few else table
                part = part.combine_chunks()
                texts = [words_of(text) for text in part.column(1).to_pylist()]
                for k in range(len(shared)):
                    hits = index(k).search_words(texts)
                    if not len(hits):
                        continue
                    keys = part.column(0).take(pa.array(hits["text"].to_numpy(np.int64))).combine_chunks()
                    rest = [pa.array(hits[c].to_numpy(np.int32 if c == "distance" else np.int64)) for c in _COLUMNS[1:]]
                    yield pa.RecordBatch.from_arrays([keys, *rest], names=_COLUMNS)

    corpus = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    return corpus.mapInArrow(search, SCHEMA).groupBy("doc_id", "item_id").agg(
        F.min("distance").alias("distance"), F.max("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")
    )


def leak_recall(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = PASSAGE_WORDS
) -> DataFrame:
    """How many of the matches of ``documents`` with all items ``leaked_items`` finds, for each distance.

    Columns ``distance`` (all that are allowed), ``n_matches`` and ``n_found``. Matches come from an exhaustive search, which is
    slow: give it the documents of a stated query set.
    """
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(block) for block in item_blocks(items, item_id, item_text)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [None] * len(shared)
        for batch in batches:
            for low in range(0, batch.num_rows, RECALL_ROWS):
                part = batch.slice(low, RECALL_ROWS)
                texts, keys = [words_of(text) for text in part.column(1).to_pylist()], part.column(0).to_pylist()
                for k, block in enumerate(shared):
                    index = kept[k] or ItemIndex.build(block.value, passage)
                    kept[k] = index if len(shared) <= KEPT_BLOCKS else None
                    rows = [(keys[t], item, d) for (t, item), d in index.exhaustive(texts).items()]
                    columns = list(zip(*rows, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance"]
                    )

    corpus = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    matches = corpus.mapInArrow(search, "doc_id bigint, item_id bigint, distance int").groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
    found = leaked_items(documents, items, doc_id, text, item_id, item_text, passage).select("doc_id", "item_id", F.lit(1).alias("found"))
    both = matches.join(found, ["doc_id", "item_id"], "left")
    counts = both.groupBy("distance").agg(F.count(F.lit(1)).alias("n_matches"), F.count("found").alias("n_found"))
    every = spark.range(edits_allowed(passage) + 1).select(F.col("id").cast("int").alias("distance"))
    return every.join(counts, "distance", "left").na.fill(0, ["n_matches", "n_found"])


def leak_counts(leaks: DataFrame) -> DataFrame:
    """For each leaked item the number of documents that hold a passage exactly, and exactly or nearly."""
    return leaks.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("n_exact"), F.count(F.lit(1)).alias("n_documents"))

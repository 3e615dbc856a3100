"""Splitting of oversized texts at natural boundaries."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import TOKENIZERS, VOCABULARY, CorpusEncoder
from tidewell.llm.tokenizing import chunks

LIMIT, OVERLAP = 512, 32
#: Characters to both sides of a first guess where nearly every overlap is found.
REACH = 48
LEVELS = ("character", "mark", "word", "sentence", "line", "code", "paragraph", "section")
CHARACTER, MARK, WORD, SENTENCE, LINE, CODE, PARAGRAPH, SECTION = range(8)
SCHEMA = "doc_id bigint, piece_no int, n_pieces int, start_char int, body_char int, end_char int, n_tokens int, overlap_tokens int, boundary string, piece string"

_CODE_SPAN = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*(?:\n|\Z)|\Z)|<pre\b.*?(?:</pre>|\Z)", re.M | re.S | re.I)
#: What ends before a boundary or starts at it, by strength. Boundaries lie after line breaks and before other white space.
_MARKS = (
    (SECTION, re.compile(r"^(?=[ ]{0,3}(?:#{1,6}[ \t]|(?:-{3,}|\*{3,}|_{3,}|={3,})[ \t]*$))", re.M)),
    (SECTION, re.compile(r"<(?=h[1-6]\b|hr\b)", re.I)),
    (PARAGRAPH, re.compile(r"\n(?:[ \t\r]*\n)+|</p>|<p>(?=)|</(?:ul|ol|table|blockquote|div)>", re.I)),
    (LINE, re.compile(r"\r?\n|\r|<br ?/?>|</li>|</tr>", re.I)),
    (SENTENCE, re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[”’」』）]*")),
)
#: Marks that begin what comes after the boundary.
_STARTS = ("<p>", "<P>", "<")

#: Weak marks stand nearly everywhere, so they are sought only where there is no other.
_WEAK = (
    (WORD, re.compile(r"(?<=\S)(?=[ \t　])")),
    (MARK, re.compile(r"(?<=[^\w\s])(?=[\w\"'])")),  # where nothing but punctuation parts words, as in dense JSON
)


def weak_boundaries(text: str, low: int, high: int) -> dict[int, int]:
    """The word ends between two positions, or without any the places where punctuation parts words."""
    for level, mark in _WEAK:
        found = {m.start(): level for m in mark.finditer(text, low, min(high + 1, len(text))) if 0 < m.start() <= high and m.start() < len(text)}
        if found:
            return found
    return {}


def boundaries(text: str) -> dict[int, int]:
    """The strength of each natural boundary from sentences on, by character position.

    Sentences and sections inside code don't count, paragraphs there count as lines.
    """
    spans = [m.span() for m in _CODE_SPAN.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    found: dict[int, int] = {}

    def note(at: int, level: int) -> None:
        if 0 < at < len(text) and found.get(at, CHARACTER) < level:
            found[at] = level

    for level, mark in _MARKS:
        for m in mark.finditer(text):
            at = m.start() if m[0] in _STARTS else m.end()
            k = bisect_right(starts, at) - 1
            inside = k >= 0 and starts[k] < at < ends[k]
            if inside and level in (SECTION, SENTENCE):
                continue
            note(at, min(level, LINE) if inside else level)
    for a, b in spans:
        note(a, CODE)
        note(b, CODE)
    return found


class Splitter:
    """Cuts one text at a time; sizes are those of the pieces when they are encoded by themselves."""

    def __init__(self, encoder: CorpusEncoder, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap must be under half of the limit")
        self.encoder, self.limit, self.overlap = encoder, limit, overlap

    def split(self, text: str, ids: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """Pieces as start, start of what is new, end, tokens, tokens of the overlap, and strength of the boundary at the end."""
        self._total = len(ids)
        if self._total <= self.limit:
            return [(0, 0, len(text), self._total, 0, SECTION)]
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self._first_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        last_byte = np.cumsum(self.encoder.table.n_bytes[ids])
        # tokens that end at or before each character position
        self._tokens_at = np.searchsorted(last_byte, self._first_byte, "right")
        whole = np.searchsorted(self._first_byte, last_byte)
        self._whole = whole[self._first_byte[whole] == last_byte][:-1]  # places between tokens and characters
        self._marks = boundaries(text)
        self._places = sorted(self._marks)
        pieces, start, cut, repeated = [], 0, 0, 0
        while True:
            end, size, level = self._next(text, start, cut, repeated)
            pieces.append((start, cut, end, size, repeated, level))
            if end == len(text):
                return pieces
            cut = end
            start, repeated = self._overlap(text, cut, start)

    def _next(self, text: str, start: int, cut: int, repeated: int) -> tuple[int, int, int]:
        """End, tokens and boundary of the piece that repeats from ``start`` and adds from ``cut``.

        What is left is taken in the fewest pieces of equal size that could hold it. The first of these targets goes to the
        strongest boundary near that keeps the limit. If that leaves more than the other pieces can hold, the next
        call finds one piece more and places its targets anew.
        """
        tokens_at, adds = self._tokens_at, self.limit - self.overlap
        done = int(tokens_at[cut])
        left, room = self._total - done, self.limit - repeated
        # cuts inside words change counts by a few tokens, so what seems slightly too much is counted
        if left <= room + 8 and (size := self.encoder.count(text[start:])) <= self.limit:
            return len(text), size, SECTION
        n = 1 + max(1, -(-(left - room) // adds))
        goal = done + (left + repeated + (n - 1) * self.overlap) / n - repeated
        reach = min(self.limit / 8, (goal - done) / 3)
        top = min(goal + reach, done + room)  # where the limit cuts the range off above, it goes farther down
        near = self._span(top - 2 * reach, top, cut, text)
        far = self._span(self._total - (n - 1) * adds, done + room, cut, text)
        # places so far back that a piece is added come last
        for low, high in (near, far, self._span(done + adds / 4, done + room, cut, text), self._span(done + 1, done + room, cut, text)):
            strong = {p: self._marks[p] for p in self._places[bisect_left(self._places, low) : bisect_right(self._places, high)]}
            for options in (strong, weak_boundaries(text, low, high)):
                for at in sorted(options, key=lambda p: (-options[p], abs(tokens_at[p] - goal), p)):
                    if (size := self.encoder.count(text[start:at])) <= self.limit:
                        return at, size, options[at]
        # nothing natural: between whole tokens, or else whole characters, the nearest to the target that keeps the limit
        k = int(np.searchsorted(self._whole, np.searchsorted(tokens_at, math.floor(goal), "left"), "right"))
        for at in chain(self._whole[:k][::-1].tolist(), range(int(np.searchsorted(tokens_at, math.ceil(goal), "left")), cut, -1)):
            if cut < at < len(text) and (size := self.encoder.count(text[start:at])) <= self.limit:
                return at, size, CHARACTER
            if at <= cut:
                break
        end = cut + 1
        return end, self.encoder.count(text[start:end]), CHARACTER if end < len(text) else SECTION

    def _span(self, least: float, most: float, cut: int, text: str) -> tuple[int, int]:
        """First and last place after ``cut`` with a number of tokens before it."""
        # whole numbers, as a search for a fraction would first copy the array
        low = int(np.searchsorted(self._tokens_at, math.ceil(least), "left"))
        high = int(np.searchsorted(self._tokens_at, math.floor(most), "right"))
        return max(low, cut + 1), min(high, len(text)) - 1

    def _overlap(self, text: str, cut: int, least: int) -> tuple[int, int]:
        """Where the repeated end of the piece before ``cut`` starts, and its tokens: the most that don't exceed the overlap.

        The search starts at the character where the text's own encoding has ``overlap`` tokens left,
        and goes on to both sides as far as a start could still be better: a later one by its bytes, as
        they are as many tokens at most, an earlier one by the fewest tokens that could give its bytes.
        """
        if not self.overlap:
            return cut, 0
        at = max(int(np.searchsorted(self._tokens_at, self._tokens_at[cut] - self.overlap, "left")), least)
        best, most = cut, 0
        for start in chain(self._order(at, least, cut), self._farther(text, at, least, cut)):
            if self._first_byte[cut] - self._first_byte[start] <= most:
                continue
            n = self.encoder.count(text[start:cut])
            if most < n <= self.overlap:
                best, most = start, n
                if n == self.overlap:
                    break
        return best, most

    @staticmethod
    def _order(at: int, least: int, cut: int) -> Iterator[int]:
        """Starts up to ``REACH`` characters from ``at``, the nearest first."""
        yield at
        for d in range(1, REACH + 1):
            if at - d >= least:
                yield at - d
            if at + d < cut:
                yield at + d

    def _farther(self, text: str, at: int, least: int, cut: int) -> Iterator[int]:
        """All farther starts that the overlap may still fit, the nearest first."""
        tokens, longest = self.encoder.table.tokens, self.encoder.table.longest
        data = text[max(least, cut - self.overlap * longest) : cut].encode("utf-8", "surrogatepass")
        fewest = [0]  # tokens that could give the last bytes, by their number
        starts, start, longest_from = [], cut, self.encoder.table.longest_from
        for k in range(len(data) - 1, -1, -1):
            reach = min(longest_from.get(data[k : k + 2], 1), len(fewest))
            fewest.append(1 + min(fewest[-m] for m in range(1, reach + 1) if m == 1 or data[k : k + m] in tokens))
            if data[k] & 0xC0 != 0x80:  # a character begins here
                start -= 1
                if fewest[-1] <= self.overlap and abs(start - at) > REACH:
                    starts.append(start)
            if k % 16 == 0 and min(fewest[-longest:]) > self.overlap:
                break
        yield from sorted(starts, key=lambda s: abs(s - at))


def split_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, keep_small: bool = False,
    tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Ordered pieces of at most ``limit`` tokens for each text of more than ``limit`` tokens.

    ``piece`` is ``text[start_char:end_char]`` in characters; what it adds begins at ``body_char``,
    and the bodies of a document's pieces put together are its text. Before that stands the repeated
    end of the piece before, of ``overlap_tokens``: as many tokens up to ``overlap`` as whole characters
    allow. Sizes are the tokens of a piece encoded by itself. ``boundary`` is the kind of place at which
    the piece ends (``section`` also at the text's end).

    The least number of pieces is computed, equal targets are placed, and the first is moved to the strongest
    boundary in a range of a quarter of the limit around it that keeps the piece within it (the nearest of equally strong ones),
    without any to one farther off where the same number of pieces still does, or to any other that does, or without
    these to the nearest whole token or character. For the rest the same is done again, so a piece is added where what is left
    outgrows the pieces meant for it, and the time grows with the text's length. A piece of one character may exceed a limit that is
    below the character's own tokens.

    Texts within the limit, null and empty ones give no rows, or with ``keep_small`` one piece each (none
    for null). Repeated rows are cut each; an empty table gives no rows; other columns are pruned. A task
    cuts its own rows, and nothing is shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(f"{tokenizers}/{vocabulary}")
        splitter = Splitter(encoder, limit, overlap)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int32()), ("body_char", pa.int32()),
             ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("boundary", pa.string()), ("piece", pa.string())]
        )
        for chunk in chunks(batches, 1):
            keys, texts = chunk.column(0).to_pylist(), chunk.column(1).to_pylist()
            rows: list[tuple] = []
            found = encoder.words(texts)
            for key, own, words, total in zip(keys, texts, found, encoder.totals(found), strict=True):
                if own is None or total <= limit and not keep_small:
                    continue
                ids = encoder.gather(words)
                pieces = splitter.split(own, ids)
                for k, (start, body, end, n, repeated, level) in enumerate(pieces):
                    rows.append((key, k, len(pieces), start, body, end, n, repeated, LEVELS[level], own[start:end]))
                if len(rows) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    columns = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    if not keep_small:  # a token is a byte at least, so a shorter text can't exceed the limit
        columns = columns.where(F.octet_length("text") > limit)
    return columns.mapInArrow(cut, SCHEMA)

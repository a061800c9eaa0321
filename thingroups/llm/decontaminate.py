"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a bounded run of documents. Its words are numbered by the words of the
benchmark; stretches in which every pair of neighbouring words also stands side by
side in the benchmark are the only ones in which a phrase can occur, and they are
joined, with separators, to the shard's text. Its suffix array gives the
Burrows-Wheeler transform, which is kept as a wavelet tree. Every phrase is then
searched backwards, last word first, by ranks in the tree; phrases that occur are
located by walking to the next sampled suffix position. Occurrences mark words,
and neighbouring marked words are merged to removal spans.

A phrase is a window of ``width`` consecutive words of an item; an item with
fewer words, but not none, is one phrase. Words are runs of ASCII letters and
digits and of all other characters above U+007F, with A-Z lower-cased.

Edge cases: NULL and empty texts have no words, no spans, and are not
contaminated; items without words or with a NULL id or text are left out of the
phrases (a NULL id cannot be reported); repeated items with one id count once;
texts of any length are taken whole; repeated documents are searched each; an
empty benchmark hits nothing, an empty document table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches

#: Benchmark text that is broadcast at a time. A larger benchmark goes in blocks.
BLOCK_BYTES = 16_000_000
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 2_000_000
#: Every so many text positions one suffix position is kept.
SAMPLED = 16

_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LETTERS).split() if text else []


class WaveletTree:
    """Ranks in a sequence of small numbers: a level of bits for each binary digit."""

    def __init__(self, values: np.ndarray, largest: int):
        self.digits = max(1, int(largest).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        for digit in range(self.digits - 1, -1, -1):
            bits = (values >> digit) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.levels.append((ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start = np.zeros_like(places)
        for (ones, zeros), digit in zip(self.levels, range(self.digits - 1, -1, -1), strict=True):
            bit = (symbols >> digit) & 1
            low, high = ones[start], ones[places]
            start = np.where(bit == 1, zeros + low, start - low)
            places = np.where(bit == 1, zeros + high, places - high)
        return places - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks of the first n, 2n, 4n, ... symbols until all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
    width = 1
    while n and rank[order[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        width *= 2
    return order


class FMIndex:
    """Backward search and location in a sequence of numbers from 1; 0 only ends it."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.searchsorted(np.sort(text), np.arange(largest + 2))
        self.tree = WaveletTree(self.last, largest)
        sampled = order % SAMPLED == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled = sampled
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase (rows of equal length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for column in phrases.T[::-1]:
            low = self.before[column] + self.tree.rank(column, low)
            high = self.before[column] + self.tree.rank(column, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one is met."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            symbols = self.last[rows[open_]]
            rows[open_] = self.before[symbols] + self.tree.rank(symbols, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.positions[self.sampled_before[rows]] + steps


class Phrases:
    """The windows of a block of items, by length, over the block's own numbering of words."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            pairs.update(zip(ids, ids[1:]))
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                known = windows.setdefault(tuple(ids[i : i + width]), set())
                if item is not None:  # words are hit, but there is no item to name
                    known.add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[set[str]]]] = {}
        for n in sorted({len(w) for w in windows}):
            chosen = sorted(w for w in windows if len(w) == n)
            self.by_length[n] = (np.array(chosen, np.int64), [windows[w] for w in chosen])
        self.separator = len(self.numbers) + 1
        self.known_pairs = np.zeros(1 << 22, bool)
        if pairs:
            both = np.array(sorted(pairs), np.int64)
            self.known_pairs[self._slot(both[:, 0], both[:, 1])] = True

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first * 1_000_003 + second * 7_919) & (len(self.known_pairs) - 1)

    def stretches(self, ids: np.ndarray) -> np.ndarray:
        """Positions of words that can belong to an occurrence; two words that were
        told apart wrongly only make the shard's text longer."""
        shortest = min(self.by_length, default=0)
        if not shortest or not len(ids):
            return np.zeros(0, np.int64)
        linked = (ids[:-1] > 0) & (ids[1:] > 0) & self.known_pairs[self._slot(ids[:-1], ids[1:])]
        edge = np.flatnonzero(np.concatenate([[True], ~linked, [True]]))
        starts, ends = edge[:-1], edge[1:]
        keep = (ends - starts >= shortest) & (ids[starts] > 0)
        marks = np.zeros(len(ids) + 1, np.int32)
        np.add.at(marks, starts[keep], 1)
        np.add.at(marks, ends[keep], -1)
        return np.flatnonzero(np.cumsum(marks[:-1]))

    def find(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[set[str]], np.ndarray]]:
        """For each phrase length: text positions, the length, items, and the phrase of each position."""
        places = self.stretches(ids)
        if not len(places):
            return
        breaks = np.flatnonzero(np.diff(places) > 1) + 1
        text = np.insert(ids[places], breaks, self.separator)
        origin = np.insert(places, breaks, -1)
        index = FMIndex(text, self.separator)
        for n, (phrases, items) in self.by_length.items():
            low, high = index.search(phrases)
            found = high - low
            if found.any():
                rows = np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
                yield origin[index.locate(rows)], n, items, np.repeat(np.arange(len(phrases)), found)


def _shard(blocks: list[Phrases], lists: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
    """Marked words and occurring items of each document of a shard."""
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    marks = np.zeros(total + 1, np.int64)
    hits: list[set[str]] = [set() for _ in lists]
    for block in blocks:
        ids = np.zeros(total, np.int64)
        number = block.numbers.get
        for start, tokens in zip(starts.tolist(), lists, strict=True):
            ids[start : start + len(tokens)] = [number(t, 0) for t in tokens]
        for positions, n, items, phrase in block.find(ids):
            np.add.at(marks, positions, 1)
            np.add.at(marks, positions + n, -1)
            owner = np.searchsorted(starts, positions, side="right") - 1
            for pair in np.unique(owner * len(items) + phrase).tolist():
                hits[pair // len(items)] |= items[pair % len(items)]
    covered = np.cumsum(marks) > 0
    return [covered[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)], hits


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans from the first to the last of neighbouring marked words."""
    if not hit.any():
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """The items, streamed through the driver in bounded blocks and broadcast."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    sc, out, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"])
        if size >= block_bytes:
            out.append(sc.broadcast(block))
            block, size = [], 0
    return out + ([sc.broadcast(block)] if block else [])


def find_overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    width: int = 13,
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per document: the columns ``keep``, n_words, n_hit, items (sorted ids with an
    occurring phrase) and spans (characters to remove: start, end exclusive)."""
    blocks, columns = _blocks(benchmark, block_bytes), list(dict.fromkeys([*keep, "text"]))
    kinds = dict(documents.dtypes)
    schema = ", ".join(
        [f"`{k}` {kinds[k]}" for k in keep]
        + ["n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"]
    )

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        phrases = [Phrases(b.value, width) for b in blocks]
        for arrays in batches:
            texts, first = arrays[columns.index("text")].to_pylist(), 0
            while first < len(texts):
                lists, total, end = [], 0, first
                while end < len(texts) and (end == first or total < shard_words):
                    lists.append(words(texts[end]))
                    total += len(lists[-1])
                    end += 1
                marked, hits = _shard(phrases, lists)
                kept = {k: a.slice(first, end - first) for k, a in zip(columns, arrays, strict=True)}
                yield kept | {
                    "n_words": [len(x) for x in lists],
                    "n_hit": [int(m.sum()) for m in marked],
                    "items": [sorted(h) for h in hits],
                    "spans": [
                        [{"start": a, "end": b} for a, b in _spans(t, m)]
                        for t, m in zip(texts[first:end], marked, strict=True)
                    ],
                }
                first = end

    return map_batches(documents, columns, work, schema, arrow_in=True)


def contaminated(share: int = 20) -> Column:
    """At least one word is hit, and at least one in ``share``."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The counts, the digest of the item ids and the verdict for each document."""
    return find_overlaps(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )

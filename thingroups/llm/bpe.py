"""Byte-level BPE: exact encoding in linear time, and decoding.

Bytes are mapped to Latin-1 characters, so that an automaton over the vocabulary
finds the longest token that starts at a place. The encoder takes it, and goes
back to shorter ones where a token cannot follow its neighbour. Two tokens may be neighbours if the merges, applied to the bytes
of both, give these two tokens again; that answer is kept. The encoding of a
prefix is unique, so a place that was given up is never tried again, and the
work is linear in the length of the piece. The short pieces that a run of texts
brings anew take these steps side by side, as arrays with one entry a piece.

Edge cases: NULL and empty texts give no tokens; texts of any length are
encoded whole; rows with equal ids or texts are encoded each; an empty table
gives an empty table; columns beside the named ones are not looked at.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches

#: Pieces that a worker remembers, and as many older ones; neighbour pairs, beyond which it starts anew.
REMEMBERED_PIECES = 150_000
REMEMBERED_PAIRS = 120_000
#: Characters of texts whose pieces are looked at together, if they are more than one text.
CHARACTERS_AT_ONCE = 1_000_000
#: Bytes of a piece that is encoded side by side with others; longer ones are encoded one by one.
SIDE_BY_SIDE = 64
#: Answers about neighbours that are kept for these, a power of two.
KEPT_ANSWERS = 1 << 20
_NEVER = 2**31 - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}


class Neighbours:
    """Which tokens the merges can produce, and which can stand side by side.

    A token is made by merges inside it, each at its rank. Along the border of two
    tokens, the part of either that touches the border grows with these merges; two
    parts that touch at the same time and could be merged before either grows on
    would be merged across the border, and then the tokens are no neighbours.
    """

    def __init__(self, rank: Callable[[bytes, bytes], int | None], halves: dict[bytes, tuple[bytes, bytes] | None] | None = None):
        self._rank = rank
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {} if halves is None else halves
        self._borders: tuple[dict, dict] = ({}, {})

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes a token; None if no merges do."""
        if token not in self._halves:
            parts = [bytes([b]) for b in token]
            last = None
            while len(parts) > 1:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self._rank(parts[i], parts[i + 1])) is not None]
                if not ranked:
                    break
                _, i = min(ranked)
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = last if len(parts) == 1 else None
        return self._halves[token]

    def whole(self, token: bytes) -> bool:
        """Whether the merges make this token from its bytes."""
        return len(token) == 1 or self.halves(token) is not None

    def border(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts that touch the border, from one byte up, each with the rank at
        which it grows on. ``side``: 1 for the end of the left token, 0 for the start
        of the right one."""
        known = self._borders[side].get(token)
        if known is None:
            known = [(token, float("inf"))]
            while len(known[-1][0]) > 1:
                both = self.halves(known[-1][0])
                known.append((both[side], self._rank(*both)))
            known = self._borders[side][token] = known[::-1]
        return known

    def fit(self, left: bytes, right: bytes) -> bool:
        ends, starts = self.border(left, 1), self.border(right, 0)
        i = j = 0
        while True:
            (end, end_grows), (start, start_grows) = ends[i], starts[j]
            across = self._rank(end, start)
            if across is not None and across < end_grows and across <= start_grows:
                return False
            if i == len(ends) - 1 and j == len(starts) - 1:
                return True
            if end_grows <= start_grows:
                i += 1
            else:
                j += 1


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """A place below ``size``, a power of two, for each key: the high bits of a product that all bits of the key reach."""
    return (keys * -7046029254386353131 >> 65 - size.bit_length()) & (size - 1)


class Numbers:
    """Whole numbers by whole-number keys, looked up many at a time."""

    def __init__(self, keys: list[int], values: list[int], absent: int):
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        size = 1 << max(8, (4 * len(keys)).bit_length())
        # a table that is at most a quarter full: neighbouring places take what its own place cannot
        self._mask, self._keys, self._values = size - 1, np.full(size, -1), np.full(size, absent, np.int32)
        left, slots = np.arange(len(keys)), _places(keys, size)
        while len(left):
            free = self._keys[slots] < 0
            self._keys[slots[free]] = keys[left[free]]
            placed = self._keys[slots] == keys[left]
            self._values[slots[placed]] = values[left[placed]]
            left, slots = left[~placed], (slots[~placed] + 1) & self._mask

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slots = _places(keys, self._mask + 1)
        there = self._keys[slots]
        found = self._values[slots]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & self._mask
            there = self._keys[slots]
            found[todo] = self._values[slots]
            more = (there != keys[todo]) & (there >= 0)
            todo, slots = todo[more], slots[more]
        return found


class SideBySide:
    """The steps of ``PieceEncoder.encode`` for many pieces at once, one array entry a piece.

    Tokens are numbered in sorted order here. The token that starts at a byte of the joined
    pieces and the place that its predecessor starts at stand in arrays over these bytes.
    """

    def __init__(self, ranks: dict[bytes, int], neighbours: Neighbours, whole: list[bytes], best: dict[str, int], shorter: dict):
        parts = whole + [b for b in (bytes([i]) for i in range(256)) if b not in ranks]
        number = {token: n for n, token in enumerate(parts)}
        by_id = {ranks[token]: n for n, token in enumerate(whole)} | {None: -1}
        self._ids = [ranks[token] for token in whole]
        self._size = np.array([len(token) for token in whole], np.int32)
        self._shorter = np.array([by_id[shorter[ranks[token]]] for token in whole], np.int32)
        node = {"": 0} | {prefix: n for n, prefix in enumerate(best, 1)}
        self._best = np.array([-1] + [by_id[i] for i in best.values()], np.int32)
        self._next = Numbers([node[p[:-1]] << 8 | ord(p[-1]) for p in best], list(range(1, len(node))), -1)
        cuts = [(number.get(t[:k]), number.get(t[k:]), r) for t, r in ranks.items() for k in range(1, len(t))]
        cuts = [(a, b, r) for a, b, r in cuts if a is not None and b is not None]
        self._across = Numbers([a << 32 | b for a, b, _ in cuts], [r for *_, r in cuts], _NEVER)
        self._known = np.empty(0, np.int64)  # made where it is used
        self._borders = []
        for side in (1, 0):
            chains = [neighbours.border(token, side) for token in whole]
            first = np.cumsum([0] + [len(c) for c in chains])[:-1]
            part = np.array([number[p] for c in chains for p, _ in c], np.int64)
            grows = np.array([_NEVER if g == float("inf") else g for c in chains for _, g in c], np.int32)
            self._borders.append((first, part, grows))

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Answers are kept at a place that the pair gives, until another pair takes it."""
        if not len(self._known):
            self._known = np.full(KEPT_ANSWERS, -1)
        pairs = left << 32 | right
        slots = _places(pairs, KEPT_ANSWERS)
        known = self._known[slots]
        fit, new = (known & 1).astype(bool), np.flatnonzero(known >> 1 != pairs)
        fit[new] = self._tested(left[new], right[new])
        self._known[slots[new]] = pairs[new] << 1 | fit[new]
        return fit

    def _tested(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        (first_end, ends, end_grows), (first_start, starts, start_grows) = self._borders
        i, j, fit, todo = first_end[left], first_start[right], np.ones(len(left), bool), np.arange(len(left))
        while len(todo):
            of_end, of_start = end_grows[i], start_grows[j]
            across = self._across[ends[i] << 32 | starts[j]]
            bad = (across < of_end) & (across <= of_start)
            fit[todo[bad]] = False
            on = ~bad & (np.minimum(of_end, of_start) < _NEVER)
            by_end = (of_end <= of_start)[on]
            i, j, todo = i[on] + by_end, j[on] + ~by_end, todo[on]
        return fit

    def _longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        reached, node, todo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        while len(todo):
            node = self._next[node << 8 | data[at]].astype(np.int64)
            on = node >= 0
            reached[todo[on]] = node[on]
            on &= at + 1 < end
            node, todo, at, end = node[on], todo[on], at[on] + 1, end[on]
        return self._best[reached]

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Pieces of one byte at least."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum([len(piece) for piece in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        chosen, came, given_up = np.full(len(data) + 1, -1), np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, bool)
        start, end, at, last = starts, ends, starts.copy(), np.full(len(starts), -1)
        token = self._longest(data, at, end).astype(np.int64)
        while len(at):
            back = np.flatnonzero(token < 0)
            if len(back):
                if (at[back] == start[back]).any():
                    raise ValueError("the vocabulary lacks a byte of the text")
                given_up[at[back]] = True
                at[back] = before = came[at[back]]
                token[back] = self._shorter[chosen[before]]
                chosen[before] = -1
                last[back] = np.where(before == start[back], -1, chosen[came[before]])
                continue
            to = at + self._size[token]
            takes = ~given_up[to]
            asked = np.flatnonzero(takes & (last >= 0))
            takes[asked] = self._fit(last[asked], token[asked])
            token[~takes] = self._shorter[token[~takes]]
            taken = np.flatnonzero(takes)
            chosen[at[taken]] = last[taken] = token[taken]
            came[to[taken]] = at[taken]
            at[taken] = to[taken]
            taken = taken[at[taken] < end[taken]]
            token[taken] = self._longest(data, at[taken], end[taken])
            if len(goes := np.flatnonzero(at < end)) < len(at):
                start, end, at, last, token = start[goes], end[goes], at[goes], last[goes], token[goes]
        places = np.flatnonzero(chosen >= 0)
        ids = list(map(self._ids.__getitem__, chosen[places].tolist()))
        cuts = np.searchsorted(places, ends).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class PieceEncoder(dict):
    """Piece of text -> ids of its tokens; a dictionary that fills itself.

    Tokens are Latin-1 texts here. ``_best`` has, for each way into the automaton,
    the longest token on it, and ``_shorter`` the next shorter one at the same place.
    Two of one vocabulary can share their ``tables``.
    """

    def __init__(self, ranks: dict[bytes, int], halves: dict | None = None, side_by_side: SideBySide | None = None):
        super().__init__()
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.neighbours = Neighbours(lambda a, b: ranks.get(a + b), halves)
        self._older: dict[str, tuple[int, ...]] = {}
        self._size = {i: len(token) for token, i in ranks.items()}
        self._shorter: dict[int, int | None] = {}
        self._best: dict[str, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._widest = max(map(len, ranks), default=0)
        self._automaton = ahocorasick.Automaton()
        self._side_by_side = side_by_side
        if side_by_side is None:
            self.build()

    def build(self) -> None:
        """What the steps for single pieces need; with the tables of ``side_by_side`` given, a long piece asks for it."""
        whole = sorted(filter(self.neighbours.whole, self.ranks))
        for token in whole:
            latin = token.decode("latin-1")
            self._automaton.add_word(latin, self.ranks[token])
            for n in range(1, len(latin)):
                self._best.setdefault(latin[:n], self._best.get(latin[: n - 1]))
            self._shorter[self.ranks[token]] = self._best.get(latin[:-1])
            self._best[latin] = self.ranks[token]
        if self._side_by_side is None:
            self._side_by_side = SideBySide(self.ranks, self.neighbours, whole, self._best, self._shorter)

    def tables(self) -> tuple[dict, SideBySide]:
        """What another encoder of these ranks can be made with at little cost."""
        return {token: self.neighbours.halves(token) for token in self.ranks if len(token) > 1}, self._side_by_side

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of these pieces, the short ones among them encoded side by side."""
        new = pieces.difference(self)
        if len(self) + len(new) > REMEMBERED_PIECES:
            self._older, new = dict(self), pieces
            self.clear()
        unknown = list(new.difference(self._older))
        self.update((piece, self._older[piece]) for piece in new.intersection(self._older))
        data = list(map(str.encode, unknown))
        short = [i for i, n in enumerate(map(len, data)) if 0 < n <= SIDE_BY_SIDE]
        self.update(zip([unknown[i] for i in short], self._side_by_side.encode([data[i] for i in short]), strict=True))
        self.update((piece, (self.ranks[d],)) for piece, d in zip(unknown, data, strict=True) if d in self.ranks)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= 2 * REMEMBERED_PIECES:
            self.clear()
        ids = self[piece] = self.encode(piece.encode("utf-8"))
        return ids

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ranks:
            return (self.ranks[piece],)
        if not self._best:
            self.build()
        latin, longest, widest = piece.decode("latin-1"), self._automaton.longest_prefix, self._widest
        best, shorter, sizes, fits = self._best, self._shorter, self._size, self._fits
        given_up: set[int] = set()
        chosen: list[int] = []
        at, last, end = 0, None, len(latin)
        token = best.get(latin[: longest(latin[:widest])])
        while at < end:
            while token is not None and not (
                at + sizes[token] not in given_up
                and (last is None or (self._fit(last, token) if (known := fits.get((last, token))) is None else known))
            ):
                token = shorter[token]
            if token is not None:
                chosen.append(token)
                last = token
                at += sizes[token]
                token = best.get(latin[at : at + longest(latin[at : at + widest])])
            elif chosen:
                given_up.add(at)
                at -= sizes[last]
                token = shorter[chosen.pop()]
                last = chosen[-1] if chosen else None
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return tuple(chosen)

    def _fit(self, left: int, right: int) -> bool:
        if len(self._fits) >= REMEMBERED_PAIRS:
            self._fits.clear()
        known = self._fits[left, right] = self.neighbours.fit(self.tokens[left], self.tokens[right])
        return known


def load_vocabulary(df: DataFrame, path: str, tables: bool = False):
    """Vocabulary files hold a few 10,000 tokens; the driver reads the file once, and with
    ``tables`` works out once what all tasks need to encode with it."""
    with open(path, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((data, *PieceEncoder(read_ranks(data)).tables()) if tables else data)


@contextmanager
def without_cycle_search() -> Iterator[None]:
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of bounded length; one text is never cut."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > CHARACTERS_AT_ONCE:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(text or "")
    yield texts[begin:]


def _token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return tokens


def _joined_tokens(lists: pa.ListArray, tokens: list[bytes]) -> list[bytes]:
    flat, ends = lists.values.to_numpy(), lists.offsets.to_pylist()  # both know where a slice begins
    return [b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", keys: Iterable[str] = ("doc_id",), decoded: str | None = None
) -> DataFrame:
    """``keys`` and ``ids array<int>``: the tokens of each whole text.

    ``path`` is a rank file, ``pattern`` splits a text into the pieces that are
    encoded one by one. With ``decoded``, the ids are decoded again in the same pass, by the
    same worker, into a binary column of that name.
    """
    keys = list(keys)
    vocabulary = load_vocabulary(df, path, tables=True)

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        data, *tables = vocabulary.value
        pieces, ranks = regex.compile(pattern), read_ranks(data)
        known = PieceEncoder(ranks, *tables)  # goes with the task: workers outlive it
        tokens = _token_bytes(ranks) if decoded else []
        for *key_columns, texts in batches:
            ids, ends = array("i"), [0]
            for run in _runs(texts.to_pylist()):
                with without_cycle_search():  # many small objects, no cycles
                    found = [pieces.findall(text) if text else [] for text in run]
                    known.learn(set(chain.from_iterable(found)))
                    for of_text in found:
                        ids.extend(chain.from_iterable(map(known.__getitem__, of_text)))
                        ends.append(len(ids))
            flat = pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            again = {decoded: _joined_tokens(lists, tokens)} if decoded else {}
            yield dict(zip(keys, key_columns, strict=True)) | {"ids": lists} | again

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["ids array<int>"] + [f"`{decoded}` binary"] * bool(decoded))
    return map_batches(df, [*keys, text], work, schema, arrow_in=True)


def decode(df: DataFrame, path: str, ids: str = "ids", output: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """Replace ``ids`` by the bytes of its tokens, or add them. NULL ids give no bytes."""
    keys = [c for c in df.columns if c != ids]
    vocabulary = load_vocabulary(df, path)

    def work(batches: Iterator[list]) -> Iterator[dict]:
        tokens = _token_bytes(read_ranks(vocabulary.value))
        for *key_columns, lists in batches:
            known = dict(zip(keys, key_columns, strict=True)) | {output: _joined_tokens(lists, tokens)}
            yield known | ({ids: lists} if keep_ids else {})

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{output}` binary"] + [f"`{ids}` array<int>"] * keep_ids)
    return map_batches(df, [*keys, ids], work, schema, arrow_in=True)


def id_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids, joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids again, and give the digests of both."""
    return encode(df, path, pattern, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        id_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

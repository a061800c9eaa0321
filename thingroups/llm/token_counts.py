"""Token counts by a finite-state transducer that is compiled while it runs.

The pre-tokenizer and the merges are one deterministic machine over bytes. A
state holds how far the current piece of text can still change: the kind of
piece, bytes of an unfinished character, and for the bytes that a longer token
could still cover, the last token and the count at each place. Each transition
says by how much the count of the text so far changes. States are found and
numbered as texts need them; then a transition is one look-up in a table, made
for thousands of chunks at once.

Texts are cut into chunks at any character, and all chunks run at once. A chunk has a map
from the states that may be live at its start to the state at its end and the change of the
count. Its first live state comes from a run over the few bytes before it, the second is where
its predecessor ended. Maps compose, and a prefix scan over the chunks of a text gives its
state and count at each chunk's end. Where the scan arrives in a state that is not among a
chunk's live ones, which takes a piece of text longer than a chunk, the chunk is run from
that state too and scanned again. So no chunk is run more than three times.

Edge cases: NULL and empty texts have no tokens; texts of any length are counted
whole; repeated rows are counted each; an empty table gives an empty table;
columns beside the named ones are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.llm.bpe import Neighbours
from thingroups.llm.common import map_batches

#: A table row has 256 transitions of 4 bytes: 128 MB at most for a worker. Beyond
#: that the machine keeps the states in use and finds the others again.
MOST_STATES = 131_072
CHUNK_BYTES = 2_048
#: Bytes before a chunk that are run for its first live state.
WARM_BYTES = 64
#: A packed transition: the next state times SHIFT, plus the change of the count and BIAS.
SHIFT, BIAS = 256, 128

START, SPACE, APOSTROPHE, HALF = "start", "space", "apostrophe", "half"
LETTER, NUMBER, OTHER = "letter", "number", "other"
_BEGIN = (START, None, "", b"")
_KINDS = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))
#: After an apostrophe at the start of a piece: endings of one letter, and first letters of those of two.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", {"r": "e", "v": "e", "l": "l"}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of a tokenizer file: byte-level BPE with the usual split."""

    def __init__(self, data: str):
        spec = json.loads(data)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is compiled")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {raw(t) for t in model["vocab"] if all(c in alphabet for c in t)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.tokens -= {s.encode() for s in self.specials}
        self.neighbours = Neighbours(lambda a, b: ranks.get((a, b)))
        self.openings = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self._partners: dict[bytes, list[tuple[bytes, int]]] = {}
        for (left, right), rank in ranks.items():
            self._partners.setdefault(left, []).append((right, rank))
        self._claims: dict[bytes, tuple] = {}
        self._begins: dict[bytes, dict[bytes, float] | None] = {}

    def claims(self, token: bytes) -> tuple:
        """Beginnings of a next token that would be merged with an end of this one, and
        the rank at which: (beginning, rank), .... A token whose beginning lasts to
        that rank cannot follow."""
        known = self._claims.get(token)
        if known is None:
            found: dict[bytes, int] = {}
            for end, grows in self.neighbours.border(token, 1):
                for right, rank in self._partners.get(end, ()):
                    if rank < grows:
                        found[right] = min(rank, found.get(right, rank))
            known = self._claims[token] = tuple(sorted(found.items()))
        return known

    def follows(self, token: bytes, claims: tuple) -> bool:
        """Whether this is a token of the merges that stands against such claims."""
        begins = self._begins.get(token, 0)
        if begins == 0:
            whole = token in self.tokens and self.neighbours.whole(token)
            begins = self._begins[token] = dict(self.neighbours.border(token, 0)) if whole else None
        return begins is not None and not any(rank <= begins.get(part, -1) for part, rank in claims)


class Transducer:
    """The compiled machine. A state is (mode, piece, held, part): what kind of
    piece is open, its merge state, a character held back, bytes of an unfinished one.

    A merge state is (tail, trail): the longest end of the piece that begins a
    longer token, and for each end of it that does, longest first: its length, what
    the last token before it claims of a token that begins there, and the count up to
    there less the present one.
    """

    def __init__(self, merges: Merges, most_states: int = MOST_STATES):
        self.merges, self.most = merges, most_states
        self._forget([])

    def _forget(self, keep: list) -> None:
        self.states: list = []
        self._narrow: dict = {}
        self.numbers: dict = {}
        self.table = np.full((1024, 256), -1, np.int32)
        self.rest = np.zeros(1024, np.int64)
        for state in [_BEGIN, *keep]:
            self.number(state)

    def number(self, state: tuple) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            if known >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.rest = np.concatenate([self.rest, np.zeros_like(self.rest)])
            self.rest[known] = self._held_back(state)
        return known

    # --- transitions, found once each ----------------------------------------

    def _feed(self, piece: tuple | None, data: bytes) -> tuple[tuple, int]:
        """The merge state after more bytes of the same piece, and the change of its count."""
        tail, trail = piece or (b"", ((0, (), 0),))
        follows, openings = self.merges.follows, self.merges.openings
        total = 0
        for i in range(len(data)):
            tail += data[i : i + 1]
            size = len(tail)
            for length, claims, count in trail:
                token = tail[size - length - 1 :]
                if follows(token, claims):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            change = count + 1
            grown = [
                (length + 1, claims and self._narrowed(claims, tail[size - length - 1 :]), count - change)
                for length, claims, count in trail
                if tail[size - length - 1 :] in openings
            ]
            trail = (*grown, (0, self.merges.claims(token), 0))
            tail = tail[size - trail[0][0] :]
            total += change
        return (tail, trail), total

    def _narrowed(self, claims: tuple, start: bytes) -> tuple:
        """The claims that can still concern a token with this start."""
        known = self._narrow.get((claims, start))
        if known is None:
            known = tuple(c for c in claims if c[0].startswith(start) or start.startswith(c[0]))
            self._narrow[claims, start] = known
        return known

    def _open(self, char: str, kind: str) -> tuple[tuple, int]:
        if kind == SPACE:
            return (SPACE, None, char, b""), 0
        piece, change = self._feed(None, char.encode())
        return (APOSTROPHE if char == "'" else kind, piece, "", b""), change

    def _character(self, mode: str, piece: tuple | None, held: str, char: str, kind: str) -> tuple[tuple, int]:
        if mode == SPACE and kind == SPACE:
            piece, change = self._feed(piece, held.encode())
            return (SPACE, piece, char, b""), change
        if mode == SPACE and held == " ":
            piece, change = self._feed(None, (held + char).encode())
            return (kind, piece, "", b""), change
        if mode == SPACE:
            _, change = self._feed(None, held.encode())
            state, more = self._open(char, kind)
            return state, change + more
        if mode == APOSTROPHE and char in SHORT_ENDINGS:
            return (START, None, "", b""), self._feed(piece, char.encode())[1]
        if mode == APOSTROPHE and char in LONG_ENDINGS:
            return (HALF, piece, char, b""), 0
        if mode == HALF and char == LONG_ENDINGS[held]:
            return (START, None, "", b""), self._feed(piece, (held + char).encode())[1]
        if mode == HALF:
            piece, change = self._feed(None, held.encode())
            state, more = self._character(LETTER, piece, "", char, kind)
            return state, change + more
        if kind == (OTHER if mode == APOSTROPHE else mode):
            piece, change = self._feed(piece, char.encode())
            return (kind, piece, "", b""), change
        return self._open(char, kind)

    def _held_back(self, state: tuple) -> int:
        """Tokens that a text which ends here still has to emit."""
        mode, piece, held, _ = state
        return self._feed(piece if mode == SPACE else None, held.encode())[1] if held else 0

    def step(self, number: int, byte: int) -> int:
        """Compile one transition; the packed entry."""
        mode, piece, held, part = self.states[number]
        part += bytes([byte])
        if len(part) < (1 if part[0] < 0x80 else 2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4):
            state, change = (mode, piece, held, part), 0
        else:
            char = part.decode()
            kind = next((k for k, chars in _KINDS if chars.match(char)), OTHER)
            state, change = self._character(mode, piece, held, char, kind)
        packed = self.number(state) * SHIFT + change + BIAS
        self.table[number, byte] = packed
        return packed

    # --- running it -----------------------------------------------------------

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, enter: list) -> tuple[np.ndarray, np.ndarray]:
        """The state in which each stretch ``data[start:end]`` ends, from the state it is
        entered in, and the change of the count; ends are valid until the next run."""
        order = np.argsort(starts - ends, kind="stable")
        at, left = starts[order].astype(np.int64), (ends - starts)[order]
        state = np.array([self.number(enter[i]) for i in order.tolist()], np.int64)
        counts = np.zeros(len(at), np.int64)
        lanes = len(at) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
        for i, n in enumerate(lanes):
            symbols = data[at[:n] + i]
            packed = self.table[state[:n], symbols]
            if packed.min() < 0:
                new = np.unique(state[:n][packed < 0] * 256 + symbols[packed < 0])
                if len(self.states) + len(new) > self.most:
                    used, state = np.unique(state, return_inverse=True)
                    kept = [self.states[s] for s in used]
                    self._forget(kept)
                    state = np.array([self.numbers[s] for s in kept], np.int64)[state]
                    new = np.unique(state[:n] * 256 + symbols)
                for x in new.tolist():
                    self.step(x // 256, x % 256)
                packed = self.table[state[:n], symbols]
            state[:n] = packed // SHIFT
            counts[:n] += packed % SHIFT - BIAS
        exits, changes = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        exits[order], changes[order] = state, counts
        return exits, changes

    def count(self, texts: list[str | None], chunk_bytes: int = CHUNK_BYTES, warm_bytes: int = WARM_BYTES) -> np.ndarray:
        """Tokens of each text; special tokens in it count as one each."""
        specials = regex.compile("|".join(map(regex.escape, self.merges.specials)) or r"(?!)")
        parts, owners, found = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [p.encode() for p in specials.split(text)] if text else []
            found[i] = max(0, len(pieces) - 1)
            pieces = [p for p in pieces if p]
            parts += pieces
            owners += [i] * len(pieces)
        if not parts:
            return found
        data = b"".join(parts)
        symbols = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        long = np.flatnonzero(ends - starts > chunk_bytes)
        cuts = [np.arange(starts[i] + chunk_bytes, ends[i], chunk_bytes) for i in long]
        cuts = _whole_characters(symbols, np.concatenate([starts, *cuts]))
        cuts = np.unique(np.append(cuts, ends[-1]))
        chunks = Chunks(self, data, symbols, cuts, np.isin(cuts[:-1], starts), warm_bytes)
        return found + np.bincount(np.array(owners, np.int64), chunks.totals(), len(texts)).astype(np.int64)


def _whole_characters(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places, moved back to where a character begins."""
    for _ in range(3):
        places = places - ((symbols[places] & 0xC0) == 0x80)
    return places


class Chunks:
    """Chunks of texts with their maps. ``cuts`` are the edges of all chunks, one behind the other;
    ``opens`` tells which chunks begin a text.

    Chunk i has up to SLOTS live states. ``to[i, k]`` is the place, among the live states of chunk
    i + 1, of the state that chunk i leads to from its k-th (-1: not among them), ``change[i, k]`` the
    change of the count. The last chunk of a text adds what its end state held back, and leads to place 0.
    """

    #: The state of the run before the chunk, the predecessor's end, and the one that the scan arrives in.
    SLOTS = 3

    def __init__(self, machine: Transducer, data: bytes, symbols: np.ndarray, cuts: np.ndarray, opens: np.ndarray, warm: int):
        self.machine, self.symbols = machine, symbols
        self.starts, self.ends, self.opens = cuts[:-1], cuts[1:], opens
        self.closes = np.append(opens[1:], True)
        n = len(opens)
        self.to = np.full((n, self.SLOTS), -1, np.int64)
        self.change = np.zeros((n, self.SLOTS), np.int64)
        self.live: list[list[tuple]] = [[] for _ in range(n)]
        self.exits: list[list[tuple]] = [[] for _ in range(n)]
        inner = np.flatnonzero(~opens)
        first = self.starts[np.flatnonzero(opens)[np.cumsum(opens) - 1]][inner]
        begin = _whole_characters(symbols, np.maximum(first, self.starts[inner] - warm))
        for j, (a, z, least) in enumerate(zip(begin.tolist(), self.starts[inner].tolist(), first.tolist(), strict=True)):
            if a > least:  # most likely every piece of text ends before a space
                begin[j] = max(a, data.find(b" ", a, z))
        guessed = [_BEGIN] * n
        warmed, _ = machine.run(symbols, begin, self.starts[inner], [_BEGIN] * len(inner))
        for i, state in zip(inner.tolist(), warmed.tolist(), strict=True):
            guessed[i] = machine.states[state]
        self._extend(np.arange(n), guessed)
        onward = [i for i in inner.tolist() if self.to[i - 1, 0] < 0]
        self._extend(np.array(onward, np.int64), [self.exits[i - 1][0] for i in onward])

    def _extend(self, chunks: np.ndarray, states: list[tuple]) -> None:
        """Extend the maps of the chunks by one live state each."""
        ends, changes = self.machine.run(self.symbols, self.starts[chunks], self.ends[chunks], states)
        held_back = self.machine.rest[ends]
        for j, (i, end) in enumerate(zip(chunks.tolist(), ends.tolist(), strict=True)):
            k = len(self.live[i])
            self.live[i].append(states[j])
            self.change[i, k] = changes[j] + (held_back[j] if self.closes[i] else 0)
            self.exits[i].append(_BEGIN if self.closes[i] else self.machine.states[end])
        for i in {j for i in chunks.tolist() for j in (i, i - 1) if j >= 0}:
            for k, state in enumerate(self.exits[i]):
                if self.closes[i]:
                    self.to[i, k] = 0
                elif state in self.live[i + 1]:
                    self.to[i, k] = self.live[i + 1].index(state)

    def _scan(self) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the place its end state has in the next one and the count from the
        beginning of its text; -1 from where the maps do not know the state."""
        to, change, reached = self.to.copy(), self.change.copy(), self.opens.copy()
        step = 1
        while not reached.all():
            # blocks that do not yet reach back to the beginning take in the block before them
            late = np.flatnonzero(~reached)
            middle = to[late - step]
            known = middle >= 0
            place = np.where(known, middle, 0)
            after = np.where(known, np.take_along_axis(to[late], place, 1), -1)
            total = change[late - step] + np.take_along_axis(change[late], place, 1)
            to[late], change[late], reached[late] = after, total, reached[late - step]
            step *= 2
        return to[:, 0], change[:, 0]

    def totals(self) -> np.ndarray:
        """Tokens of each text."""
        while True:
            places, counts = self._scan()
            lost = np.flatnonzero((places < 0) & np.append(True, self.opens[1:] | (places[:-1] >= 0)))
            if not len(lost):
                return counts[self.closes]
            # the chunk after is entered in a state that it has no map for
            entered = [0 if self.opens[i] else int(places[i - 1]) for i in lost.tolist()]
            self._extend(lost + 1, [self.exits[i][k] for i, k in zip(lost.tolist(), entered, strict=True)])


_machines: dict[int, Transducer] = {}


def count_tokens(df: DataFrame, path: str, text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keys``, ``n_bytes`` and ``n_tokens`` of each whole text, by a tokenizer file."""
    keys = list(keys)
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        key = hash(spec.value)
        if key not in _machines:
            _machines.clear()
            _machines[key] = Transducer(Merges(spec.value))
        for *key_columns, texts in batches:
            yield dict(zip(keys, key_columns, strict=True)) | {
                "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                "n_tokens": _machines[key].count(texts),
            }

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n_bytes long", "n_tokens long"])
    return map_batches(df, [*keys, text], work, schema)


def over_limit(df: DataFrame, path: str, limit: int) -> DataFrame:
    """Counts of every text, and whether it has more tokens than ``limit``."""
    return count_tokens(df, path).withColumn("over_limit", F.col("n_tokens") > limit)

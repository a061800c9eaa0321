"""Exact Jaccard join of word n-gram sets by blocked sparse products.

Each text becomes the set of hashes of its word n-grams. Equal sets are one row of
the incidence matrix. Two sets of n and m n-grams with a Jaccard index of t or more
share at least t * max(n, m) of them, and that bound discards rows in two steps:

* Of a set's smallest hashes, a head is taken that is so long that two linked heads
  share a known number of hashes. The incidence of heads goes in blocks (a run of
  documents by a range of hashes) to the hash ranges, where hashes of one set only
  fall away; the overlaps left are added up for each set. Sets below the bound have
  no partner. Few others stay. Hashes are shortened in this step, which can only keep
  a set that could go.
* For what stays, the frequency of each n-gram is counted in the same blocks. Linked
  sets share one of their rarest n - ceil(t * n) + 1 n-grams; sets that share one,
  directly or through others, form a cluster.

Inside a cluster, blocks of rows are multiplied: overlap counts of all pairs of two
blocks come from one product, and pairs below the bound are discarded. A large
cluster first multiplies one block with every other; block pairs whose rows are
then all connected need no product. A block pair gives a spanning forest of its
links, not the links.

Hashes have 64 bits, set keys 128. Words are runs of other characters than ASCII
white space, A-Z is lower-cased; a text with fewer words than n is one n-gram.

Edge cases: NULL texts and texts without words have an empty set, and are linked
with nothing; equal sets are linked whatever their text; repeated rows are answered
each; a NULL id takes part, but is never the name of a component unless all its
members' ids are NULL; texts are taken whole; empty tables give empty tables;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches, on_workers, stored
from thingroups.llm.components import Forest, components

NGRAM, PERCENT = 4, 85
#: Rows of a block in the products, and hashes of a range.
BLOCK_ROWS, RANGE_HASHES = 512, 3_000_000
#: Words that a worker remembers the hash of.
REMEMBERED = 250_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    tokens = text.encode().lower().split() if text else []
    return np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))


def shingle_sets(texts: list[str | None], n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams."""
    sets = []
    for text in texts:
        hashes = word_hashes(text)
        width = min(n, len(hashes))
        mixed = np.zeros(len(hashes) - width + 1 if width else 0, np.uint64)
        for i in range(width):
            mixed = (mixed ^ hashes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        if width < n:
            mixed ^= np.uint64(width)  # a short text differs from a longer one's n-gram
        sets.append(np.unique(mixed))
    return sets


def least_shared(n, percent: int):
    """No fewer n-grams are shared by a set of n and one that is linked with it."""
    return -(-n * percent // 100)


def head_length(n: int, percent: int) -> int:
    return min(n, n - least_shared(n, percent) + -(-n * (100 - percent) // 100))


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sets_of(documents: DataFrame, ngram: int, hashes: bool, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns ``also``, n, key and, if asked for, the hashes of each text's set."""
    kinds = dict(documents.dtypes)

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        for doc_ids, texts, *others in batches:
            for i in range(0, len(texts), 1_000):
                sets = shingle_sets(texts[i : i + 1_000], ngram)
                out = {
                    "doc_id": doc_ids[i : i + 1_000],
                    **{c: values[i : i + 1_000] for c, values in zip(also, others, strict=True)},
                    "n": [len(s) for s in sets],
                    "key": [_set_key(s) if len(s) else None for s in sets],
                }
                yield out | ({"hashes": [s.tobytes() for s in sets]} if hashes else {})
        _words.clear()  # workers outlive their tasks

    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in also), "n long, key binary"]) + ", hashes binary" * hashes
    return map_batches(rows, ["doc_id", "text", *also], work, schema)


def shortened(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """32-bit values for the hashes of each owner (ascending), different ones for different hashes.

    A value that its owner already has moves on to the next free one. What two owners share
    then fills places that both have, in whatever else they hold: their common values are
    never fewer than their common hashes, and only look more."""
    low = (hashes & np.uint64(2**32 - 2**20 - 1)).astype(np.int64) + (owner.astype(np.int64) << 33)
    order = np.argsort(low, kind="stable")
    place = np.arange(len(low))
    moved = np.maximum.accumulate(low[order] - place) + place
    out = np.empty(len(low), np.uint32)
    out[order] = (moved & (2**33 - 1)).astype(np.uint32)
    return out


def _cells(keys: list[bytes], lists: list[np.ndarray], ranges: int, key_bytes: int, kind: type) -> Iterator[dict]:
    """The incidence of a run of sets in blocks: for each range of hashes the keys that
    have some there, how many, and these. Keys and hashes may be shortened: what falls
    together then only makes overlaps look larger."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    hashes = np.concatenate([*lists, np.zeros(0, np.uint64)])
    part = (hashes >> np.uint64(33)) % np.uint64(ranges)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
    for p in range(ranges):
        here = order[edges[p] : edges[p + 1]]
        if len(here):
            own, counts = np.unique(owner[here], return_counts=True)
            yield {
                "range": [p],
                "keys": [b"".join([keys[i][:key_bytes] for i in own.tolist()])],
                "counts": [counts.astype(np.uint32).tobytes()],
                "hashes": [(shortened(hashes[here], owner[here]) if kind is np.uint32 else hashes[here]).tobytes()],
            }


_CELLS = "range int, keys binary, counts binary, hashes binary"


def _joined(block: pd.DataFrame, key_bytes: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One range: its keys, and the (key, hash) pairs in it, each once."""
    keys = np.frombuffer(b"".join(block["keys"]), f"V{key_bytes}")
    keys, place = np.unique(keys.view([(f"k{i}", ">u8") for i in range(key_bytes // 8)]), return_inverse=True)
    owner = np.repeat(place, np.frombuffer(b"".join(block["counts"]), np.uint32))
    hashes = np.frombuffer(b"".join(block["hashes"]), kind)
    order = np.lexsort((owner, hashes))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return keys, owner[new], hashes[new]


def _frequency(hashes: np.ndarray) -> np.ndarray:
    """How often each of the sorted hashes occurs."""
    edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
    return np.repeat(np.diff(edges), np.diff(edges))


def _homes(keys: np.ndarray, homes: int) -> np.ndarray:
    return ((keys["k0"] >> np.uint64(7)) % np.uint64(homes)).astype(np.int64)


def _parts(df: DataFrame, total_hashes: int) -> int:
    """Ranges of hashes: enough for the tasks, and of bounded size."""
    return max(1, -(-total_hashes // RANGE_HASHES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def possible(documents: DataFrame, ngram: int, percent: int, total_hashes: int) -> DataFrame:
    """``start`` (8 bytes of a key) and ``shared`` of sets with hashes in their heads that
    others have in theirs; sent back in one piece for each range and home of keys."""
    parts = _parts(documents, total_hashes)

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        for (texts,) in batches:
            for i in range(0, len(texts), 5_000):
                heads = {}
                for whole in shingle_sets(texts[i : i + 5_000], ngram):
                    if len(whole):
                        heads[_set_key(whole)] = whole[: head_length(len(whole), percent)]
                yield from _cells(list(heads), list(heads.values()), parts, 8, np.uint32)
        _words.clear()

    def overlaps(block: pd.DataFrame) -> pd.DataFrame:
        keys, owner, hashes = _joined(block, 8, np.uint32)
        shared = np.bincount(owner[_frequency(hashes) > 1], minlength=len(keys))
        some = np.flatnonzero(shared)
        home = _homes(keys[some], parts)
        lines = []
        for h in np.unique(home).tolist():
            mine = some[home == h]
            lines.append((h, keys[mine].tobytes(), shared[mine].astype(np.uint32).tobytes()))
        return pd.DataFrame(lines, columns=["home", "keys", "shared"])

    def add(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(block["keys"]), [("k0", ">u8")])
        keys, place = np.unique(keys, return_inverse=True)
        shared = np.bincount(place, np.frombuffer(b"".join(block["shared"]), np.uint32), len(keys))
        return pd.DataFrame({"start": [k.tobytes() for k in keys], "shared": shared.astype(np.int64)})

    cells = map_batches(documents, ["text"], work, _CELLS)
    found = cells.groupBy("range").applyInPandas(overlaps, "home int, keys binary, shared binary")
    return found.groupBy("home").applyInPandas(add, "start binary, shared long")


def rare_ngrams(sets: DataFrame, percent: int, total_hashes: int) -> DataFrame:
    """key and hash: those of a set's rarest n-grams that other sets have as well."""
    parts = _parts(sets, total_hashes)

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        for keys, blobs in batches:
            for i in range(0, len(keys), 2_000):
                lists = [np.frombuffer(b, np.uint64) for b in blobs[i : i + 2_000]]
                yield from _cells(keys[i : i + 2_000], lists, parts, 16, np.uint64)

    def frequencies(block: pd.DataFrame) -> pd.DataFrame:
        keys, owner, hashes = _joined(block, 16, np.uint64)
        times = np.minimum(_frequency(hashes), 65_535)  # the rest of the order is by hash
        keep = times > 1
        once = np.bincount(owner[~keep], minlength=len(keys))
        owner, hashes, times = owner[keep], hashes[keep], times[keep]
        home = _homes(keys, parts)
        order = np.lexsort((owner, home[owner]))
        owner, hashes, times = owner[order], hashes[order], times[order]
        lines = []
        for h in np.unique(home).tolist():
            mine = np.flatnonzero(home == h)
            a, b = np.searchsorted(home[owner], [h, h + 1])
            counts = np.bincount(np.searchsorted(mine, owner[a:b]), minlength=len(mine))
            lines.append((h, keys[mine].tobytes(), once[mine].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), times[a:b].astype(np.uint16).tobytes(), hashes[a:b].tobytes()))
        return pd.DataFrame(lines, columns=["home", "keys", "once", "counts", "times", "hashes"])

    def rarest(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(block["keys"]), [("k0", ">u8"), ("k1", ">u8")])
        once, counts = (np.frombuffer(b"".join(block[c]), np.uint32).astype(np.int64) for c in ("once", "counts"))
        keys, place = np.unique(keys, return_inverse=True)
        single = np.bincount(place, once, len(keys)).astype(np.int64)
        sizes = single + np.bincount(place, counts, len(keys)).astype(np.int64)
        owner = np.repeat(place, counts)
        times = np.frombuffer(b"".join(block["times"]), np.uint16)
        hashes = np.frombuffer(b"".join(block["hashes"]), np.uint64)
        order = np.lexsort((hashes, times, owner))
        owner, hashes = owner[order], hashes[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        room = sizes - least_shared(sizes, percent) + 1 - single
        keep = rank < room[owner]
        return pd.DataFrame({"key": [keys[i].tobytes() for i in owner[keep]], "hash": hashes[keep].view(np.int64)})

    cells = map_batches(sets, ["key", "hashes"], work, _CELLS)
    schema = "home int, keys binary, once binary, counts binary, times binary, hashes binary"
    found = cells.groupBy("range").applyInPandas(frequencies, schema)
    return found.groupBy("home").applyInPandas(rarest, "key binary, hash long")


def linked(keys: list[bytes], blobs: list[bytes], percent: int, own: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among some sets.

    The product runs over blocks of columns; ``own`` keeps pairs apart that another
    block pair has already multiplied: two rows of one mark are not compared."""
    lists = [np.frombuffer(b, np.uint64) for b in blobs]
    sizes = np.array([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), sizes)
    hashes, column = np.unique(np.concatenate(lists), return_inverse=True)
    common = np.bincount(column, minlength=len(hashes)) > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], number[column[keep]]
    width = int(common.sum())
    overlap = np.zeros((len(lists), len(lists)))  # counts, exact up to 2**53
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, width, 4_096):
        a, b = np.searchsorted(column, [start, start + 4_096])
        part = np.zeros((len(lists), min(4_096, width - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        overlap += part @ part.T
    both = sizes[:, None] + sizes[None, :] - overlap
    good = np.triu(overlap * 100 >= percent * both, 1)
    if own is not None:
        good &= own[:, None] != own[None, :]
    seen, out = Forest(), []
    for i, j in np.argwhere(good).tolist():
        if seen.join(i, j):
            out.append((keys[i], keys[j]))
    return out


def _products(tasks: DataFrame, percent: int, across: bool) -> DataFrame:
    """Links of each (cluster, first, second) group of rows (key, hashes, block)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        own = rows["block"].to_numpy() if across else None
        pairs = linked(rows["key"].tolist(), rows["hashes"].tolist(), percent, own)
        return pd.DataFrame(pairs, columns=["a", "b"])

    groups = on_workers(tasks).groupBy("cluster", "first", "second")
    return groups.applyInPandas(work, "a binary, b binary")


def links_of(sets: DataFrame, clusters: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) of keys, with the components of all links. ``clusters``: node, component."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    placed = (
        clusters.join(sizes, "component")
        .withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        .select(F.col("node").alias("key"), F.col("component").alias("cluster"), "block", "blocks")
    )
    rows = stored(sets.select("key", "hashes").join(placed, "key"), "rows")
    to_first = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    tasks = rows.select("key", "hashes", "cluster", "block", F.lit(0).alias("first"), F.explode(to_first).alias("second"))
    edges = stored(_products(tasks, percent, False), "links")
    large = rows.where("blocks > 2")
    if large.isEmpty():
        return edges
    named = large.select("key", "cluster", "block").join(components(edges).withColumnRenamed("node", "key"), "key", "left")
    marks = named.groupBy("cluster", "block").agg(
        F.min(F.coalesce("component", "key")).alias("low"), F.max(F.coalesce("component", "key")).alias("high")
    )
    marks = marks.where("block > 0")
    left, right = (marks.toDF("cluster", f"{s}_block", f"{s}_low", f"{s}_high") for s in ("l", "r"))
    pairs = left.join(right, "cluster").where(
        "l_block < r_block AND NOT (l_low = l_high AND r_low = r_high AND l_low = r_low)"
    )
    ends = pairs.select(
        "cluster", F.col("l_block").alias("first"), F.col("r_block").alias("second"), F.explode(F.array("l_block", "r_block")).alias("block")
    )
    more = _products(large.join(ends, ["cluster", "block"]).select(*tasks.columns), percent, True)
    return edges.unionByName(more)


def near_copies(documents: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each row.
    With columns in ``also`` these follow, and ``component``, which tells components of one
    id apart and is NULL for an empty set."""
    documents = documents.select("doc_id", "text", *also)
    rows = stored(sets_of(documents, ngram, False, also), "set-keys")
    total = rows.agg(F.sum("n")).first()[0] or 0
    named = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"))
    share = head_length(1_000, percent) / 1_000
    overlaps = possible(documents, ngram, percent, int(total * share)).withColumnRenamed("start", "from_start")
    smallest = F.ceil(F.col("n") * percent / 100)  # of the sets that it can be linked with
    near = named.withColumn("start", F.substring("key", 1, 8)).join(overlaps, F.col("start") == F.col("from_start"))
    near = stored(near.where(F.col("shared") * 100 >= smallest * (100 - percent)).select("key", "least"), "possible")
    # a second look at the texts of these sets only
    again = documents.join(near.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    whole = sets_of(again, ngram, True).join(near.select("key"), "key", "left_semi")
    whole = stored(whole.groupBy("key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "sets")
    total = whole.agg(F.sum("n")).first()[0] or 0
    rare = stored(rare_ngrams(whole, percent, total), "rare")
    meeting = rare.groupBy("hash").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = rare.join(meeting, "hash").where(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b").distinct()
    links = links_of(whole, components(shared), percent)
    classes = components(links).join(named.select(F.col("key").alias("node"), "least"), "node")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    members = classes.join(least, "component").select(F.col("node").alias("key"), "component_id", "component")
    component = [F.coalesce("component", "key").alias("component")] if also else []
    ids = named.join(members, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"), *component)
    ids = stored(ids, "ids")  # a plain table, so that the join can split the copies of a hot text
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "key", *also).join(ids, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *also, *(["component"] if also else [])
    )

"""Phrase collocations from sorted streams of counts.

Texts are cut into pieces and words; phrases never cross a piece. Counting goes from
short to long: words first, then pairs of frequent words, then longer phrases all of whose
pairs are frequent. What is frequent is told to the tasks by a bitmap of hashed phrases of
fixed size (``FILTER_BITS``): a phrase that only shares a bit with a frequent one is counted too and
falls at the threshold, so counts are exact at any size of the corpus. Each task adds its counts
up before it passes them on, and gives them out whenever it holds ``HELD`` phrases.

The counts of frequent phrases (the empty phrase, which counts all words of a language, is
their root) are then laid out as two streams. In prefix order, by words from the left, the
prefixes of a phrase stand before it and nothing but their other extensions between; a
walk with a stack therefore meets each phrase together with the counts of all its
prefixes. In suffix order, by words from the right, the same walk meets all its suffixes. Streams are
cut by range partitions, wherever a cut falls; the few prefixes of the first phrase of each
part are put in front of it. So a frequent first word is no hot key, and no count is looked up
by a hash.

A phrase that a longer candidate contains as often as it occurs (``covered`` percent) is left
out. Counts fall from a phrase to a longer one, so if any longer candidate does that, one that has a
word more on either side does.

Edge cases: NULL texts are empty; a NULL language is ``und``; only A-Z are lower-cased; repeated rows
count each; an empty table, or none frequent, gives an empty table; texts of any length are read
whole; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches, stored

LONGEST, LEAST, COVERED, TOP = 5, 100, 100, 2_000
#: Bits of the bitmap of frequent phrases, and distinct phrases that a task adds up at a time.
FILTER_BITS, HELD = 1 << 27, 400_000
#: Bytes of text that are taken apart at a time.
TEXT_BYTES = 4_000_000
#: Words that a worker remembers; beyond that it starts anew with the next texts.
REMEMBERED = 500_000
#: Between pieces; no byte of UTF-8 text.
BREAK = b"\xff"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for upper in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[upper] = upper + 32
    for end in b".,;:!?\n\x0b\x0c\r":
        table[end] = BREAK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


BYTES = _byte_table()


def words_of(texts: list[str | None]) -> list[bytes]:
    """The words of all texts in order, with a BREAK between pieces and after each text."""
    joined = BREAK.join([text.encode() if text else b"" for text in texts])
    return joined.translate(BYTES).replace(BREAK, b" " + BREAK + b" ").split()


class Lexicon(dict):
    """Word -> number; a BREAK is 0."""

    def __init__(self, seed: int):
        super().__init__({BREAK: 0})
        self.seed, self.words, self._hashes = seed, [BREAK], [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self._hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number

    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, np.uint64)


def extended(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that have one more word on the right."""
    mixed = (left ^ word) * _MIX
    return mixed ^ mixed >> np.uint64(29)


def phrase_hash(words: list[bytes], seed: int) -> int:
    mixed = np.array([xxhash.xxh64_intdigest(words[0], seed)], np.uint64)
    for word in words[1:]:
        mixed = extended(mixed, np.array([xxhash.xxh64_intdigest(word, seed)], np.uint64))
    return int(mixed[0])


def seed_of(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


class FrequentBits:
    """Bitmap over hashed phrases: no frequent phrase is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(8 * len(self.bits) - 1)
        return self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def tally(tokens: list[bytes], lexicon: Lexicon, lengths: range, frequent: FrequentBits | None) -> Iterator[tuple[bytes, int]]:
    """Phrases of these lengths and their counts; without bits, of all, else of those whose
    words (for pairs) or pairs (for longer ones) all have their bit."""
    ids = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, len(tokens))
    if lengths == range(1, 2):
        counts = np.bincount(ids, minlength=1)
        counts[0] = 0
        yield from ((lexicon.words[i], int(counts[i])) for i in np.flatnonzero(counts).tolist())
        return
    hashes = lexicon.hashes()
    if 2 in lengths:
        passing = (ids > 0) & frequent(hashes)[ids]
        good = passing[:-1] & passing[1:]
    else:
        good = (ids[:-1] > 0) & (ids[1:] > 0)
        good[good] = frequent(extended(hashes[ids[:-1][good]], hashes[ids[1:][good]]))
    # number the phrases of each length by (number of the shorter one, next word), exactly
    at, number, base = np.flatnonzero(good), None, len(lexicon.words)
    for length in range(2, lengths.stop):
        if length > 2:
            there = at + length - 2 < len(good)
            there[there] = good[at[there] + length - 2]
            at, number = at[there], number[there]
        key = (ids[at] if number is None else number) * base + ids[at + length - 1]
        _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if length in lengths:
            for place, count in zip(at[first].tolist(), counts.tolist(), strict=True):
                yield b" ".join(tokens[place : place + length]), count


def partial_counts(documents: DataFrame, lengths: range, bits: bytes | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase and n: counts of each task's texts, several rows a phrase."""
    shared = None if bits is None else documents.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[list]) -> Iterator[dict]:
        frequent = None if shared is None else FrequentBits(np.frombuffer(shared.value, np.uint8))
        held: dict[str, dict[bytes, int]] = {}
        lexicons: dict[str, Lexicon] = {}

        def given() -> dict:
            out = {
                "lang": [lang for lang, counts in held.items() for _ in counts],
                "phrase": [phrase.decode() for counts in held.values() for phrase in counts],
                "n": [n for counts in held.values() for n in counts.values()],
            }
            held.clear()
            return out

        for texts, langs in batches:
            for name, some in _by_language(texts, langs):
                if sum(map(len, lexicons.values())) >= REMEMBERED:
                    lexicons.clear()
                lexicon = lexicons.get(name) or lexicons.setdefault(name, Lexicon(seed_of(name)))
                counts = held.setdefault(name, {})
                for phrase, n in tally(words_of(some), lexicon, lengths, frequent):
                    counts[phrase] = counts.get(phrase, 0) + n
                if sum(map(len, held.values())) >= HELD:
                    yield given()
        yield given()

    columns = documents.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return map_batches(columns, ["text", "lang"], work, "lang string, phrase string, n long")


def _by_language(texts: list, langs: list) -> Iterator[tuple[str, list]]:
    """Texts of one language at a time, of about TEXT_BYTES."""
    for name in sorted(set(langs)):
        some, size = [], 0
        for text, lang in zip(texts, langs, strict=True):
            if lang == name and text:
                some.append(text)
                size += len(text)
                if size >= TEXT_BYTES:
                    yield name, some
                    some, size = [], 0
        if some:
            yield name, some


def frequent_bits(phrases: DataFrame) -> bytes:
    """The bitmap of these phrases (lang, phrase), put together by Spark: 4 KB pieces of fixed number."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        for langs, texts in batches:
            hashes = [phrase_hash(text.encode().split(b" "), seed_of(lang)) for lang, text in zip(langs, texts, strict=True)]
            yield {"place": [h & (FILTER_BITS - 1) for h in hashes]}

    places = map_batches(phrases, ["lang", "phrase"], work, "place long")
    pieces = places.groupBy(F.expr("place div 32768").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("place") % 32768).alias("bits")
    )
    bits = bytearray(FILTER_BITS // 8)
    for row in pieces.toLocalIterator():
        bits[row["piece"] * 4096 : row["piece"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(bits)


def frequent_counts(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words and f of every phrase of up to ``longest`` words that occurs ``least`` times, and
    of the empty phrase, which stands for all words of a language."""
    summed = lambda lengths, bits: (
        partial_counts(documents, lengths, bits, text, lang).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    )
    words = stored(summed(range(1, 2), None), "words")
    roots = words.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.lit("").alias("phrase"), "f")
    often = [words.where(F.col("f") >= least)]
    for lengths in (range(2, 3), range(3, longest + 1)):
        if lengths.start <= longest:
            often.append(stored(summed(lengths, frequent_bits(often[-1])).where(F.col("f") >= least), "phrases"))
    found = often[0]
    for more in often[1:]:
        found = found.unionByName(more)
    pieces = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    return stored(found.unionByName(roots).select("lang", pieces.alias("words"), "f"), "counts")


def with_ancestors(counts: DataFrame, order: str, name: str) -> DataFrame:
    """Add to each phrase the counts of its proper beginnings in the array column ``order``, from the
    empty one on, by a walk along the sorted stream. Every beginning has to be there itself."""
    keys = ["lang", order]
    ranged = stored(counts.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "stream")
    # the first phrase of each part, and its beginnings: a few rows a part
    heads = ranged.groupBy("part").agg(F.min(F.struct(*keys)).alias("head")).select("part", "head.*")
    lengths = F.sequence(F.lit(0), F.size(order) - 1)
    heads = heads.where(F.size(order) > 0).select("part", "lang", F.explode(F.transform(lengths, lambda n: F.slice(order, 1, n))).alias(order))
    carried = ranged.select(*keys, "f").join(heads, keys)
    others = [c for c in counts.columns if c not in (*keys, "f")]
    kinds = dict(counts.dtypes)
    carried = carried.select(
        "part", *keys, "f", *[F.lit(None).cast(kinds[c]).alias(c) for c in others], F.lit(True).alias("carried")
    )
    stream = ranged.withColumn("carried", F.lit(False)).select(carried.columns).unionByName(carried)
    stream = stream.repartition("part").sortWithinPartitions("part", *keys)
    given = [*keys, "f", *others]

    def work(batches: Iterator[list]) -> Iterator[dict]:
        part, lang, above, depth = None, None, [], []
        for parts, langs, phrases, f, flags, *rest in batches:
            lists, kept = [], []
            for i, (p, l, phrase, n, flag) in enumerate(zip(parts, langs, phrases, f, flags, strict=True)):
                if p != part or l != lang:
                    part, lang, above, depth = p, l, [], []
                while depth and depth[-1] != phrase[: len(depth[-1])] or depth and len(depth[-1]) >= len(phrase):
                    depth.pop()
                    above.pop()
                if not flag:
                    lists.append(list(above))
                    kept.append(i)
                depth.append(phrase)
                above.append(n)
            columns = [langs, phrases, f, *rest]
            yield {c: [column[i] for i in kept] for c, column in zip(given, columns, strict=True)} | {name: lists}

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in given], f"`{name}` array<long>"])
    return map_batches(stream, ["part", *keys, "f", "carried", *others], work, schema)


def candidates(counts: DataFrame) -> DataFrame:
    """lang, words, f, lefts and rights of all phrases: ``lefts[k]`` and ``rights[k]`` count the first and
    the last k words; entry 0 of either is the number of words of the language."""
    left = with_ancestors(counts, "words", "lefts").withColumn("back", F.reverse("words"))
    return with_ancestors(left, "back", "rights").select("lang", "words", "f", "lefts", "rights")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n and score of each phrase of two words or more, at its lowest cut."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        for langs, phrases, counts, lefts, rights in batches:
            cuts = [
                min((1000 * a * left[0] // (left[k] * right[len(words) - k]), k) for k in range(1, len(words)))
                for words, a, left, right in zip(phrases, counts, lefts, rights, strict=True)
            ]
            yield {
                "lang": langs,
                "words": phrases,
                "a": counts,
                "l": [left[k] for left, (_, k) in zip(lefts, cuts, strict=True)],
                "r": [right[len(words) - k] for words, right, (_, k) in zip(phrases, rights, cuts, strict=True)],
                "n": [left[0] for left in lefts],
                "score": [score for score, _ in cuts],
            }

    longer = found.where(F.size("words") >= 2)
    schema = "lang string, words array<string>, a long, l long, r long, n long, score long"
    return map_batches(longer, ["lang", "words", "f", "lefts", "rights"], work, schema)


def covered_phrases(found: DataFrame, percent: int = COVERED) -> DataFrame:
    """lang and words of phrases that one with a word more contains in ``percent`` of their occurrences."""
    longer = found.where(F.size("words") >= 3).withColumn("m", F.size("words"))
    enough = lambda shorter: F.col("f").cast("decimal(20,0)") * 100 >= shorter.cast("decimal(20,0)") * percent
    inside = F.array(
        F.when(enough(F.get("lefts", F.col("m") - 1)), F.expr("slice(words, 1, m - 1)")),
        F.when(enough(F.get("rights", F.col("m") - 1)), F.expr("slice(words, 2, m - 1)")),
    )
    return longer.select("lang", F.explode(F.filter(inside, lambda w: w.isNotNull())).alias("words")).distinct()


def collocations(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = COVERED, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Every phrase of 2 to ``longest`` words that occurs ``least`` times and is not covered, with its score."""
    found = stored(candidates(frequent_counts(documents, least, longest, text, lang)), "candidates")
    open_ = scored(found).join(covered_phrases(found, percent), ["lang", "words"], "left_anti")
    return open_.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "l", "r", "n", "score")


def report(documents: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(documents).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

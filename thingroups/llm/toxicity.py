"""Toxicity by the nearest labelled examples.

Examples and texts are TF-IDF vectors over the words that tell the labels apart,
and the nearest examples are found by their exact cosine. The examples stand in an
inverted index in blocks; for each word and block the index has the largest weight.
With these a query has an upper bound for each block; blocks are scored by falling
bound until the bound is below the k-th cosine found. The neighbours vote with
weights that fall with their distance, and an isotonic curve turns the vote into a
probability. The neighbours are the evidence.

Words, weights and examples come from ``EXAMPLES`` labelled rows at most, those with
the smallest hash of the id; copies among them count once. A fifth of them is not
indexed: their votes give the curve. Everything that reaches the driver is bounded
by that number or by ``WORDS``.

Edge cases: a NULL or empty text, or one without such a word, has no neighbours and
gets the curve's value for the share of toxic rows among such examples; labels that
are NULL are not learned from, and of different labels of one id the largest counts, of
different texts the one with the least digest;
equal cosines go to the example that comes first; texts are taken whole; repeated
rows are scored each; with nothing to learn from every score is 0; an empty table
gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import fold, map_batches

EXAMPLES = 20_000
#: Words of the vectors: those with the highest chi-square of presence and label, which
#: is at least that and, with few examples, at least that share of their number.
WORDS, LEAST_CHI2, LEAST_SHARE = 4_096, 24.0, 0.05
NEIGHBOURS, BLOCK = 15, 64
#: Weight of a neighbour: its cosine to this power. The prior counts as much as one at cosine 1.
POWER = 4
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class BlockMaxIndex:
    """Inverted lists of unit vectors, in blocks of rows, with the largest weight of each block."""

    def __init__(self, vectors: list[dict[int, float]], terms: int, block: int = BLOCK):
        # rows with the same strongest words stand together, so that blocks differ
        self.order = sorted(range(len(vectors)), key=lambda i: (sorted(vectors[i], key=lambda t: -vectors[i][t]), i))
        self.block, self.rows = block, len(vectors)
        self.blocks = -(-len(vectors) // block)
        lines = [(t, place, vectors[i][t]) for place, i in enumerate(self.order) for t in vectors[i]]
        lines.sort()
        self.places = np.array([p for _, p, _ in lines], np.int64)
        self.weights = np.array([w for *_, w in lines], np.float64)
        cells = np.array([t * self.blocks + p // block for t, p, _ in lines], np.int64)
        self.starts = np.searchsorted(cells, np.arange(terms * self.blocks + 1))
        self.largest = np.zeros(terms * self.blocks)
        np.maximum.at(self.largest, cells, self.weights)
        self.largest = self.largest.reshape(terms, self.blocks) if self.blocks else np.zeros((terms, 0))

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k rows of highest cosine above 0: (cosine, row), ties to the lower place."""
        if not query or not self.blocks:
            return []
        terms, weights = np.array(sorted(query)), np.array([query[t] for t in sorted(query)])
        bounds = weights @ self.largest[terms] * (1 + 1e-12)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < -best[-1][0]):
                break
            scores = np.zeros(self.block)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                a, z = self.starts[t * self.blocks + b], self.starts[t * self.blocks + b + 1]
                if z > a:
                    scores[self.places[a:z] - b * self.block] += w * self.weights[a:z]
            found = np.flatnonzero(scores > 0)
            best = sorted(best + [(-round(float(scores[i]), 12), b * self.block + int(i)) for i in found])[:k]
        return [(-s, self.order[p]) for s, p in best]


def isotonic(votes: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
    """Rising steps through (vote, label) pairs: the lowest vote and the level of each."""
    steps: list[list[float]] = []
    for vote in sorted({v for v, _ in votes}):
        labels = [y for v, y in votes if v == vote]
        steps.append([vote, float(sum(labels)), float(len(labels))])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, total, rows = steps.pop()
            steps[-1][1] += total
            steps[-1][2] += rows
    return [s[0] for s in steps], [s[1] / s[2] for s in steps]


class Model:
    """Words with their weights, indexed examples, and the curve of the votes."""

    def __init__(self, idf: dict[str, float], examples: list[tuple[int, int, dict[str, int]]]):
        self.numbers = {w: i for i, w in enumerate(sorted(idf))}
        self.idf = [idf[w] for w in sorted(idf)]
        kept = [e for i, e in enumerate(examples) if i % 5]
        self.ids, self.labels = [e[0] for e in kept], [e[1] for e in kept]
        self.prior = sum(self.labels) / max(len(kept), 1)
        self.index = BlockMaxIndex([self.vector(e[2]) for e in kept], len(idf))
        votes = [(self.vote(self.index.nearest(self.vector(e[2]), NEIGHBOURS)), e[1]) for i, e in enumerate(examples) if i % 5 == 0]
        self.steps, self.levels = isotonic(votes)

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        raw = {self.numbers[w]: (1 + math.log(n)) * self.idf[self.numbers[w]] for w, n in counts.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length for t, x in raw.items()} if length else {}

    def vote(self, neighbours: list[tuple[float, int]]) -> float:
        weights = [(c**POWER, self.labels[row]) for c, row in neighbours]
        return round((self.prior + sum(w * y for w, y in weights)) / (1 + sum(w for w, _ in weights)), 9)

    def score(self, vote: float) -> float:
        """The curve, straight between the steps' levels."""
        return round(float(np.interp(vote, self.steps, self.levels)), 9) if self.steps else 0.0


def _word_counts(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, toxic, texts in batches:
            counted = [Counter(words(t)) for t in texts]
            yield {
                "doc_id": ids,
                "toxic": toxic,
                "words": [list(c) for c in counted],
                "times": [list(c.values()) for c in counted],
            }

    return map_batches(rows, ["doc_id", "toxic", "text"], work, "doc_id long, toxic int, words array<string>, times array<int>")


def learn(documents: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    """A model from at most that many labelled rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text of each id, so that the bound on ids is one on examples
    first = F.min(F.struct(F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("~")).alias("digest"), "text"))
    rows = rows.groupBy("doc_id", "toxic").agg(first.alias("first")).select("doc_id", "toxic", "first.text")
    rows = _word_counts(rows.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = rows.dropDuplicates(["words", "times", "toxic"]).persist()
    present = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic")
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, t = float(size["n"]), float(size["toxic"])
    r, x = F.col("rows").cast("double"), F.col("toxic").cast("double")
    apart = n * (x * (n - t - r + x) - (r - x) * (t - x)) ** 2 / (r * (n - r) * t * (n - t))
    telling = present.where((r < n) & F.lit(0 < t < n)).withColumn("chi2", apart)
    telling = telling.where(F.col("chi2") >= min(LEAST_CHI2, LEAST_SHARE * n)).orderBy(F.desc("chi2"), "word").limit(WORDS).collect() if 0 < t < n else []
    idf = {w["word"]: math.log((n + 1) / (w["rows"] + 1)) + 1 for w in telling}
    telling_words = F.lit(sorted(idf)) if idf else F.array().cast("array<string>")
    pairs = F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))
    kept = rows.select("doc_id", "toxic", F.filter(pairs, lambda p: F.array_contains(telling_words, p["word"])).alias("pairs"))
    examples = [(e["doc_id"], e["toxic"], {p["word"]: p["times"] for p in e["pairs"]}) for e in kept.collect()]
    rows.unpersist()
    return Model(idf, sorted(examples, key=lambda e: (e[0], e[1], sorted(e[2].items()))))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and neighbours (id, toxic, cosine) of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        model, known = shared.value, {}
        numbers = model.numbers

        def answer(found: tuple[str, ...]) -> tuple[float, list[dict]]:
            key = tuple(sorted(Counter(found).items()))
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                near = model.index.nearest(model.vector(dict(key)), NEIGHBOURS)
                evidence = [{"doc_id": model.ids[i], "toxic": model.labels[i], "cosine": c} for c, i in near]
                known[key] = model.score(model.vote(near)), evidence
            return known[key]

        for ids, texts in batches:
            answers = [answer([w for w in words(t) if w in numbers]) for t in texts]
            yield {"doc_id": ids, "score": [a[0] for a in answers], "neighbours": [a[1] for a in answers]}

    schema = "doc_id long, score double, neighbours array<struct<doc_id: long, toxic: int, cosine: double>>"
    return map_batches(documents.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], work, schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; labels of the fold that is held out are not learned from."""
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = score(documents, learn(documents, labels.where(~held_out)))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours"
    )

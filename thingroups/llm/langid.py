"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A group of three letters is bound:
the first letter's vector rotated by two places, the second's by one and the
third's are multiplied. A text's vector is the sum of the vectors of its groups;
a language's prototype is the sum of the unit vectors of its texts, as whole
numbers, so that it does not depend on the order of the rows. A text gets the
language of the prototype with the highest cosine.

Runs of other characters than letters count as one boundary sign. Letters are
lower-cased. All labelled rows of the training folds are learned from.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0; so is
every text if nothing was learned. Rows without a language are not learned from.
Equal cosines go to the first language in alphabetical order. Texts are taken
whole, with any number of languages; repeated rows are each predicted and each learned from; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thingroups.llm.common import fold, map_batches, stored

DIMENSIONS = 1_024
SEED = 20_240
#: Texts whose vectors are computed together.
TOGETHER = 256
#: Languages whose prototypes are compared in one pass over the texts; more take more passes.
MOST_LANGUAGES = 1_000
#: Whole numbers per unit of a text's vector in a prototype.
SCALE = 10_000
#: How sharply the score falls with the distance of the cosines.
SHARPNESS = 20.0

_is_letter = None


def letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _is_letter


class Profiles:
    """Vectors of texts; letter vectors are drawn from the seed and the code point."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            if len(self._letters) >= 20_000:
                self._letters.clear()
            draw = np.random.Generator(np.random.Philox(key=[self.seed, code]))
            self._letters[code] = (draw.integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self._letters[code]

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and whether it has a letter."""
        found = np.zeros(len(texts), bool)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        coded = [np.frombuffer(f"\n{(t or '').lower()}\n".encode("utf-32-le"), np.uint32) for t in texts]
        if not texts:
            return out, found
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in coded])
        codes = np.concatenate(coded)
        letter = letters()[codes]
        codes = np.where(letter, codes, 0)
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
        codes, owner = codes[keep], owner[keep]
        found[owner[codes > 0]] = True
        present = np.unique(codes)
        ids = np.searchsorted(present, codes)
        whole = (owner[2:] == owner[:-2]) & (codes[1:-1] + codes[2:] + codes[:-2] > 0)
        k = len(present)
        keys = ((ids[:-2] * k + ids[1:-1]) * k + ids[2:])[whole]
        if k**3 <= 4_000_000:
            used = np.flatnonzero(np.bincount(keys, minlength=1))
            place = np.zeros(k**3, np.int64)
            place[used] = np.arange(len(used))
            groups = place[keys]
        else:
            used, groups = np.unique(keys, return_inverse=True)
        if not len(used):
            return out, found
        owner = owner[2:][whole]
        drawn = np.stack([self.letter(int(c)) for c in present])
        first, second = np.roll(drawn, 2, axis=1), np.roll(drawn, 1, axis=1)
        for start in range(0, len(used), 16_384):  # a bounded number of groups at a time
            part = used[start : start + 16_384]
            bound = first[part // k**2] * second[part // k % k] * drawn[part % k]
            mine = (groups >= start) & (groups < start + len(part))
            counts = np.bincount(
                owner[mine] * len(part) + groups[mine] - start, minlength=len(texts) * len(part)
            ).reshape(len(texts), len(part))
            out += counts.astype(np.float32) @ bound.astype(np.float32)
        return out, found


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def learn(documents: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """lang, number (0, 1, ... in alphabetical order) and prototype, from the columns text and lang of all given rows."""

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        profiles, sums = Profiles(dimensions), {}
        for texts, languages in batches:
            for i in range(0, len(texts), TOGETHER):
                vectors, found = profiles.vectors(texts[i : i + TOGETHER])
                units = np.rint(_units(vectors) * SCALE).astype(np.int64)
                names = np.array(languages[i : i + TOGETHER])
                for name in set(names[found]):
                    sums[name] = sums.get(name, 0) + units[found & (names == name)].sum(axis=0)
        for name, total in sums.items():
            yield {"lang": [str(name)] * dimensions, "place": range(dimensions), "total": total}

    rows = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sums = map_batches(rows, ["text", "lang"], work, "lang string, place int, total long")
    added = sums.groupBy("lang", "place").agg(F.sum("total").alias("total"))
    entries = F.array_sort(F.collect_list(F.struct("place", "total")))  # ``dimensions`` of them
    prototypes = stored(added.groupBy("lang").agg(F.transform(entries, lambda e: e["total"]).alias("prototype")), "prototypes")
    # one row a language: the numbers need no more than the names
    numbers = prototypes.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).alias("number"))
    return prototypes.join(numbers, "lang")


def predict(
    documents: DataFrame,
    prototypes: dict[str, np.ndarray],
    keep: list[str],
    dimensions: int = DIMENSIONS,
    earlier: bool = False,
    last: bool = True,
) -> DataFrame:
    """The columns ``keep``, the language and a score from 0 to 1 for each row.

    The score is the share of the best language when shares fall off exponentially
    with the cosine. ``cosine`` is the best cosine itself. A pass over some of the
    languages takes what an ``earlier`` one found among languages before these, and unless it is the
    ``last`` keeps the text and, in place of the score, the sum that the share is taken of."""
    names = sorted(prototypes)
    matrix = _units(np.stack([prototypes[n] for n in names])).astype(np.float32) if names else None
    model = documents.sparkSession.sparkContext.broadcast((names, matrix))
    kept = list(keep) if last else list(dict.fromkeys([*keep, "text"]))
    before = ["lang_pred", "cosine", "total"] if earlier else []
    columns = list(dict.fromkeys([*kept, "text", *before]))

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        profiles, (names, matrix) = Profiles(dimensions), model.value
        for arrays in batches:
            given = dict(zip(columns, arrays, strict=True))
            texts = given["text"].to_pylist()
            language, total, cosine, letter = [], [], [], []
            for i in range(0, len(texts), TOGETHER):
                vectors, found = profiles.vectors(texts[i : i + TOGETHER])
                if not names:
                    found[:] = False
                alike = _units(vectors) @ matrix.T if names else np.zeros((len(found), 1))
                best = alike.argmax(axis=1)
                top = alike.max(axis=1)
                language += [names[b] if f else "und" for b, f in zip(best, found, strict=True)]
                total.append(np.exp(SHARPNESS * (alike - top[:, None])).sum(axis=1))
                cosine.append(np.where(found, top, 0.0))
                letter.append(found)
            total, cosine, letter = (np.concatenate([*x, np.zeros(0)]) for x in (total, cosine, letter))
            if earlier:
                was, sums = given["cosine"].to_numpy(), given["total"].to_numpy()
                top = np.maximum(was, cosine)
                total = sums * np.exp(SHARPNESS * (was - top)) + total * np.exp(SHARPNESS * (cosine - top))
                language = [a if w >= c else b for a, b, w, c in zip(given["lang_pred"].to_pylist(), language, was, cosine, strict=True)]
                cosine = top
            out = {c: given[c] for c in kept} | {"lang_pred": language, "cosine": cosine.tolist()}
            yield out | ({"score": np.where(letter > 0, 1 / total, 0.0).tolist()} if last else {"total": total.tolist()})

    kinds = dict(documents.dtypes)
    found = ["lang_pred string", "score double", "cosine double"] if last else ["lang_pred string", "cosine double", "total double"]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in kept] + found)
    return map_batches(documents, columns, work, schema, arrow_in=True)


def held_out() -> Column:
    return fold(F.col("doc_id"), 3) == 1


def identify(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from the training folds and predict every row."""
    keep = keep or ["doc_id"]
    learned = stored(learn(documents.where(~held_out()).select("text", "lang")), "languages")
    passes = max(1, -(-learned.count() // MOST_LANGUAGES))
    for i in range(passes):
        here = learned.where((F.col("number") >= i * MOST_LANGUAGES) & (F.col("number") < (i + 1) * MOST_LANGUAGES))
        prototypes = {row["lang"]: np.array(row["prototype"], np.float64) for row in here.collect()}
        documents = predict(documents, prototypes, keep, earlier=i > 0, last=i == passes - 1)
    return documents


def report(documents: DataFrame) -> DataFrame:
    return identify(documents).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

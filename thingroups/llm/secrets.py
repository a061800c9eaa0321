"""Secrets in texts: fixed patterns, and strings that look drawn at random.

Patterns give spans of three kinds: assigned values, access keys, long hex. All
other long runs of key characters are judged by two Markov models of characters,
one of random strings and one of ordinary identifiers: a run is a secret if the
random model explains it better by a log-likelihood ratio per character above a
threshold. The models are learned from labelled samples: values that the patterns
find are the random strings, words that stand outside them are ordinary. Both
come from ``TRAINING_ROWS`` documents at most (expected), chosen by a hash.

Only DataFrame functions are used. The models are tables of the alphabet's
squared size, so they are collected and put into the plan as arrays.

Edge cases: NULL is an empty text, without spans; texts are searched whole; spans
are in code points, end exclusive; a run that touches a pattern's span is not
added; repeated rows are searched each; with nothing to learn from, the random
model is uniform; an empty table gives an empty table; further columns are passed
on only by ``redact``, which replaces them by none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.llm.arrays import add, cut_out, let, reversed_running, running

#: Patterns, in the order of kinds. Group 1 of an assignment is its value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SHORTEST_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the models judge.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
#: Ordinary words that the models learn from.
WORD = r"[A-Za-z_][A-Za-z0-9_]{3,}"
TRAINING_ROWS = 20_000
#: Mean log-likelihood ratio of a character from which a run counts as random.
THRESHOLD = 0.5

SPAN = "struct<start: int, kind: int, end: int, value: string>"


def _found(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of all matches, leftmost first, from the lengths of what lies between."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    gaps = F.split(text, pattern, -1)

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.char_length(p["gap"]) + F.char_length(p["match"])), add)
        return F.zip_with(
            parts,
            ends,
            lambda p, end: F.struct(
                (end - F.char_length(p["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value")
            ),
        )

    parts = F.arrays_zip(matches.alias("match"), values.alias("value"), gaps.alias("gap"))
    whole = F.filter(parts, lambda p: p["match"].isNotNull())  # one gap more than matches
    return F.when(text.rlike(pattern), let(whole, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(documents: DataFrame) -> DataFrame:
    """Add ``assign``, ``access`` and ``hex``: arrays of spans of each pattern."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumns(
        {
            "assign": F.filter(_found(text, ASSIGN, 0, 1), lambda s: F.char_length(s["value"]) >= SHORTEST_VALUE),
            "access": _found(text, ACCESS, 1),
            "hex": _found(text, HEX, 2),
        }
    )


def learn(documents: DataFrame, training_rows: int = TRAINING_ROWS) -> list[float]:
    """The log-likelihood ratio of each pair of neighbouring characters, random over
    ordinary; pair (a, b) stands at index(a) * size + index(b)."""
    total = documents.count()
    share = min(1.0, training_rows / max(total, 1))
    chosen = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    spans = base_spans(chosen.select("doc_id", "text"))
    random = spans.select(F.explode(F.concat("assign", "access", "hex")).alias("span")).select(
        F.lit(True).alias("random"), F.col("span.value").alias("value")
    )
    ordinary = (
        chosen.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
        .where(~F.col("value").rlike("[0-9]"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("times"))
        .select(F.lit(False).alias("random"), "value")
    )
    pairs = (
        random.unionByName(ordinary)
        .where(F.char_length("value") > 1)
        .select(
            "random",
            F.explode(let(F.split("value", ""), lambda c: _neighbours(c, lambda a, b: F.concat(a, b)))).alias("pair"),
        )
        .groupBy("random", "pair")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    size = len(ALPHABET)
    # the alphabet bounds the rows: other characters occur in no run
    counts = {True: [1.0] * size**2, False: [1.0] * size**2}
    for row in pairs.collect():
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0:
            counts[row["random"]][a * size + b] += row["times"]

    def log_share(kind: bool, i: int) -> float:
        first = i // size * size
        return math.log(counts[kind][i] / sum(counts[kind][first : first + size]))

    return [round(log_share(True, i) - log_share(False, i), 6) for i in range(size**2)]


def _neighbours(items: Column, join) -> Column:
    """``join`` of each element and the next."""
    n = F.size(items) - 1
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), join)


def random_likelihood(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of neighbouring characters."""
    size = len(ALPHABET)
    table = F.lit(ratios)
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    of_pair = lambda a, b: F.element_at(table, (a * size + b + 1).cast("int"))
    total = let(codes, lambda c: F.aggregate(_neighbours(c, of_pair), F.lit(0.0), lambda x, y: x + y))
    return total / (F.char_length(value) - 1)


def _apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no span of ``base``: by start, no span before reaches into one, and the
    next one begins behind it."""
    item = lambda s, run: F.struct(s["start"].alias("start"), F.lit(run).alias("run"), s["end"].alias("end"), s["value"].alias("value"))
    both = F.array_sort(F.concat(F.transform(base, lambda s: item(s, 0)), F.transform(runs, lambda r: item(r, 1))))

    def free(items: Column) -> Column:
        reach = running(F.transform(items, lambda x: F.when(x["run"] == 0, x["end"]).otherwise(F.lit(-1))), F.greatest)
        follows = reversed_running(F.transform(items, lambda x: F.when(x["run"] == 0, x["start"]).otherwise(F.lit(2**31 - 1))), F.least)
        lines = F.arrays_zip(items.alias("item"), reach.alias("reach"), follows.alias("follows"))
        good = F.filter(lines, lambda x: (x["item"]["run"] == 1) & (x["reach"] <= x["item"]["start"]) & (x["follows"] >= x["item"]["end"]))
        return F.transform(
            good,
            lambda x: F.struct(
                x["item"]["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["item"]["end"].alias("end"), x["item"]["value"].alias("value")
            ),
        )

    return F.when(F.size(runs) > 0, let(both, free)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(documents: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``assign``, ``access``, ``hex`` and ``random``: the spans of each kind, with
    their values, and ``spans``, all of them by start and kind."""
    ratios = learn(documents) if ratios is None else ratios
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = base_spans(documents).withColumn("runs", _found(text, RUN, 3)).withColumn(
        "base", F.array_sort(F.concat("assign", "access", "hex"))
    )
    return (
        with_base.withColumn(
            "random",
            F.filter(_apart(F.col("runs"), F.col("base")), lambda r: random_likelihood(r["value"], ratios) > threshold),
        )
        .withColumn("spans", F.array_sort(F.concat("base", "random")))
        .drop("runs")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda s: F.element_at(F.lit(KINDS), s["kind"] + 1)
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of spans that overlap or touch replaced by a mark."""
    text = scanned["text"]

    def cut(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return let(reach, lambda r: cut_at(spans, r))

    def cut_at(spans: Column, reach: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        lines = F.zip_with(spans, before, lambda s, b: F.struct(s["start"].alias("start"), b.alias("before")))
        first = F.filter(lines, lambda x: x["before"] < x["start"])  # nothing before reaches this one
        return let(first, lambda f: pieces(f, F.element_at(reach, -1)))

    def pieces(first: Column, last: Column) -> Column:
        ends = F.concat(F.slice(F.transform(first, lambda x: x["before"]), F.lit(2), F.size(first) - 1), F.array(last))
        begins = F.concat(F.array(F.lit(0)), ends)
        stops = F.concat(F.transform(first, lambda x: x["start"]), F.array(F.char_length(text)))
        return F.array_join(cut_out(text, begins, stops), mark)

    return F.when(F.size(scanned["spans"]) > 0, let(scanned["spans"], cut)).otherwise(text)


def report(documents: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """Counts, the digest of the patterns' spans, and all spans of each document."""
    scanned = scan(documents.select("doc_id", "text"), ratios)
    return scanned.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

"""Collocations against plain counting, over cut streams, and their edge cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from thingroups.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, f int, words string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "x", 1, "y", 2) for i, (t, la) in enumerate(rows)], SCHEMA)


def plain(rows, least, longest, percent=100):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang or "und", *words[i : i + m]) for i in range(len(words) - m + 1))
    often = {p: f for p, f in counts.items() if f >= least}
    out = []
    for (lang, *words), a in often.items():
        m = len(words)
        inside = any(
            q[0] == lang and len(q) - 1 > m and 100 * f >= percent * a and any(list(q[i : i + m]) == words for i in range(1, len(q) - m + 1))
            for q, f in often.items()
        )
        if m > 1 and not inside:
            cuts = [(1000 * a * totals[lang] // (often[lang, *words[:k]] * often[lang, *words[k:]]), k) for k in range(1, m)]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, often[lang, *words[:k]], often[lang, *words[k:]], totals[lang], score))
    return sorted(out)


def texts():
    draw = random.Random(7)
    word = ["the", "a", "\x01b", "a\x01", "Ünï", "ünï", "of", "x-y", " ", "d\x1ce", *(f"w{i}" for i in range(30))]
    rows = []
    for _ in range(400):
        parts = [draw.choice(word[: draw.choice([4, 9, 40])]) for _ in range(draw.randrange(60))]
        rows.append(("".join(p + draw.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for p in parts), draw.choice(["en", "fr", None, "und"])))
    rows += [("Kept Together always here now", "en")] * 12 + [("kept together always", "en")] * 3
    rows += [(None, "en"), ("", None), (" \t.. ", "de"), ("go " * 5_000, "long"), ("one", None)]
    return rows


def test_against_plain_counts(spark, monkeypatch):
    rows = texts()
    df = frame(spark, rows).repartition(5)
    found = lambda *a: sorted(tuple(r) for r in collocations.collocations(df, *a).collect())
    expected = plain(rows, 5, 5)
    assert len({p.count(" ") for _, p, *_ in expected}) == 4
    assert found(5) == expected
    # few held phrases, short runs of text, a full bitmap: the same counts
    monkeypatch.setattr(collocations, "HELD", 3)
    monkeypatch.setattr(collocations, "REMEMBERED", 10)
    monkeypatch.setattr(collocations, "FILTER_BITS", 32_768)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(8, 3, 60) == plain(rows, 8, 3, 60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collocations.collocations(df.limit(0), 1).collect() == []
    assert collocations.collocations(df, 10**9).collect() == []


def test_large_numbers_and_ranks(spark):
    big = 3_000_000_000_000_000_000
    line = ("en", ["a", "b"], big, [4 * big // 2, big + 1], [4 * big // 2, big + 2])
    df = spark.createDataFrame([line], "lang string, words array<string>, f long, lefts array<long>, rights array<long>")
    (row,) = collocations.scored(df).collect()
    assert row["score"] == 1000 * big * (2 * big) // ((big + 1) * (big + 2))
    rows = [("p q. r s. t u", "x")] * 120 + [("r s", "x")]
    ranked = [tuple(r)[:4] for r in collocations.report(frame(spark, rows), 2).collect()]
    assert sorted(ranked) == [("x", 1, "p q", 120), ("x", 2, "t u", 120)]


def test_streams_are_cut_anywhere(spark):
    draw = random.Random(3)
    phrases = {()}
    while len(phrases) < 500:
        phrase = tuple(draw.choice("ab") * draw.choice([1, 1, 2]) for _ in range(draw.randrange(1, 6)))
        phrases |= {phrase[:n] for n in range(len(phrase) + 1)}
        if len(phrases) > 300:
            break
    count = {p: 1_000 - len(p) * 100 + i for i, p in enumerate(sorted(phrases))}
    df = spark.createDataFrame([("l", list(p), n) for p, n in count.items()], "lang string, words array<string>, f long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = collocations.with_ancestors(df.repartition(4), "words", "above").select("words", F.col("above")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r["words"]): r["above"] for r in found} == {p: [count[p[:n]] for n in range(len(p))] for p in count}

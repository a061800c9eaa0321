"""Operators on document tables against brute force, and their edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest import DATA
from thingroups.llm import components, decontaminate, jaccard, langid, secrets, sharding
from thingroups.llm.queries import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, 1.0, "x", "k") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination -------------------------------------------------------


def overlap(text, items, width=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    words, hit, found = find(text), set(), set()
    for item, body in items:
        w = find(body)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrase = w[i : i + width]
            for at in range(len(words) - len(phrase) + 1):
                if words[at : at + len(phrase)] == phrase:
                    hit |= set(range(at, at + len(phrase)))
                    found |= set() if item is None else {str(item)}
    return len(words), len(hit), sorted(found)


def test_decontaminate_query(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in load()["op5_decontaminate"][0](spark, DATA).collect()}
    for d in documents:
        n, hit, found = overlap(d["text"], items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        row = got[d["doc_id"]]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == (n, hit, len(found), digest)
        assert row["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_decontaminate_edges(spark):
    draw = random.Random(5)
    items = [(1, "a b c a b"), (1, "a b c a b"), (2, "B"), (3, ""), (4, None), (None, "c c"), (5, "é-c c"), (10, "a a a a")]
    texts = [" ".join(draw.choice("abcdé") for _ in range(draw.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "a" * 5000, "a " * 3000, "b b", "b b"]
    docs = frame(spark, list(zip([*range(64), None, None], texts, ["en"] * 66, strict=True)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [i for i in items if i[1]]  # an item without id hits words, and is not listed
    for options in ({}, {"block_bytes": 3}, {"shard_words": 5}):
        rows = decontaminate.find_overlaps(docs, bench, ["doc_id", "score"], width=4, **options).collect()
        assert len(rows) == 66
        by_id = defaultdict(list)
        for r in rows:
            by_id[r["doc_id"]].append(r)
        for i, t in zip([*range(64), None, None], texts, strict=True):
            r = by_id[i][0]
            assert (r["n_words"], r["n_hit"], r["items"]) == overlap(t, known, 4)
            for a, b in [(s["start"], s["end"]) for s in r["spans"]]:
                assert re.fullmatch(r"[a-dé]+(?: [a-dé]+)*", t[a:b])
            marked = sum(len(t[s["start"] : s["end"]].split()) for s in r["spans"])
            assert marked == r["n_hit"]
    assert decontaminate.find_overlaps(docs.limit(0), bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.find_overlaps(docs, bench.limit(0)).collect())


def test_fm_index_against_plain_search():
    draw = np.random.default_rng(1)
    text = draw.integers(1, 5, 400)
    index = decontaminate.FMIndex(text, 5)
    for n in (1, 2, 3, 6):
        phrases = draw.integers(1, 5, (30, n))
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high, strict=True):
            expected = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


# --- near copies -----------------------------------------------------------


def near_classes(rows, n=4, percent=85):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = i if least[root(k)] is None else min(i, least[root(k)])
    return sorted((str(i), len(s), str(least[root(k)])) for k, (i, s) in enumerate(sets))


def answers(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_jaccard_query(spark, documents):
    got = answers(load()["op6_jaccard_join"][0](spark, DATA))
    assert got == near_classes([(d["doc_id"], d["text"]) for d in documents])


def test_jaccard_large_group_in_small_blocks(spark, monkeypatch):
    draw = random.Random(11)
    base = [f"w{draw.randint(0, 300)}" for _ in range(60)]
    rows = [(100, None), (101, ""), (102, "one two"), (103, "ONE  two"), (104, " \t "), (104, "one two three"), (None, "one two")]
    for i in range(60):  # near copies, some too far from most others
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 4])):
            words[draw.randrange(60)] = f"x{draw.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    rows += [rows[-1], (200, rows[-1][1].upper())]
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    expected = near_classes(rows)
    assert len({c for _, _, c in expected}) > 4
    assert answers(jaccard.near_copies(docs)) == expected
    monkeypatch.setattr(jaccard.links_of, "__defaults__", (7,))
    assert answers(jaccard.near_copies(docs)) == expected
    assert jaccard.near_copies(docs.limit(0)).collect() == []


def test_shortened_hashes_never_hide_a_shared_one():
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 2**63, 60).astype(np.uint64)
    pool = (pool & ~np.uint64(0xFFFFFFFF)) | draw.integers(0, 12, 60).astype(np.uint64)  # nearly all collide
    sets = [np.unique(draw.choice(pool, draw.integers(1, 40))) for _ in range(80)]
    owner = np.repeat(np.arange(80), [len(x) for x in sets])
    short = jaccard.shortened(np.concatenate(sets), owner)
    lines = [set(short[owner == i].tolist()) for i in range(80)]
    assert [len(x) for x in lines] == [len(x) for x in sets]
    for i in range(80):
        for j in range(i):
            assert len(lines[i] & lines[j]) >= len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: forest.root(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- language --------------------------------------------------------------


def test_language_query_on_held_out_documents(spark, documents):
    rows = load()["op7_language_id"][0](spark, DATA).collect()
    lang = {d["doc_id"]: d["lang"] for d in documents}
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(i, f"{w} {w}ing the {w}", "en") for i, w in enumerate("walk talk sing jump read".split())]
    rows += [(i, f"{w} {w}ción el {w}", "es") for i, w in enumerate("canto hablo luzco nado leo".split(), 10)]
    rows += [(20, None, "en"), (21, "", None), (22, "12 + 3", "en"), (None, "el canto", "es"), (23, "talking the", None), (23, "talking the", None)]
    got = langid.report(frame(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i]["lang_pred"] for i in (20, 21, 22)] == ["und"] * 3 and by_id[20]["score"] == 0
    assert by_id[23]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "es"
    assert langid.report(frame(spark, rows).limit(0)).collect() == []
    unlabelled = langid.report(frame(spark, [(1, "some text", None)])).collect()
    assert unlabelled[0]["lang_pred"] == "und"


def test_many_languages_take_several_passes(spark, monkeypatch):
    draw = random.Random(2)
    rows = []
    for n in range(7):
        letters = draw.sample("abcdefghijklmnopqrstuvwxyz", 9)
        rows += [(100 * n + i, " ".join("".join(draw.choices(letters, k=5)) for _ in range(12)), f"l{n}") for i in range(20)]
    rows += [(9_000, "", "l1"), (9_001, None, None)]
    docs = frame(spark, rows)
    whole = {r["doc_id"]: r for r in langid.report(docs).collect()}
    assert len({r["lang_pred"] for r in whole.values()}) == 8
    for most in (1, 3):
        monkeypatch.setattr(langid, "MOST_LANGUAGES", most)
        got = langid.report(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["lang_pred"] == whole[r["doc_id"]]["lang_pred"] and r["score"] == pytest.approx(whole[r["doc_id"]]["score"], abs=1e-6)


def test_group_vectors_are_bound_and_bundled():
    profiles = langid.Profiles(64, 3)
    vectors, found = profiles.vectors(["Ab", "1", None])
    a, b = (profiles.letter(ord(c)).astype(int) for c in "ab")
    edge = profiles.letter(0).astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert (vectors[0] == bind(edge, a, b) + bind(a, b, edge)).all()
    assert found.tolist() == [True, False, False]


# --- secrets ---------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_query(spark, documents):
    got = {r["doc_id"]: r for r in load()["op8_secrets"][0](spark, DATA).collect()}
    for d in documents:
        expected = base_spans(d["text"])
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
        assert set(filter(None, expected.split(","))) <= set(got[d["doc_id"]]["spans"].split(","))


def test_secret_edges_and_random_strings(spark):
    draw = random.Random(4)
    letters = secrets.ALPHABET[:62]
    keys = ["".join(draw.choice(letters) for _ in range(32)) for _ in range(40)]
    plain = "the quick configuration_of_the_running_application internationalisation_settings handles requests "
    rows = [(i, f"é😀 {plain} token = {k[:20]} and", "en") for i, k in enumerate(keys[:20])]
    rows += [(100 + i, f"ключ {k} {plain}", "en") for i, k in enumerate(keys[20:])]
    odd = [
        "token: token:abcdefg", "PASSWORD='secret123'token=x", "AKIA" + "A" * 16 + "b", "AKIAAKIA" + "1" * 12, "a" * 24, "0123456789abcdef" * 400,
        "api_key:abcdef apikey = abcdefg", "secret", "", None, "x token=abc", "😀token=abcdef😀", plain * 40,
    ]
    rows += [(1000 + i, t, "en") for i, t in enumerate(odd)] + [(1000, odd[0], "en"), (None, "token=abcdefgh", "en")]
    docs = frame(spark, rows)
    ratios = secrets.learn(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert len(secrets.report(docs).collect()) == len(rows)  # whatever so few rows teach
    got = secrets.report(docs, ratios).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        assert by_id[i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest(), t
    found = sum("random:" in by_id[100 + i]["spans"] for i in range(20))
    assert found >= 18
    assert "random:" not in by_id[1012]["spans"]
    assert by_id[100]["spans"] == "random:5:37"
    scanned = secrets.scan(docs, ratios)
    clean = {r["doc_id"]: r["clean"] for r in scanned.select("doc_id", secrets.redact(scanned).alias("clean")).collect()}
    assert clean[100] == f"ключ [SECRET] {plain}" and clean[0].endswith("[SECRET] and") and clean[1009] is None and clean[1008] == ""
    assert clean[1005] == "[SECRET]" and clean[1006] == "[SECRET] [SECRET]"
    assert secrets.report(docs.limit(0)).collect() == []


def test_long_texts_with_secrets(spark):
    draw = random.Random(6)
    letters = secrets.ALPHABET[:62]
    run = "".join(draw.choices(letters, k=1_000_000))
    many = " ".join(f"token=abc{i:06d} é" if i % 3 else "".join(draw.choices(letters, k=30)) for i in range(20_000))
    texts = {1: run, 2: many, 3: "f" * 400_000 + " 😀 " + "AKIA" + "Z" * 300_000, 4: "x" * 30 + "token=abcdefg" + "y" * 30}
    docs = frame(spark, [(i, t, "en") for i, t in texts.items()])
    ratios = secrets.learn(spark.read.parquet(f"{DATA}/documents.parquet"))
    scanned = secrets.scan(docs, ratios)
    begin = time.time()
    got = {r["doc_id"]: r for r in scanned.select("doc_id", "base", "spans", secrets.redact(scanned).alias("clean")).repartition(4).collect()}
    assert time.time() - begin < 40  # four texts of up to a million characters
    for i, text in texts.items():
        listed = ",".join(f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in got[i]["base"])
        assert listed == base_spans(text)
        stretches, spans = [], sorted((s["start"], s["end"]) for s in got[i]["spans"])
        for a, b in spans:
            if stretches and stretches[-1][1] >= a:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        at, clean = 0, []
        for a, b in stretches:
            clean += [text[at:a], "[SECRET]"]
            at = b
        assert got[i]["clean"] == "".join([*clean, text[at:]])
        base = [(s["start"], s["end"]) for s in got[i]["base"]]
        random_spans = [(s["start"], s["end"]) for s in got[i]["spans"] if s["kind"] == 3]
        assert not any(a < y and x < b for a, b in random_spans[:200] for x, y in base)
    assert sum(s["kind"] == 3 for s in got[2]["spans"]) > 5_000


# --- sharding --------------------------------------------------------------


def test_sharding(spark):
    draw = random.Random(9)
    rows = [(i, "x" * draw.randint(0, 400), "en") for i in range(300)] + [(5, "é", "en")] * 3
    rows += [(None, "copy", "en")] * 2 + [(i, "copy", "en") for i in range(1000, 1200)] + [(7, None, "en"), (8, "", "en")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    target = sum(sizes.values()) / 40
    assert set(sizes) == set(range(40)) and all(abs(s - target) <= 416 for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 5} >= {(18, zlib.crc32("é".encode()))}
    assert [(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 7 and r["size"] == 16] == [(16, None)]
    copies = sorted(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"copy"))
    assert copies[-1] - copies[0] <= 202 * 20 // target + 1
    assert sharding.shard_documents(frame(spark, rows).limit(0)).collect() == []
    assert {r["shard"] for r in sharding.shard_documents(frame(spark, rows[:1])).collect()} == {0}

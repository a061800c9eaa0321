"""Vectors, pages, toxicity and the pipeline against brute force, and their edge cases."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from test_documents import frame, near_classes, overlap
from thingroups.llm import html_extract, topk, toxicity
from thingroups.llm.queries import load

# --- top k -----------------------------------------------------------------


def nearest(rows, k):
    usable = {
        (i, tuple(int(np.floor(1024 * float(x))) for x in v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    out = []
    for query in {i for i, _ in usable if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for n, q in usable if n == query for i, v in usable if i != query)
        out += [(query, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_edges_and_small_shards(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(320)]
    rows += [(i, [0.5] * 6) for i in range(400, 460)]  # ties
    rows += [(500, None), (600, [float("nan")] * 6), (700, [1.0, None]), (701, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(800, [1.0, 2.0]), (801, []), (100, rows[100][1]), (100, [0.25] * 6), (3, [9.0] * 6)]
    schema = "vec_id long, embedding array<double>, label int, rank int, score string, asks int"
    df = spark.createDataFrame([(i, v, 1, 1, "x", 1) for i, v in rows], schema)
    found = lambda: sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect())
    expected = nearest(rows, 10)
    assert found() == expected
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    assert found() == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 10).collect()
    assert len(few) == 2


def test_ball_tree_prunes_and_stays_exact():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(20, 8)) * 3_000
    vectors = np.floor(centres[draw.integers(0, 20, 3_000)] + draw.normal(size=(3_000, 8)) * 30)
    tree = topk.BallTree(vectors, 64)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(3_000))
    bounds = tree.bounds(vectors[:50])
    for n, leaf in enumerate(tree.leaves):
        assert (bounds[:, n] >= (vectors[:50] @ vectors[leaf].T).max(axis=1)).all()
    best = np.sort(vectors[:50] @ vectors.T, axis=1)[:, -10]
    assert (bounds >= best[:, None]).mean() < 0.5
    ids = np.arange(3_000)
    q, vec, score = topk.search_shard(ids, vectors, ids[:50], vectors[:50], np.full(50, -np.inf), 10)
    for i in range(50):
        products = (vectors @ vectors[i]).astype(int)
        expected = sorted((-p, j) for j, p in enumerate(products) if j != i)[:10]
        assert list(zip((-score[q == i]).tolist(), vec[q == i].tolist(), strict=True)) == expected


def test_large_components_stay_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 1.0]])
    assert topk._products(a, b)[0, 0] == 2**40 * (2**20 + 1) + 3


# --- toxicity --------------------------------------------------------------


def test_block_max_search_is_exact():
    draw = random.Random(6)
    vectors = []
    for _ in range(400):
        raw = {draw.randrange(40): draw.random() for _ in range(draw.randint(0, 5))}
        length = sum(x * x for x in raw.values()) ** 0.5
        vectors.append({t: x / length for t, x in raw.items()})
    index = toxicity.BlockMaxIndex(vectors, 40, block=8)
    place = {row: p for p, row in enumerate(index.order)}
    for query in vectors[:150]:
        cosines = [(-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), place[i], i) for i, v in enumerate(vectors)]
        expected = [(-c, i) for c, _, i in sorted(c for c in cosines if c[0] < 0)[:7]]
        got = index.nearest(query, 7)
        assert [i for _, i in got] == [i for _, i in expected]
        assert np.allclose([c for c, _ in got], [c for c, _ in expected])


def test_isotonic():
    votes, levels = toxicity.isotonic([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1), (0.9, 1)])
    assert votes == [0.1, 0.2, 0.9] and levels == [0.0, 0.5, 1.0]


def test_toxicity_on_held_out_rows_and_edges(spark):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = [draw.choice("abcdefghij") * draw.randint(1, 4) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words[draw.randrange(20)] = draw.choice(["zork", "blarg"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "ZORK, blarg!", "en"), (None, "zork", "en"), (0, rows[0][1], "en")]
    labels += [(5002, 1, None), (None, 1, 1), (0, 0, 1), (9999, 0, 0)]
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, known).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert by_id[5000]["score"] == by_id[5001]["score"] < 0.5 < by_id[5002]["score"] and by_id[None]["predicted"] == 1
    near = by_id[5002]["neighbours"]
    assert near and all(n["toxic"] == 1 for n in near) and near[0]["cosine"] >= near[-1]["cosine"]
    assert toxicity.report(docs.limit(0), known).collect() == []
    assert {r["score"] for r in toxicity.report(docs, known.limit(0)).collect()} == {0.0}


# --- pages -----------------------------------------------------------------


def test_page_markup():
    page = """<html><head><title>T</title><style>p{}</style></head><body><!-- x --><header>Site</header>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use</div>
    <article><header><h1>Head &amp; tail</h1></header><p>One<br>two <b>three</b>four<p>Caf&eacute;&nbsp; x &#33; &lt;p&gt;
    <script>var t="</p>";</script><div class='ad'>Buy</div><form><p>Name</p></form>
    <section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>End</footer></body></html>"""
    blocks = [t for kind, t in html_extract.blocks_of(page) if kind == html_extract.KEEP]
    assert blocks == ["Head & tail", "One two threefour", "Café x ! <p>"]
    assert html_extract.blocks_of(None) == html_extract.blocks_of("") == html_extract.blocks_of("<p> </p>") == []
    assert html_extract.blocks_of("a < b <p>c<") == [(html_extract.OPEN, "a < b"), (html_extract.OPEN, "c<")]


def test_repeated_runs_against_all_windows():
    draw = random.Random(12)
    streams = [[[draw.choice("abc") for _ in range(draw.randint(0, 15))] for _ in range(3)] for _ in range(12)]
    pages = [1, 2, 2, *range(3, 12)]
    where = {}
    for p, stream in zip(pages, streams, strict=True):
        for b in stream:
            for i in range(len(b) - 4):
                where.setdefault(tuple(b[i : i + 5]), set()).add(p)
    for stream, marks in zip(streams, html_extract.repeated(streams, pages), strict=True):
        for b, mark in zip(stream, marks, strict=True):
            expected = np.zeros(len(b), bool)
            for i in range(len(b) - 4):
                if len(where[tuple(b[i : i + 5])]) > 1:
                    expected[i : i + 5] = True
            assert (mark == expected).all()


def test_host_boilerplate_and_edges(spark):
    line = "<p>Follow our weekly letter for all news</p>"
    rows = [(i, f"https://Host.example/{i}", f"<body>{line}<p>Story number {i} tells of w{i}</p></body>") for i in range(6)]
    rows += [(10, "https://other.example/", f"<body>{line}</body>"), (11, None, None), (12, "x", ""), (12, "x", ""), (None, "y", "<p>hi")]
    schema = "page_id long, url string, html string, host string, text string, part int"
    df = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], schema)
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in html_extract.extract(df).collect())
    expected = [(i, f"Story number {i} tells of w{i}") for i in range(6)]
    expected += [(10, "Follow our weekly letter for all news"), (11, ""), (12, ""), (12, ""), (-1, "hi")]
    assert got == sorted(expected)
    assert html_extract.extract(df.limit(0)).collect() == []


def test_page_query(spark):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = load()["op10_html_text"][0](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == " ".join(filter(None, parts)) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


#: The same markup as one pattern, for short texts.
PLAIN_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{html_extract.RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)


def test_markup_is_found_as_by_a_pattern():
    draw = random.Random(8)
    bits = ["<a ", "</p>", "<p", ">", "'", '"', "x", " ", "<!--", "-->", "<script", "</script >", "</SCRIPT>", "<title>", "<!", "<?", "=", "<b>", "/", "<titles>"]
    for _ in range(20_000):
        page = "".join(draw.choices(bits, k=draw.randrange(1, 16)))
        mine = [(t.start, t.end, t.name, t.closes, t.rest) for t in html_extract.Tags(page)]
        plain = [(m.start(), m.end(), (m["name"] or "").lower(), bool(m["end"]), m["rest"] or "") for m in PLAIN_TAG.finditer(page)]
        assert mine == plain, page


@pytest.mark.parametrize(
    "bit", ["<a ", '<a "', "<a '", "<a '<a \"", "<script ", "<script>", "</p", "<!--", "<![", "<div>", "<div></p>", "<a \"'", "</script", "<article><nav>", '<div class="menu"><article>']
)
def test_long_broken_markup_is_linear(bit):
    page = bit * (1_000_000 // len(bit))
    begin = time.time()
    blocks = html_extract.blocks_of(page + "end")
    assert time.time() - begin < 10 and len(blocks) <= 1 + 500_000


# --- pipeline --------------------------------------------------------------


def test_pipeline_against_plain_rules(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    spelled = [(d[0], d[1]) for d in docs if any(c.isalpha() for c in d[1] or "")]
    kept = {int(i) for i, _, c in near_classes(spelled, 5, 80) if i == c}
    clean = set()
    for i, text in spelled:
        n, hit, _ = overlap(text, items)
        if i in kept and not (hit and 20 * hit >= n):
            clean.add(i)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(clean)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_pipeline_stages_on_odd_rows(spark):
    text = "some words that stand in no benchmark and are long enough to be compared"
    rows = [(1, None, None), (2, "", "en"), (3, "123 456", "en"), (4, text, "en"), (4, text, "en"), (4, "another text of its own", "en")]
    rows += [(9, text, "en"), (5, f"{text} token=abcdefgh12 end", "en"), (6, "only one word", None)]
    rows += [(7, "a sentence of another kind with token=abcdefgh12 in it", "en")]
    docs = frame(spark, rows).drop("score", "ids", "key").withColumn("found", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, DATA).columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), DATA).collect() == []
        docs = stage(spark, docs, DATA).withColumn("found", F.lit(1)).checkpoint()
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    # documents 4 and 5 share 10 of 12 five-word n-grams
    clean = "a sentence of another kind with [SECRET] in it"
    assert left == [(4, "another text of its own"), (4, text), (6, "only one word"), (7, clean)]
    assert [r["n_chars"] for r in docs.where("doc_id = 7").collect()] == [len(clean)]
    assert {r["lang"] for r in docs.collect()} == {"en"}  # found by the model, also where the input has none


def test_large_hosts_in_several_groups(spark, monkeypatch):
    line = "<p>Follow our weekly letter for all news</p>"
    rows = [(i, f"https://a.example/{i}", f"<body>{line}<p>Story {i}</p></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (10, 0):
        monkeypatch.setattr(html_extract, "MOST_BROADCAST", most)
        got = html_extract.extract(df, group_bytes=2_000).collect()
        assert sorted((r["page_id"], r["text"]) for r in got) == [(i, f"Story {i}") for i in range(60)]


PAGES = "page_id long, url string, html string"


def test_repeats_across_groups_of_a_host(spark):
    quote = " ".join(f"q{i}" for i in range(20))
    rows = [(i, f"https://a.example/{i}", f"<p>Story {i} has words {'x' * 300}{i}</p>") for i in range(80)]
    for i, j in [(1, 2), (11, 12), (21, 22), (31, 32), (41, 42), (51, 52)]:
        for k in (i, j):
            rows[k] = (*rows[k][:2], rows[k][2] + f"<p>Only pages {i} and {j} say this</p>")
    for k in (3, 13, 23):
        rows[k] = (*rows[k][:2], rows[k][2] + f"<p>Start {k} {quote} end{k}</p>")
    df = spark.createDataFrame(rows, PAGES)
    whole = sorted(tuple(r) for r in html_extract.extract(df).collect())
    assert whole[1][2] == f"Story 1 has words {'x' * 300}1" and whole[3][2].endswith("Start 3 end3")
    for group_bytes in (400, 2_000, 9_000):
        assert sorted(tuple(r) for r in html_extract.extract(df, group_bytes).collect()) == whole


def test_copies_of_a_page_and_phrases_stay(spark):
    copy = "<p>A whole story of more than five words</p><p>and its second part which is long too</p>"
    quote = " ".join(f"q{i}" for i in range(20))
    phrase = "he said in the end that nothing was lost"
    rows = [(1, copy), (2, f"<nav>print this page now and here</nav>{copy}"), (3, copy)]
    rows += [(i, f"<p>Writer {i} tells that {phrase} on day {i}</p>") for i in (4, 5, 6)]
    rows += [(i, f"<p>Report {i} quotes {quote} on day {i}</p>") for i in (7, 8)]
    df = spark.createDataFrame([(i, "https://a.example/", h) for i, h in rows], PAGES)
    for group_bytes in (2_000_000, 100):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, group_bytes).collect()}
        story = "A whole story of more than five words and its second part which is long too"
        assert [got[i] for i in (1, 2, 3)] == [story] * 3
        assert [got[i] for i in (4, 5, 6)] == [f"Writer {i} tells that {phrase} on day {i}" for i in (4, 5, 6)]
        assert [got[i] for i in (7, 8)] == [f"Report {i} quotes {quote} on day {i}" for i in (7, 8)]


def test_names_do_not_drop_the_article():
    text = lambda page: [t for kind, t in html_extract.blocks_of(page) if kind != html_extract.DROP]
    story = "<article><p>Story</p></article>"
    for page in (
        f'<body class="has-sidebar"><div class="sidebar">Side</div>{story}</body>',
        f'<html class="no-comments modal"><body id="menu">{story}</body></html>',
        f'<div id="page" class="with-header">{story}</div>',
        f'<div class="sidebar">{story}</div>',
        '<article class="post related-story"><p>Story</p></article>',
        '<main class="content share"><p>Story</p></main>',
        '<div class="header-image"><p>Story</p></div><ul class="main-menu"><li>Go</li></ul><div class="menu-list">Go</div>',
        f'{story}<section class="comments"><article class="comment">First!</article></section><div class="related-posts related">{story}</div>',
        '<div class="post">Story</div><ol class="comment-list"><li><article>First!</article></li></ol>',
    ):
        assert text(page) == ["Story"], page


def test_pipeline_near_copies_under_one_id_and_under_null_ids(spark):
    text = lambda name: " ".join([f"{name[0]}{k}" for k in range(60)] + [name])
    rows = [(7, text(f"a-{i}"), "en") for i in "xyz"] + [(None, text(f"b-{i}"), "en") for i in "xyz"]
    rows += [(7, text("c-x"), "en"), (8, text("c-y"), "en"), (8, text("d"), "en"), (None, text("d"), "en"), (None, text("e"), "en")]
    rows += [rows[0], rows[3]]
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), DATA).collect()
    got = sorted((str(r["doc_id"]), r["text"][0]) for r in kept)
    assert got == [("7", "a"), ("7", "c"), ("8", "d"), ("None", "b"), ("None", "e")]


def test_toxicity_with_few_labels_and_with_rare_toxic_words(spark):
    draw = random.Random(3)
    plain = lambda: [draw.choice("abcdefghijklmnop") * draw.randint(1, 4) for _ in range(12)]
    few = [(i, " ".join(plain() + ["zork", "blarg", "gnarf"][: 3 * (i % 6 == 0)]), "en") for i in range(60)]
    docs = frame(spark, few + [(900, "zork blarg", "en"), (901, "abc", "en")])
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 6 == 0)) for i, _, _ in few], "doc_id long, toxic int"))
    assert {"zork", "blarg", "gnarf"} <= set(model.numbers)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert scores[900] > scores[901]
    rare = [(i, " ".join(plain() + ["zork"] * (i in (7, 8, 9))), "en") for i in range(900)]
    model = toxicity.learn(frame(spark, rare), spark.createDataFrame([(i, int(i in (7, 8, 9))) for i, _, _ in rare], "doc_id long, toxic int"))
    assert "zork" in model.numbers


def test_toxicity_examples_are_bounded_by_ids(spark):
    rows = [(i % 30, f"text {i} of {'bad words' if i % 2 else 'good words'}", "en") for i in range(300)] + [(7, f"hot {i}", "en") for i in range(2_000)]
    rows += [(3, None, "en"), (None, "x", "en")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1)], "doc_id long, toxic int")
    for most in (1, 11, 25):
        model = toxicity.learn(docs, labels, most)
        assert len(model.ids) <= most
    again = toxicity.learn(docs.repartition(7), labels, 25)
    assert (again.ids, again.labels) == (model.ids, model.labels)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (100, [1e308, 1.0]), (1, [1e300, 1e300]), (2, [-1e300, 0.0]), (3, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()]
    top = 2**63 - 1
    assert sorted(got) == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 2, -top)]


def test_toxicity_query_against_all_cosines(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(F.expr("pmod(crc32(cast(doc_id AS string)), 5) != 0"))
    model = toxicity.learn(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}

    def vector(text):
        counts = Counter(w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if w in model.numbers)
        raw = np.zeros(len(model.numbers))
        for w, n in counts.items():
            raw[model.numbers[w]] = (1 + np.log(n)) * model.idf[model.numbers[w]]
        return raw / (np.linalg.norm(raw) or 1)

    examples = np.array([vector(texts[i]) for i in model.ids])
    place = {row: p for p, row in enumerate(model.index.order)}
    got = {r["doc_id"]: r for r in load()["op1_toxicity"][0](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        cosines = np.round(examples @ vector(text), 12)
        near = sorted((row for row in np.flatnonzero(cosines > 0).tolist()), key=lambda r: (-cosines[r], place[r]))[:15]
        weights = [cosines[r] ** 4 for r in near]
        vote = (model.prior + sum(w * model.labels[r] for w, r in zip(weights, near, strict=True))) / (1 + sum(weights))
        score = float(np.interp(round(vote, 9), model.steps, model.levels))
        row = got[i]
        assert row["score"] == pytest.approx(score, abs=1e-6) and row["predicted"] == int(row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert sorted(n["cosine"] for n in row["neighbours"]) == pytest.approx(sorted(cosines[near].tolist()), abs=1e-9)

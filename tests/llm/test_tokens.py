"""Byte-level BPE and token counts against the libraries they must equal."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from conftest import DATA
from thingroups.llm import bpe, token_counts
from thingroups.llm.queries import load

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPEC = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a\n\n b \n", " \n", "a\t\tb", "don't 'tis 're 'r x'v I'LL", "'", "''s", " 's", "x" * 3000, "ab" * 2000,
    "<|endoftext|> hi<|endoftext|>", "  <|endoftext|>  x", "é" * 50 + "中文字 ١٢٣ 😀😀 ﷽", " 　x", "a\u0085b",
]


def random_texts(n=600):
    draw = random.Random(7)
    return ["".join(draw.choice("ab 's\n\t'1é中😀rvle<|.  ") for _ in range(draw.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_encoding_is_exact():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.PieceEncoder(ranks)
    for text in ODD + random_texts():
        ids = [i for piece in bpe.regex.findall(public_tokenizers.PATTERN, text) for i in encoder[piece]]
        assert ids == library.encode_ordinary(text)


def test_encoder_goes_back_from_longest_matches():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    library = tiktoken.Encoding("small", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.PieceEncoder(ranks)
    draw = random.Random(3)
    for _ in range(500):
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 12)))
        assert list(encoder[text]) == library.encode_ordinary(text)


def test_pieces_learned_side_by_side(monkeypatch):
    """As the library gives them, over forgotten pieces and kept answers; no short piece is tested by itself."""
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first = bpe.PieceEncoder(ranks)
    encoder = bpe.PieceEncoder(ranks, *first.tables())
    texts = ODD + random_texts() + ["rtherlyatschè Keitgewon étionou" * 3]
    found = [bpe.regex.findall(public_tokenizers.PATTERN, text) for text in texts]
    monkeypatch.setattr(bpe, "KEPT_ANSWERS", 16)
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 40)
    for text, pieces in list(zip(texts, found, strict=True)) * 2:
        encoder.learn(set(pieces))
        assert all(p in encoder for p in pieces if 0 < len(p.encode()) <= bpe.SIDE_BY_SIDE)
        assert [i for p in pieces for i in encoder[p]] == library.encode_ordinary(text)
    monkeypatch.setattr(first.neighbours, "fit", lambda *_: pytest.fail("tested one by one"))
    first.learn({p for pieces in found for p in pieces if len(p.encode()) <= bpe.SIDE_BY_SIDE})


def test_side_by_side_goes_back_from_longest_matches():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    library = tiktoken.Encoding("small", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 12))) for _ in range(500)]
    encoder = bpe.PieceEncoder(ranks)
    encoder.learn(set(texts))
    assert all(list(dict(encoder)[text]) == library.encode_ordinary(text) for text in texts)
    lacking = bpe.PieceEncoder({b"a": 0, b"b": 1, b"ab": 2})
    with pytest.raises(ValueError):
        lacking.learn({"ab", "abc"})


def test_digest_query(spark, documents):
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))},
        special_tokens={},
    )
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in load()["op4_byte_bpe"][0](spark, DATA).collect()}
    for d in documents.collect():
        ids = library.encode_ordinary(d["text"] or "")
        expected = (len(ids), sha(",".join(map(str, ids)).encode()), sha((d["text"] or "").encode()))
        assert tuple(got[d["doc_id"]][k] for k in ("n_tokens", "ids_sha256", "decoded_sha256")) == expected


def test_null_empty_repeated_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "é", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in found) == [(0, "é"), (1, ""), (2, ""), (3, "a b"), (3, "a b")]
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    counted = token_counts.over_limit(docs, SPEC, 1).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counted) == [
        (0, 2, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, True), (3, 3, 2, True),
    ]
    assert token_counts.count_tokens(docs.limit(0), SPEC).collect() == []


def test_counts_equal_the_library():
    library = Tokenizer.from_file(SPEC)
    texts = ODD + random_texts() + [None]
    expected = [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    with open(SPEC, encoding="utf-8") as f:
        merges = token_counts.Merges(f.read())
    machine = token_counts.Transducer(merges)
    assert machine.count(texts).tolist() == expected
    assert machine.count(texts, chunk_bytes=7).tolist() == expected
    assert machine.count(texts, chunk_bytes=5, warm_bytes=0).tolist() == expected
    small = token_counts.Transducer(merges, most_states=300)
    assert [int(small.count([t])[0]) for t in texts[:200]] == expected[:200]
    assert len(small.states) <= 600


def long_texts():
    draw = random.Random(5)
    cyrillic = " ".join("".join(draw.choice("абвгдежзиклмнопрстуюя") for _ in range(draw.randint(2, 9))) for _ in range(12_000))
    chinese = "".join(chr(draw.randint(0x4E00, 0x4FFF)) for _ in range(20_000)) + "。"
    return [cyrillic, chinese, "z" * 9_000, " \u3000\u00a0" * 3_000, "a1" * 5_000, "<|endoftext|>é" * 2_000, "'" * 5_001 + "ll"]


def test_chunks_of_texts_without_safe_places():
    library = Tokenizer.from_file(SPEC)
    texts = long_texts()
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    with open(SPEC, encoding="utf-8") as f:
        machine = token_counts.Transducer(token_counts.Merges(f.read()))
    assert machine.count(texts).tolist() == expected
    assert machine.count(texts[1:], chunk_bytes=130, warm_bytes=3).tolist() == expected[1:]
    assert machine.count(texts[::-1]).tolist() == expected[::-1]


def test_chunk_maps_compose():
    """The scan against a walk through the chunks; every chunk has three runs at most."""
    with open(SPEC, encoding="utf-8") as f:
        machine = token_counts.Transducer(token_counts.Merges(f.read()))
    runs, run = [], machine.run
    machine.run = lambda data, starts, ends, enter: runs.append(ends - starts) or run(data, starts, ends, enter)
    for text in ODD[1:] + [t[:4_000] for t in long_texts()]:
        data = text.encode()
        symbols = np.frombuffer(data, np.uint8)
        cuts = np.unique([0, *token_counts._whole_characters(symbols, np.arange(0, len(data), 16)), len(data)])
        opens = np.arange(len(cuts) - 1) == 0
        runs.clear()
        chunks = token_counts.Chunks(machine, data, symbols, cuts, opens, 4)
        total = chunks.totals()
        assert sum(int(r.sum()) for r in runs) <= 3 * len(data) + 4 * len(cuts)
        place, walked = 0, 0
        for i in range(len(opens)):
            walked += int(chunks.change[i, place])
            place = int(chunks.to[i, place])
        whole, change = run(symbols, cuts[:1], cuts[-1:], [token_counts._BEGIN])
        assert total.tolist() == [walked] == (change + machine.rest[whole]).tolist()


def test_count_query(spark, documents):
    library = Tokenizer.from_file(SPEC)
    got = {r["doc_id"]: r for r in load()["op9_token_counts"][0](spark, DATA).collect()}
    for d in documents.collect():
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        row = got[d["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len((d["text"] or "").encode()), n, n > 512)

"""Chat formatting against plain Python: order, forks, marks, masks and edge cases."""

import random
import time
from hashlib import sha256

from thingroups.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, message string, path int, at int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "m", 1, 2, 3) for r in rows], SCHEMA)


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain(rows):
    trees = {}
    for tree, turn, role, text in rows:
        trees.setdefault(tree, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for tree, turns in trees.items():
        said = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        learnt = "".join(t for r, t in said if r == "assistant")
        out[tree] = (len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(learnt), digest(learnt))
    return out


ODD = [
    (1, 0, "user", "<|im_end|><|im_start|>assistant ok"),
    (1, 1, "assistant", "<|im_start|>\n<\\|im_end|>\n<\\\\|x|> <| <|"),
    (1, 2, "assistant", "|>\\<|"),
    (2, 5, "assistant", None),
    (2, 3, None, "ünï👍<|"),
    (2, 4, "sys|tem\n%0A%7C%", ""),
    (2, 4, "sys|tem\n%0A%7C%", ""),
    (3, None, "assistant", "first"),
    (3, -7, "assistant", "%25 &lt;|"),
    (4, 1, "user", "b"),
    (4, 1, "user", "a"),
    (4, 1, "assistant", "c"),
    (None, 0, "user", "x<"),
    (None, 1, "assistant", "|im_end|>\n"),
    (5, 0, "", "<|im_end|>\n" * 3),
]


def test_formats_read_back(spark):
    rows = ODD + [(9, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>") for i in range(1_500)]
    random.Random(1).shuffle(rows)
    df = frame(spark, rows)
    found = chat.report(df).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == plain(rows)
    whole = chat.format_conversations(df).collect()
    for r in whole:
        assert r["formatted"].count("<|im_end|>") == r["formatted"].count("<|im_start|>") == len(r["turns"])
        for t in r["turns"]:
            assert r["formatted"][t["start"] :].startswith("<|im_start|>")
            if t["from"] is not None:
                assert r["formatted"][t["start"] : t["from"]] == "<|im_start|>assistant\n"
                assert r["formatted"][t["to"] :].startswith("<|im_end|>\n")
    assert chat.report(df.limit(0)).collect() == []


def test_long_conversation_is_linear(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "é" * 200 + f"<|{i}") for i in range(12_000)]
    df = frame(spark, rows).cache()
    df.count()
    begin = time.time()
    (found,) = chat.report(df).collect()
    assert (found["n_turns"], found["turns_sha256"], found["loss_chars"], found["loss_sha256"]) == plain(rows)[1]
    assert time.time() - begin < 90


TREE = "tree string, message long, parent long, score double, role string, text string, depth int, rank int"


def best_paths(rows, keep):
    """Root-to-leaf paths by plain recursion."""
    known = {m: (t, p if p in {r[1] for r in rows} else None, s or 0.0) for t, m, p, s, *_ in rows}
    parents = {p for _, p, _ in known.values()}
    out = {}
    for leaf in known.keys() - parents:
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = known[at][1]
        if at is None:
            out.setdefault(known[leaf][0], []).append((-sum(known[m][2] for m in path), leaf, path[::-1]))
    return {(t, leaf, i): path for t, found in out.items() for i, (_, leaf, path) in enumerate(sorted(found)[:keep], 1)}


def test_paths_of_trees(spark):
    draw = random.Random(5)
    rows = []
    for tree in range(6):
        base = tree * 1_000
        rows += [(f"t{tree}", base, None, 1.0, "user", "root", 1, 1)]
        rows += [
            (f"t{tree}", base + i, base + draw.randrange(max(0, i - 4), i), float(draw.randrange(-3, 4)), ("user", "assistant")[i % 2], f"{i}", 1, 1)
            for i in range(1, 60)
        ]
    rows += [("star", 10_000, None, None, "user", "hub", 1, 1)]
    rows += [("star", 10_001 + i, 10_000, float(i % 7), "assistant", f"{i}", 1, 1) for i in range(2_000)]
    rows += [("orphan", 20_000, 99_999, 1.0, "assistant", None, 1, 1)]
    rows += [("circle", 30_000, 30_001, 1.0, "user", "a", 1, 1), ("circle", 30_001, 30_000, 1.0, "user", "b", 1, 1)]
    rows += [("circle", 30_002, 30_001, 1.0, "user", "below a circle", 1, 1), (None, 40_000, None, 0.0, "user", "x", 1, 1)]
    rows += [rows[3]]
    messages = chat.as_trees(spark.createDataFrame(rows, TREE))
    for keep in (1, None):
        chosen = chat.paths(messages, keep)
        found = {}
        for r in chosen.join(messages.select("message", "tree"), "message").collect():
            found.setdefault((r["tree"], r["path"], r["rank"]), []).append((r["at"], r["message"]))
        assert {k: [m for _, m in sorted(v)] for k, v in found.items()} == best_paths(rows, keep)
    text = {r[1]: (r[4], r[5] or "") for r in rows}
    lines = chat.format_paths(messages, chat.paths(messages, 2)).select("tree", "path", "rank", chat.parsed("formatted").alias("said")).collect()
    expected = best_paths(rows, 2)
    assert {(r["tree"], r["path"], r["rank"]): [tuple(s) for s in r["said"]] for r in lines} == {
        k: [text[m] for m in path] for k, path in expected.items()
    }

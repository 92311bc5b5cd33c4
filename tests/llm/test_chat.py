"""Reply trees and chat formatting, held against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from flowtrail.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\|im_end|>", "a<|im_start|>assistant\nhi<|im_end|>\n", "[\\INST]", "\\", "<", "[", "<<s>", "", None, "two\nlines\n", "日本<s>", "$1 \\1", "x" * 30_000]


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_escape_is_reversible_and_leaves_no_control_string(spark, text):
    r = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
    assert r.u == text
    assert not any(c in r.e for c in ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"))
    if text == "plain < text [":
        assert r.e == text


def conversation_rows():
    rng = random.Random(2)
    rows = [(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(NASTY)]
    rows += [(2, 5, "user", "b"), (2, 3, "assistant", "a"), (2, None, None, None), (2, 3, "assistant", "a"), (2, 3, "assistant", None), (None, 1, "user", "no id"), (None, 0, "assistant", "none"), (3, 0, "odd role\n|>", "x")]
    rows += [(4, t, rng.choice(["user", "assistant"]), f"t{t}") for t in range(700)] + [(5, -3, "assistant", "only")]
    return rows


def test_conversations(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({"tree": F.lit("clash"), "node": F.lit("clash"), "part": F.lit(1)})
    got = {r.conv_id: r for r in chat.parse(chat.table(chat.conversations(df), "t")).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(t[2] or "", t[3] or "") for t in turns]
        assert r.n_turns == len(turns) and r.loss_text == "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert len(r.loss) == sum(t[2] == "assistant" for t in turns)
        ends = [(s.start, s.start + s.length) for s in r.loss]
        assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))


def test_empty_table(spark):
    assert chat.conversations(spark.createDataFrame([], TURNS)).count() == 0


def brute_paths(nodes, top):
    """tree -> its best paths, as lists of nodes from the root."""
    out = {}
    for tree in {n[0] for n in nodes}:
        parent = {n[1]: n[2] for n in nodes if n[0] == tree}
        score = {n[1]: n[3] or 0.0 for n in nodes if n[0] == tree}
        parent = {k: (p if p in parent else None) for k, p in parent.items()}
        leaves, paths = set(parent) - {p for p in parent.values() if p is not None}, []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = parent[at]
            if at is None:
                paths.append((-sum(score[n] for n in path), leaf, path[::-1]))
        if paths:
            out[tree] = [(leaf, p) for _, leaf, p in sorted(paths)[:top]]
    return out


@pytest.mark.parametrize("top", [1, 3])
def test_paths(spark, top):
    rng = random.Random(4)
    nodes = []
    for tree in range(12):
        for n in range(rng.randint(1, 40)):
            nodes.append((f"t{tree}", n, rng.choice([None, *range(n)]) if n else None, rng.choice([None, 0.5, 1.0, 2.0])))
    nodes += [("deep", n, n - 1 if n else None, 1.0) for n in range(300)] + [("cycle", 1, 2, 1.0), ("cycle", 2, 1, 1.0), ("cycle", 3, 2, 1.0), ("cycle", 9, None, 1.0), ("lost", 5, 77, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.paths(df, top).collect():
        got.setdefault((r.tree, r["rank"], r.leaf), []).append((r.place, r.node))
    want = {(tree, k + 1, leaf): list(enumerate(path)) for tree, ps in brute_paths(nodes, top).items() for k, (leaf, path) in enumerate(ps)}
    assert {k: sorted(v) for k, v in got.items()} == want

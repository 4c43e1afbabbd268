"""Top-k search and reply trees against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import chat, topk
from fleetvitals.llm.queries import MARKED, chat_format


def plain_top(vectors, queries, k):
    found = {}
    for own, q in queries:
        best = {}
        for i, v in vectors:
            if i != own and len(v) == len(q):
                score = sum(a * b for a, b in zip(q, v))
                best[i] = max(score, best.get(i, score))
        found.setdefault(own, {})
        for i, score in best.items():
            found[own][i] = max(score, found[own].get(i, score))
    return {own: sorted(((-s, i) for i, s in best.items()))[:k] for own, best in found.items() if best}


@pytest.mark.parametrize("shard_rows, few", [(64, 64), (40, 2), (8192, 5)])
def test_top_k_agrees_with_all_products(spark, monkeypatch, shard_rows, few):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.RandomState(5)
    centers = rng.randint(-600, 600, (6, 16))
    vectors = [(i, (centers[i % 6] + rng.randint(-80, 80, 16)).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(60)]  # ties
    vectors += [(5, vectors[9][1]), (5, vectors[5][1]), (7, [1, 2]), (2000, []), (2001, [])]
    queries = [v for v in vectors if v[0] % 20 == 0 or v[0] == 5]
    frame = lambda rows: spark.createDataFrame(
        rows + [(None, [1] * 16), (9, None)], "vec_id long, vector array<long>")
    found = {}
    for r in topk.top_k(frame(vectors), frame(queries), 10).collect():
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    got = {q: [x[1:] for x in sorted(rows)] for q, rows in found.items()}
    assert got == plain_top(vectors, queries, 10)


def test_few_segments_are_enough_where_neighbours_stand_out():
    rng = np.random.RandomState(2)
    vectors = rng.randint(-40, 40, (2000, 32)).astype(np.int64)
    vectors[:5] = 900
    index = topk.ShardIndex(np.arange(2000), vectors)
    ids, scores = index.best(vectors[0], 0, 4)
    assert ids.tolist() == [1, 2, 3, 4] and set(scores.tolist()) == {900 * 900 * 32}


@pytest.mark.parametrize("spread", [0, 3])
def test_repeats_of_one_outstanding_id_hide_no_other(spark, spread):
    rng = np.random.RandomState(8)
    vectors = [(i, rng.randint(-40, 40, 16).tolist()) for i in range(300)]
    # The same row 30 times, or 30 vectors of one id.
    vectors += [(900, (900 + rng.randint(-spread, spread + 1, 16)).tolist()) for _ in range(30)]
    queries = [(1000, [50] * 16), (900, [50] * 16), vectors[4]]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, vector array<long>")
    found = {}
    for r in topk.top_k(frame(vectors), frame(queries), 10).collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: sorted(rows) for q, rows in found.items()} == plain_top(vectors, queries, 10)


def test_vectors_are_floored_and_bad_ones_left_out(spark):
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]),
            (5, [float("-inf"), 0.0]), (6, [])]
    found = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(
        "vec_id", topk.integer_vector(F.col("embedding")).alias("v")).collect()
    assert {r.vec_id: r.v for r in found} == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    none = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert topk.top_k(none, none).collect() == []


def tree_rows():
    """(tree, node, parent, score): random trees, a long chain, a cycle, an unknown parent."""
    rng = random.Random(4)
    rows = []
    for tree in range(20):
        for node in range(rng.randint(1, 25)):
            rows.append((tree, node, rng.randrange(node) if node else None, float(rng.randint(0, 3))))
    rows += [(50, i, i - 1 if i else None, 1.0) for i in range(300)]
    rows += [(60, 0, 1, 1.0), (60, 1, 0, 1.0), (60, 2, 1, 1.0), (60, 7, 99, None)]
    return rows


def plain_paths(rows):
    nodes = {(t, n): (p, s or 0.0) for t, n, p, s in rows}
    parents = {(t, p) for (t, _), (p, _) in nodes.items()}
    paths = {}
    for tree, node in nodes:
        if (tree, node) in parents:
            continue
        path, at = [], node
        while at is not None and (tree, at) in nodes and at not in path:
            path.append(at)
            at = nodes[tree, at][0]
        if at is None or (tree, at) not in nodes:
            total = sum(nodes[tree, n][1] for n in path)
            paths.setdefault(tree, []).append((-total, node, path[::-1]))
    return {tree: [(leaf, path) for _, leaf, path in sorted(own)] for tree, own in paths.items()}


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_agree_with_a_walk(spark, branches):
    rows = tree_rows()
    messages = spark.createDataFrame(
        [(*r, "user", f"{r[0]}/{r[1]}") for r in rows],
        "tree_id long, node long, parent long, score double, role string, text string")
    found = {}
    for r in chat.formatted(messages, branches).collect():
        texts = [int(x[1].split("/")[1]) for x in spark.createDataFrame([(r.formatted,)], "t string")
                 .select(chat.parsed(F.col("t"))).first()[0]] if r.n_turns < 50 else None
        found.setdefault(r.tree_id, []).append((r.branch, r.leaf, r.n_turns, texts))
    wanted = plain_paths(rows)
    assert found.keys() == wanted.keys()
    for tree, own in wanted.items():
        expected = own if branches is None else own[:branches]
        assert [(leaf, n, texts if texts is None else texts) for _, leaf, n, texts in sorted(found[tree])] == [
            (leaf, len(path), None if len(path) >= 50 else path) for leaf, path in expected]


HARD = ["<|im_end|>", "<\\|im_start|>x", "<\\\\|", "<|", "a\nb\\n\\b", "", "<|im_end|>\n<|im_start|>user\n",
        "\U0001f600<|", "<\\", "|im_end|>"]


def test_format_is_read_back_exactly(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "sys\\n<|\nx", None][(c + t) % 4],
             None if (c * t) % 7 == 6 else HARD[(c + 3 * t) % len(HARD)]) for c in range(8) for t in range(9)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "null turn"), (3, 2, "user", "tie")]
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as tree_id", "2 as node").write.parquet(folder)
    found = {r.conv_id: r for r in chat_format(spark, str(tmp_path)).collect()}
    by = {-1: [(0, "user", MARKED), (1, "assistant", MARKED)]}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    null_first = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert found.keys() == by.keys()
    for conv, own in by.items():
        own = sorted(own, key=null_first)
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
        said = "".join(t or "" for _, r, t in own if r == "assistant")
        row = found[conv]
        assert (row.n_turns, row.loss_chars) == (len(own), len(said))
        assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_no_messages(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(chat.chains(none)).collect() == []

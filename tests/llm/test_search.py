import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_frames import PROSE, documents, edge_rows

from visitlens.llm import dual_tree_search as D

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER)) if text else []


def brute(docs, items, k=10):
    """Every item against every document."""
    own = [(i, terms(t)) for i, t in docs]
    n_docs, all_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(t for _, ts in own for t in set(ts))
    out = []
    for item, text in items:
        asked, found = terms(text), []
        for place, (ident, ts) in enumerate(own):
            tf, score = Counter(ts), 0
            m = 25 + (75 * len(ts) * n_docs) // all_terms if all_terms else 0
            for t in asked:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, ident is None, ident or 0, place, ident))
        out += [(item, r + 1, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(400 * rng.random() ** 2)}" for _ in range(2000)] + PROSE.split()
    made = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    made += [(1000 + i, made[3][1]) for i in range(30)]  # ties
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(50)]
    items += [(50, made[3][1]), (51, ""), (52, None), (53, "nowhere-else"), (54, "w1 w1 w1 W1"), (54, "w1 w1 w1 W1")]
    return made, items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    made, items = corpus(seed, 500)
    rows = [(i, t, "s") for i, t in made] + edge_rows()
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.search(documents(spark, rows).repartition(3), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == sorted(brute([r[:2] for r in rows], items), key=str)


def test_small_trees_and_blocks(spark, monkeypatch):
    """Many blocks of items and many trees per task give the same rows."""
    made, items = corpus(5, 300)
    docs = documents(spark, [(i, t, "s") for i, t in made], clashes=False).repartition(2)
    asked = spark.createDataFrame(items[:20], "item_id bigint, text string")
    monkeypatch.setattr(D, "TERMS", 60)
    numbered = asked.selectExpr("item_id as item", "cast(coalesce(text, '') as binary) as text")
    blocks = list(D._blocks(numbered))
    assert 2 < len(blocks) < 20 and all(len({t for _, ts in b for t in ts}) <= 60 for b in blocks)
    assert rows_of(D.search(docs, asked, k=3)) == sorted(brute(made, items[:20], 3), key=str)


def test_pruning_is_exact_and_takes_effect():
    """Documents in one stream of batches: the best are those of plain products, and most pairs are never scored."""
    rng = np.random.default_rng(4)
    width, n = 300, 4000
    topics = rng.integers(0, 30, n)
    vectors = np.zeros((n, width), np.int64)
    for i in range(n):
        vectors[i, topics[i] * 10 + rng.integers(0, 10, 6)] = rng.integers(1, 1000, 6)
        vectors[i, rng.integers(0, width, 2)] = rng.integers(1, 60, 2)
    weights = np.zeros((90, width), np.int64)
    for i in range(90):
        weights[i, (i % 30) * 10 + rng.integers(0, 10, 5)] = rng.integers(1, 9, 5)
    items = D.item_tree(list(range(90)), weights)
    best = D.Best(items, 10, {})
    for begin in range(0, n, 500):
        best.search(vectors[begin : begin + 500].astype(items.weights.dtype), begin)
    scores = weights @ vectors.T
    for place, number in enumerate(items.numbers):
        order = np.lexsort((np.arange(n), -scores[number]))[:10]
        order = order[scores[number][order] > 0]
        assert best.scores[place].tolist() == scores[number][order].tolist()
        assert best.rows[place].tolist() == order.tolist()
    assert best.scored < 0.35 * 90 * n
    # With the k-th best scores known beforehand still less is scored, and the same is found.
    floor = {number: int(np.sort(scores[number])[-10]) for number in range(90)}
    again = D.Best(items, 10, floor)
    for begin in range(0, n, 500):
        again.search(vectors[begin : begin + 500].astype(items.weights.dtype), begin)
    assert [r.tolist() for r in again.rows] == [r.tolist() for r in best.rows] and again.scored < best.scored


def test_bounds_hold():
    rng = np.random.default_rng(8)
    weights = rng.integers(0, 5, (37, 20)) * rng.integers(0, 2, (37, 20))
    items = D.item_tree(list(range(37)), weights)
    nodes = [items.root]
    while nodes:
        node = nodes.pop()
        assert (items.weights[node.begin : node.end][:, node.columns] <= node.most).all()
        assert items.weights[node.begin : node.end].sum() == items.weights[node.begin : node.end][:, node.columns].sum()
        assert not node.children or [c.begin for c in node.children] + [node.end] == [node.begin] + [c.end for c in node.children]
        nodes += node.children
    tree = D.DocumentTree(rng.integers(0, 9, (101, 20)))
    for level, rows in enumerate(tree.levels):
        size = D.LEAF * D.FAN**level
        for g in range(len(rows)):
            assert (tree.vectors[g * size : (g + 1) * size].max(axis=0) == rows[g]).all()
    assert sorted(tree.order.tolist()) == list(range(101))


def test_large_scores_stay_whole_numbers():
    assert D.item_tree([0], np.array([[5, 7]])).weights.dtype == np.float64
    items = D.item_tree([0], np.array([[10**10, 1]]))
    assert items.weights.dtype == np.int64
    best = D.Best(items, 2, {})
    best.search(np.array([[999_999, 1], [999_999, 2]]), 0)
    assert best.scores[0].tolist() == [999_999 * 10**10 + 2, 999_999 * 10**10 + 1]


def test_empty_tables_and_other_types(spark):
    made, items = corpus(1, 20)
    docs = documents(spark, [(i, t, "s") for i, t in made])
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert D.search(docs, asked.limit(0)).collect() == []
    assert D.search(docs.limit(0), asked).collect() == []
    named = docs.selectExpr("concat('d', doc_id) as name", "text as body")
    got = D.search(named, asked.selectExpr("concat('i', item_id) as q", "text as t"), 2, "name", "body", "q", "t").collect()
    assert {r["doc_id"][0] for r in got} == {"d"} and {r["item_id"][0] for r in got} == {"i"}


def test_one_text_for_a_third_of_all_rows(spark):
    made, items = corpus(2, 200)
    rows = made + [(5000 + i, made[7][1]) for i in range(150)]
    docs = documents(spark, [(i, t, "s") for i, t in rows], clashes=False).repartition(4)
    asked = spark.createDataFrame([(0, made[7][1]), *items[1:4]], "item_id bigint, text string")
    assert rows_of(D.search(docs, asked)) == sorted(brute(rows, [(0, made[7][1]), *items[1:4]]), key=str)

import numpy as np
import pytest
from llm_frames import components

from visitlens.llm import embed_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, node string, v int"


def rows():
    rng = np.random.default_rng(1)
    out, ident = [], 0
    for i in range(40):
        middle = rng.standard_normal(16)
        for _ in range(6):
            turn = rng.standard_normal(16)
            turn -= (turn @ middle) / (middle @ middle) * middle
            turn *= np.linalg.norm(middle) / np.linalg.norm(turn)
            c = rng.uniform(0.92, 0.999)
            out.append((ident, (i + 1.0) * (c * middle + np.sqrt(1 - c * c) * turn)))
            ident += 1
        out += [(ident, middle), (ident + 1, middle), (ident + 1, 3 * middle)]
        ident += 2
    odd = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [None] + [1.0] * 15), (-5, [1.0] * 3), (-6, [])]
    odd += [(-7, [float("inf")] + [1.0] * 15), (None, out[0][1])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], "n", 0) for i, v in out + odd]


def brute(data):
    good = [i for i, r in enumerate(data) if r[1] and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([np.float32(data[i][1]).astype(float) for i in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= E.LEAST_COSINE
    root = components(len(good), lambda i, j: close[i, j])
    least = {}
    for i, r in zip(good, root, strict=True):
        if data[i][0] is not None:
            least[r] = min(data[i][0], least.get(r, data[i][0]))
    want = {i: (data[i][0], 0, data[i][0]) for i in range(len(data))}
    for place, (i, r) in enumerate(zip(good, root, strict=True)):
        want[i] = (data[i][0], int(close[place].sum()) - 1, least.get(r))
    return sorted(want.values(), key=str)


@pytest.mark.parametrize("block", [8192, 3])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    data = rows()
    got = E.near_vectors(spark.createDataFrame(data, SCHEMA), recall=1.0).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(data)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_recall_on_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in E.near_vectors(table).collect()}
    data = table.collect()
    x = np.array([r["embedding"] for r in data], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= E.LEAST_COSINE).sum(axis=1) - 1
    assert all(got[r["vec_id"]] <= n for r, n in zip(data, want, strict=True))
    assert sum(got.values()) >= 0.9 * want.sum()


def test_recall_at_the_threshold(spark):
    """Pairs at exactly the least cosine in random directions, the hardest there are."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(axis=1)[:, None] * x
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    y = 0.902 * x + np.sqrt(1 - 0.902**2) * turn
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, y)))]
    got = E.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    assert sum(r["n_links"] for r in got) >= 0.9 * 2 * len(x)


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    index = E.MultiIndex(rng.standard_normal((7, 4)), rng.standard_normal((5, 4)))
    x = rng.standard_normal((20, 8))
    left, right = index._halves(x)
    sums = (left[:, :, None] + right[:, None, :]).reshape(20, -1)
    for n in (1, 6, 35):
        near = index.nearest_cells(x, n)
        assert np.allclose(np.take_along_axis(sums, near, 1), np.sort(sums, axis=1)[:, :n])


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = E.near_vectors(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).collect()
    assert [tuple(r) for r in lone] == [(1, 0, 1, True)]


def test_vectors_of_every_length_are_compared(spark):
    data = [(i, [1.0, float(i), 2.0]) for i in range(5)] + [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [0.0, 1.0]), (13, [3.0]), (14, [1.0]), (15, [-1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>"), recall=1.0).collect()}
    assert (got[10], got[11], got[12]) == ((1, 10), (1, 10), (0, 12))
    assert (got[13], got[14], got[15]) == ((1, 13), (1, 13), (0, 15))
    assert got[3][1] == got[4][1] and got[0][1] == 0


def test_visits_grow_until_the_recall_is_reached():
    """Vectors without any structure need more cells than the fit begins with; what it finds holds for other pairs."""
    rng = np.random.default_rng(5)
    index = E.fit_index(E._unit(rng.standard_normal((4096, 64))), 20_000_000, recall=0.98)
    assert index.visits > E.FIRST_VISITS
    x = E._unit(rng.standard_normal((2000, 64)))
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = E.LEAST_COSINE * x + np.sqrt(1 - E.LEAST_COSINE**2) * E._unit(noise)
    some = index.at_once(index.visits)
    hit = [index.nearest_cells(x[a : a + some]) == index.cell(y[a : a + some])[:, None] for a in range(0, len(x), some)]
    assert np.mean(np.concatenate([h.any(axis=1) for h in hit])) > 0.96

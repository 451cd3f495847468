import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from llm_frames import PROSE, WORDS, components, documents, edge_rows
from pyspark.sql import functions as F

from visitlens.llm import simhash
from visitlens.llm.components import components as linked

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_print(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check(spark, rows):
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    root = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (ident, _, _), r in zip(rows, root, strict=True):
        if ident is not None:
            least[r] = min(ident, least.get(r, ident))
    want = [(ident, f"{p:016x}", least.get(r)) for (ident, _, _), p, r in zip(rows, prints, root, strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))


def test_edges_match_brute_force(spark):
    check(spark, edge_rows())


def test_chains_and_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, ident = [], 0
    for _ in range(12):
        text = rng.choices(words, k=300)
        for _ in range(8):
            text = list(text)
            text[rng.randrange(300)] = rng.choice(words)
            rows.append((ident, " ".join(text), "s"))
            ident += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_hot_bucket_in_blocks_finds_the_same_links(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1, 1 << 62))
    close = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))}
    far = {int(x) for x in rng.integers(0, 1 << 62, 300)}
    fps = sorted(close | far)
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for block in (16, 4096):
        links = simhash.close_links(frame, block=block).collect()
        place = {f: i for i, f in enumerate(fps)}
        pairs = {(place[r["a"]], place[r["b"]]) for r in links}
        assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in pairs)
        got = components(len(fps), lambda i, j, p=pairs: (i, j) in p or (j, i) in p)
        assert got == want


def test_probes_of_a_hot_key_are_dealt_into_blocks(spark, monkeypatch):
    """A key with few owners that many fingerprints probe is cut like one with many owners."""
    rng = np.random.default_rng(4)
    mask = (1 << 12) - 1
    few = {int(x) << 12 | mask for x in rng.integers(0, 1 << 50, 30)}
    many = {int(x) << 12 | mask ^ 1 << int(b) for x, b in zip(rng.integers(0, 1 << 50, 600), rng.integers(0, 12, 600))}
    many |= {x ^ 1 ^ 1 << 40 for x in few}
    frame = spark.createDataFrame([(f,) for f in few | many], "fp bigint")
    monkeypatch.setattr(simhash, "choose_parts", lambda fps, most: [(mask, list(range(12)), 1)])
    dealt, plain = [], simhash._dealt
    monkeypatch.setattr(simhash, "_dealt", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    found = {frozenset((r.a, r.b)) for r in simhash.close_links(frame, 4, block=32).collect()}
    assert {frozenset((x, x ^ 1 ^ 1 << 40)) for x in few} <= found
    assert all((a ^ b).bit_count() <= 4 for a, b in map(tuple, found))
    cells = dealt[0].groupBy("part", "key", "cell").count().agg(F.max("count")).first()[0]
    assert cells <= 2.5 * 32


def test_many_probes_of_one_group_are_compared_in_little_memory():
    rng = np.random.default_rng(6)
    rows = np.zeros((5, 30_000), np.int64)
    rows[4] = rng.integers(0, 1 << 62, 30_000)
    rows[3, 100:] = 1
    rows[4, 200] = rows[4, 7] ^ 3
    tracemalloc.start()
    links = [r for batch in simhash._forest(rows, 4) for r in batch.to_pylist()]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    a, b = sorted(rows[4, [7, 200]].tolist())
    assert links == [{"a": b, "b": a}]
    assert peak < 16 << 20


@pytest.mark.parametrize("spread", (0, 3, 40))
def test_one_group_links_as_brute_force(spread):
    """Groups of few close pairs, of many, and of some that hang together by others."""
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 1 << 62, 12)[rng.integers(0, 12, 300)]
    for _ in range(spread):
        fps = fps ^ (np.int64(1) << rng.integers(0, 62, 300))
    owners, probes = fps[:200].view(np.uint64), fps[200:].view(np.uint64)
    pairs = [(i, j) for i in range(200) for j in range(i + 1, 300) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    got = simhash._compare(owners, probes, 4)
    up = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for a, b in got:
        assert (a ^ b).bit_count() <= 4
        if top(a) != top(b):
            up[top(a)] = top(b)
    assert all(top(int(fps[i])) == top(int(fps[j])) for i, j in pairs)


def test_links_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    links = spark.range(1, 40, 1, 2).selectExpr("id as a", "id - 1 as b").mapInArrow(run, "a bigint, b bigint")
    assert linked(links).where("root = 0").count() == 40
    assert made.value == 39


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark):
    docs = documents(spark, edge_rows())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 not in ids and ids.count(4) == 1 and 1 in ids and 2 not in ids


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_thresholds_always_add_up(parts):
    cost = [[0.0, *(float(i + t) for t in range(5))] for i in range(parts)]
    _, chosen = simhash.allocate(cost, 4)
    assert sum(t + 1 for t in chosen) == 5


def test_long_text_is_hashed_whole():
    text = PROSE * 8000
    assert len(text.split()) > 1 << 16
    assert simhash.fingerprint(text) == brute_print(text)


def similarity(one, other):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, other)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted_copies(n, at_least, below, seed):
    """(id, text, source) rows: n texts of 100 or 400 words and, under id + n, a copy of similarity [at_least, below)."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for ident in range(n):
        base = rng.choices(words, k=rng.choice((100, 400)))
        while True:
            copy = list(base)
            while similarity(base, copy) >= below:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if similarity(base, copy) >= at_least:
                break
        rows += [(ident, " ".join(base), "s"), (ident + n, " ".join(copy).upper(), "s")]
    return rows


@pytest.mark.parametrize(("at_least", "below"), [(0.8, 0.85), (0.85, 0.9), (0.9, 0.97)])
def test_keep_one_finds_planted_copies_from_the_share_up(spark, at_least, below):
    n = 300
    ids = {r["doc_id"] for r in simhash.keep_one(documents(spark, planted_copies(n, at_least, below, 7))).collect()}
    assert set(range(n)) <= ids
    assert len(ids) <= n + 3  # 0.99 of the copies are found


def test_keep_one_finds_copies_by_the_pigeonhole_alone(spark):
    """Without common bands every copy whose fingerprint is within the probed bits is still found."""
    rows = planted_copies(60, 0.9, 0.97, 11)
    alone = iter(np.random.default_rng(1).integers(0, 1 << 62, (10_000, simhash.BANDS)))
    docs = documents(spark, rows)
    sketched = docs.select("doc_id", "text", simhash._sketch(F.col("text")).alias("s")).select("doc_id", "text", "s.*").collect()
    frame = spark.createDataFrame(
        [(r.node, r.fp, [int(k) for k in next(alone)], r.text, i) for i, r in enumerate(sketched)],
        "node bigint, fp bigint, bands array<bigint>, text string, row bigint",
    )
    at = {r.doc_id: r for r in sketched}
    near = {i for i in range(60) if ((at[i].fp ^ at[i + 60].fp) & (1 << 64) - 1).bit_count() <= simhash.PROBE_BITS}
    found = {frozenset((r.a, r.b)) for r in simhash.copy_links(frame).collect()}
    assert len(near) > 40
    assert {frozenset((at[i].node, at[i + 60].node)) for i in near} <= found


def test_keep_one_leaves_texts_below_the_share(spark):
    rows = planted_copies(200, 0.7, 0.79, 8)
    assert simhash.keep_one(documents(spark, rows)).count() == len(rows)


def test_large_groups_in_blocks_link_alike(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        text = list(base)
        for _ in range(1 + i % 3):
            text[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        texts.append(text)
    root = components(len(texts), lambda i, j: similarity(texts[i], texts[j]) >= 0.8)
    rows = spark.createDataFrame([(" ".join(t), i) for i, t in enumerate(texts)], "text string, row bigint")
    rows = rows.select("*", simhash._sketch(simhash.F.col("text")).alias("s")).select("*", "s.*")
    place = {r["node"]: r["row"] for r in rows.collect()}
    for block in (16, 1024):
        pairs = {(place[r["a"]], place[r["b"]]) for r in simhash.copy_links(rows, block=block).collect()}
        assert components(len(texts), lambda i, j, p=pairs: (i, j) in p or (j, i) in p) == root

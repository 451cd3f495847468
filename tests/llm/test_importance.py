import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from llm_frames import PROSE, documents, edge_rows

from visitlens.llm import importance as I

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [crc32(g.encode()) % 10_000 for g in grams]


def brute(rows, target, least=20, percent=25):
    own = [(i, *features(t)) for i, t, *_ in rows]
    corpus = Counter(b for _, _, f in own for b in f)
    like = Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(corpus.values()) + 10_000, sum(like.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((like[b] + 1) * s_all / ((corpus[b] + 1) * t_all))) for b in corpus}
    out = []
    for ident, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append((ident, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter()
    drawn = [(r, k + 1) for k, r in enumerate(fit[: len(fit) * percent // 100])]
    for r, k in drawn:
        ranks[(r, k)] += 1
    rest = [(r, None) for r in fit[len(drawn) :]] + [(r, None) for r in out if r[1] < least]
    return sorted([(*r, k) for (r, k) in [*ranks.elements(), *rest]], key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def mixed_rows():
    odd = [(100 + i, f"{PROSE} Number {i} ÄÖ a-b_c 4{i}", "g") for i in range(60)]
    junk = [(300 + i, f"zz{i} qq " * 30, "j") for i in range(60)]
    return edge_rows() + odd + junk + [odd[3], odd[3]]


def test_matches_brute_force(spark):
    alike = f"{PROSE} Ä " * 100
    target = spark.createDataFrame([(1, alike), (2, None), (3, "")], "item_id bigint, text string")
    got = I.resample(documents(spark, mixed_rows()), target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute(mixed_rows(), [alike, None, ""])
    assert rows_of(got) == want
    drawn = [r for r in want if r[5]]
    assert len(drawn) > 20 and sum(r[0] is None or r[0] < 300 for r in drawn) > 0.8 * len(drawn)


def test_texts_of_one_batch_do_not_meet():
    """No feature crosses two texts, however they are joined."""
    texts = [b"a b", b"", b"c", b"  ", b"A\x00d e", "é f".encode()]
    found, owners, words = I.hashed_features(texts)
    assert words.tolist() == [2, 0, 1, 0, 3, 2]
    for i, text in enumerate(texts):
        assert sorted(found[owners == i].tolist()) == sorted(features(text.decode())[1])
    found, owners, words = I.hashed_features([b""])
    assert not len(found) and words.tolist() == [0]


def test_long_texts_are_joined_in_portions(monkeypatch):
    monkeypatch.setattr(I, "JOINED_BYTES", 10)
    texts = [b"x" * 30, b"", b"a b", b"c", b"d" * 9]
    assert [p for p in I._portions(texts)] == [[b"x" * 30], [b"", b"a b", b"c"], [b"d" * 9]]


def test_empty_tables_and_other_id_types(spark):
    target = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    assert I.resample(documents(spark, []), target).collect() == []
    named = spark.createDataFrame([(f"d{i}", f"{PROSE} {i}") for i in range(9)], "name string, body string")
    got = I.resample(named, target.limit(0), "name", "body").collect()
    assert sorted(r["doc_id"] for r in got) == [f"d{i}" for i in range(9)]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_drawn_documents_keep_their_columns(spark):
    docs = documents(spark, mixed_rows())
    target = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    kept = I.drawn_documents(docs, target)
    want = {r["doc_id"] for r in I.resample(docs, target).where("rank is not null").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_many_equal_scores_are_ranked_without_gaps(spark):
    rows = [(7, f"{PROSE} same", "h")] * 400 + [(i, f"{PROSE} {i}", "h") for i in range(100, 300)]
    target = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    got = I.resample(documents(spark, rows, clashes=False).repartition(5), target).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 600 and ranks == list(range(1, 151))
    score = {r["rank"]: r["score"] for r in got if r["rank"]}
    assert all(score[k] >= score[k + 1] for k in range(1, 150))


def test_given_documents(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(I.resample(docs, bench)) == brute(rows, [r["text"] for r in bench.collect()])

import base64
import hashlib
import random

import numpy as np
import pytest
from llm_frames import PROSE, documents, edge_rows

from visitlens.llm import paragraph_sketch as S


def sentences(rng, n):
    return [" ".join(rng.choice(PROSE.split()) + str(rng.randrange(99)) for _ in range(rng.randrange(3, 8))) + "." for _ in range(n)]


def likeness(a, b):
    """By plain sets."""
    one, two = set(S.digests_of(a).tolist()), set(S.digests_of(b).tolist())
    return 2 * len(one & two) / (len(one) + len(two)) if one or two else 1.0


def test_paragraphs_make_up_the_text():
    rng = random.Random(3)
    texts = [r[1] or "" for r in edge_rows()] + ["".join(rng.choice("ab .!\n\té") for _ in range(200)) for _ in range(300)]
    for text in [*texts, "x" * 2000, " " * 500, "\n\n\n", "a " * 900]:
        assert "".join(S.PARAGRAPH.findall(text)) == text
    assert S.PARAGRAPH.findall("One two. Three\nfour 1 2 3 4 5 6 7 8 9\n\nten") == [
        "One two. ", "Three\n", "four 1 2 3 4 5 6 7 ", "8 9\n\n", "ten",
    ]
    assert max(map(len, S.PARAGRAPH.findall("y" * 5000))) == 8 * 64


@pytest.mark.parametrize("changed", [0, 1, 5, 60, 700])
def test_peeling_recovers_the_difference(changed):
    """Differences of any size are recovered exactly; larger ones need more cells."""
    rng = random.Random(changed)
    old, new = [], []
    for _ in range(20):
        lines = sentences(rng, 800)
        old.append(S.digests_of("\n".join(lines)))
        new.append(S.digests_of("\n".join(lines[changed:] + sentences(rng, changed))))
    for a, b, (gone, come, cells) in zip(old, new, S.differences(old, new), strict=True):
        assert set(gone.tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(come.tolist()) == set(b.tolist()) - set(a.tolist())
        assert cells >= len(gone) + len(come) or cells == S.CELLS
        assert cells <= max(S.CELLS, 64 * (len(gone) + len(come)))  # a size or two more, if cells collide
    if changed == 700:
        assert min(c for _, _, c in S.differences(old, new)) > S.CELLS


def test_repeated_paragraphs_count():
    few, many = S.digests_of("same line\n" * 3), S.digests_of("same line\n" * 5)
    [(gone, come, _)] = S.differences([few], [many])
    assert (len(few), len(many), len(gone), len(come)) == (3, 5, 0, 2)


def test_a_fingerprint_is_the_sketch_itself():
    """The difference of two fingerprints can be worked out from their text alone."""
    a, b = S.digests_of(PROSE + "\nOne more.\n"), S.digests_of(PROSE + "\nAnother.\n")
    tables = []
    for text in S.fingerprints_of([a, b]):
        raw = base64.b64decode(text)
        tables.append((np.frombuffer(raw[: 4 * S.CELLS], "<i4"), np.frombuffer(raw[4 * S.CELLS :], "<u8")))
    left = S.Sketches(1, S.CELLS)
    left.count[:] = tables[0][0] - tables[1][0]
    left.key[:] = tables[0][1] ^ tables[1][1]
    _, digests, signs = left.peel()
    assert left.emptied().all()
    assert set(digests[signs > 0].tolist()) == set(a.tolist()) - set(b.tolist())
    assert set(digests[signs < 0].tolist()) == set(b.tolist()) - set(a.tolist())


def test_compare_versions(spark):
    rng = random.Random(9)
    lines = sentences(rng, 300)
    rows = [
        (1, "\n".join(lines), "\n".join(lines[:200] + sentences(rng, 30) + lines[200:])),
        (2, None, ""),
        (3, "a", None),
        (None, "same", "same"),
        (None, "same", "same"),
        (5, "\n".join(lines), "\n".join(sentences(rng, 280))),
    ]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id bigint, old string, new string").withColumn("likeness", F.lit("own"))
    got = sorted(S.compare_versions(frame).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == 6
    for (_, old, new), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), got, strict=True):
        a, b = (set(S.digests_of(t or "").view(np.int64).tolist()) for t in (old, new))
        assert (set(r["removed"]), set(r["added"])) == (a - b, b - a)
        assert r["likeness"] == pytest.approx(likeness(old or "", new or ""))
        assert (r["old_fingerprint"] == r["new_fingerprint"]) == (a == b)
    assert len(got[0]["added"]) <= 31 and len(got[0]["removed"]) <= 1  # insertions disturb nothing else
    assert S.compare_versions(frame.limit(0)).collect() == []


def brute(rows):
    """Rows in order of id (null first) with their successors' texts; rows of one id go by what the operator says."""
    out = []
    for i, (ident, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        out.append((ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), likeness(text, changed), likeness(text, after)))
    return out


def report(frame):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in frame.collect()]


def matches(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_report_matches_brute_force(spark, parts):
    """With few and with more parts than rows, so that ranges hold no, one or many rows."""
    rng = random.Random(parts)
    rows = [(i, "\n".join(sentences(rng, rng.randrange(0, 12)))) for i in range(-5, 30)]
    rows += [(40, ""), (41, PROSE * 50), (42, PROSE * 50), (43, "été 𝄞 naïve"), (44, "𝄞" * 9)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = documents(spark, [(i, None if i == 40 else t, "s") for i, t in shuffled]).repartition(4)
        matches(report(S.edit_report(frame)), brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    assert S.edit_report(documents(spark, [])).collect() == []
    alone = S.edit_report(documents(spark, [(1, "abcdefgh", "a")])).collect()
    assert [(r["n_chars"], r["edited_sha256"], r["near_next"]) for r in alone] == [(8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    got = S.edit_report(documents(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}
    assert len(prints) == 1
    named = spark.createDataFrame([("b", "x"), ("a", "y")], "name string, body string")
    assert {r["doc_id"] for r in S.edit_report(named, "name", "body").collect()} == {"a", "b"}


def test_one_id_for_many_rows(spark):
    rows = [(7, "the same text. again.", "h")] * 300 + [(i, f"{PROSE} {i}.", "h") for i in range(100)]
    got = S.edit_report(documents(spark, rows, clashes=False).repartition(6)).collect()
    same = [r for r in got if r["doc_id"] == 7 and r["n_chars"] == 21]
    assert len(got) == 400 and sum(r["near_next"] == 1.0 for r in same) == 299


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got = S.edit_report(docs)
    matches(report(got), brute(rows))
    texts = dict(rows)
    prints = {}
    for r in got.select("doc_id", "fingerprint").collect():
        prints.setdefault(r["fingerprint"], set()).add(texts[r["doc_id"]])
    assert all(len(t) == 1 for t in prints.values()) and len(prints) == len(set(texts.values()))
    # Documents of some length keep most of what the edit leaves.
    assert got.where("n_chars > 500").agg({"near_edited": "min"}).first()[0] > 0.4

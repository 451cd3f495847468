import math
import re
import struct
from collections import Counter

import xxhash
from llm_frames import PROSE, WORDS, documents, edge_rows

from visitlens.llm import quality_llr as Q

CELLS, MASS = Q.CELLS, Q.CELLS * Q.PRIOR


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def cells(text):
    signed = [struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORDS.findall(text or "")]
    out = []
    for i, h in enumerate(signed):
        own = xxhash.xxh64_intdigest(h, 42)
        pair = xxhash.xxh64_intdigest(signed[i + 1], own) if i + 1 < len(signed) else own
        out.append((struct.unpack("<Q", h)[0] % CELLS, pair % CELLS))
    return out


def brute(rows, good):
    ratios = []
    for k in (0, 1):
        raw = Counter(c[k] for _, t, _ in rows for c in cells(t))
        target = Counter(c[k] for i, t, _ in rows if i in good for c in cells(t))
        n, m = sum(raw.values()), sum(target.values())
        share = lambda c, r=raw, n=n: r[c] / n
        ratios.append(
            lambda c, t=target, m=m, share=share: math.log((t[c] + MASS * share(c)) / (m + MASS)) - math.log(share(c))
        )
    out = []
    for ident, text, _ in rows:
        counts = base(text)
        own = cells(text)
        score = sum(ratios[0](u) + ratios[1](b) for u, b in own) / len(own) if own else 0.0
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        least = Q.LEAST - Q.MARGIN / math.sqrt(max(counts[0], 1))
        out.append((ident, *counts, failed, not failed and score >= least, score))
    return out


def rows_with_junk():
    junk = [(100 + i, " ".join(f"zz{i}{k}*** |" for k in range(60)), "j") for i in range(6)]
    clean = [(200 + i, f"{PROSE} number {i} of these texts", "g") for i in range(1200)]
    return edge_rows() + junk + clean


def labels(spark):
    rows = [(200 + i, 1, "x") for i in range(1200)] + [(100, 0, "x"), (None, 1, "x"), (200, 0, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, text string")


def test_matches_brute_force(spark):
    rows = rows_with_junk()
    got = Q.quality_rules(documents(spark, rows), labels(spark)).collect()
    want = brute(rows, {200 + i for i in range(1200)})
    key = lambda r: (str(r[0]), r[1:8])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:8] == w[:8]
        assert abs(g[8] - w[8]) < 1e-4
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[100 + i] for i in range(6)) and all(kept[200 + i] for i in range(1200))


def test_keep_good_takes_effect_and_keeps_columns(spark):
    docs = documents(spark, rows_with_junk())
    kept = Q.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in Q.quality_rules(docs, labels(spark)).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_without_labels_or_rows(spark):
    none = labels(spark).limit(0)
    got = Q.quality_rules(documents(spark, edge_rows()), none).collect()
    assert {r["score"] for r in got} == {0.0} and len(got) == len(edge_rows())
    assert Q.quality_rules(documents(spark, []), labels(spark)).collect() == []


def test_held_out_labels(spark, sf_dir):
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fit = known.where("doc_id % 2 = 0")  # the other half is held out
    judged = Q.quality_rules(docs, fit).join(known.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good = [r["kept"] for r in judged.where("quality = 1").select("kept").collect()]
    assert sum(good) >= 0.99 * len(good)
    judged = Q.quality_rules(docs, known).join(known, "doc_id").where("quality = 0")
    junk = [r["kept"] for r in judged.select("kept").collect()]
    assert sum(junk) <= 0.1 * len(junk)


def test_base_counts_of_given_documents(spark, sf_dir):
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: tuple(r)[1:6] for r in Q.quality_rules(docs, known).collect()}
    for row in docs.select("doc_id", "text").collect():
        assert got[row["doc_id"]] == base(row["text"])

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_frames import PROSE, documents, edge_rows
from tokenizers import Tokenizer

from visitlens.llm import packing as P
from visitlens.llm.queries import word_tokenizer

ODD = [
    "<|endoftext|> a<|startoftext|>b", "ÀÉß ÿ µm ² ½ ª 'S it'll we've 12 3a", "ΑΣ ΟΔΟΣ İx", "é ́a",
    "\x1c\x1d a\tb\rc\x0bd e\xa0f\xad", "x" * 5000, "'s 's's ''", "İ𝄞 日本", "", " ", "\n\n", "a\0b", "don't I'm A.B,c!!",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_tokenizer())


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encode = P.word_encoder(word_tokenizer())
    for texts in (ODD, ODD[::-1]):
        ids, at = encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_portions_hold_every_text_once():
    texts = ["ab " * 10, "", "c" * 50, "d e", "", "x y z " * 20, "ü ü" * 30]
    for most in (1, 7, 20, 1000):
        out, held = [], ""
        for ended, part in P._portions(pa.array(texts), most):
            for text in part.to_pylist():
                held += text
                if ended:
                    out.append(held)
                    held = ""
        assert out == texts


def rows():
    big = [(100 + i, PROSE * (1 + i % 7), "big") for i in range(300)]
    return edge_rows() + big + [(500 + i, PROSE * 2, "mid") for i in range(60)]


def check(spark, tokenizer, data, **options):
    got = P.pack(documents(spark, data), word_tokenizer(), **options).collect()
    window = options.get("window", P.WINDOW)
    tokens = defaultdict(list)
    for ident, text, _ in data:
        tokens[ident].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    assert sum(r["length"] for r in got) == sum(len(t) for own in tokens.values() for t in own)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for ident, own in pieces.items():  # repeated rows have the same ids, so each piece occurs as often as the row
        covered = Counter()
        for r in own:
            ids = next(t for t in tokens[ident] if len(t) == r["doc_tokens"])
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"] > 0
            covered.update((r["doc_tokens"], i) for i in range(r["start"], r["start"] + r["length"]))
        want = Counter((len(t), i) for t in tokens[ident] for i in range(len(t)))
        assert covered == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    return sequences


def test_every_token_lies_in_one_piece(spark, tokenizer):
    sequences = check(spark, tokenizer, rows(), window=512)
    totals = Counter()
    for own in sequences.values():
        for _, n, source in own:
            totals[source] += n
    whole = sum(totals.values())
    for number, own in sequences.items():
        if number < whole // 512:
            share = Counter()
            for _, n, source in own:
                share[source] += n
            assert all(abs(share[s] - 512 * totals[s] / whole) <= 2 * P.GRAIN for s in totals)


def test_mixture_is_met_while_the_sources_last(spark, tokenizer):
    sequences = check(spark, tokenizer, rows(), window=256, mixture={"big": 1.0, "mid": 1.0, "a": 1e-6, "b": 0.5, "c": 0.01, None: 0.5})
    first = Counter()
    for number in range(10):
        for _, n, source in sequences[number]:
            first[source] += n
    assert abs(first["big"] - first["mid"]) <= 2 * P.GRAIN


def test_sources_beyond_the_bound_share_a_queue(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "OWN_QUEUES", 2)
    check(spark, tokenizer, rows() + [(900 + i, PROSE, f"rare{i}") for i in range(9)], window=128)


def test_empty_table(spark):
    assert P.pack(documents(spark, []), word_tokenizer()).collect() == []


def test_shares_of_nothing_are_refused():
    with pytest.raises(ValueError):
        P.Rounds([5, 5], [1.0, 0.0], 16)


def many_sources():
    return [(i, f"{PROSE} {i}", f"s{i % 40}") for i in range(800)]


def test_a_share_for_no_source_is_refused(spark, tokenizer):
    for unknown in ({"nosuch": 3.0}, {None: 1.0}, {"s1": 1.0, "nosuch": 1.0}):
        with pytest.raises(ValueError, match="no rows of the sources"):
            P.pack(documents(spark, many_sources()), word_tokenizer(), mixture=unknown)


def test_a_named_source_has_its_own_queue_however_small(spark, tokenizer, monkeypatch):
    """Ten times its share of the corpus means that it is used up in the first tenth of the windows."""
    monkeypatch.setattr(P, "OWN_QUEUES", 3)
    data = [*many_sources(), *[(9000 + i, PROSE, "rare") for i in range(8)], (9100, PROSE, None)]
    mixture = {"rare": 0.1, None: 0.05}
    check(spark, tokenizer, data, mixture=mixture, window=256)
    got = P.pack(documents(spark, data), word_tokenizer(), mixture=mixture, window=256).collect()
    last = max(r["sequence_id"] for r in got)
    for ident in (*range(9000, 9008), 9100):
        assert max(r["sequence_id"] for r in got if r["doc_id"] == ident) < 0.2 * last


def test_sources_of_the_shared_queue_are_mixed(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "OWN_QUEUES", 1)
    frame = documents(spark, many_sources()).repartition(16)
    got = P.pack(frame, word_tokenizer(), window=256).collect()
    last = max(r["sequence_id"] for r in got)
    half = Counter(r["source"] for r in got if r["sequence_id"] < last / 2)
    assert len(half) >= 38  # most sources occur in either half

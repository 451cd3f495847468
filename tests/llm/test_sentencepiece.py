import random

import numpy as np
import pytest
from llm_frames import PROSE, documents, edge_rows

from visitlens.llm import sentencepiece_viterbi as V
from visitlens.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a  b\n c ", "▁x▁ y", "𝄞é�\x00", "a" * 700, "ab" * 500 + " " * 40 + "z", "日本語テキスト" * 60,
    PROSE * 3, "x" * 300 + "\t\r\n" + "é" * 300,
]


@pytest.fixture(scope="module")
def pieces():
    return V.Pieces.load(MODEL)


def brute(pieces, chars):
    """Viterbi over the whole text at once."""
    cost, link = [0], [None]
    for end in range(1, len(chars) + 1):
        best, how = cost[-1] + V._BYTE_COST * len(chars[end - 1].encode("utf-8", "surrogatepass")), (1, -1)
        for length in range(1, min(pieces.longest, end) + 1):
            known = pieces.cost.get(chars[end - length : end])
            if known and cost[end - length] + known[0] <= best:
                best, how = cost[end - length] + known[0], (length, known[1])
        cost.append(best)
        link.append(how)
    out, end = [], len(chars)
    while end:
        length, piece = link[end]
        out.append([piece] if piece >= 0 else pieces.fallback(chars[end - 1]))
        end -= length
    return [i for part in reversed(out) for i in part]


def marked(text):
    return V.SPACE + text.replace(V.SPACE, V._LITERAL).replace(" ", V.SPACE) if text else ""


def test_stream_and_memo_match_whole_viterbi(pieces):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("abc de", k=400)) for _ in range(20)]
    encode = V.text_encoder(pieces)
    for text in texts:
        want = brute(pieces, marked(text))
        assert [i for part in V.viterbi_stream(pieces, iter(marked(text))) for i in part] == want
        assert np.frombuffer(encode(text), "<u4").tolist() == want
        assert V.decode_ids(pieces, encode(text)) == text


def test_ids_come_before_the_text_ends(pieces):
    read = 0

    def chars():
        nonlocal read
        for c in PROSE * 50:
            read += 1
            yield c

    next(V.viterbi_stream(pieces, chars()))
    assert read < 500


def test_scores_of_a_unigram_model_are_log_probabilities():
    toy = V.Pieces(["a", "b", "ab", "▁"], [-1.0, -1.5, -2.7, -3.25], set(), {b: 4 + b for b in range(0)})
    assert [i for p in V.viterbi_stream(toy, iter("ab▁ab")) for i in p] == [0, 1, 3, 0, 1]


def test_frames_round_trip(spark):
    rows = edge_rows() + [(100 + i, t, "t") for i, t in enumerate(TEXTS)]
    docs = documents(spark, rows)
    back = V.decode(V.encode(docs, MODEL), MODEL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    report = V.round_trips(docs, MODEL).collect()
    assert all(r["same"] for r in report) and len(report) == len(rows)
    assert V.round_trips(documents(spark, []), MODEL).collect() == []

"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text is that with the least total cost of its pieces. Scores are needed only for the
last positions, as many as the longest piece has characters. Whenever all paths that are still alive run through
one boundary, the ids up to it are final and are given out. Two kinds of boundary are known beforehand: no piece
goes on across a space after a letter, and none holds a character that the vocabulary lacks. What lies between
such boundaries is segmented once and remembered.

A model of kind BPE has ranks for scores; a piece then costs log(rank + 2), as frequencies fall with rank.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visitlens.llm.common import columns_of, small_batches, text_or_empty

SPACE = "▁"
#: A space mark that stands in the text itself, kept apart from spaces; lone surrogates are in no text.
_LITERAL = "\udc81"
#: Costs are whole numbers of millionths, so sums are exact.
_UNIT = 1_000_000
#: Cost of one byte of a character that no piece covers: more than any piece.
_BYTE_COST = 30 * _UNIT
#: Characters after which convergence is looked for; segments that a worker remembers.
_EVERY, REMEMBERED = 64, 500_000


class Pieces:
    """The pieces of a model with their costs."""

    def __init__(self, pieces: list[str], scores: list[float], skip: set[int], byte_ids: dict[int, int]) -> None:
        ranked = {i: s for i, s in enumerate(scores) if i not in skip}
        ranks = bool(ranked) and all(s == int(s) for s in ranked.values())
        self.byte_ids = byte_ids
        self.cost: dict[str, tuple[int, int]] = {}
        for i, score in ranked.items():
            cost = math.log(2 - score) if ranks else -score
            self.cost.setdefault(pieces[i], (max(0, round(cost * _UNIT)), i))
        self.longest = max(map(len, self.cost), default=1)
        #: Gives all pieces in a text, by their ends, of each end the longest first.
        self.matches = ahocorasick.Automaton()
        for piece, (cost, i) in self.cost.items():
            self.matches.add_word(piece, (len(piece), cost, i))
        self.matches.make_automaton()
        across = any(SPACE in p.lstrip(SPACE) for p in self.cost)
        absent = "".join(c for c in "\n\r\t" if not any(c in p for p in self.cost))
        lone = f"|[{absent}]" if absent else ""
        # Without pieces across spaces every run of spaces starts a segment.
        self.segments = re.compile(
            f"[^{absent}]+{lone}" if across else f"{SPACE}*[^{SPACE}{absent}]+|{SPACE}+{lone}"
        )
        self.bytes = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in pieces]
        for byte, i in byte_ids.items():
            self.bytes[i] = bytes([byte])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        skip = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls(pieces, [model.get_score(i) for i in range(n)], skip, byte_ids)

    def fallback(self, char: str) -> list[int]:
        raw = (SPACE if char == _LITERAL else char).encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw]


def viterbi_stream(pieces: Pieces, chars: Iterator[str], every: int = _EVERY) -> Iterator[list[int]]:
    """Ids of the cheapest segmentation, given out as they become final; of equal costs the longer last piece wins.

    ``chars`` is read once. Kept are the last ``longest`` characters and costs, and the back links since the last
    boundary given out.
    """
    longest, cost_of = pieces.longest, pieces.cost
    recent = ""  # the last characters
    costs = [0]  # cheapest way to the last positions, newest last
    links: list[tuple[int, int]] = []  # (length of the last piece, its id or -1) of positions base + 1, ...
    letters: list[str] = []  # characters since the base, for bytes
    at = base = 0
    look = every
    for char in chars:
        at += 1
        recent = (recent + char)[-longest:]
        letters.append(char)
        best, link = costs[-1] + _BYTE_COST * len(char.encode("utf-8", "surrogatepass")), (1, -1)
        for length in range(1, min(len(recent), len(costs)) + 1):
            known = cost_of.get(recent[-length:])
            if known is not None and costs[-length] + known[0] <= best:
                best, link = costs[-length] + known[0], (length, known[1])
        costs = [*costs[-(longest - 1) :], best] if longest > 1 else [best]
        links.append(link)
        if at == look:
            alive = {p for p in range(max(base, at - longest + 1), at + 1)}
            while len(alive) > 1:
                last = max(alive)
                if last <= base:
                    break
                alive.discard(last)
                alive.add(last - links[last - base - 1][0])
            boundary = max(alive)
            if base < boundary and len(alive) == 1:
                yield _ids(pieces, links, letters, boundary - base)
                del links[: boundary - base], letters[: boundary - base]
                base = boundary
            look = at + max(every, len(links) // 2)  # seldom where paths stay apart, so that looking stays cheap
    if links:
        yield _ids(pieces, links, letters, len(links))


def _ids(pieces: Pieces, links: list[tuple[int, int]], letters: list[str] | str, end: int) -> list[int]:
    out: list[int] = []
    while end > 0:
        length, piece = links[end - 1]
        if piece >= 0:
            out.append(piece)
        else:
            out.extend(reversed(pieces.fallback(letters[end - 1])))
        end -= length
    out.reverse()
    return out


def _segment_ids(pieces: Pieces, segment: str) -> list[int]:
    """The same for one short segment, all of it at once."""
    n = len(segment)
    best: list[float] = [math.inf] * (n + 1)
    best[0] = 0
    link: list[tuple[int, int]] = [(1, -1)] * (n + 1)
    settled = 0
    for end, (length, cost, piece) in pieces.matches.iter(segment):
        while settled < end:  # positions whose pieces are all known
            settled += 1
            if best[settled] - best[settled - 1] > _BYTE_COST:
                _take_bytes(segment, best, link, settled)
        end += 1
        total = best[end - length] + cost
        if total < best[end]:  # of equal costs the longer piece came first
            best[end] = total
            link[end] = (length, piece)
    while settled < n:
        settled += 1
        if best[settled] - best[settled - 1] > _BYTE_COST:
            _take_bytes(segment, best, link, settled)
    return _ids(pieces, link[1:], segment, n)


def _take_bytes(segment: str, best: list[float], link: list[tuple[int, int]], at: int) -> None:
    """Bytes instead of pieces for one character, where they cost less."""
    raw = best[at - 1] + _BYTE_COST * len(segment[at - 1].encode("utf-8", "surrogatepass"))
    if raw < best[at]:
        best[at], link[at] = raw, (1, -1)


def text_encoder(pieces: Pieces, longest_kept: int = 256) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    known: dict[str, bytes] = {}

    def ids_of(segment: str) -> bytes:
        if len(segment) > longest_kept:
            parts = (np.array(p, "<u4").tobytes() for p in viterbi_stream(pieces, iter(segment)))
            return b"".join(parts)
        if len(known) >= REMEMBERED:
            known.clear()
        found = known[segment] = array("I", _segment_ids(pieces, segment)).tobytes()
        return found

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        marked = SPACE + text.replace(" ", SPACE)
        return b"".join([known.get(s) or ids_of(s) for s in pieces.segments.findall(marked)])

    return encode


def _kept_by_worker(model_path: str) -> tuple[Pieces, Callable[[str], bytes]]:
    """Pieces and encoder of a model. A worker serves many tasks and each brings its own copy of this code, so what
    was learnt stays with the library."""
    import sentencepiece

    kept = vars(sentencepiece).setdefault("_encoders_by_path", {})
    if model_path not in kept:
        pieces = Pieces.load(model_path)
        kept[model_path] = pieces, text_encoder(pieces)
    return kept[model_path]


def decode_ids(pieces: Pieces, ids: bytes) -> str:
    """The text of ids: pieces and bytes in a row, without the space that encoding puts first."""
    table = pieces.bytes
    raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
    return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, 32 bits each) of every row.

    A null or empty text has no ids. Repeated rows and null ids each get a row. ``model_path`` is read by every
    worker, so it must lie at the same place on all machines.
    """
    small_batches(docs.sparkSession)
    own = columns_of(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids_of = _kept_by_worker(model_path)
        for batch in batches:
            ids = [ids_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row; null ids count as none."""
    small_batches(encoded.sparkSession)
    own = columns_of(encoded, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _kept_by_worker(model_path)
        for batch in batches:
            texts = [decode_ids(pieces, i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32, same (decoding gives the text back) of every row."""
    small_batches(docs.sparkSession)
    own = columns_of(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids_of = _kept_by_worker(model_path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = ids_of(text)
                rows.append((len(text), len(ids) // 4, zlib.crc32(ids), decode_ids(pieces, ids) == text))
            chars, n, crc, same = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            arrays = [pa.array(v, pa.int64()) for v in (chars, n, crc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays, pa.array(same, pa.bool_())], ["doc_id", "n_chars", "n_ids", "ids_crc32", "same"]
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, n_ids bigint, ids_crc32 bigint, same boolean"
    return own.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, schema)

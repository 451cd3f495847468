"""Fingerprints of documents that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A text falls into paragraphs, each paragraph has a 64-bit digest, and a sketch of a few cells holds all digests: each
digest adds one to the count and itself to the exclusive-or of three cells. The difference of two sketches holds only
what the texts do not share. A cell with a count of one in which a valid digest lies gives that digest away;
taking it out of its other cells frees further ones, until the sketch is empty: then all differing digests are known.
If something is left the difference was too large for the cells, and sketches of more cells are tried.

Pairs of texts are handled side by side: the cells of all pairs of a batch lie in one array, and one round of peeling
serves all of them. A batch and the texts of its rows are all that a task holds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from visitlens.llm.common import columns_of, saved, small_batches, text_or_empty

#: Cells of the sketch that is a document's fingerprint, and by how much a retry enlarges it. Multiples of HASHES.
CELLS, GROWTH = 18, 4
#: Cells that each digest lies in, one in each third of the sketch.
HASHES = 3
#: Characters whose pairs are compared at a time: bounds the cells in memory, except for one longer pair.
PORTION_CHARS = 1 << 22

#: A paragraph is a line. Long ones are cut after the end of a sentence and after 8 words, very long words after 64
#: characters. White space goes with what stands before it, so that the paragraphs make up the whole text.
PARAGRAPH = re.compile(
    r"""\s*+\S{1,64}+(?:[^\S\n]*+\S{1,64}+){0,7}?       # up to 8 words of a line ...
        (?:(?<=[.!?])(?!\S)|(?=\s*\n)|(?=\s*\Z))\s*+     # ... to the end of a sentence, of the line or of the text
      | \s*+\S{1,64}+(?:[^\S\n]*+\S{1,64}+){0,7}+\s*+    # ... or 8 words
      | \s++                                             # a text without words""",
    re.VERBOSE,
)

_LOW = np.uint64(0xFFFF)
# Odd multipliers of a finalizer, one for the check bits and one for each third of the cells.
_CHECK = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * factor
    return x ^ (x >> np.uint64(32))


def _valid(digests: np.ndarray) -> np.ndarray:
    """The low 16 bits of a digest follow from the others: an exclusive-or of several digests hardly ever fits."""
    return (_mixed(digests >> np.uint64(16), _CHECK) & _LOW) == (digests & _LOW)


def digests_of(text: str) -> np.ndarray:
    """Distinct digests of a text's paragraphs; the second of two equal paragraphs has another digest than the first."""
    seen: dict[str, int] = {}
    found = []
    for piece in PARAGRAPH.findall(text):
        times = seen.get(piece, 0)
        seen[piece] = times + 1
        found.append(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), times))
    high = np.array(found, np.uint64) >> np.uint64(16)
    return np.unique((high << np.uint64(16)) | (_mixed(high, _CHECK) & _LOW))


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each digest, one row per third."""
    third = np.uint64(cells // HASHES)
    own = np.stack([_mixed(digests, f) % third for f in _PLACES]).astype(np.int64)
    return own + (np.arange(HASHES) * (cells // HASHES))[:, None]


class Sketches:
    """Sketches of equal size side by side: number i has the cells from i * cells on."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)

    def add(self, owners: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = (_places(digests, self.cells) + owners * self.cells).ravel()
        signs = np.tile(np.broadcast_to(sign, digests.shape), HASHES)
        self.count += np.bincount(at, weights=signs, minlength=len(self.count)).astype(np.int64)
        np.bitwise_xor.at(self.key, at, np.tile(digests, HASHES))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that can be recovered; what it recovers is taken out of the cells."""
        owners, digests, signs = [], [], []
        for _ in range(self.cells * HASHES):
            lone = np.flatnonzero(np.abs(self.count) == 1)
            lone = lone[_valid(self.key[lone])]
            place = lone % self.cells
            fits = (_places(self.key[lone], self.cells) == place).any(axis=0)
            lone = lone[fits]
            if not len(lone):
                break
            # A digest that lies alone in several cells of its sketch is taken out once.
            owner, digest = lone // self.cells, self.key[lone]
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], self.count[lone][order]
            first = np.ones(len(order), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            owner, digest, sign = owner[first], digest[first], sign[first]
            self.add(owner, digest, -sign)
            owners.append(owner)
            digests.append(digest)
            signs.append(sign)
        empty = np.zeros(0, np.int64)
        return (
            np.concatenate([empty, *owners]),
            np.concatenate([empty.astype(np.uint64), *digests]),
            np.concatenate([empty, *signs]),
        )

    def emptied(self) -> np.ndarray:
        """Which sketches hold nothing any more."""
        left = (self.count != 0) | (self.key != 0)
        return ~left.reshape(self.n, self.cells).any(axis=1)

    def text(self, i: int) -> str:
        """One sketch as text: its counts and its keys."""
        cut = slice(i * self.cells, (i + 1) * self.cells)
        return base64.b64encode(self.count[cut].astype("<i4").tobytes() + self.key[cut].astype("<u8").tobytes()).decode()


def _dealt(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return owners, np.concatenate([np.zeros(0, np.uint64), *sets])


def fingerprints_of(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The fingerprint of each set of digests."""
    sketches = Sketches(len(sets), cells)
    sketches.add(*_dealt(sets))
    return [sketches.text(i) for i in range(len(sets))]


def differences(old: list[np.ndarray], new: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Digests that only the old and only the new version of each pair has, and the cells it took to find them."""
    out: list = [None] * len(old)
    open_pairs = list(range(len(old)))
    while open_pairs:
        sketches = Sketches(len(open_pairs), cells)
        sketches.add(*_dealt([old[i] for i in open_pairs]))
        sketches.add(*_dealt([new[i] for i in open_pairs]), -1)
        owners, digests, signs = sketches.peel()
        order = np.argsort(owners, kind="stable")
        ends = np.cumsum(np.bincount(owners, minlength=len(open_pairs)))
        cuts = np.split(order, ends[:-1])
        done = sketches.emptied()
        for i, cut, ok in zip(open_pairs, cuts, done.tolist(), strict=True):
            if ok:
                out[i] = (digests[cut][signs[cut] > 0], digests[cut][signs[cut] < 0], cells)
        open_pairs = [i for i, ok in zip(open_pairs, done.tolist(), strict=True) if not ok]
        cells *= GROWTH
    return out


def likeness(old: np.ndarray, new: np.ndarray, gone: np.ndarray, come: np.ndarray) -> float:
    """The share of the paragraphs of two versions, each counted in its own, that both have; 1 if neither has any."""
    held = len(old) + len(new)
    return 1.0 - (len(gone) + len(come)) / held if held else 1.0


def _portions(pairs: list[tuple[str, str]]) -> Iterator[slice]:
    begin, held = 0, 0
    for i, (a, b) in enumerate(pairs):
        if i > begin and held + len(a) + len(b) > PORTION_CHARS:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(a) + len(b)
    if pairs:
        yield slice(begin, len(pairs))


_COMPARED = (
    "old_fingerprint string, new_fingerprint string, removed array<bigint>, added array<bigint>, likeness double, cells int"
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True))
        for cut in _portions(pairs):
            old, new = ([digests_of(p[side]) for p in pairs[cut]] for side in (0, 1))
            found = differences(old, new)
            alike = [likeness(a, b, gone, come) for a, b, (gone, come, _) in zip(old, new, found, strict=True)]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[cut],
                    pa.array(fingerprints_of(old)),
                    pa.array(fingerprints_of(new)),
                    pa.array([np.sort(f[0].view(np.int64)) for f in found], lists),
                    pa.array([np.sort(f[1].view(np.int64)) for f in found], lists),
                    pa.array(alike, pa.float64()),
                    pa.array([f[2] for f in found], pa.int32()),
                ],
                ["doc_id", *[c.split()[0] for c in _COMPARED.split(", ")]],
            )


def compare_versions(pairs: DataFrame, id_col: str = "doc_id", old_col: str = "old", new_col: str = "new") -> DataFrame:
    """Two versions of each document compared through their sketches.

    Per row: doc_id, both fingerprints, the digests (as signed 64-bit numbers, ascending) of the paragraphs that were
    removed and added, the likeness of 0 to 1, and the number of cells that the difference needed. A null text is
    empty; two empty texts have likeness 1. Repeated rows and null ids each get their row; no rows give no rows.
    """
    small_batches(pairs.sparkSession)
    own = columns_of(pairs, doc_id=id_col, old=old_col, new=new_col)
    own = own.select("doc_id", text_or_empty("old").alias("old"), text_or_empty("new").alias("new"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_compared, f"doc_id {kind}, {_COMPARED}")


# Documents against their edited form and the next document


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many of the first of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_EDIT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a task in order, and beside them the text of its first row, and of its last, which lacks its successor.
_STEP = f"{_EDIT}, head string, tail string, part int, last boolean"


def _edit_rows(texts: list[str], following: list[str]) -> dict[str, list]:
    """The digest columns of successive rows; ``following`` are their texts moved up by one, and the one after them."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, new = [digests_of(t) for t in texts], [digests_of(t) for t in changed]
    after = [*own[1:], digests_of(following[-1])]

    def near(other: list[np.ndarray]) -> list[float]:
        found = differences(own, other)
        return [likeness(a, b, gone, come) for a, b, (gone, come, _) in zip(own, other, found, strict=True)]

    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": fingerprints_of(own),
        "edited_fingerprint": fingerprints_of(new),
        "near_edited": near(new),
        "near_next": near(after),
    }


def _neighbours(kind: pa.DataType):
    names = [c.split()[0] for c in _EDIT.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row against the next of its task; the last row keeps its text for whoever knows what follows."""
        from pyspark import TaskContext

        part, head, waiting = TaskContext.get().partitionId(), None, None

        def out(ids: list, columns: dict[str, list], tail: str | None, last: bool) -> pa.RecordBatch:
            n = len(ids)
            nonlocal head
            heads, head = [head] + [None] * (n - 1), None
            types = [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.string(), pa.string(), pa.int32(), pa.bool_()]
            data = [ids, *[columns[c] for c in names], heads, [None] * (n - 1) + [tail], [part] * n, [last] * n]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(data, types, strict=True)],
                ["doc_id", *names, "head", "tail", "part", "last"],
            )

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            if waiting is None:
                head = texts[0]
            else:
                ids, texts = [waiting[0], *ids], [waiting[1], *texts]
            pairs = list(zip(texts[:-1], texts[1:], strict=True))
            for cut in _portions(pairs):
                yield out(ids[:-1][cut], _edit_rows(texts[:-1][cut], texts[1:][cut]), None, False)
            waiting = ids[-1], texts[-1]
        if waiting is not None:
            yield out([waiting[0]], {c: [None] for c in names}, waiting[1], True)

    return walk


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column("tail").to_pylist(), batch.column("head").to_pylist(), strict=True))
        for i, (text, following) in enumerate(pairs):
            found = _edit_rows([text], [following])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i : i + 1], *[pa.array(v) for v in found.values()]], ["doc_id", *found]
            )


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text (see ``edited``) and against the next document.

    Documents are in ascending order of their ids, nulls first, rows of one id in the order of their text's hash; the
    next of the last is the first, a single document is its own next. Texts are shuffled once, into ranges of this
    order; a range is read as a stream, and only its last row has to be matched with the first of the next range
    afterwards: one row per range. A null text is empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = columns_of(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty("text").alias("text"))
    kind = own.schema["doc_id"].dataType
    order = [F.asc("doc_id"), F.asc("h"), F.asc("row")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = own.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    steps = saved(dealt.mapInArrow(_neighbours(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {_STEP}"), "edit-steps")
    columns = ["doc_id", *[c.split()[0] for c in _EDIT.split(", ")]]
    ends = steps.where("last").select("doc_id", "tail", "part")
    # A range's head row is its first; a range of one row has its head on its last row.
    heads = steps.where("head is not null").select(F.col("part").alias("of"), "head")
    held = sorted(r["of"] for r in heads.select("of").collect())  # one number per range
    follows = spark.createDataFrame(list(zip(held, [*held[1:], *held[:1]], strict=True)), "part int, of int")
    pairs = ends.join(F.broadcast(follows), "part").join(heads, "of").select("doc_id", "tail", "head")
    finished = pairs.mapInArrow(_finished, f"doc_id {kind.simpleString()}, {_EDIT}")
    return steps.where("not last").select(*columns).unionByName(finished.select(*columns))

"""Exact ranked search of many items at once over two trees.

Items and documents are vectors over the items' terms: an item's coordinates are its terms' weights times their
repeats, a document's are what the term frequencies are worth in it; their product is the score, and no coordinate is
negative. Both sides get a tree whose nodes hold the greatest coordinate of all vectors below. The product of the
maxima of an item node and a document node is never less than any score below the two, so if it does not exceed the
weakest of the k-th best scores that the node's items have so far, all of the node pair is left out; otherwise the
pair is opened. What remains are leaf pairs, which are scored exactly.

Two passes serve a block of items, a block being as many items as have TERMS different terms: the first reads every
text, counts all its terms and writes the frequencies of the block's terms; the second goes over these with the trees.
A task keeps the best k of each item of the block, so what is shuffled at the end is k rows per item and task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from visitlens.llm.common import columns_of, saved, small_batches

#: Different terms of the items that are searched together; one item with more stands alone.
TERMS = 1 << 13
#: Coordinates of the documents of one document tree.
COORDINATES = 1 << 22
#: Children of a node of either tree, and vectors of a leaf.
FAN, LEAF = 4, 8
#: Documents that are searched first to have k-th best scores to start from.
FIRST = 4096
#: Fixed values of the score.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75
#: Terms over UTF-8 with A-Z lower-cased: ASCII digits and letters, and everything beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


# Items


@dataclass
class Node:
    """Items ``[begin, end)`` of a tree's order: the terms any of them has, the greatest weight of each, children."""

    begin: int
    end: int
    columns: np.ndarray
    most: np.ndarray
    children: list[Node] = field(default_factory=list)


@dataclass
class Items:
    """A block of items as a matrix over the block's terms, in the order of its tree."""

    numbers: list[int]
    weights: np.ndarray
    root: Node


def tree_order(vectors: np.ndarray) -> np.ndarray:
    """An order in which similar vectors are near each other: halves by which of two far vectors is closer, again and
    again."""
    order, out = [np.arange(len(vectors))], []
    unit = vectors / np.maximum(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)), 1e-300)[:, None]
    while order:
        part = order.pop()
        if len(part) <= LEAF:
            out.append(part)
            continue
        own = unit[part]
        one = int(np.argmin(own @ own[0]))
        other = int(np.argmin(own @ own[one]))
        side = np.argsort(own @ (own[one] - own[other]), kind="stable")
        order += [part[side[len(part) // 2 :]], part[side[: len(part) // 2]]]
    return np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int64)


def _node(weights: np.ndarray, begin: int, end: int) -> Node:
    most = weights[begin:end].max(axis=0)
    columns = np.flatnonzero(most)
    node = Node(begin, end, columns, most[columns])
    if end - begin > LEAF:
        cuts = np.linspace(begin, end, FAN + 1).astype(int).tolist()
        node.children = [_node(weights, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    return node


def item_tree(numbers: list[int], weights: np.ndarray) -> Items:
    order = tree_order(weights)
    weights = weights[order]
    # Products of whole numbers are exact in doubles up to 2**53; beyond, they are worked out in integers.
    exact = float(weights.sum(axis=1).max(initial=0)) * SCALE / 1000 < 2**53
    weights = weights.astype(np.float64 if exact else np.int64)
    return Items([numbers[i] for i in order.tolist()], weights, _node(weights, 0, len(weights)))


# Documents


class DocumentTree:
    """Documents in groups of LEAF, these in groups of FAN, and so on; each level holds the greatest coordinates."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = self._near(vectors)
        self.vectors = vectors[self.order]
        self.levels = [self._grouped(self.vectors, LEAF)]
        while len(self.levels[-1]) > FAN:
            self.levels.append(self._grouped(self.levels[-1], FAN))

    @staticmethod
    def _near(vectors: np.ndarray) -> np.ndarray:
        """Documents with the same best terms stand together."""
        best = np.argmax(vectors, axis=1)
        return np.lexsort((-vectors[np.arange(len(vectors)), best], best))

    @staticmethod
    def _grouped(rows: np.ndarray, size: int) -> np.ndarray:
        return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


class Best:
    """The k best documents of each item of a block so far. ``floor`` is a score that k documents are known to reach."""

    def __init__(self, items: Items, k: int, floor: dict[int, int]) -> None:
        self.items, self.k = items, k
        self.floor = np.array([floor.get(n, 0) for n in items.numbers], np.int64)
        self.kth = np.zeros(len(items.numbers), np.int64)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64) for _ in items.numbers]
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64) for _ in items.numbers]
        self.scored = 0

    def weakest(self, node: Node) -> int:
        """A score that a later document has to exceed to matter to any item of a node."""
        return int(np.maximum(self.kth, self.floor - 1)[node.begin : node.end].min())

    def put(self, item: int, scores: np.ndarray, rows: np.ndarray) -> None:
        """Rows come in ascending order over all calls' batches; of equal scores the earlier row is better."""
        keep = (scores > self.kth[item]) & (scores >= self.floor[item])
        if not keep.any():
            return
        scores = np.concatenate([self.scores[item], scores[keep]])
        rows = np.concatenate([self.rows[item], rows[keep]])
        order = np.lexsort((rows, -scores))[: self.k]
        self.scores[item], self.rows[item] = scores[order], rows[order]
        if len(order) == self.k:
            self.kth[item] = self.scores[item][-1]

    def search(self, vectors: np.ndarray, first_row: int) -> None:
        """Offer a batch of documents, whose rows count from ``first_row``."""
        tree = DocumentTree(vectors)
        top = len(tree.levels) - 1
        self._open(tree, self.items.root, top, np.arange(len(tree.levels[top])), first_row)

    def _open(self, tree: DocumentTree, node: Node, level: int, groups: np.ndarray, first_row: int) -> None:
        """An item node against document nodes of one level: those that may matter are opened, the best ones first."""
        bound = tree.levels[level][np.ix_(groups, node.columns)] @ node.most
        chosen = bound > self.weakest(node)
        groups, bound = groups[chosen], bound[chosen]
        if not len(groups):
            return
        if level:
            inner = (groups[:, None] * FAN + np.arange(FAN)).ravel()
            self._open(tree, node, level - 1, inner[inner < len(tree.levels[level - 1])], first_row)
        elif node.children:
            for child in node.children:
                self._open(tree, child, 0, groups, first_row)
        else:
            self._score(tree, node, groups[np.argsort(-bound, kind="stable")], np.sort(bound)[::-1], first_row)

    def _score(self, tree: DocumentTree, node: Node, groups: np.ndarray, bound: np.ndarray, first_row: int) -> None:
        """Leaf against leaves in falling order of their bounds, in growing portions, as long as one can matter."""
        at, size = 0, FAN
        while at < len(groups) and bound[at] > self.weakest(node):
            part = groups[at : at + size]
            docs = (part[:, None] * LEAF + np.arange(LEAF)).ravel()
            docs = docs[docs < len(tree.vectors)]
            scores = tree.vectors[np.ix_(docs, node.columns)] @ self.items.weights[node.begin : node.end][:, node.columns].T
            self.scored += scores.size
            rows = first_row + tree.order[docs]
            for i in range(node.begin, node.end):
                self.put(i, scores[:, i - node.begin].astype(np.int64), rows)
            at, size = at + size, size * FAN


# On Spark


def _read_terms(vocabulary: dict[bytes, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text or b"")
                held = Counter(map(vocabulary.get, words))
                held.pop(None, None)
                lengths.append(len(words))
                terms.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n_terms", "terms", "counts"],
            )

    return read


def worth(counts: np.ndarray, lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What so many occurrences are worth in a document of so many terms."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // all_terms
    return (SCALE * counts) // (1000 * counts + SATURATION * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _vectors(batch: pa.RecordBatch, width: int, n_docs: int, all_terms: int, kind: type) -> np.ndarray:
    terms, counts = batch.column("terms"), batch.column("counts")
    held = terms.value_lengths().to_numpy(zero_copy_only=False)
    values = worth(counts.flatten().to_numpy(), np.repeat(batch.column("n_terms").to_numpy(), held), n_docs, all_terms)
    out = np.zeros((batch.num_rows, width), kind)
    out[np.repeat(np.arange(batch.num_rows), held), terms.flatten().to_numpy()] = values
    return out


def _search(items: Items, k: int, n_docs: int, all_terms: int, floor: dict[int, int], kind: pa.DataType):
    width = items.weights.shape[1]
    rows_at_once = max(COORDINATES // max(width, 1), LEAF)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, row = Best(items, k, floor), {}, 0
        for whole in batches:
            for begin in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(begin, rows_at_once)
                best.search(_vectors(batch, width, n_docs, all_terms, items.weights.dtype.type), row)
                fresh = {r for rows in best.rows for r in rows[rows >= row].tolist()}
                named = batch.column("doc_id").take(pa.array([r - row for r in fresh], pa.int64())).to_pylist()
                ids.update(zip(fresh, named, strict=True))
                row += batch.num_rows
            wanted = {r for rows in best.rows for r in rows.tolist()}
            ids = {r: ids[r] for r in wanted}
        found = [(n, int(s), ids[r]) for n, ss, rs in zip(items.numbers, best.scores, best.rows, strict=True) for s, r in zip(ss.tolist(), rs.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[2] for f in found], kind),
            ],
            ["item", "score", "doc_id"],
        )

    return search


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """Items (number, terms with repeats) in blocks of TERMS different terms; one block at a time is on the driver."""
    block: list[tuple[int, Counter]] = []
    held: set[bytes] = set()
    for row in items.toLocalIterator():
        terms = Counter(terms_of(bytes(row["text"])))
        if not terms:
            continue
        if block and len(held | terms.keys()) > TERMS:
            yield block
            block, held = [], set()
        block.append((row["item"], terms))
        held |= terms.keys()
    if block:
        yield block


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searched(block: list[tuple[int, Counter]], docs: DataFrame, k: int) -> DataFrame:
    """The best documents of a block's items: item, rank, doc_id, score."""
    kind = docs.schema["doc_id"].dataType
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    shape = f"doc_id {kind.simpleString()}, n_terms bigint, terms array<int>, counts array<bigint>"
    read = saved(docs.mapInArrow(_read_terms(vocabulary), shape), "search-terms")
    totals = read.where("n_terms > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("terms")).first()
    n_docs, all_terms = totals["n"], totals["terms"] or 1
    held = read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.collect():  # a row per term of the block at most
        weights[row["term"]] = weight(row["df"], n_docs)
    matrix = np.zeros((len(block), len(vocabulary)), np.int64)
    for i, (_, terms) in enumerate(block):
        for t, n in terms.items():
            matrix[i, vocabulary[t]] = n * weights[vocabulary[t]]
    items = item_tree([number for number, _ in block], matrix)

    def best(rows: DataFrame, floor: dict[int, int]) -> DataFrame:
        task = _search(items, k, n_docs, all_terms, floor, to_arrow_type(kind))
        ordered = rows.where(F.size("terms") > 0).sortWithinPartitions(F.asc_nulls_last("doc_id"))
        return _top(ordered.mapInArrow(task, f"item bigint, score bigint, doc_id {kind.simpleString()}"), k)

    # Any documents give scores that the k-th best cannot fall below; which ones these are changes no result.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * max(n_docs // FIRST, 1) < F.lit(1 << 20)
    floor = {r["item"]: r["score"] for r in best(read.where(share), {}).where(F.col("rank") == k).collect()}
    return saved(best(read, floor), "search-block")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    A null or empty text has no terms: such a document is counted nowhere and found by nothing, such an item finds
    nothing. Equal scores go by document id, null last. Repeated documents and repeated items have their own rows, so
    an item that is there twice gives its list twice. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    numbered = columns_of(items, item_id=item_col, text=item_text_col)
    numbered = saved(numbered.withColumn("item", F.monotonically_increasing_id()), "search-items")
    asked = numbered.select("item", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    own = columns_of(docs, doc_id=id_col, text=text_col)
    found = [_searched(block, own, k) for block in _blocks(asked)]
    if not found:
        found = [own.limit(0).selectExpr("0L as item", "0L as score", "doc_id", "0 as rank")]
    named = reduce(DataFrame.unionByName, found).join(numbered.select("item", "item_id"), "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

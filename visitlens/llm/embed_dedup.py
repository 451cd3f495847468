"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; the two code words name a cell of a product grid.
A vector visits the cells nearest to it in the order of the multi-sequence traversal, as many as the target
recall takes, and is compared there in double precision. The codebooks and the number of cells to visit come
from a bounded sample; every vector is indexed and every vector searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from visitlens.llm.common import columns_of, saved
from visitlens.llm.components import components

LEAST_COSINE = 0.9
#: Vectors the codebooks and the visits are fitted on, at most: those with the smallest hashes.
SAMPLE = 20_000
#: Pairs at the least cosine that the number of visits is fitted on, and the share of them to be found.
TRIALS, RECALL = 4096, 0.98
#: Vectors a cell should hold, code words of one half, cells that the fit of the visits begins with.
CELL_SIZE, MOST_WORDS, FIRST_VISITS = 64, 1024, 256
#: Ranks of cells that are in memory at a time, for some vectors together.
RANKS = 1 << 22
#: Members of a cell that one block holds; larger cells are cut into blocks.
BLOCK = 8192
_TURNS = 12


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(values: pa.Array, kind: str) -> np.ndarray:
    """Rows of binary numbers of a kind as unit vectors in double precision."""
    rows = values.to_pylist()
    return _unit(np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float)) if rows else np.empty((0, 0))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ words.T + (words**2).sum(axis=1)[None, :]


def fit_codebook(x: np.ndarray, words: int, seed: int = 7) -> np.ndarray:
    """k-means over the sample; an empty code word moves to the point worst served."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(_TURNS):
        far = _distances(x, book)
        near = far.argmin(axis=1)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        full = count > 0
        book[full] = total[full] / count[full, None]
        worst = np.argsort(-far[np.arange(len(x)), near], kind="stable")[: int((~full).sum())]
        book[~full] = x[worst]
    return book


class MultiIndex:
    """Two codebooks and the multi-sequence order of their cells."""

    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int = 1) -> None:
        self.left, self.right, self.visits = left, right, visits

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return _distances(x[:, :cut], self.left), _distances(x[:, cut:], self.right)

    def cell(self, x: np.ndarray) -> np.ndarray:
        far_left, far_right = self._halves(x)
        return far_left.argmin(axis=1) * len(self.right) + far_right.argmin(axis=1)

    def at_once(self, visits: int) -> int:
        """Vectors whose nearest cells are looked for together, so that memory does not grow with the visits."""
        return int(max(1, min(1024, RANKS // (visits * (1 + np.log(visits))))))

    def nearest_cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells with the least sums of distances, nearest first.

        The cell at ranks (i, j) comes after all cells of lower ranks, so of the first n only cells with
        (i + 1) * (j + 1) <= n can be among them.
        """
        n = min(visits or self.visits, len(self.left) * len(self.right))
        far_left, far_right = self._halves(x)
        order_left, order_right = far_left.argsort(axis=1, kind="stable"), far_right.argsort(axis=1, kind="stable")
        ranks = [(i, j) for i in range(min(n, len(self.left))) for j in range(min(n // (i + 1), len(self.right)))]
        i, j = np.array(ranks).T
        li, rj = order_left[:, i], order_right[:, j]
        sums = np.take_along_axis(far_left, li, 1) + np.take_along_axis(far_right, rj, 1)
        first = sums.argsort(axis=1, kind="stable")[:, :n]
        return np.take_along_axis(li * len(self.right) + rj, first, 1)


def fit_index(sample: np.ndarray, rows: int, least: float = LEAST_COSINE, recall: float = RECALL) -> MultiIndex:
    """Codebooks for ``rows`` vectors, and as many visits as find ``recall`` of pairs at the least cosine.

    The trial pairs are sample vectors that the codebooks do not know, turned in random directions until their cosine is ``least``, which is the
    hardest case; the cell of one must be among the visits of the other. Where too few are found, twice as many cells
    are looked at, up to the whole grid. A recall of 1 visits every cell.
    """
    cut = sample.shape[1] // 2
    words = int(2 ** np.ceil(np.log2(max(4.0, np.sqrt(rows / CELL_SIZE)))))
    # A fifth of the sample, if there is enough of it, is kept from the codebooks and tried instead.
    fitted, tried = (sample[len(sample) // 5 :], sample[: len(sample) // 5]) if len(sample) >= 100 else (sample, sample)
    words = min(words, MOST_WORDS, max(1, len(fitted) // 8))
    index = MultiIndex(fit_codebook(fitted[:, :cut], words), fit_codebook(fitted[:, cut:], words))
    if recall >= 1:
        index.visits = len(index.left) * len(index.right)
        return index
    rng = np.random.default_rng(11)
    x = tried[rng.integers(0, len(tried), TRIALS)]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least**2) * _unit(noise)
    goal, rank, visits = index.cell(y), np.full(TRIALS, np.iinfo(np.int64).max), FIRST_VISITS
    cells = len(index.left) * len(index.right)
    while True:
        open_ = np.flatnonzero(rank == rank.max()) if visits > FIRST_VISITS else np.arange(TRIALS)
        step = index.at_once(visits)
        for at in range(0, len(open_), step):
            some = open_[at : at + step]
            hit = index.nearest_cells(x[some], visits) == goal[some, None]
            rank[some] = np.where(hit.any(axis=1), hit.argmax(axis=1), np.iinfo(np.int64).max)
        needed = np.quantile(rank, recall, method="higher")
        if needed < np.iinfo(np.int64).max or visits >= cells:
            index.visits = int(min(needed, cells - 1)) + 1
            return index
        visits *= 2


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & some, F.lit(False))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = LEAST_COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing. Vectors of different
    lengths do not link; each length has an index of its own. Equal vectors are one class, whatever their number, and are expanded only in the counts.
    Repeated rows count as other vectors; a row without an id takes part and is not kept. An empty table gives
    no rows. ``recall`` is that of the hardest pairs, those at the threshold.
    """
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType)
    own = columns_of(vectors, vec_id=id_col, v=vector_col)
    own = own.withColumn("v", F.col("v").cast("array<float>" if single else "array<double>"))
    keys = own.withColumn("good", _valid(F.col("v"))).withColumns(
        {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), "v")}
    )
    rows = saved(keys.select("vec_id", "good", "k1", "k2", F.when(F.col("good"), F.col("v")).alias("v")), "vectors")
    grouped = rows.where("good").groupBy("k1", "k2").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    classes = saved(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    lengths = sorted(r["n"] for r in classes.select(F.size("v").alias("n")).distinct().collect())
    each = [class_links(classes.where(F.size("v") == n), least, recall) for n in lengths]
    found = reduce(DataFrame.unionByName, each) if each else class_links(classes, least, recall)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comps = components(found.where("b is not null").select("a", "b"))
    slim = classes.select("node", "k1", "k2", "copies", "least")
    full = slim.join(comps, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = saved(full, "components")
    heads = full.groupBy("root").agg(F.min("least").alias("component_id"))
    known = full.join(heads, "root").select(
        "k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = rows.where("good").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def class_links(classes: DataFrame, least: float = LEAST_COSINE, recall: float = RECALL) -> DataFrame:
    """Links of the classes (node, v, copies): rows (a, n) say that n vectors link with a from one block, rows
    (a, b) are links that join all linked classes; each pair of classes is compared at most once."""
    spark = classes.sparkSession
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("k1", "k2"), "k1").limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "a bigint, b bigint, n bigint")
    # Vectors travel as they came; single precision takes half the room and is widened where it is compared.
    kind = "<f4" if isinstance(classes.schema["v"].dataType.elementType, FloatType) else "<f8"
    index = fit_index(_unit(np.array([r["v"] for r in sample], float)), count, least, recall)
    located = classes.select("node", "copies", "v").mapInArrow(_indexer(index, kind), "node bigint, copies bigint, cell int, v binary")
    indexed = saved(located, "indexed")
    sizes = np.zeros(len(index.left) * len(index.right), np.int64)  # one number for each cell of the grid
    for row in indexed.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]
    blocks = -(-sizes // BLOCK)
    schema = "cell int, block int, role int, node bigint, copies bigint, v binary"
    dealt = indexed.mapInArrow(_visitor(index, blocks, kind), schema)
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    return saved(dealt.mapInArrow(_comparer(least, kind), "a bigint, b bigint, n bigint"), "found")


def _indexer(index: MultiIndex, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            given = flat.reshape(batch.num_rows, -1).astype(kind)
            x = _unit(given.astype(float))
            raw = [row.tobytes() for row in given]
            arrays = [batch.column("node"), batch.column("copies"), pa.array(index.cell(x), pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "copies", "cell", "v"])

    return run


def _visitor(index: MultiIndex, blocks: np.ndarray, kind: str):
    """A vector is a member of one block of its own cell, and a guest in the later blocks of that cell and in all
    blocks of the cells it visits. Of two cells only the lower one visits, so no pair meets twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = index.at_once(index.visits)
            for begin in range(0, whole.num_rows, some):
                batch = whole.slice(begin, some)
                node, cell = batch.column("node").to_numpy(), batch.column("cell").to_numpy()
                x = _matrix(batch.column("v"), kind)
                near = index.nearest_cells(x)
                row, col = np.nonzero((near > cell[:, None]) & (blocks[near] > 0))
                goal = near[row, col]
                mine = (node * 2654435761 % 4294967291 % blocks[cell]).astype(np.int64)
                parts = [(np.arange(len(x)), cell, mine, np.zeros(len(x), int))]
                rows, goals = np.concatenate((row, np.arange(len(x)))), np.concatenate((goal, cell))
                first = np.concatenate((np.zeros(len(row), int), mine + 1))
                times = blocks[goals] - first
                again = np.repeat(np.arange(len(rows)), times)
                step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                parts.append((rows[again], goals[again], first[again] + step, np.ones(len(again), int)))
                who, where, block, role = (np.concatenate(p) for p in zip(*parts, strict=True))
                for at in range(0, len(who), 8192):
                    s = slice(at, at + 8192)
                    pick = pa.array(who[s])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(where[s], pa.int32()), pa.array(block[s], pa.int32()), pa.array(role[s], pa.int32()),
                            batch.column("node").take(pick), batch.column("copies").take(pick), batch.column("v").take(pick),
                        ],
                        ["cell", "block", "role", "node", "copies", "v"],
                    )

    return run


class _Block:
    """Members of one block, compared with each other and with guests as they come."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, x: np.ndarray, least: float) -> None:
        self.nodes, self.copies, self.x, self.least = nodes, copies, x, least
        self.label = np.arange(len(nodes))
        self.count = np.zeros(len(nodes), np.int64)
        self.links: list[tuple[int, int]] = []

    def _tie(self, node: int, hits: np.ndarray) -> None:
        labels = np.unique(self.label[hits])
        self.links += [(node, int(self.nodes[k])) for k in labels]
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def among(self) -> None:
        for begin in range(0, len(self.x), 512):
            close = self.x[begin : begin + 512] @ self.x.T >= self.least
            close[np.arange(len(close)), begin + np.arange(len(close))] = False
            self.count[begin : begin + 512] += close @ self.copies
            for i in np.flatnonzero(close.any(axis=1)):
                self._tie(int(self.nodes[begin + i]), np.append(np.flatnonzero(close[i]), begin + i))

    def guests(self, nodes: np.ndarray, copies: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """Numbers of vectors that the guests link with."""
        close = x @ self.x.T >= self.least
        self.count += copies @ close
        met = np.flatnonzero(close.any(axis=1))
        for i in met:
            self._tie(int(nodes[i]), np.flatnonzero(close[i]))
        return list(zip(nodes[met].tolist(), (close[met] @ self.copies).tolist(), strict=True))

    def result(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        some = self.count > 0
        return self.links, list(zip(self.nodes[some].tolist(), self.count[some].tolist(), strict=True))


def _comparer(least: float, kind: str):
    names = ["a", "b", "n"]

    def rows(links: list[tuple[int, int]], counts: list[tuple[int, int]]) -> pa.RecordBatch:
        a = [x for x, _ in links] + [x for x, _ in counts]
        b = [y for _, y in links] + [None] * len(counts)
        n = [None] * len(links) + [y for _, y in counts]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # members of a block still coming in

        def ready() -> _Block:
            made = _Block(*(np.concatenate(p) for p in zip(*waiting, strict=True)), least)
            made.among()
            return made

        for batch in batches:
            cell, part, role, node, copies = (batch.column(k).to_numpy() for k in range(5))
            x = _matrix(batch.column(5), kind)
            key = np.stack((cell, part, role))
            edges = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = (int(cell[lo]), int(part[lo]))
                if own != at:
                    if waiting:
                        block = ready()
                    if block:
                        yield rows(*block.result())
                    at, block, waiting = own, None, []
                if role[lo] == 0:
                    waiting.append((node[lo:hi], copies[lo:hi], x[lo:hi]))
                    continue
                if waiting:
                    block, waiting = ready(), []
                if block is None:  # guests of a block without members cannot be: empty blocks are not dealt
                    continue
                for s in range(lo, hi, 512):
                    e = min(s + 512, hi)
                    counts = block.guests(node[s:e], copies[s:e], x[s:e])
                    if counts:
                        yield rows([], counts)
        if waiting:
            block = ready()
        if block:
            yield rows(*block.result())

    return run

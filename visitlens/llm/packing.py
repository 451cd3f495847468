"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens. A round gives every queue its share of one window, in whole grains of a few
tokens; the part of a grain that a queue could not be given stays with it as a deficit and counts in the next
round. With a share of g grains, round r therefore serves the grains from floor(r * g) to floor((r + 1) * g) of
the queue, wherever its documents are stored, so the position of any token among all served tokens follows from its place in its own
queue and the queues' totals alone: nothing has to pass through one task, and no token is moved.
Windows are filled without a gap from the served stretches. A queue that runs dry is skipped, and the others
share its part in their proportions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.common import columns_of, saved, small_batches, text_or_empty

#: Tokens in a window, and the id that ends a document.
WINDOW, END_ID = 2048, 1
#: Tokens of a queue that are served at least at once, so that a rare source is not packed token by token.
GRAIN = 8
#: Sources with a queue of their own; the smaller ones beyond it share one more, so the table of queues is bounded.
OWN_QUEUES = 255
#: Parts, or hashes of rare sources, that are added up together.
BUCKETS = 1024
#: Parts of words whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text that are cut into words at once.
PORTION = 8 << 20

_NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECES = ", ".join(["doc_id bigint", "source string", *(f"{name} bigint" for name in _NUMBERS)])


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others
    follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of texts as 16-bit numbers, for a vocabulary that never joins across spaces.

    The tokenizer drops white space and splits at it, so the ids of a text are those of its words, one after the
    other. Texts are cut into words, the different words into the parts (letters, a digit, signs) that the
    tokenizer's own pattern gives, and only parts that are not remembered go through the merges; texts are then
    put together from their numbers. Words beyond Latin-1, with control characters or with what could be a
    special token go through the whole tokenizer.
    """
    import json
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    setup = json.loads(tokenizer.to_str())
    splitter, bytewise = setup["pre_tokenizer"]["pretokenizers"]
    steps = [n["type"] for n in setup["normalizer"]["normalizers"]]
    if steps != ["NFC", "Replace", "Lowercase"] or not splitter["invert"] or bytewise["type"] != "ByteLevel":
        raise ValueError("a byte-level tokenizer that lower-cases and keeps only what its pattern matches is asked for")
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids have to fit into 16 bits")
    pattern = f"({splitter['pattern']['Regex']})"
    setup["normalizer"] = setup["pre_tokenizer"] = None
    merges = Tokenizer.from_str(json.dumps(setup))
    letters = _byte_letters()
    whole = "\0"  # goes before words for the whole tokenizer
    known: dict[str, bytes] = {}

    def written(part: str) -> str:
        return part if part.isascii() else "".join([letters[b] for b in part.encode()])

    def learn(parts: list[str]) -> None:
        for by, names, forms in (
            (merges, own := [p for p in parts if p[0] != whole], map(written, own)),
            (tokenizer, rest := [p for p in parts if p[0] == whole], (p[1:] for p in rest)),
        ):
            texts = list(forms)
            for begin in range(0, len(texts), 4096):
                got = by.encode_batch_fast(texts[begin : begin + 4096], add_special_tokens=False)
                known.update(zip(names[begin : begin + 4096], [array("H", g.ids).tobytes() for g in got], strict=True))

    def part_ids(parts: list[str]) -> list[bytes]:
        if len(known) > REMEMBERED:
            known.clear()
        known[""] = b""
        found = list(map(known.get, parts))
        if None in found:
            learn([p for p, ids in zip(parts, found, strict=True) if ids is None])
            found = list(map(known.__getitem__, parts))
        return found

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more at the end)."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, r"[^\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]|<\|")
        cut = pc.utf8_lower(coded.dictionary)
        mixed = pc.invert(pc.utf8_is_alpha(cut))
        cut = pc.replace_with_mask(cut, mixed, pc.replace_substring_regex(cut.filter(mixed), pattern, r"\1 "))
        cut = pc.if_else(odd, pc.binary_join_element_wise(whole, coded.dictionary, ""), cut)
        parts = pc.split_pattern(cut, " ")
        part = parts.flatten().dictionary_encode()
        ids = part_ids(part.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        pool = np.frombuffer(b"".join(ids), "<u2")
        pool, bounds = _gathered(pool, np.cumsum(sizes) - sizes, sizes, part.indices.to_numpy(), parts.offsets.to_numpy())
        return _gathered(pool, bounds[:-1], np.diff(bounds), coded.indices.to_numpy(), words.offsets.to_numpy())

    return encode


def _gathered(
    pool: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``pool`` in the order of ``which``, and where every list of them (``bounds``) begins."""
    counts = sizes[which]
    done = np.concatenate(([0], np.cumsum(counts)))
    out = pool[np.repeat(first[which] - done[:-1], counts) + np.arange(done[-1])]
    return out, done[bounds - bounds[0]]


def _portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, pa.Array]]:
    """(number of texts that end in it, its texts): portions of about ``most`` bytes; a longer text comes in
    several, cut at spaces, of which only the last counts."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        if sizes[at] <= most:
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
            yield stop - at, texts.slice(at, stop - at)
            at = stop
            continue
        text, begin = texts[at].as_py(), 0
        while begin < len(text):
            stop = text.find(" ", begin + most)
            stop = len(text) if stop < 0 else stop
            yield int(stop == len(text)), pa.array([text[begin:stop]])
            begin = stop
        at += 1


def _larger(batches: Iterator[pa.RecordBatch], least: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have ``least`` bytes: words that repeat are then looked up once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("text").nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, part, start_in_part (tokens of the source before it in its part), n_tokens, ids (16 bits each).

    Written once: from here on the order of documents within a source is that of (part, place in it).
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # A worker serves many tasks and each brings its own copy of this code; what was learnt stays with the library.
        encoders = vars(tokenizers).setdefault("_encoders_by_path", {})
        encode = encoders.get(tokenizer_path) or encoders.setdefault(tokenizer_path, word_encoder(tokenizer_path))
        done: dict[str | None, int] = {}
        for batch in _larger(batches):
            ids: list[bytes] = []
            open_: list[bytes] = []  # of a text that comes in several portions
            for ended, texts in _portions(batch.column("text")):
                tokens, bounds = encode(texts)
                raw = memoryview(tokens.tobytes())
                for low, high in zip((2 * bounds[:-1]).tolist(), (2 * bounds[1:]).tolist(), strict=True):
                    open_.append(raw[low:high])
                    if ended:
                        ids.append(b"".join([*open_, end]))
                        open_ = []
            starts = []
            for source, own in zip(batch.column("source").to_pylist(), ids, strict=True):
                starts.append(done.get(source, 0))
                done[source] = starts[-1] + len(own) // 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("source"), batch.column("part"), pa.array(starts, pa.int64()),
                    pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                ],
                ["doc_id", "source", "part", "start_in_part", "n_tokens", "ids"],
            )

    rows = docs.select("doc_id", "source", text_or_empty("text").alias("text"), F.spark_partition_id().alias("part"))
    schema = "doc_id bigint, source string, part int, start_in_part bigint, n_tokens bigint, ids binary"
    return saved(rows.mapInArrow(run, schema), "tokens")


class Rounds:
    """Where tokens of queues fall among all served tokens."""

    def __init__(self, totals: list[int], weights: list[float], window: int) -> None:
        if any(w <= 0 for w in weights):
            raise ValueError("a source with a share of nothing would never be packed; leave its rows out instead")
        self.totals = np.array(totals, np.int64)
        share = np.array(weights, float)
        #: Grains that a queue may give in one round, a fraction.
        self.grains = window * share / share.sum() / GRAIN
        self.all = int(self.totals.sum())
        self.window = window

    def _given(self, queue: np.ndarray | int, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue without end has given in the first ``rounds`` rounds."""
        return GRAIN * np.floor(rounds * self.grains[queue]).astype(np.int64)

    def stretches(
        self, queue: np.ndarray, start: np.ndarray, stop: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens [start, stop) of queues, cut by rounds: row, begin and end in the queue, first position served."""
        low_grain = start // GRAIN
        counts = (stop - 1) // GRAIN - low_grain + 1
        row = np.repeat(np.arange(len(queue)), counts)
        low = GRAIN * (low_grain[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
        own = queue[row]
        # The round that gives a grain; the two corrections undo rounding.
        rounds = np.ceil((low + GRAIN) / GRAIN / self.grains[own]).astype(np.int64) - 1
        rounds = rounds + (self._given(own, rounds + 1) <= low)
        rounds = rounds - (self._given(own, rounds) > low)
        first = np.flatnonzero(np.concatenate(([True], (rounds[1:] != rounds[:-1]) | (row[1:] != row[:-1]))))
        last = np.append(first[1:], len(row)) - 1
        row, own, rounds, low, high = row[first], own[first], rounds[first], low[first], low[last] + GRAIN
        begins, ends = np.maximum(low, start[row]), np.minimum(high, stop[row])
        position = begins - self._given(own, rounds)
        queues = np.arange(len(self.totals))
        some = max(1, (1 << 20) // len(queues))
        for at in range(0, len(row), some):  # what all queues had given before
            s = slice(at, at + some)
            done = self._given(queues[None, :], rounds[s, None] + (queues[None, :] < own[s, None]))
            position[s] += np.minimum(self.totals[None, :], done).sum(axis=1)
        return row, begins, ends, position

    def edges(self) -> np.ndarray:
        """Where the sequences of the unfilled last window begin: powers of two, so that none needs padding."""
        rest, at, out = self.all % self.window, self.all - self.all % self.window, []
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                out.append(at)
                at += 1 << bit
        return np.array(out or [self.all], np.int64)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    mixture: dict[str | None, float] | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``mixture`` gives target token shares of sources; a source without one, and all of them by default, counts
    with its share of the corpus, so every window has the corpus's proportions. Shares are positive, and a share for a
    source that has no rows is an error. Sources beyond the OWN_QUEUES largest that ``mixture`` does not name share a
    queue, in which their parts are mixed by hash. All tokens are packed. A null or empty text is the end id alone; a
    null source is a queue like any other; repeated rows and null ids are packed as they come; an empty table gives no
    rows. Every sequence is full but those of the last window, which are powers of two.
    """
    spark = docs.sparkSession
    tokens = tokenized(columns_of(docs, doc_id=id_col, text=text_col, source=source_col), tokenizer_path, end_id)
    parts = saved(
        tokens.groupBy("source", "part").agg(F.sum("n_tokens").cast("bigint").alias("n"), F.count(F.lit(1)).alias("rows")),
        "parts",
    )
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    asked = list(mixture or {})
    given = [s for s in asked if s is not None]
    wanted = F.coalesce(F.col("source").isin(given), F.lit(None in asked)) if given else F.col("source").isNull() & F.lit(None in asked)
    # Sources that the mixture names have a queue of their own, however small they are.
    first = [F.desc("asked"), F.desc("n"), F.col("source").asc_nulls_first()]
    sources = sources.withColumn("asked", wanted).orderBy(*first).limit(max(OWN_QUEUES, len(asked)))
    largest = sources.withColumn("queue", F.row_number().over(Window.orderBy(*first)) - 1)
    largest = saved(largest.select("source", "queue", "n"), "queues")
    named = largest.orderBy("queue").collect()  # at most OWN_QUEUES rows, or those of the mixture
    unknown = set(asked) - {r["source"] for r in named}
    if unknown:
        raise ValueError(f"no rows of the sources {sorted(map(str, unknown))}, for which the mixture has a share")
    everything = parts.agg(F.sum("n")).first()[0] or 0
    totals = [r["n"] for r in named]
    own = [r["source"] for r in named]
    if everything > sum(totals):
        totals.append(everything - sum(totals))
    weights = [float(n) for n in totals]
    if mixture:
        weights = [mixture.get(s, n / everything) for s, n in zip(own, weights, strict=False)] + [
            n / everything for n in weights[len(own) :]
        ]
    rounds = Rounds(totals, weights, window)

    shared = len(own)
    queue = F.coalesce("queue", F.lit(shared)).cast("int")
    placed = parts.alias("p").join(F.broadcast(largest.select("source", "queue")).alias("q"), F.expr("p.source <=> q.source"), "left")
    placed = placed.select("p.source", "p.part", "p.n", queue.alias("queue"))
    # Tokens of a queue before each (source, part), in two steps: over buckets of them, and within a bucket.
    # In the shared queue the parts of all sources are mixed, so that a window has its share of each of them on average.
    bucket = F.when(F.col("queue") == shared, F.pmod(F.xxhash64("part", "source"), F.lit(BUCKETS))).otherwise(
        F.floor(F.col("part") / BUCKETS)
    )
    placed = placed.withColumn("bucket", bucket)
    ahead = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("queue", "bucket").agg(F.sum("n").alias("n"))
    sums = sums.select("queue", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = [F.col("source").asc_nulls_first(), "part"]
    before = Window.partitionBy("queue", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sums, ["queue", "bucket"])
    base = (F.col("ahead") + F.col("inside")).alias("base")
    known = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")]
    bases = saved(placed.select(*known, "part", "queue", base), "bases")

    lined = tokens.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    rows = lined.join(bases, ["s", "none", "part"]).select(
        "doc_id", "source", "queue", (F.col("base") + F.col("start_in_part")).alias("first"), "n_tokens", "ids"
    )
    small_batches(spark)
    pieces = rows.mapInArrow(_cutter(rounds), _PIECES)
    return pieces.select(*[c for c in pieces.columns if c != "source"], "source")


def _cutter(rounds: Rounds):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string())]
        + [(name, pa.int64()) for name in _NUMBERS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, window = rounds.edges(), rounds.window
        full = rounds.all // window

        def sequence(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sequence, its first position and its end."""
            late = positions >= full * window
            k = np.searchsorted(edges, positions, "right") - 1
            ends = np.concatenate((edges[1:], [rounds.all]))
            k = np.maximum(k, 0)
            begin = np.where(late, edges[k], positions // window * window)
            end = np.where(late, ends[k], begin + window)
            return np.where(late, full + k, positions // window), begin, end

        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, first = batch.column("n_tokens").to_numpy(), batch.column("first").to_numpy()
            row, lo, hi, at = rounds.stretches(batch.column("queue").to_numpy(), first, first + lengths)
            pieces = []
            while lo.size:  # a stretch that meets the end of its sequence goes on in the next
                seq, begin, end = sequence(at)
                take = np.minimum(hi - lo, end - at)
                pieces.append(np.stack((row, lo - first[row], take, seq, at - begin)))
                more = lo + take < hi
                row, lo, hi, at = row[more], (lo + take)[more], hi[more], (at + take)[more]
            row, start, length, seq, offset = np.concatenate(pieces, axis=1)
            order = np.lexsort((start, row))
            row, start, length, seq, offset = row[order], start[order], length[order], seq[order], offset[order]
            crcs = np.empty(len(row), np.int64)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, ids in enumerate(batch.column("ids")):
                raw = memoryview(np.frombuffer(ids.as_py(), "<u2").astype("<u4").tobytes())
                s = slice(bounds[i], bounds[i + 1])
                begins = (4 * start[s]).tolist()
                ends = (4 * (start[s] + length[s])).tolist()
                crcs[s] = [zlib.crc32(raw[b:e]) for b, e in zip(begins, ends, strict=True)]
            values = (start, length, crcs, lengths[row], seq, offset)
            names = [batch.column(c) for c in ("doc_id", "source")]
            for begin in range(0, len(row), 50_000):
                part = slice(begin, begin + 50_000)
                which = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [c.take(which) for c in names] + [pa.array(v[part].astype(np.int64)) for v in values], schema=schema
                )

    return run

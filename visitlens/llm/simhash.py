"""SimHash near-duplicates found by the generalised pigeonhole principle.

A text's fingerprint has 64 bits. Bits are grouped into parts so that bits that go together share a part.
If part i is searched up to distance t_i and the numbers t_i + 1 add up to ``most + 1``, then two fingerprints
that differ in ``most`` bits or fewer are within t_i in at least one part: were every part farther apart, the
distances would add up to more. A dynamic programme chooses the number of parts and the t_i that cost least by
estimated candidates and probes; it affects the cost alone, never which links are found.

``keep_one`` asks for more than few bits can tell: it joins texts whose sets of five-word shingles have a
similarity (Jaccard) of 0.8 or more, which is about ten bits. It probes the sets' fingerprints by the same pigeonhole
for candidates within ``PROBE_BITS``. At the bits that reach every such pair the probes would compare nearly all texts, so
pairs beyond come from bands of minima over the shingles with a wide bit limit within a band. Every candidate is held
against the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import columns_of, saved, small_batches, text_or_empty
from visitlens.llm.components import components

#: Words in a shingle and the hash's seed.
SHINGLE, SEED = 4, 42
#: Fingerprints that differ in so many bits or fewer are linked.
MOST_BITS = 4
#: Near copies of ``keep_one``: words in a shingle and the least share of common shingles.
COPY_SHINGLE, COPY_SHARE = 5, 0.8
#: Bits within which ``keep_one`` finds every pair of fingerprints by the pigeonhole.
PROBE_BITS = 8
#: Bands of minima and minima in a band: at a share of 0.8 a pair has a band in common in 0.9993 of cases.
BANDS, IN_BAND = 24, 6
#: Bits in which candidates of one band may differ: at a share of 0.8 the mean is 9.7 with a deviation of 2.9.
COPY_BITS = 22
#: Texts, and their code points, of a group of candidates that are compared in one block.
COPY_BLOCK, COPY_CHARS = 1024, 4 << 20
#: Fingerprints looked at for the cost estimate (a statistic that decides the plan only).
SAMPLE = 8192
#: Numbers of parts that are weighed against each other.
PARTS = (2, 3, 4, 5)
#: Cost of a probe row (made, shuffled, sorted and sent to Python) against that of comparing one candidate pair.
PROBE_COST = 300.0
#: Owners and probes of a bucket that are compared in one block; larger buckets are cut into slices of so many.
BLOCK = 4096
#: Groups of up to so many owners are compared many at a time, larger ones one by one.
SMALL = 64
#: Close pairs for each row of a group beyond which it is searched.
DENSE = 16
#: Rows that are put together before their groups are compared.
PORTION = 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1 << 16


def fingerprint(text: str) -> int:
    """The fingerprint of one text, signed; zero without words."""
    words = _words(text)
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for digests in _digests(words, SHINGLE):
        ones, total = ones + _ones(digests), total + len(digests)
    return _majority(ones, total)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _digests(words: list[bytes], shingle: int) -> Iterator[list[int]]:
    """Hashes of all shingles in portions; fewer words than a shingle has are one shingle."""
    if len(words) <= shingle:
        yield [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        return
    total = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for begin in range(0, total, _PIECE):
        part = words[begin : begin + _PIECE + shingle - 1]
        line = b" ".join(part)
        stops = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))
        ends = stops[shingle - 1 :].tolist()
        yield [digest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends, strict=False)]


def _majority(ones: np.ndarray, total: int) -> int:
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _ones(digests: list[int]) -> np.ndarray:
    raw = np.array(digests, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a column; a null text has that of an empty one."""

    @F.pandas_udf("bigint")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "") for t in texts], dtype="int64")

    return compute(text)


# Choosing parts and thresholds


def _bits(fps: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(fps, np.int64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them bits i and j are both set; all are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy()).astype(np.float32)
            both, n = both + x.T @ x, n + len(x)
        values = np.concatenate((both.ravel(), [n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = np.zeros(64 * 64 + 1)
    for row in cells.collect():  # 4097 rows
        sums[row["cell"]] = row["n"]
    return int(sums[-1]), sums[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of like size; a group takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: tie[b, group].mean())
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def close_share(sample: np.ndarray, mask: int, most: int) -> np.ndarray:
    """Share of the pairs of ``sample`` within distance 0, 1, ... ``most`` in the bits of ``mask``."""
    keys = sample.view(np.uint64) & np.uint64(mask)
    seen = np.zeros(65)
    for begin in range(0, len(keys), 256):
        rows = keys[begin : begin + 256, None] ^ keys[None, :]
        seen += np.bincount(np.bitwise_count(rows).ravel(), minlength=65)
    seen[0] -= len(keys)
    return np.cumsum(seen)[: most + 1] / max(1.0, len(keys) * (len(keys) - 1.0))


def allocate(cost: list[list[float]], most: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 whose t_i + 1 add up to ``most + 1`` at the least total ``cost[i][t_i + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for step in range(min(most + 1 - used, len(own) - 1) + 1):
                option = (total + own[step], [*chosen, step - 1])
                if used + step not in after or option[0] < after[used + step][0]:
                    after[used + step] = option
        best = after
    return best[most + 1]


def choose_parts(fps: DataFrame, most: int = MOST_BITS) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each part that is searched."""
    n, both = bit_pairs(fps)
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64)
    options = []
    for parts in PARTS:
        groups = group_bits(n, both, parts)
        costs = []
        for bits in groups:
            close = close_share(sample, _mask(bits), most)
            probes = np.cumsum([_choose(len(bits), d) for d in range(most + 1)])
            # An empty table still takes the plan with few probes: millions of flips are slow to plan, whatever their rows.
            costs.append([0.0, *(PROBE_COST * max(n, 1) * probes + close * n * n / 2)])
        total, chosen = allocate(costs, most)
        options.append((total, [(_mask(g), g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


# Probing and verifying


def close_links(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, distinct) within ``most`` bits into their components.

    Every fingerprint owns a place in its own bucket of each part and probes those of the keys within the part's
    threshold; of two keys only the smaller probes the larger, so a pair meets once per part. Buckets with
    more than ``block`` owners and probes are cut into slices that meet in blocks, so no task holds a whole hot bucket.
    Within a block every owner is compared with all others, and a spanning forest of the close ones is returned.
    """
    parts = choose_parts(fps, most)
    homes = _union([_home(fps, index, mask) for index, (mask, _, _) in enumerate(parts)])
    owners = saved(homes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("owners")), "owners")
    rows, counts = [homes], [owners.withColumn("probes", F.lit(0).cast("bigint"))]
    for index, (mask, bits, threshold) in enumerate(parts):
        flips = [_signed(_mask(list(c))) for d in range(1, threshold + 1) for c in combinations(bits, d)]
        if flips:
            rows.append(_larger_keys(_home(fps, index, mask, probe=1), flips))
            asked = _larger_keys(owners.where(F.col("part") == index), flips)
            counts.append(asked.select("part", "key", F.lit(0).cast("bigint").alias("owners"), F.col("owners").alias("probes")))
    counts = _union(counts).groupBy("part", "key").agg(F.sum("owners").alias("owners"), F.sum("probes").alias("probes"))
    return _bucket_links(counts, _union(rows), most, block)


def _home(fps: DataFrame, index: int, mask: int, probe: int = 0) -> DataFrame:
    key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    return fps.select(F.lit(index).alias("part"), key.alias("key"), "fp", F.lit(probe).alias("probe"))


def _larger_keys(rows: DataFrame, flips: list[int]) -> DataFrame:
    """Each row of ``rows`` (key and others) once for every larger key that differs from its own by one of ``flips``."""
    near = rows.withColumnRenamed("key", "own")
    other = F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("own").bitwiseXOR(f)))
    return near.select("*", other.alias("key")).where("key > own").select(*rows.columns)


def _bucket_links(counts: DataFrame, rows: DataFrame, most: int, block: int) -> DataFrame:
    """Links within ``most`` bits inside the buckets (part, key) of ``rows`` (part, key, fp, probe).

    A row is an owner of its bucket (probe 0), which is compared with all others, or probes it (probe 1) and is compared
    with its owners. ``counts`` (part, key, owners, probes) has the rows of each bucket.
    """
    dealt = _dealt(counts, rows, block).repartition("part", "key", "cell")
    # The key leads the order: most comparisons of the sort end with it.
    sorted_rows = dealt.sortWithinPartitions("key", "part", "cell", "probe")
    return sorted_rows.mapInArrow(_linker(most), "a bigint, b bigint").distinct()


def _dealt(counts: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with the cells in which they are compared; a cell has two slices of its bucket at most."""
    hot = counts.where(F.col("owners") + F.col("probes") > block)
    slices = [F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("owners", "probes")]
    rows = rows.join(saved(hot.select("part", "key", *slices), "hot"), ["part", "key"], "left")
    owners, probes = F.coalesce("owners", F.lit(1)), F.coalesce("probes", F.lit(0))
    spread, probing = F.xxhash64("fp"), F.col("probe") == 1
    mine = F.when(probing & (probes > 0), owners + F.pmod(spread, F.greatest(probes, F.lit(1)))).otherwise(
        F.pmod(spread, F.greatest(owners, F.lit(1)))
    )
    # Probes meet owners only; a bucket of probes alone has nothing to compare.
    others = F.when(probing, owners).otherwise(owners + probes)
    cut = rows.where(owners > 0).select(
        "part", "key", "fp", "probe", mine.cast("int").alias("mine"), (owners + probes).alias("slices"),
        F.explode(F.sequence(F.lit(0), others - 1)).alias("with"),
    )
    cell = F.least("mine", "with") * F.col("slices").cast("bigint") + F.greatest("mine", "with")
    return cut.select("part", "key", cell.alias("cell"), "probe", "fp")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _linker(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [np.zeros((5, 0), np.int64)], 0
        for batch in batches:
            rest.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)]))
            held += rest[-1].shape[1]
            if held < PORTION:
                continue
            rows = np.concatenate(rest, axis=1)
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
            whole = cuts[-1] + 1 if len(cuts) else 0  # the last group may go on in the next batch
            yield from _forest(rows[:, :whole], most)
            rest = [rows[:, whole:].copy()]
            held = 0 if whole else -held  # a group of many portions is put together when its rows have doubled
        yield from _forest(np.concatenate(rest, axis=1), most)

    return run


def _forest(rows: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of whole groups (rows: part, key, cell, probe, fingerprint), in each the owners first."""
    if not rows.shape[1]:
        return
    fps = rows[4].view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
    sizes = np.diff(np.concatenate((starts, [fps.size])))
    owners = np.add.reduceat(rows[3] == 0, starts, dtype=np.int64)
    own, first = np.repeat(owners, sizes), np.repeat(starts, sizes)
    place = np.arange(fps.size) - first
    pick = np.flatnonzero(own <= SMALL)
    left, right = [], []
    for k in range(SMALL):  # the owner at place k against all rows behind it
        pick = pick[(place[pick] > k) & (own[pick] > k)]
        if not pick.size:
            break
        x, y = fps[pick], fps[first[pick] + k]
        good = np.bitwise_count(x ^ y) <= most
        left.append(x[good])
        right.append(y[good])
    links = _spanning(np.concatenate(left), np.concatenate(right)) if left else []
    for g in np.flatnonzero(owners > SMALL):
        group = fps[starts[g] : starts[g] + sizes[g]]
        links += _compare(group[: owners[g]], group[owners[g] :], most)
    if links:
        pairs = np.array(links, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])


def _compare(owners: np.ndarray, probes: np.ndarray, most: int, cells: int = 1 << 18) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs of one group: of two owners, or of an owner and a probe.

    All pairs are compared in arrays of about ``cells``. Where few are close, they are the links; where many are, the
    rows that have any are searched, and each step meets many of them."""
    owners = np.unique(owners)
    rows = np.concatenate((owners, probes))
    linked, left, right, found = np.zeros(rows.size, bool), [], [], 0
    step = max(1, cells // owners.size)
    for begin in range(0, rows.size, step):
        part = rows[begin : begin + step]
        until = owners[: begin + part.size]
        hits = np.flatnonzero(np.bitwise_count(part[:, None] ^ until[None, :]) <= most)
        i, j = hits // until.size + begin, hits % until.size
        i, j = i[j < i], j[j < i]  # an owner among owners meets those before it
        linked[i] = linked[j] = True
        found += i.size
        if found <= DENSE * rows.size:
            left.append(rows[i])
            right.append(rows[j])
    if found > DENSE * rows.size:
        return _search(rows[linked], most)
    return _spanning(np.concatenate(left), np.concatenate(right))


def _spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    links = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            links.append((x, y))
    return links


def _search(fps: np.ndarray, most: int, wide: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of one group by breadth-first search: each member is met once and expanded once."""
    open_ = np.unique(fps)
    links = []
    while open_.size:
        front, open_ = open_[:1], open_[1:]
        while front.size and open_.size:
            now, front = front[:wide], front[wide:]
            near = np.bitwise_count(now[:, None] ^ open_[None, :]) <= most
            met = near.any(axis=0)
            links += zip(now[near[:, met].argmax(axis=0)].tolist(), open_[met].tolist(), strict=True)
            front, open_ = np.concatenate((front, open_[met])), open_[~met]
    return links


def fingerprint_classes(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``prints`` (fp): equal roots are linked."""
    fps = saved(prints.select("fp").distinct(), "fps")
    comps = components(close_links(fps, most))
    return fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) of every row.

    Null and empty texts have the fingerprint zero and are linked like any other; repeated rows each come
    back; a row with a null id gets the component of its fingerprint, null if no member has an id. Texts are
    read whole. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    own = columns_of(docs, doc_id=id_col, text=text_col)
    prints = saved(own.select("doc_id", fingerprint_of(text_or_empty("text")).alias("fp")), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = saved(fingerprint_classes(least, most).join(least, "fp"), "classes")
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(heads, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near copies by their shingle sets


def shingle_set(text: str, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted; none without words."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate([np.array(d, np.uint64) for d in _digests(words, shingle)]))


def _factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * IN_BAND), np.int64).astype(np.uint64) * np.uint64(2)
    return draw[0] + np.uint64(1), draw[1], draw[2] + np.uint64(1)


_TIMES, _PLUS, _MIX = _factors()


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band: equal when the band's minima of two shingle sets are equal."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(own), 1024):
        least = np.minimum(least, (_TIMES[:, None] * own[None, begin : begin + 1024] + _PLUS[:, None]).min(axis=1))
    return (least * _MIX).reshape(BANDS, IN_BAND).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketch(text: Column) -> Column:
    """node (stands for the shingle set), fp (the set's fingerprint) and bands; zeros and no bands without words."""

    @F.pandas_udf("node bigint, fp bigint, bands array<bigint>")
    def compute(texts: pd.Series) -> pd.DataFrame:
        nodes, fps, bands = [], [], []
        for text in texts:
            own = shingle_set(text)
            nodes.append(_signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)) if own.size else 0)
            ones = sum((_ones(own[i : i + _PIECE]) for i in range(0, len(own), _PIECE)), np.zeros(64, np.int64))
            fps.append(_majority(ones, len(own)))
            bands.append(band_keys(own) if own.size else np.zeros(0, np.int64))
        return pd.DataFrame({"node": nodes, "fp": fps, "bands": bands})

    return compute(text)


def copy_links(rows: DataFrame, share: float = COPY_SHARE, block: int = COPY_BLOCK) -> DataFrame:
    """Links (a, b) that join the nodes of ``rows`` (node, fp, bands, text, row) with similar shingle sets.

    Fingerprints within ``PROBE_BITS``, all of which the pigeonhole finds, and those that share a band and differ in
    ``COPY_BITS`` or fewer hang together in groups, so a text is sent once, to its group. Within a group every pair is compared exactly; a large one is cut into blocks of two slices each.
    """
    nodes = saved(rows.where(F.size("bands") > 0).dropDuplicates(["node"]).select("node", "fp", "bands", "row"), "nodes")
    buckets = nodes.select("fp", F.posexplode("bands").alias("part", "key"))
    buckets = buckets.select("part", "key", "fp", F.lit(0).alias("probe"))
    counts = buckets.groupBy("part", "key").agg(F.count(F.lit(1)).alias("owners"), F.lit(0).cast("bigint").alias("probes"))
    close = close_links(saved(nodes.select("fp").distinct(), "fps"), PROBE_BITS)
    wide = _bucket_links(counts, buckets, COPY_BITS, BLOCK)
    groups = components(close.unionByName(wide)).withColumnRenamed("node", "fp")
    grouped = nodes.join(groups, "fp", "left").select("node", "row", F.coalesce("root", "fp").alias("grp"))
    grouped = saved(grouped, "groups")
    # Counts are written before they are joined: rows of a large group are then dealt for the join alone, and Spark can
    # cut its partition.
    several = saved(grouped.groupBy("grp").count().where(F.col("count") > 1).select("grp"), "several")
    members = grouped.join(several, "grp").join(rows.select("row", "text"), "row").select("grp", "node", "text")
    members = saved(members, "members")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    slices = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / COPY_CHARS)).cast("int")
    sizes = saved(sizes.select("grp", slices.alias("slices")), "sizes")
    cut = members.join(sizes, "grp").withColumn(
        "mine", F.pmod(F.xxhash64("node"), "slices").cast("int")
    )
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cell = F.least("mine", "with") * F.col("slices").cast("bigint") + F.greatest("mine", "with")
    dealt = cut.select("grp", cell.alias("cell"), "node", "text")
    dealt = dealt.repartition("grp", "cell").sortWithinPartitions("grp", "cell")
    return dealt.mapInArrow(_copy_linker(share), "a bigint, b bigint").distinct()


def _copy_linker(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for grp, cell, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, cell) != now:
                    yield from _as_links(similar_sets(held, share))
                    now, held = (grp, cell), {}
                held[node] = shingle_set(text)
        yield from _as_links(similar_sets(held, share))

    return run


def _as_links(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        pairs = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])


def similar_sets(sets: dict[int, np.ndarray], share: float = COPY_SHARE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with at least ``share`` of their members in common."""
    if len(sets) < 2:
        return []
    nodes, sizes = list(sets), np.array([len(x) for x in sets.values()])
    stops = np.cumsum(sizes)
    starts = stops - sizes
    which = np.unique(np.concatenate(list(sets.values())), return_inverse=True)[1]
    mark = np.zeros(len(which), np.int32)
    open_, links = np.ones(len(nodes), bool), []
    for first in range(len(nodes)):
        front, open_[first] = [first] if open_[first] else [], False
        while front and open_.any():
            i = front.pop()
            own = which[starts[i] : stops[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[which], starts)
            mark[own] = 0
            met = np.flatnonzero(open_ & (common >= share * (sizes[i] + sizes - common) - 1e-9))
            open_[met] = False
            links += [(nodes[i], nodes[j]) for j in met]
            front += met.tolist()
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = COPY_SHARE) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest id (nulls last).

    Near copies have at least ``share`` of their different five-word shingles in common (Jaccard, words
    lower-cased); a class is what hangs together by them. Null and empty texts are one class. Texts are read
    whole. All columns stay. Of repeated rows with one id a single row stays. Columns of any name may be there.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    sketched = inner.withColumn("sketch", _sketch(text_or_empty(text)))
    rows = saved(sketched.select("*", "sketch.*", F.monotonically_increasing_id().alias("row")).drop("sketch"), "rows")
    comps = components(copy_links(rows.withColumn("text", text_or_empty(text)), share))
    order = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), "row")
    least = rows.groupBy("node").agg(F.min(order).alias("least"))
    classes = least.join(comps, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    stay = classes.groupBy("root").agg(F.min("least")["row"].alias("row")).select("row")
    return rows.join(stay, "row", "left_semi").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)

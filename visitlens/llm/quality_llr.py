"""Quality rules: base counts per text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed unigrams and bigrams are estimated, one from trusted documents and one from the
whole corpus. A document's score is the mean over its words of the log ratio of the two; junk uses n-grams that
trusted documents lack, which pulls the mean down. Built-in functions only: the table of log ratios has a fixed
number of cells and travels as one constant, so scoring is a plain projection of each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import columns_of, let, text_or_empty

#: Cells for unigrams, and as many again for bigrams; a power of two.
CELLS = 1 << 14
#: N-grams per cell that the target is taken to share with the raw corpus beforehand.
PRIOR = 10
#: Trusted documents that the target is estimated from, at most; chosen by the hash of their ids.
TRUSTED = 20_000
#: A document of n words stays if its mean log ratio is at least LEAST - MARGIN / sqrt(n).
LEAST, MARGIN = -0.15, 0.5
#: Base rules.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _cell(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _next_cell(hashes: Column, x: Column, i: Column) -> Column:
    """Cell of the bigram that starts at i; the last word stands alone."""
    return _cell(F.xxhash64(x, F.get(hashes, i + 1))) + CELLS


def repeat_words(hashes: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, the first time included."""
    window = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - WINDOW + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
    )

    def covered(places: Column) -> Column:
        """Each window covers five words, less where the next begins earlier."""
        gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda s, i: (s["h"] == F.get(ordered, i - 1)["h"]) | (s["h"] == F.get(ordered, i + 1)["h"]),
        )
        return F.array_sort(F.transform(twice, lambda s: s["i"]))

    def count(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda o: let(places(o), covered))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)

    return let(window, count)


def _counts(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(hashes),
    }
    return {name: value.cast("bigint") for name, value in counts.items()}


def verdict(text: Column, ratios: list[float]) -> Column:
    """A struct of the base counts, base_failed, score and kept. Every intermediate value is bound once, so the
    expression costs the same wherever the optimiser puts it, in a projection or in a filter."""

    def decide(c: Column) -> Column:
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
        least = F.lit(LEAST) - F.lit(MARGIN) / F.sqrt(F.greatest(c["n_words"], F.lit(1)))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
        return F.struct(
            *[c[n].alias(n) for n in names],
            failed.alias("base_failed"),
            (~failed & (c["score"] >= least)).alias("kept"),
        )

    def measure(words: Column, hashes: Column) -> Column:
        counts = _counts(text, words, hashes)
        return F.struct(*[v.alias(k) for k, v in counts.items()], mean_ratio(hashes, ratios).alias("score"))

    return let(words_of(text), lambda w: let(_hashes(w), lambda h: let(measure(w, h), decide)))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log of target share over raw share of each cell, from all of ``docs`` (doc_id, text).

    The target's shares are drawn towards the raw ones as if PRIOR more n-grams per cell had been seen in raw
    proportions: a small target says little, and chance gaps of it are no evidence against a document.

    ``trusted`` (doc_id) names the target documents; at most TRUSTED of them, those with the smallest hashes,
    are looked up, so the broadcast is bounded. The counts have 2 * CELLS rows.
    """
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.limit(TRUSTED).withColumn("target", F.lit(1))
    words = _hashes(words_of(text_or_empty("text")))
    one = lambda h: F.transform(h, lambda x, i: F.struct(_cell(x).alias("u"), _next_cell(h, x, i).alias("b")))
    cells = docs.select("doc_id", let(words, one).alias("cells"))
    flagged = cells.join(F.broadcast(ids), "doc_id", "left")
    pairs = flagged.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode("cells").alias("c"))
    both = pairs.select("target", F.explode(F.array("c.u", "c.b")).alias("cell"))
    counts = both.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [0] * (2 * CELLS), [0] * (2 * CELLS)
    for row in counts:
        raw[row["cell"]], target[row["cell"]] = row["raw"], row["target"]
    out: list[float] = []
    for begin in (0, CELLS):
        r, t = raw[begin : begin + CELLS], target[begin : begin + CELLS]
        if not sum(t):
            return [0.0] * (2 * CELLS)
        rows, known = sum(r), sum(t)
        out += [math.log((y * rows / x + PRIOR * CELLS) / (known + PRIOR * CELLS)) if x else 0.0 for x, y in zip(r, t, strict=True)]
    return out


def mean_ratio(hashes: Column, ratios: list[float]) -> Column:
    """Mean over the words of the log ratios of their unigram and bigram cells; 0 without words."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    own = F.transform(hashes, lambda x, i: F.get(table, _cell(x)) + F.get(table, _next_cell(hashes, x, i)))
    total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(hashes) == 0, F.lit(0.0)).otherwise(total / F.size(hashes))


def fitted(docs: DataFrame, labels: DataFrame) -> list[float]:
    """``log_ratios`` with the documents labelled 1 in ``labels`` (doc_id, quality) as the target."""
    good = columns_of(labels, doc_id="doc_id", quality="quality").where("quality = 1")
    return log_ratios(docs, good.select("doc_id"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, score.

    A null or empty text has no words and fails the base rules. Repeated rows each get their own row, null
    ids too (they are never trusted). Labels that name no document, conflict (one 1 is enough) or are missing
    altogether are fine: without a target every score is 0 and the base rules alone decide.
    """
    own = columns_of(docs, doc_id=id_col, text=text_col)
    found = own.select("doc_id", verdict(text_or_empty("text"), fitted(own, labels)).alias("v"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *[f"v.{c}" for c in (*counts, "base_failed", "kept", "score")])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all their columns, whatever their names."""
    own = columns_of(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.where(verdict(text, fitted(own, labels))["kept"])

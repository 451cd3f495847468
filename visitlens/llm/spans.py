"""Places of pattern matches in a text, with built-in functions only.

Patterns are Java's. Positions count code points from 0, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.llm.common import let

SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches that are put together at a time: a list that grows is copied for each of them.
BLOCK = 128


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _beginnings(items: Column) -> Column:
    return F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK))


def _block(measured: Column, begin: Column, kind: int) -> Column:
    """Of BLOCK matches from ``begin`` on: their length with the gaps, and the spans counted from their beginning."""
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(acc: Column, item: Column) -> Column:
        first = acc["at"] + item["gap"]
        end = first + item["size"]
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(item["good"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.slice(measured, begin + 1, BLOCK), start, step)


def _joined(blocks: Column) -> Column:
    """The spans of all blocks, each moved by the length of those before it."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")
    )
    starts = F.aggregate(blocks, nothing, step, lambda acc: acc["starts"])

    def moved(block: Column, by: Column) -> Column:
        return F.transform(
            block["found"],
            lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")),
        )

    return F.flatten(F.zip_with(blocks, starts, moved))


def find_spans(
    text: Column,
    pattern: str,
    kind: int,
    accept: Callable[[Column], Column] | None = None,
    hint: str | Column | None = None,
) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` that ``accept`` takes, as an array of ``SPANS``.

    The pieces between the matches and the matches themselves are measured and added up from the left, in blocks, so one
    pass gives all positions and a text with very many matches costs little more than its length. A text without a
    match of ``hint`` (a cheaper pattern or a condition that every text with a match meets) is not searched at all.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.zip_with(
        F.split(text, pattern, -1),
        matches,
        lambda piece, match: F.struct(
            F.length(piece).alias("gap"),
            F.coalesce(F.length(match), F.lit(0)).alias("size"),
            (match.isNotNull() if accept is None else F.coalesce(accept(match), F.lit(False))).alias("good"),
        ),
    )
    blocks = lambda m: F.transform(_beginnings(m), lambda i: _block(m, i, kind))
    found = let(measured, lambda m: let(blocks(m), _joined))
    likely = hint if isinstance(hint, Column) else text.rlike(hint or pattern)
    return F.when(likely, found).otherwise(no_spans())


def spans_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(name) for name in kinds])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def cut_out(text: Column, spans: Column, marks: tuple[str, ...]) -> Column:
    """``text`` with every span replaced by the mark of its kind; overlapping spans give one mark. ``spans`` is sorted.

    Spans are handled in blocks here too: a block's stretch of the text is cut out first, so that its parts are not
    looked for from the beginning of the text.
    """
    names = F.array(*[F.lit(mark) for mark in marks])

    def ends(acc: Column, block: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["end"]))).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"])).alias("starts"),
        )

    def within(block: Column, begin: Column, stretch: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            before = F.substring(stretch, acc["at"] - begin + 1, s["start"] - acc["at"])
            return F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(fresh, F.concat(acc["out"], F.array(before, F.get(names, s["kind"]))))
                .otherwise(acc["out"])
                .alias("out"),
            )

        nothing = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(block, nothing, step, lambda acc: F.array_join(acc["out"], ""))

    def clean(block: Column, begin: Column) -> Column:
        end = F.array_max(F.transform(block, lambda s: s["end"]))
        return let(F.substring(text, begin + 1, end - begin), lambda stretch: within(block, begin, stretch))

    def joined(blocks: Column, scan: Column) -> Column:
        rest = F.substring(text, scan["at"] + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(blocks, scan["starts"], clean), ""), rest)

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    blocks = F.transform(_beginnings(spans), lambda i: F.slice(spans, i + 1, BLOCK))
    whole = let(blocks, lambda b: let(F.aggregate(b, nothing, ends), lambda scan: joined(b, scan)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)

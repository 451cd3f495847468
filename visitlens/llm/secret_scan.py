"""Secrets in texts, and weak candidates that become credentials through their neighbours.

Strong patterns are reported wherever they stand. Weak ones (a bare upper-case identifier, a bare random
string, a service address) are reported only when the parts that complete a credential stand within the same
scope: an identifier with a secret, a secret with an identifier, an address with both. Complementary parts are
found by an interval join: positions are put into cells as wide as the scope, each cell keeps only the first
and last position of either role, and a candidate looks into its own cell and the two beside it. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import columns_of, let, saved, text_key, text_or_empty
from visitlens.llm.spans import SPANS, count_kind, cut_out, find_spans, no_spans, spans_text

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT = range(6)
BASE = 3
#: Code points between the beginnings of parts that still belong together.
SCOPE = 400

ASSIGN_PATTERN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_PATTERN = r"AKIA[A-Z0-9]{14,}"
HEX_PATTERN = r"[0-9a-f]{16,}"
_EDGE, _END = r"(?<![A-Za-z0-9+/=_-])", r"(?![A-Za-z0-9+/=_-])"
WEAK_ID_PATTERN = rf"{_EDGE}(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{{16,}}+{_END}"
WEAK_SECRET_PATTERN = (
    rf"{_EDGE}(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])"
    rf"[A-Za-z0-9+/_-]{{20,}}+={{0,2}}{_END}"
)
ENDPOINT_PATTERN = (
    r"(?i:https?|jdbc:[a-z0-9]+|amqps?|rediss?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|s3|ftp)"
    r"://[A-Za-z0-9.-]+(?::[0-9]+)?"
)
def _could_be_weak(text: Column) -> Column:
    """Met by every text with a weak candidate: a bare identifier and a random string hold digits, an address ://."""
    return text.rlike("[0-9]") | text.contains("://")


def base_spans(text: Column) -> Column:
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN_PATTERN, 2)) >= 12
    named = (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN_PATTERN)
    found = [
        find_spans(text, ASSIGN_PATTERN, ASSIGN, long_value, hint=named),
        find_spans(text, ACCESS_PATTERN, ACCESS, hint=text.contains("AKIA")),
        find_spans(text, HEX_PATTERN, HEX),
    ]
    return F.array_sort(F.concat(*found))


def weak_spans(text: Column) -> Column:
    found = [
        find_spans(text, WEAK_ID_PATTERN, WEAK_ID),
        find_spans(text, WEAK_SECRET_PATTERN, WEAK_SECRET),
        find_spans(text, ENDPOINT_PATTERN, ENDPOINT),
    ]
    return F.when(_could_be_weak(text), F.concat(*found)).otherwise(no_spans())


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (with text) plus base and weak spans and the text's key; weak spans inside base ones are dropped."""
    found = rows.withColumns({"base": base_spans(F.col("text")), "weak": weak_spans(F.col("text"))})
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    keys = dict(zip(("k1", "k2"), text_key(F.col("text")), strict=True))
    return found.withColumns({"weak": F.when(F.size("weak") > 0, free).otherwise(F.col("weak")), **keys})


def linked_spans(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k1, k2, linked): the weak spans of each text that complementary parts within ``scope`` confirm.

    ``parts`` has k1, k2, base and weak. Copies of a text are worked on once.
    """
    texts = parts.where(F.size("weak") > 0).groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    each = texts.select("k1", "k2", F.explode(F.concat("base", "weak")).alias("s")).select(
        "k1", "k2", "s", F.floor(F.col("s.start") / scope).alias("cell")
    )
    each = saved(each, "parts")
    is_id = F.col("s.kind").isin(ACCESS, WEAK_ID)
    is_secret = F.col("s.kind").isin(ASSIGN, HEX, WEAK_SECRET)
    sides = {}
    for name, own in (("id", is_id), ("secret", is_secret)):
        at = F.when(own, F.col("s.start"))
        sides |= {f"{name}_first": F.min(at), f"{name}_last": F.max(at)}
    cells = each.groupBy("k1", "k2", "cell").agg(*[v.alias(k) for k, v in sides.items()])
    shifts = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift")
    seen = cells.select("*", shifts).select(
        "k1",
        "k2",
        (F.col("cell") + F.col("shift")).alias("cell"),
        *[
            F.when(F.col("shift") == shift, F.col(f"{role}_{edge}")).alias(f"{role}_{place}")
            for role in ("id", "secret")
            for shift, edge, place in ((1, "last", "before"), (0, "first", "here"), (-1, "first", "after"))
        ],
    )
    # Of the cell before only the last position matters, of the cell after only the first.
    places = [f"{role}_{place}" for role in ("id", "secret") for place in ("before", "here", "after")]
    around = seen.groupBy("k1", "k2", "cell").agg(*[F.max(p).alias(p) for p in places])

    def near(role: str) -> Column:
        start = F.col("s.start")
        return F.coalesce(
            F.col(f"{role}_here").isNotNull()
            | F.coalesce(start - F.col(f"{role}_before") < scope, F.lit(False))
            | F.coalesce(F.col(f"{role}_after") - start < scope, F.lit(False)),
            F.lit(False),
        )

    kind = F.col("s.kind")
    complete = (
        ((kind == WEAK_ID) & near("secret"))
        | ((kind == WEAK_SECRET) & near("id"))
        | ((kind == ENDPOINT) & near("id") & near("secret"))
    )
    joined = each.where(kind >= BASE).join(around, ["k1", "k2", "cell"])
    # The list is as long as one text has confirmed candidates.
    return joined.where(complete).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("s")).alias("linked"))


def _all_spans() -> Column:
    return F.array_sort(F.concat("base", F.coalesce("linked", no_spans())))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, base (array of spans) and all (base and linked weak spans, sorted), one row per document.

    A null or empty text has no spans. Repeated rows and null ids each get a row; the links depend on the text
    alone, so copies share them.
    """
    own = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty("text"))
    parts = saved(with_parts(own).drop("text"), "secrets")
    weak = parts.where(F.size("weak") > 0).join(linked_spans(parts, scope), ["k1", "k2"], "left")
    plain = parts.where(F.size("weak") == 0).withColumn("linked", F.lit(None).cast(SPANS))
    both = weak.unionByName(plain)
    return both.select("doc_id", "base", _all_spans().alias("all"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``find_secrets``."""
    base = spans_text(F.col("base"), KINDS)
    return find_secrets(docs, id_col, text_col).select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(base, 256).alias("base_sha256"),
        spans_text(F.col("all"), KINDS).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``[SECRET:kind]``; rows, columns and null texts stay.

    Only rows whose text could hold a weak candidate are joined with the links; the others pass in the scan.
    """
    names = docs.columns
    where = names.index(text_col)
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("all"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    likely = _could_be_weak(F.col("text"))
    hinted, plain = inner.where(likely), inner.where(~likely)
    links = linked_spans(with_parts(hinted.select("text")).drop("text"), scope)
    joined = with_parts(hinted).join(links, ["k1", "k2"], "left")
    marks = tuple(f"[SECRET:{k}]" for k in KINDS)

    def cleaned(rows: DataFrame, spans: Column) -> DataFrame:
        clean = let(spans, lambda s: cut_out(F.col("text"), s, marks))
        text = F.when(F.col(f"all.c{where}").isNotNull(), clean)
        return rows.select(*[text.alias(f"c{i}") if i == where else F.col(f"all.c{i}") for i in range(len(names))])

    both = cleaned(joined, _all_spans()).unionByName(cleaned(plain, base_spans(F.col("text"))))
    return both.toDF(*names)

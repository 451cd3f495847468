"""Personal data in texts, and the words around it that give it away.

Base kinds are found by pattern. For every protected value (one address, one number) the corpus says how strongly
a word near it reveals it: with p(word | value) from the texts that hold the value and p(word) from all documents,
log(p(word | value) / p(word)) is the information the word gives about the value, and -log p(value) is all there
is to give. A word whose share of that reaches GENERALISE is replaced by a general mark, from REMOVE on it goes.
``whole_report`` and ``sanitised`` weigh every word of every text that holds a value, by a smoothed estimate, and
mark it wherever it stands in the text; ``personal_report`` is the narrow form, for words near a value in SUPPORT
texts.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import columns_of, let, saved, text_key, text_or_empty
from visitlens.llm.spans import SPANS, count_kind, cut_out, find_spans, no_spans, spans_text

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
EMAIL, IP, CARD, PHONE, REMOVED, GENERALISED = range(6)
BASE = 4
#: Code points on either side of a value in which words count as near it.
REACH = 160
#: Different texts in which a word must stand near a value before it can be held against it.
SUPPORT = 3
#: Texts with the corpus's share of a word that are added to those of a value when p(word | value) is estimated.
PRIOR = 1.0
#: Shares of a value's information from which a word is generalised or removed.
GENERALISE, REMOVE = 0.6, 0.9

# A run of address characters can only begin a match at its first character or right after a match, so the search
# never starts inside a long run; repeated groups are possessive and need no stack.
EMAIL_PATTERN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_PATTERN = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD_PATTERN = r"[0-9](?:[\x20-]?[0-9])++"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM_PATTERN = r"\p{L}{3,}"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the sum of all digits ends in 0."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0))
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    card = lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    found = [
        find_spans(text, EMAIL_PATTERN, EMAIL, hint=text.contains("@")),
        find_spans(text, IP_PATTERN, IP, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        find_spans(text, CARD_PATTERN, CARD, card, hint=r"[0-9](?:[\x20-]?[0-9]){11}"),
        find_spans(text, PHONE_PATTERN, PHONE, lambda m: F.length(_digits(m)).between(9, 15), hint=r"\+[0-9]"),
    ]
    return F.array_sort(F.concat(*found))


def _value(text: Column, s: Column) -> Column:
    """A protected value, the same however it is written."""
    raw = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    plain = F.when(s["kind"] == EMAIL, F.lower(raw)).when(s["kind"] == IP, raw).otherwise(_digits(raw))
    return F.concat(s["kind"].cast("string"), F.lit(":"), plain)


def _near_terms(text: Column, base: Column) -> Column:
    """Words within REACH of each value: array of (value, term, start, end); words cut by the reach and words
    inside a protected value are left out."""

    def around(s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - REACH)
        left = F.substring(text, low + 1, s["start"] - low)
        right = F.substring(text, s["end"] + 1, F.lit(REACH))
        last = F.length(right)
        whole_left = lambda t: (t["start"] > 0) | (low == 0)
        whole_right = lambda t: (t["end"] < last) | (last < REACH)
        value = _value(text, s)

        def of(side: Column, offset: Column, whole) -> Column:
            terms = F.filter(find_spans(side, TERM_PATTERN, REMOVED), whole)
            return F.transform(
                terms,
                lambda t: F.struct(
                    value.alias("value"),
                    F.lower(F.substring(side, t["start"] + 1, t["end"] - t["start"])).alias("term"),
                    (t["start"] + offset).alias("start"),
                    (t["end"] + offset).alias("end"),
                ),
            )

        return F.concat(of(left, low, whole_left), of(right, s["end"], whole_right))

    free = lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return F.filter(F.flatten(F.transform(base, around)), free)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, base, values and near of every document (doc_id, text)."""
    found = docs.withColumn("base", base_spans(F.col("text")))
    own = lambda s: _value(F.col("text"), s)
    nothing = F.array().cast("array<struct<value:string,term:string,start:int,end:int>>")
    some = F.size("base") > 0
    return found.select(
        "doc_id",
        *text_key(F.col("text")),
        "base",
        F.when(some, F.array_distinct(F.transform("base", own))).otherwise(F.array().cast("array<string>")).alias("values"),
        F.when(some, _near_terms(F.col("text"), F.col("base"))).otherwise(nothing).alias("near"),
    )


def revealing(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(k1, k2, more): the words of each text that reveal a value in it, as spans.

    Words are first counted near values, over different texts; only those with enough support are then counted
    in all of ``docs`` (text).
    """
    places = seen.where(F.size("near") > 0).select("k1", "k2", F.explode("near").alias("n")).select("k1", "k2", "n.*")
    places = saved(places.distinct(), "places")
    together = places.select("value", "term", "k1", "k2").distinct().groupBy("value", "term").agg(F.count(F.lit(1)).alias("both"))
    together = saved(together.where(F.col("both") >= SUPPORT), "together")
    terms = together.select("term").distinct()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM_PATTERN), F.lit(0)))).alias("term"))
    in_docs = words.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    mentions = seen.where(F.size("values") > 0).select("k1", "k2", F.explode("values").alias("value"))
    value_docs = mentions.groupBy("value").agg(F.count(F.lit(1)).alias("value_docs"))
    value_texts = mentions.distinct().groupBy("value").agg(F.count(F.lit(1)).alias("value_texts"))
    total = float(seen.count())
    known = together.join(in_docs, "term").join(value_docs, "value").join(value_texts, "value")
    gained = F.log((F.col("both") / F.col("value_texts")) / (F.col("term_docs") / F.lit(total)))
    share = gained / F.log(F.lit(total) / F.col("value_docs"))
    kind = F.when(share >= REMOVE, REMOVED).when(share >= GENERALISE, GENERALISED)
    told = known.where(F.col("value_docs") < total).select("value", "term", kind.alias("kind")).where("kind is not null")
    spans = places.join(told, ["value", "term"]).groupBy("k1", "k2", "start", "end").agg(F.min("kind").alias("kind"))
    # The list is as long as one text has such words near its values.
    return spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))


def _words(text: Column) -> Column:
    """The different words of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), F.lower))


def whole_scanned(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, base of every document (doc_id, text); text and values too of those that hold a value."""
    found = docs.withColumn("base", base_spans(F.col("text")))
    own = lambda s: _value(F.col("text"), s)
    some = F.size("base") > 0
    return found.select(
        "doc_id",
        *text_key(F.col("text")),
        "base",
        F.when(some, F.col("text")).alias("text"),
        F.when(some, F.array_distinct(F.transform("base", own))).alias("values"),
    )


def whole_revealing(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(k1, k2, removed, general): the words of each text that reveal a value in it.

    Every word of a text counts with every value of it; p(word | value) is smoothed by PRIOR texts that have the
    corpus's share. A word can give no more than -log p(word), so words that are too common for a value at any
    p(word | value) are not paired with it. Values of one text only are all told alike, so one stands for them.
    """
    total = float(seen.count())
    held = seen.where(F.size("base") > 0)
    texts = saved(held.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.first("values").alias("values"), F.count(F.lit(1)).alias("copies")), "texts")
    each = texts.select("k1", "k2", "copies", F.explode("values").alias("value"))
    known = each.groupBy("value").agg(F.sum("copies").alias("value_docs"), F.count(F.lit(1)).alias("value_texts"))
    known = known.where(F.col("value_docs") < total)
    mentions = each.drop("copies").join(known, "value")
    single = mentions.where("value_texts = 1").groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("value", "value_docs", "value_texts")])
    mentions = saved(mentions.where("value_texts > 1").unionByName(single), "mentions")
    most = mentions.agg(F.max("value_docs")).first()[0] or 1
    in_docs = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    given = F.log(F.lit(total) / F.col("term_docs"))
    there = F.log(F.lit(total) / F.col("value_docs"))
    near_least = GENERALISE - 1e-9
    in_docs = in_docs.where(given >= near_least * F.log(F.lit(total) / F.lit(float(most))))
    bare = cut_out(F.col("text"), F.col("base"), (" ",) * BASE)
    terms = texts.select("k1", "k2", F.explode(_words(bare)).alias("term")).join(in_docs, "term")
    pairs = saved(terms.join(mentions, ["k1", "k2"]).where(given >= near_least * there), "pairs")
    both = pairs.groupBy("value", "term").agg(
        F.count(F.lit(1)).alias("both"), *[F.first(c).alias(c) for c in ("value_docs", "value_texts", "term_docs")]
    )
    common = F.col("term_docs") / F.lit(total)
    smooth = (F.col("both") + PRIOR * common) / (F.col("value_texts") + PRIOR)
    share = F.log(smooth / common) / there
    kind = F.when(share >= REMOVE, REMOVED).when(share >= GENERALISE, GENERALISED)
    told = both.select("value", "term", kind.alias("kind")).where("kind is not null")
    found = pairs.select("k1", "k2", "value", "term").join(told, ["value", "term"])
    found = found.groupBy("k1", "k2", "term").agg(F.min("kind").alias("kind"))
    # The lists are as long as one text has such words.
    listed = [F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(n) for k, n in ((REMOVED, "removed"), (GENERALISED, "general"))]
    return found.groupBy("k1", "k2").agg(*listed)


def _whole_more() -> Column:
    """All places of the words ``removed`` and ``general`` in ``text`` outside its ``base`` spans."""
    text, base = F.col("text"), F.col("base")

    def places(name: str, kind: int) -> Column:
        own = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return find_spans(text, TERM_PATTERN, kind, lambda m: F.array_contains(own, F.lower(m)), hint=F.size(own) > 0)

    free = lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return F.filter(F.concat(places("removed", REMOVED), places("general", GENERALISED)), free)


def find_disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all (spans), one row per document, over whole texts.

    Nulls, empty texts, repeated rows and values that every document holds are as in ``find_personal_data``.
    """
    own = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty("text"))
    seen = saved(whole_scanned(own), "personal")
    held = seen.where(F.size("base") > 0).join(whole_revealing(own, seen), ["k1", "k2"], "left")
    held = held.select("doc_id", "base", _whole_more().alias("more"))
    plain = seen.where(F.size("base") == 0).select("doc_id", "base", no_spans().alias("more"))
    return held.unionByName(plain).select("doc_id", "base", _all_spans().alias("all"))


def _all_spans() -> Column:
    return F.array_sort(F.concat("base", F.coalesce("more", no_spans())))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all (spans), one row per document.

    A null or empty text has no spans. Repeated rows and null ids each get a row; what a word reveals depends on
    the corpus and the text, so copies share it. In a corpus where every document holds a value, nothing
    reveals that value.
    """
    own = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty("text"))
    seen = saved(scanned(own), "personal")
    more = revealing(own, seen)
    slim = seen.select("doc_id", "k1", "k2", "base")
    joined = slim.where(F.size("base") > 0).join(more, ["k1", "k2"], "left")
    plain = slim.where(F.size("base") == 0).withColumn("more", F.lit(None).cast(SPANS))
    return joined.unionByName(plain).select("doc_id", "base", _all_spans().alias("all"))


def _report(found: DataFrame) -> DataFrame:
    base = spans_text(F.col("base"), KINDS)
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(base, 256).alias("base_sha256"),
        spans_text(F.col("all"), KINDS).alias("spans"),
    )


def personal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``find_personal_data``."""
    return _report(find_personal_data(docs, id_col, text_col))


def whole_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``find_disclosures``."""
    return _report(find_disclosures(docs, id_col, text_col))


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with values replaced by ``[EMAIL]`` and the like, general words by ``[WORD]``, removed ones by nothing.

    All rows and columns stay, null texts too. Only documents that hold a value are joined.
    """
    names = docs.columns
    where = names.index(text_col)
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    found = inner.withColumn("base", base_spans(F.col("text"))).select("*", *text_key(F.col("text")))
    seen = saved(whole_scanned(inner.select(F.lit(None).cast("bigint").alias("doc_id"), "text")), "personal")
    joined = found.where(F.size("base") > 0).join(whole_revealing(inner.select("text"), seen), ["k1", "k2"], "left")
    joined = joined.withColumn("more", _whole_more()).drop("removed", "general")
    plain = found.where(F.size("base") == 0).withColumn("more", F.lit(None).cast(SPANS))
    marks = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[WORD]")
    marked = joined.unionByName(plain).withColumn("spans", _all_spans())
    clean = F.when(F.col(f"doc_id.c{where}").isNotNull(), cut_out(F.col("text"), F.col("spans"), marks))
    columns = [clean.alias(f"c{i}") if i == where else F.col(f"doc_id.c{i}") for i in range(len(names))]
    return marked.select(*columns).toDF(*names)

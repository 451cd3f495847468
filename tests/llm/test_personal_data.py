import hashlib
import math
import re

from llm_frames import documents, edge_rows

from visitlens.llm import pii_disclosure as P


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def value(text, span):
    raw = text[span[0] : span[2]]
    return (span[1], raw.lower() if span[1] == 0 else raw if span[1] == 1 else re.sub("[^0-9]", "", raw))


def near(text):
    own = base(text)
    out = set()
    for span in own:
        low = max(0, span[0] - P.REACH)
        for side, at, whole in (
            (text[low : span[0]], low, lambda m, n, lo=low: m.start() > 0 or lo == 0),
            (text[span[2] : span[2] + P.REACH], span[2], lambda m, n: m.end() < n or n < P.REACH),
        ):
            for m in re.finditer(r"[^\W\d_]{3,}", side):
                place = (at + m.start(), at + m.end())
                if whole(m, len(side)) and not any(b[0] < place[1] and place[0] < b[2] for b in own):
                    out.add((value(text, span), m[0].lower(), *place))
    return out


def brute(rows):
    texts = {t or "" for _, t, _ in rows}
    around = {t: near(t) for t in texts}
    docs = [t or "" for _, t, _ in rows]
    holds = lambda t, v: v in {value(t, s) for s in base(t)}
    has = lambda t, w: w in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", t)}
    kinds = {}
    for v, w in {(v, w) for found in around.values() for v, w, _, _ in found}:
        both = sum(any((x, y) == (v, w) for x, y, _, _ in found) for found in around.values())
        in_texts, in_docs = sum(holds(t, v) for t in texts), sum(holds(t, v) for t in docs)
        if both < P.SUPPORT or in_docs == len(docs):
            continue
        gained = math.log((both / in_texts) / (sum(has(t, w) for t in docs) / len(docs)))
        share = gained / math.log(len(docs) / in_docs)
        kinds[v, w] = 4 if share >= P.REMOVE else 5 if share >= P.GENERALISE else None
    out = []
    for ident, text, _ in rows:
        own = base(text)
        more = {}
        for v, w, s, e in around[text or ""]:
            if kinds.get((v, w)):
                more[s, e] = min(kinds[v, w], more.get((s, e), 9))
        every = sorted(own + [(s, k, e) for (s, e), k in more.items()])
        write = lambda spans: ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        counts = [sum(k == kind for _, kind, _ in own) for k in range(4)]
        out.append((ident, *counts, hashlib.sha256(write(own).encode()).hexdigest(), write(every)))
    return out


ROWS = edge_rows() + [
    (30, "a@b.com_foo@y.zz x@y a.b%c@d-e.f.g. 300.1.2.3.4 1.2.3.4.5.6.7.8 001.002.255.0 256.1.1.1", "p"),
    (31, "4785380592391139 4785-3805-9239-1139, 4111 1111 1111 1111; 12 34 +1 (286) 555-5136 +123 é𝄞 q@w.ee", "p"),
    (32, "1" * 5000 + " " + "a." * 3000 + "@x.y " + "b@" + "c." * 3000 + "d", "p"),
    *[(40 + i, f"call Zaphodius the {'lazy' if i < 3 else 'calm'} dog at zap.hod@betel.example number {i} unique{'abcdef'[i] * 4}", "p") for i in range(6)],
    (45, "call Zaphodius the calm dog at zap.hod@betel.example number 5 uniqueffff", "p"),
    *[(50 + i, f"the dog and the bird at number {i} call for Zaphodius" if i == 0 else f"the dog at number {i}", "q") for i in range(12)],
]


def test_matches_brute_force(spark):
    got = [tuple(r) for r in P.personal_report(documents(spark, ROWS)).collect()]
    want = brute(ROWS)
    assert sorted(got, key=str) == sorted(want, key=str)
    spans = {r[0]: r[6] for r in got}
    assert "remove" in spans[40] or "generalise" in spans[40]
    assert not any(spans[50 + i] for i in range(12))


def test_sanitised(spark):
    docs = documents(spark, ROWS)
    clean = P.sanitised(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(texts) == len({r[0] for r in ROWS}) and texts[1] is None
    assert all("betel" not in (t or "") for t in texts.values())
    assert "[EMAIL]" in texts[40] and "Zaphodius" not in texts[40]
    assert texts[51] == "the dog at number 1"


def test_empty_table(spark):
    assert P.personal_report(documents(spark, [])).collect() == []


def test_base_spans_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in P.personal_report(docs).collect()}
    for row in docs.select("doc_id", "text").collect():
        spans = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base(row["text"]))
        assert got[row["doc_id"]] == hashlib.sha256(spans.encode()).hexdigest()


def whole_brute(rows):
    """Every word of every text that holds a value, by the smoothed estimate."""
    docs = [t or "" for _, t, _ in rows]
    words = {}
    for t in set(docs):
        own = base(t)
        every = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        words[t] = [w for w in every if not any(s < w[2] and w[1] < e for s, _, e in own)]
    held = {t: {value(t, s) for s in base(t)} for t in words}
    has = {t: {m.lower() for m in re.findall(r"[^\W\d_]{3,}", t)} for t in words}
    out = {}
    for t, own in held.items():
        more = {}
        for v in own:
            texts, in_docs = [x for x in held if v in held[x]], sum(v in held[x] for x in docs)
            for w, s, e in words[t] if in_docs < len(docs) else []:
                common = sum(w in has[x] for x in docs) / len(docs)
                both = sum(any(y[0] == w for y in words[x]) for x in texts)
                gained = math.log((both + P.PRIOR * common) / (len(texts) + P.PRIOR) / common)
                share = gained / math.log(len(docs) / in_docs)
                if share >= P.GENERALISE:
                    more[s, e] = min(4 if share >= P.REMOVE else 5, more.get((s, e), 9))
        every = sorted(base(t) + [(s, k, e) for (s, e), k in more.items()])
        out[t] = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in every)
    return [(ident, out[t or ""]) for ident, t, _ in rows]


def test_whole_report_weighs_all_words_of_all_texts(spark):
    far = "the dog and the bird call " * 20
    rows = ROWS + [
        (70, f"Trillianus wrote {far} to only.one@value.example and {far} then Trillianus left", "r"),
        *[(71 + i, "write Marvinus at paranoid@android.example now", "r") for i in range(3)],
        *[(80 + i, f"the dog and the bird call, number {i}", "r") for i in range(40)],
    ]
    got = {r["doc_id"]: r["spans"] for r in P.whole_report(documents(spark, rows)).collect()}
    want = dict(whole_brute(rows))
    assert got == want
    text = rows[len(ROWS)][1]
    last = text.rindex("Trillianus")
    assert all(f":{at}:{at + 10}" in got[70] for at in (0, last))  # one text, beyond 160 code points
    assert "remove:6:14" in got[71] or "generalise:6:14" in got[71]  # copies of one text
    clean = {r["doc_id"]: r["text"] for r in P.sanitised(documents(spark, rows)).collect()}
    assert "Trillianus" not in clean[70] and "Marvinus" not in clean[71]


def test_whole_report_of_an_empty_table(spark):
    assert P.whole_report(documents(spark, [])).collect() == []

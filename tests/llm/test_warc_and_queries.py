import hashlib

import duckdb
import pytest
from llm_frames import documents, edge_rows

import corpus_pipeline
from visitlens.llm import queries, warc_fixity
from visitlens.llm.components import components as linked

PAGES = "page_id bigint, url string, html string, hash string"


def pages(spark, n=5000):
    return spark.createDataFrame([(i, f"http://x/{i}", f"<p>é page {i}</p>", "h") for i in range(n)], PAGES)


def test_audit_finds_what_was_damaged(spark):
    ours = pages(spark)
    hit = "page_id in (0, 17, 4095, 4096, 4999)"
    theirs = ours.selectExpr("page_id", "url", f"case when {hit} then replace(html, 'page', 'PAGE') else html end as html")
    found = warc_fixity.audit_pages(ours, theirs).where("fault <> 'sound'").collect()
    assert sorted((r["page_id"], r["fault"]) for r in found) == [(i, "changed") for i in (0, 17, 4095, 4096, 4999)]


def faults(frame):
    return sorted((r["page_id"], r["fault"]) for r in frame.where("fault <> 'sound'").collect())


def test_a_missing_record_is_one_fault(spark):
    ours = pages(spark)
    for gone in (0, 17, 4095, 4100, 4999):
        assert faults(warc_fixity.audit_pages(ours, ours.where(f"page_id <> {gone}"))) == [(gone, "missing")]


def test_missing_beginnings_of_nodes(spark):
    """Records that nodes of any level begin with may be missing too: their nodes then run together."""
    ours = pages(spark)
    records = warc_fixity.warc_records(ours).drop("record")
    begins = {r["key"].split("#")[0] for level in warc_fixity.trees(records)[1:] for r in level.collect() if r["key"]}
    gone = sorted(int(b) for b in begins)
    assert len(gone) > 100
    found = warc_fixity.audit_pages(ours, ours.where(~ours["page_id"].isin(gone)))
    assert faults(found) == [(g, "missing") for g in gone]


def test_extra_changed_and_missing_together(spark):
    ours = pages(spark, 600).where("page_id % 100 <> 7")
    theirs = pages(spark, 600).where("page_id % 150 <> 20")
    theirs = theirs.selectExpr("page_id", "url", "case when page_id = 300 then 'other and longer' else html end as html")
    want = [(i, "extra") for i in range(7, 600, 100)] + [(i, "missing") for i in range(20, 600, 150)] + [(300, "changed")]
    left, right = (warc_fixity.warc_records(f).drop("record") for f in (ours, theirs))
    found = warc_fixity.audit(left, right).collect()
    assert sorted((int(r["key"].split("#")[0]), r["fault"]) for r in found) == sorted(want)
    assert faults(warc_fixity.audit_pages(ours, theirs)) == sorted(w for w in want if w[1] != "extra")


def test_a_repeated_record_too_few(spark):
    ours = pages(spark, 50)
    three = ours.unionByName(ours.where("page_id = 5")).unionByName(ours.where("page_id = 5"))
    assert faults(warc_fixity.audit_pages(three, ours)) == [(5, "missing"), (5, "missing")]
    assert faults(warc_fixity.audit_pages(ours, three)) == []


def test_sound_roots_end_the_descent(spark):
    records = warc_fixity.warc_records(pages(spark)).drop("record")
    assert warc_fixity.audit(records, records).count() == 0
    counts = [level.count() for level in warc_fixity.trees(records)]
    assert counts[0] == 5000 and counts[-1] == 2 and 200 < counts[1] < 450
    assert all(a >= b for a, b in zip(counts, counts[1:], strict=False))


def test_edges(spark):
    rows = [(None, None, None, "h"), (1, None, "", "h"), (1, None, "", "h")]
    frame = spark.createDataFrame(rows, PAGES)
    got = warc_fixity.audit_pages(frame, frame).collect()
    assert len(got) == 3 and {r["fault"] for r in got} == {"sound"}
    assert warc_fixity.audit_pages(frame.limit(0), frame.limit(0)).count() == 0
    assert {r["fault"] for r in warc_fixity.audit_pages(frame, frame.limit(0)).collect()} == {"missing"}
    record = warc_fixity.warc_records(frame).where("page_id = 1").first()
    assert hashlib.sha256(record["record"].encode()).hexdigest() == record["sha"]
    assert record["length"] == len(record["record"].encode())


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    back = [(2003, 2001), (2001, 2003), (2002, 2003), (7, 7)]
    got = {r["node"]: r["root"] for r in linked(spark.createDataFrame(chain + star + back, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)} | {2001: 2001, 2002: 2001, 2003: 2001}
    assert got == want
    assert linked(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    docs = documents(spark, edge_rows()).withColumnRenamed("k", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_runs_over_the_given_documents(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    rows = packed.selectExpr("count(distinct doc_id) as docs", "sum(length) as tokens").first()
    assert rows["docs"] > 500 and rows["tokens"] > 100_000

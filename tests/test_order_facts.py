"""Cues of documents in one pass, the merged record, task details and the newest fetch."""

import datetime

from proofloom.catalog import orders as C
from proofloom.operators import orders as O
from proofloom.operators import sites
from proofloom.operators.stored import stored
from tests.conftest import rows

DOCS = "order_id int, source string, doc_ord int, kind string, text string"


def test_cues_prefer_kind_then_order(spark):
    docs = spark.createDataFrame([
        (1, "est.pdf", 0, "Estimate", "RENEWAL INVOICE"), (1, "sow.pdf", 1, "SOW", "2026 RENEWAL  PROPOSAL"), (1, "b.pdf", 2, "SOW", "RENEWAL PROPOSAL"),
        (2, "x.pdf", 0, "Unknown", "New Client, AI Managed Phishing"), (3, "e2.pdf", 0, "Estimate", "nothing"), (3, "e1.pdf", 1, "Estimate", None)], DOCS)
    got = {r.order_id: r for r in O.document_cues(docs).collect()}
    assert (got[1].renewal.source, got[1].renewal.evidence) == ("sow.pdf", "RENEWAL  PROPOSAL")
    assert got[1].new_account is None and got[1].bought_sources == ["est.pdf"]
    # A document of unknown kind says nothing of the type, but of managed phishing.
    assert got[2].new_account is None and got[2].managed.evidence == "AI Managed Phishing"
    assert got[3].renewal is None and got[3].bought_sources == ["e1.pdf", "e2.pdf"]
    assert O.document_cues(docs.limit(0)).count() == 0


def test_record_takes_mail_before_documents(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id int")
    mail = spark.createDataFrame([(1, "company", "Mailed", 3), (1, "company", "Later", 5), (1, "portal_url", "N/A", 1), (2, "training_poc", "a@b.c", 1), (2, "company", "", 0)],
                                 "order_id int, key string, value string, line_no int")
    facts = spark.createDataFrame([(1, "Prepared for", "Client", "s"), (1, "OD URL", "https://Portal.example.org", "e"), (2, "Prepared for", "Client two", "s"),
                                   (2, "OD POC", "poc@b.c", "e"), (2, "Order number", "77", "e"), (2, "Order number", "88", "f")],
                                  "order_id int, label string, value string, source string")
    cues = spark.createDataFrame([(2, ["e.pdf"])], "order_id int, bought_sources array<string>")
    got = O.order_record(orders, mail, facts, cues, "d.com")
    assert rows(got) == [(1, None, "Mailed", "portal.example.org", None, []), (2, "77", "Client two", None, "a@b.c", ["e.pdf"]), (3, None, None, None, None, [])]


def test_header_cells_are_found_once(spark):
    cells = spark.createDataFrame([
        (1, "s", 0, 0, 0, "SKU"), (1, "s", 0, 0, 1, "Description"), (1, "s", 0, 0, 2, "Number of users"), (1, "s", 0, 0, 3, "Users"),
        (1, "s", 0, 1, 0, "DL-SSO"), (1, "s", 0, 1, 1, "Sign on"), (1, "s", 0, 1, 2, "7"), (1, "s", 0, 1, 3, "9"),
        (1, "s", 1, 0, 0, "Heading"), (1, "s", 1, 1, 0, "DL-NOT")], "order_id int, source string, table_no int, row_no int, col_no int, value string")
    assert rows(O.sku_lines(cells), "sku", "description", "users") == [("DL-SSO", "Sign on", 7)]


def test_newest_fetch_counts(spark):
    links = spark.createDataFrame([(1, "link", "u"), (1, "link", "v"), (1, "link", "w")], "page_id int, kind string, url string")
    log = spark.createDataFrame([("u", 1, 500, "down"), ("u", 2, 200, ""), ("v", 2, 404, ""), ("v", 1, 200, "")],
                                "url string, fetched_at int, status int, note string")
    got = sites.resource_status(links, log)
    assert rows(got, "url", "status", "ok") == [("u", 200, True), ("v", 404, False), ("w", 0, False)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _written(spark, values, schema):
    return stored(spark.createDataFrame(values, schema), "test")


def test_hosting_sends_no_table_of_orders_to_the_driver(spark):
    orders = _written(spark, [(1, ""), (2, "p.example.com"), (3, None), (4, None)], "order_id int, portal_url string")
    skus = _written(spark, [(1, "s", 1, "DL-LMS1"), (1, "s", 0, "DL-LMS2"), (4, "s", 0, "DL-SCR")], "order_id int, source string, ord int, sku string")
    docs = spark.createDataFrame([(3, "s", 0, "SOW", "AI Managed Phishing"), (4, "s", 0, "SOW", "")], DOCS)
    urls = _written(spark, [(4, "na SCORM")], "order_id int, od_url string")
    choice = _written(spark, [(2, "Self-Hosted"), (3, "")], "order_id int, hosting string")
    got = O.hosting(orders, skus, docs, urls, choice, stored(O.document_cues(docs), "test"))
    assert rows(got, "order_id", "detected_hosting", "hosting_source", "hosting") == [
        (1, "Vendor-Hosted", "DL-LMS2 SKU", "Vendor-Hosted"), (2, "Vendor-Hosted", "portal URL p.example.com", "Self-Hosted"),
        (3, "Managed-Hosted", '"AI Managed Phishing" in a document, no hosting SKU', "Managed-Hosted"), (4, "Self-Hosted", "DL-SCR SKU", "Self-Hosted")]
    assert "Broadcast" not in _plan(got) and "SortMergeJoin" in _plan(got)


def test_order_type_sends_no_table_of_orders_to_the_driver(spark):
    docs = spark.createDataFrame([(1, "s", 0, "SOW", "RENEWAL PROPOSAL"), (2, "s", 0, "SOW", "New Client"), (3, "s", 0, "SOW", "x")], DOCS)
    choice = _written(spark, [(1, "New Account"), (2, "")], "order_id int, order_type string")
    got = O.order_type(docs, choice, stored(O.document_cues(docs), "test"))
    assert rows(got, "order_id", "detected_type", "order_type") == [
        (1, "Renewal", "New Account"), (2, "New Account", "New Account"), (3, None, None)]
    assert "Broadcast" not in _plan(got) and "SortMergeJoin" in _plan(got)


def test_tasks_send_no_table_of_orders_to_the_driver(spark, tmp_path):
    day = datetime.datetime(2026, 1, 5)
    orders = [(i, 40 + i, s, day, p) for i, (s, p) in enumerate([("O", "1-URGENT"), ("F", "2-HIGH"), ("P", "4-NOT"), ("O", "5-LOW")])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")
    got = C.q_tasks(spark, str(tmp_path))
    assert {r.order_id for r in got.collect()} == {0, 1, 2, 3}
    assert "Broadcast" not in _plan(got) and "SortMergeJoin" in _plan(got)

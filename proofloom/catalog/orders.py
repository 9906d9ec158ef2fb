"""Order reconciliation.

Lists: a supplier is an order, parts it shipped from 1998 on are wanted and
parts it shipped before are present.  Documents: each row of ``orders`` writes
a mail, a statement of work or an estimate (by its status) and their tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table
from ..functions import orders as OF
from ..functions import text as T
from ..operators import orders as O
from ..operators.stored import merged, stored
from ..sources import pasted

DOMAIN = "portal.example.com"
STOP_WORDS = ["the", "and", "old", "new", "from", "bundle", "course", "courses", "remove"]
FIELDS = ["portal_url", "opp_name", "company", "billing_poc", "training_poc", "license_dates"]


# -- item lists ---------------------------------------------------------------

def _items(spark, sf, wanted: bool):
    li = table(spark, sf, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")
    side = (li.filter(late if wanted else ~late).groupBy("l_suppkey", "l_partkey")
            .agg(F.min("l_quantity").cast("int").alias("license_count")))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    number = (F.col("l_partkey") + 1000).cast("string")
    return (side.join(part, side.l_partkey == part.p_partkey)
            .select(F.col("l_suppkey").alias("order_id"), number.alias("number"),
                    F.concat_ws(" ", "p_name", number).alias("name"), F.lit("").alias("note"),
                    F.lit("order" if wanted else "Portal").alias("source"),
                    (F.lit(None).cast("int") if wanted else F.col("license_count")).alias("license_count"), "p_size"))


def _keep(spark, sf):
    return _items(spark, sf, False).filter("p_size > 40").select("order_id", "number")


def q_compare(spark, sf):
    return O.compare_lists(_items(spark, sf, True), _items(spark, sf, False), _keep(spark, sf))


def q_final(spark, sf):
    return (O.final_items(q_compare(spark, sf)).groupBy("order_id")
            .agg(F.count("*").alias("n_items"), F.min(F.lower("name")).alias("first_name")))


def q_renumber(spark, sf):
    return O.renumber_candidates(q_compare(spark, sf)).select("order_id", "number", "replaces", "ratio")


def q_candidates(spark, sf):
    return (O.removal_candidates(_items(spark, sf, False), _items(spark, sf, True))
            .select("order_id", "number", "name"))


def _notes(spark, sf):
    """A returned line asks to remove its part, an accepted one to swap it."""
    li = table(spark, sf, "lineitem").filter("l_returnflag IN ('R', 'A')")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    n = (F.col("l_partkey") + 1000).cast("string")
    removed = F.col("l_returnflag") == "R"
    text = F.when(removed, F.concat(F.lit("Please take out "), n, F.lit("P and "), n, F.lit(".")))\
        .otherwise(F.concat(F.lit("Upgrade from the old "), "p_name", F.lit(" bundle to the new one")))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_suppkey").alias("order_id"), F.when(removed, "archive_remove").otherwise("upgrade").alias("kind"),
                    n.alias("label"), n.alias("ord"), text.alias("text")))


def q_named_numbers(spark, sf):
    return O.named_number_check(_notes(spark, sf), q_candidates(spark, sf), _items(spark, sf, True))


def q_keywords(spark, sf):
    return O.keyword_suggestions(_notes(spark, sf), q_candidates(spark, sf), STOP_WORDS)


def q_removal_plan(spark, sf):
    named = q_named_numbers(spark, sf).filter("verdict = 'suggest'")
    choice = (table(spark, sf, "supplier").filter("s_acctbal < 1000")
              .select(F.col("s_suppkey").alias("order_id"), (F.col("s_acctbal") < 0).alias("keep_existing")))
    settled = table(spark, sf, "supplier").filter("s_acctbal >= 5000").select(F.col("s_suppkey").alias("order_id"), F.lit("upgrade").alias("kind"))
    notes = _notes(spark, sf).join(settled, ["order_id", "kind"], "left_anti")
    return O.removal_plan(_items(spark, sf, False), _items(spark, sf, True), notes, named, choice)


def q_merge_first(spark, sf):
    """Three documents per supplier, one per return flag, read in that order."""
    li = table(spark, sf, "lineitem")
    items = li.select(F.col("l_suppkey").alias("order_id"), F.col("l_partkey").cast("string").alias("number"),
                      F.col("l_returnflag").alias("source"), F.col("l_quantity").cast("int").alias("ord"))
    return O.merge_first(items, ["source", "ord"])


def q_shared(spark, sf):
    """Sizes of the intersection and both differences of the number sets."""
    w = _items(spark, sf, True).select("order_id", "number")
    p = _items(spark, sf, False).select("order_id", "number")
    tagged = (w.intersect(p).withColumn("part", F.lit("both")).unionByName(
        w.exceptAll(p).withColumn("part", F.lit("wanted_only"))).unionByName(
        p.exceptAll(w).withColumn("part", F.lit("present_only"))))
    return tagged.groupBy("order_id", "part").agg(F.count("*").alias("n"))


def q_validate(spark, sf):
    """Line items as a reviewer's edited list: numbers repeat and some are wrong."""
    li = table(spark, sf, "lineitem")
    number = F.when(F.col("l_discount") > 0.09, F.lit("12x")).otherwise(
        F.concat((F.col("l_partkey") + 1000).cast("string"), F.lit("p")))
    edited = (li.groupBy("l_suppkey", number.alias("number"), "l_tax").agg(F.count("*").alias("n"))
              .select(F.col("l_suppkey").alias("order_id"), F.round(F.col("l_tax") * 100).cast("int").alias("ord"),
                      (F.col("l_tax") > 0.01).alias("ticked"), "number", F.lit("x").alias("name")))
    return O.validate_items(edited).groupBy("order_id", "status").agg(F.count("*").alias("n"))


# -- documents ---------------------------------------------------------------

def _orders(spark, sf):
    o = table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    cust = F.col("o_custkey").cast("string")
    return o.select(F.col("o_orderkey").alias("order_id"), cust.alias("cust"), "o_custkey", F.col("o_orderstatus").alias("st"),
                    p.alias("p"), F.col("o_orderdate").cast("timestamp").alias("d"),
                    (F.col("o_custkey") % 90 + 10).cast("int").alias("users"))


def _mails(spark, sf):
    o = _orders(spark, sf)
    lines = F.array_compact(F.array(
        F.lit("Hello team"),
        F.when(F.col("p") != "5", F.concat(F.lit("OD: Cust"), "cust")),
        F.concat(F.lit("Opp Name: Deal: "), "cust", F.lit("_"), F.col("users").cast("string"), F.lit(" users_2026")),
        F.concat(F.lit("Company:  Customer\t"), "cust"), F.lit("Suite 9"),
        F.when(F.col("st") != "P", F.concat(F.lit("Billing POC: Bill Ng, bill"), "cust", F.lit("@example.com"))),
        F.concat(F.lit("License Dates: "), F.date_format("d", "M/d/yyyy"), F.lit(" - "),
                 F.date_format(F.add_months("d", 12), "M/d/yy")),
        F.lit("Link:"), F.lit("https://example.com/a"), F.lit(""), F.lit("Note: one"), F.lit("Company: Second"), F.lit("Note: two")))
    return o.select("order_id", F.array_join(lines, "\n").alias("text"))


def q_label_value(spark, sf):
    return pasted.read_label_value(_mails(spark, sf))


def _lists(spark, sf):
    o = _orders(spark, sf)
    n = (F.col("o_custkey") + 1000).cast("string")
    u = F.col("users").cast("string")
    lines = F.array(
        F.lit("Name\tCompany\tCount"),
        F.concat(F.lit("Tabbed Course "), n, F.lit("\t77\t"), u, F.lit("\tThirdPartyScorm")),
        F.concat(F.lit("Top 10 Spaced "), n, F.lit("A   77  "), u, F.lit(" ThirdPartyScorm")),
        F.lit("Bundle\t77\t3\tItemCollection"),
        F.concat(F.lit("Cell Course "), n, F.lit("B")), F.lit("77"), u, F.lit("ThirdPartyScorm"),
        F.concat(F.lit("Cell Bundle "), n, F.lit("C")), F.lit("77"), F.lit("ItemCollection"),
        F.concat(F.lit("Clip "), n, F.lit("D: What happens")), F.lit("77"),
        F.concat(F.lit("Again "), n), F.lit("Custom thing"), F.lit("Second custom"), F.lit("ItemCollection"))
    return o.select("order_id", F.array_join(lines, "\r\n").alias("text"))


def q_license_list(spark, sf):
    return pasted.read_license_list(_lists(spark, sf))


def _documents(spark, sf):
    o = _orders(spark, sf)
    term = F.concat(F.lit("License Term: "), F.date_format("d", "M/d/yyyy"), F.lit(" to "),
                    F.date_format(F.add_months("d", 12), "MM-dd-yyyy"))
    sow = F.concat_ws("\n", F.when(F.col("p") < "4", F.lit("2026 RENEWAL PROPOSAL")).otherwise(F.lit("ORGANIZATION INFORMATION")),
                      F.lit("Prepared for:"), F.concat(F.lit("  Customer "), F.when(F.col("p") == "2", F.lit("Zed")).otherwise(F.col("cust"))),
                      F.when(F.col("p") != "3", term),
                      F.when(F.col("p") == "1", F.lit("Licensing Option Selected: 3 Year Licensing")),
                      F.when(F.col("p") == "4", F.lit("with AI Managed Phishing")),
                      F.when(F.col("p") == "2", F.lit("All other courses will remain\tunchanged")))
    est = F.concat_ws("\n", F.concat(F.lit("Estimate 9"), F.lpad("cust", 6, "0")), F.lit("SALES REP  OD POC  OD URL"),
                      F.concat(F.lit("Ann Lee poc"), "cust", F.lit("@example.com "), F.when(F.col("p") == "1", F.lit("NA SCORM"))
                               .when(F.col("p") == "2", F.lit("other")).otherwise(F.concat(F.lit("cust"), "cust"))),
                      F.concat(F.lit("EXPIRATION DATE "), F.date_format(F.add_months("d", 13), "MM/dd/yyyy")))
    docs = F.array_compact(F.array(
        F.when(F.col("st").isin("O", "P"), F.struct(F.lit("sow.pdf").alias("source"), F.lit(0).alias("doc_ord"), sow.alias("text"))),
        F.when(F.col("st").isin("F", "P"), F.struct(F.lit("estimate.pdf").alias("source"), F.lit(1).alias("doc_ord"), est.alias("text"))),
        F.when(F.col("p") == "5", F.struct(F.lit("extra.pdf").alias("source"), F.lit(2).alias("doc_ord"), F.lit("Terms and conditions").alias("text")))))
    return (o.select("order_id", F.explode(docs).alias("x")).select("order_id", "x.*")
            .withColumn("kind", OF.document_kind(F.col("text"))))


def q_document_kind(spark, sf):
    return _documents(spark, sf).select("order_id", "source", "kind")


def q_expiration(spark, sf):
    return (_documents(spark, sf).select("order_id", "source", F.explode(OF.expiration_dates(F.col("text"))).alias("x"))
            .select("order_id", "source", "x.date", "x.found_as"))


def q_multi_year(spark, sf):
    return _documents(spark, sf).select("order_id", F.explode(OF.multi_year_notes(F.col("text"))).alias("note"))


def q_date_conflict(spark, sf):
    mail = _mails(spark, sf).select("order_id", F.explode(OF.expiration_dates(F.col("text"))).alias("x")).select("order_id", "x.date")
    return O.single_or_conflict(q_expiration(spark, sf).select("order_id", "date").unionByName(mail))


def q_order_type(spark, sf):
    return O.order_type(_documents(spark, sf), _type_choice(spark, sf))


def _cells(spark, sf):
    o = _orders(spark, sf)
    n, u = (F.col("o_custkey") + 1000).cast("string"), F.col("users").cast("string")

    def row(table_no, row_no, *values):
        return F.array(*[F.struct(F.lit(table_no).alias("table_no"), F.lit(row_no).alias("row_no"), F.lit(i).alias("col_no"),
                                  (v if not isinstance(v, str) else F.lit(v)).alias("value")) for i, v in enumerate(values)])

    ready = F.when(F.col("p") < "3", "SSO in place.").otherwise("SSO not yet in place")
    sow = F.flatten(F.array(
        row(0, 0, "Heading", "Nothing"), row(0, 1, "CL-NOT-READ", "1"),
        row(1, 0, "SKU", "Description", "Number of  users"),
        row(1, 1, "CL-SST-ESS", F.concat(F.lit("Upgrade from the 2021 topic"), n, F.lit(" bundle to the new one")), u),
        row(1, 2, "Related Services:DL-SSO", ready, ""),
        row(1, 3, F.concat(F.lit("CL-"), n), "Free text topic", "12"), row(1, 4, "PH-SAAS- PB", "Mail Test", "n/a"),
        row(1, 5, F.when(F.col("p") == "4", "DL-LMS1").when(F.col("p") == "5", "DL-SCR").otherwise("none"), "Delivery", ""),
        row(2, 0, "Archive  &  Remove", F.concat(F.lit("Old topics "), n, F.lit("P, "), n)), row(2, 1, "Archive and Reset", "N/A"),
        row(2, 2, "Requested Date", "TBD"), row(2, 3, "", "x")))
    est = F.flatten(F.array(
        row(0, 0, "ACTIVITY", "Description", "License Count"),
        row(0, 1, "CL-SST-ESS2", "Main", F.when(F.col("p") == "1", (F.col("users") + 1).cast("string")).otherwise(u)),
        row(0, 2, "SRV-CUS", "Custom screens", ""),
        row(0, 3, "DL-SSO", "SSO", "")))
    docs = F.array_compact(F.array(
        F.when(F.col("st").isin("O", "P"), F.struct(F.lit("sow.pdf").alias("source"), sow.alias("cells"))),
        F.when(F.col("st").isin("F", "P"), F.struct(F.lit("estimate.pdf").alias("source"), est.alias("cells")))))
    return (o.select("order_id", F.explode(docs).alias("d")).select("order_id", "d.source", F.explode("d.cells").alias("c"))
            .select("order_id", "source", "c.*"))


def _skus(spark, sf):
    kind = F.when(F.col("source") == "sow.pdf", "SOW").otherwise("Estimate")
    return O.sku_lines(_cells(spark, sf)).withColumn("kind", kind)


def q_sku_lines(spark, sf):
    return _skus(spark, sf).select("order_id", "source", "sku", "description", "users")


def q_archive_rows(spark, sf):
    return O.archive_rows(_cells(spark, sf)).select("order_id", "source", "label", "value")


def q_sku_table_items(spark, sf):
    o = _orders(spark, sf)
    n, u = (F.col("o_custkey") + 1000).cast("string"), F.col("users").cast("string")
    read = o.filter("st IN ('O', 'P')").select("order_id", F.explode(F.array(
        F.struct(F.concat(n, F.lit("A")).alias("number"), F.concat(F.lit("Read "), n, F.lit("A")).alias("name")),
        F.struct(u.alias("number"), u.alias("name")))).alias("x")).select(
        "order_id", "x.*", F.lit("").alias("note"), F.lit("sow.pdf").alias("source"))
    return O.sku_table_items(_cells(spark, sf), read)


def _change_notes(spark, sf):
    return O.change_notes(_skus(spark, sf), O.archive_rows(_cells(spark, sf)))


def q_change_notes(spark, sf):
    return _change_notes(spark, sf).select("order_id", "kind", "label", "text")


def q_keep_reasons(spark, sf):
    return O.keep_existing_reasons(_change_notes(spark, sf), _documents(spark, sf))


def q_sku_difference(spark, sf):
    return O.sku_difference(_skus(spark, sf))


def _counts(spark, sf):
    skus = _skus(spark, sf)
    present = q_license_list(spark, sf).filter("status = 'item'").withColumn(
        "license_count", F.when(F.col("order_id") % 5 == 0, F.col("license_count") + 2).otherwise(F.col("license_count")))
    deals = pasted.read_label_value(_mails(spark, sf)).filter("key = 'opp_name'").select(
        "order_id", F.col("value").alias("opp_name"))
    return O.license_counts(skus, present, deals)


def q_license_counts(spark, sf):
    return _counts(spark, sf)


def q_license_check(spark, sf):
    return O.license_count_check(_counts(spark, sf))


def q_sku_pick(spark, sf):
    return O.sku_pick(_skus(spark, sf), O.SSO_SKU)


def _read(spark, sf):
    """What the orders' papers say, each read once and written: documents with their cues, mails and SKU lines."""
    docs = _documents(spark, sf)
    return {"documents": docs, "cues": stored(O.document_cues(docs), "cues"), "facts": stored(O.document_facts(docs), "document-facts"),
            "mail": stored(q_label_value(spark, sf), "mail"), "skus": stored(_skus(spark, sf), "skus")}


def _type_choice(spark, sf):
    return _orders(spark, sf).filter("p = '1'").select("order_id", F.lit(O.NEW_ACCOUNT).alias("order_type"))


def _hosts(spark, sf, read):
    urls = read["facts"].filter("label = 'OD URL'").select("order_id", F.col("value").alias("od_url"))
    mail = read["mail"].filter("key = 'portal_url'").select("order_id", OF.portal_host(F.col("value"), DOMAIN).alias("portal_url"))
    orders = _orders(spark, sf).select("order_id").join(merged(mail), "order_id", "left").withColumn(
        "portal_url", F.when(F.col("order_id") % 3 == 0, F.col("portal_url")))
    choice = _orders(spark, sf).filter("p = '2' AND st = 'O'").select("order_id", F.lit(O.SELF_HOSTED).alias("hosting"))
    return O.hosting(orders, read["skus"], read["documents"], urls, choice, read["cues"])


def q_hosting(spark, sf):
    return _hosts(spark, sf, _read(spark, sf))


def q_facts(spark, sf):
    read = _read(spark, sf)
    types = O.order_type(read["documents"], _type_choice(spark, sf), read["cues"])
    return O.order_facts(read["documents"], read["mail"], types, _hosts(spark, sf, read), read["facts"])


def q_warnings(spark, sf):
    mail, docs = stored(q_label_value(spark, sf), "mail"), _documents(spark, sf)
    return O.order_warnings(_orders(spark, sf), mail, docs, O.document_facts(docs), FIELDS, DOMAIN)


def q_record(spark, sf):
    """What mail and documents of an order together say."""
    docs = _documents(spark, sf)
    record = O.order_record(_orders(spark, sf), q_label_value(spark, sf), O.document_facts(docs), O.document_cues(docs), DOMAIN)
    return record.withColumn("bought_sources", F.array_join("bought_sources", ", "))


def q_tasks(spark, sf):
    """Work lists from the facts of every order."""
    read = _read(spark, sf)
    o = _orders(spark, sf).select("order_id", "users", "p", "st", "cust", "o_custkey")
    dates = q_date_conflict(spark, sf).select("order_id", F.col("date").alias("exp_date"))
    types = O.order_type(read["documents"], _type_choice(spark, sf), read["cues"]).select("order_id", "order_type")
    hosts = _hosts(spark, sf, read).select("order_id", "hosting")
    sso = O.sku_pick(read["skus"], O.SSO_SKU).select(
        "order_id", F.col("sku").alias("sso_sku"), F.col("in_place").alias("sso_in_place"), F.col("bought").alias("sso_bought"))
    wide = o
    for facts in (dates, types, hosts, sso):
        wide = wide.join(merged(facts), "order_id", "left")
    numbers = F.transform(F.sequence(F.lit(1), F.col("o_custkey") % 3), lambda i: (F.col("o_custkey") + 1000 + i).cast("string"))
    wide = wide.select(
        "order_id", "hosting", "order_type", "exp_date", F.when(F.col("st") != "F", F.col("users")).alias("sow_users"),
        (F.col("users") + (F.col("p") == "1").cast("int")).alias("portal_users"), (F.col("o_custkey") % 3).alias("n_add"),
        (F.col("o_custkey") % 2).alias("n_demo"), F.lit(0).alias("n_reset"), (F.col("o_custkey") % 4).alias("n_remove"),
        F.lit(0).alias("n_review"), F.lit(False).alias("assessment"), "sso_sku", "sso_in_place", "sso_bought",
        F.lit(None).cast("string").alias("scorm_sku"), F.lit(None).cast("boolean").alias("scorm_bought"),
        F.when(F.col("st") != "O", "SRV-CUS").alias("custom_sku"), F.lit(True).alias("custom_bought"),
        F.when(F.col("st") != "F", "PH-SAAS-PB").alias("phishing_sku"), F.lit(False).alias("phishing_bought"),
        F.lit(True).alias("phishing_box"), (F.col("p") == "4").alias("firewall"), (F.col("p") == "3").alias("comms_toolbox"),
        F.when(F.col("p") != "2", F.concat(F.lit("cust"), "cust", F.lit("."), F.lit(DOMAIN))).alias("portal_url"),
        F.concat(F.lit("Order of customer "), "cust").alias("order_line"), F.lit("Custom screens").alias("custom_description"),
        F.when(F.col("p") < "3", "Mail Test").alias("phishing_description"),
        F.when(F.col("o_custkey") % 3 > 0, numbers).alias("add_numbers"))
    return O.order_tasks(wide).withColumn("details", F.array_join("details", " | "))


def q_templates(spark, sf):
    """Subject lines whose missing parts stay visible."""
    o = _orders(spark, sf)
    facts = (O.document_facts(_documents(spark, sf)).groupBy("order_id").agg(
        F.max(F.when(F.col("label") == "Order number", F.col("value"))).alias("number"),
        F.max(F.when(F.col("label") == "OD POC", F.col("value"))).alias("poc")))
    line = O.fill_template("{number}: Customer {cust}: {poc}", number=F.col("number"), cust=F.col("cust"), poc=F.col("poc"))
    return o.join(facts, "order_id", "left").select("order_id", line.alias("subject"), OF.first_name(
        F.concat(F.lit("Bill Ng, bill"), "cust")).alias("greeting"))


QUERIES = {
    "compare_lists": q_compare, "final_items": q_final, "renumber_candidates": q_renumber,
    "removal_candidates": q_candidates, "named_number_check": q_named_numbers,
    "keyword_suggestions": q_keywords, "removal_plan": q_removal_plan, "merge_first": q_merge_first,
    "number_set_sizes": q_shared, "validate_items": q_validate, "read_label_value": q_label_value,
    "read_license_list": q_license_list, "document_kind": q_document_kind, "expiration_dates": q_expiration,
    "multi_year_notes": q_multi_year, "date_single_or_conflict": q_date_conflict, "order_type": q_order_type,
    "sku_lines": q_sku_lines, "archive_rows": q_archive_rows, "sku_table_items": q_sku_table_items,
    "change_notes": q_change_notes, "keep_existing_reasons": q_keep_reasons, "sku_difference": q_sku_difference,
    "license_counts": q_license_counts, "license_count_check": q_license_check, "sku_pick": q_sku_pick,
    "hosting": q_hosting, "order_facts": q_facts, "order_warnings": q_warnings, "order_record": q_record, "order_tasks": q_tasks,
    "message_templates": q_templates,
}

_ITEMS = """w AS (SELECT l_suppkey AS order_id, l_partkey, p_size, p_name, (l_partkey + 1000)::VARCHAR AS number,
    p_name || ' ' || (l_partkey + 1000) AS name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= '1998-01-01') JOIN part ON p_partkey = l_partkey),
  p AS (SELECT l_suppkey AS order_id, l_partkey, p_size, p_name, (l_partkey + 1000)::VARCHAR AS number, p_name || ' ' || (l_partkey + 1000) AS name, lc
    FROM (SELECT l_suppkey, l_partkey, min(l_quantity)::INT AS lc FROM lineitem WHERE l_shipdate < '1998-01-01' GROUP BY ALL) JOIN part ON p_partkey = l_partkey)"""
_COMPARED = _ITEMS + """, cmp AS (SELECT coalesce(w.order_id, p.order_id) AS order_id, coalesce(w.number, p.number) AS number, coalesce(w.name, p.name) AS name,
    CASE WHEN w.number IS NOT NULL AND p.number IS NOT NULL THEN CASE WHEN p.lc = 5 THEN 'add' ELSE 'reset' END
      WHEN w.number IS NOT NULL THEN CASE WHEN w.number::BIGINT BETWEEN 1990 AND 2039 THEN 'review' ELSE 'add' END
      WHEN p.p_size > 40 THEN 'reset' WHEN p.lc = 5 THEN 'demo_remove' ELSE 'remove' END AS action, w.number AS wn, p.lc
    FROM w FULL JOIN p ON w.order_id = p.order_id AND w.number = p.number)"""
_CANDS = _ITEMS + ", cand AS (SELECT p.order_id, p.number, p.name, p.p_name FROM p ANTI JOIN w ON w.order_id = p.order_id AND w.number = p.number)"
# Ratio of all pairs of names of an order: the longest block, earliest on either side, then both sides of it, until nothing matches.
_RATIOS = """adds AS (SELECT order_id, number, replace(name, ' ' || number, '') AS key FROM cmp WHERE action = 'add'),
  gone AS (SELECT order_id, number, replace(name, ' ' || number, '') AS key FROM cmp WHERE action = 'remove'),
  named AS (SELECT DISTINCT a.key AS a, g.key AS b FROM adds a JOIN gone g USING (order_id)),
  seg AS (SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi, 0::BIGINT AS got FROM named
    UNION ALL
    SELECT a, b, CASE WHEN side = 0 THEN alo ELSE i + k END, CASE WHEN side = 0 THEN i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE j + k END,
      CASE WHEN side = 0 THEN j ELSE bhi END, CASE WHEN side = 0 THEN k ELSE 0 END
    FROM (SELECT a, b, alo, ahi, blo, bhi, m[1] AS k, -m[2] AS i, -m[3] AS j, unnest([0, 1]) AS side FROM (
      SELECT a, b, alo, ahi, blo, bhi, max([k, -i, -j]) AS m FROM (
        SELECT *, unnest(range(1, least(ahi - i, bhi - j) + 1)) AS k FROM (
          SELECT *, unnest(range(blo, bhi)) AS j FROM (SELECT *, unnest(range(alo, ahi)) AS i FROM seg)) WHERE a[i + 1] = b[j + 1])
      WHERE substr(a, i + 1, k) = substr(b, j + 1, k) GROUP BY a, b, alo, ahi, blo, bhi))),
  ratios AS (SELECT a, b, 2.0::DOUBLE * sum(got) / (length(a) + length(b)) AS ratio FROM seg GROUP BY a, b)"""
_NAMED = _CANDS + """, nm AS (SELECT DISTINCT l_suppkey AS order_id, unnest([(l_partkey + 1000)::VARCHAR, (l_partkey + 1000) || 'P']) AS number FROM lineitem WHERE l_returnflag = 'R'),
  verdicts AS (SELECT n.order_id, n.number, CASE WHEN c.number IS NOT NULL THEN 'suggest' WHEN w.number IS NOT NULL THEN 'conflict' ELSE 'unknown' END AS verdict
    FROM nm n LEFT JOIN cand c ON c.order_id = n.order_id AND c.number = n.number LEFT JOIN w ON w.order_id = n.order_id AND w.number = n.number
    WHERE n.number NOT BETWEEN '1990' AND '2039' OR length(n.number) <> 4)"""
_O = """o AS (SELECT o_orderkey AS order_id, o_custkey, o_custkey::VARCHAR AS cust, o_orderstatus AS st, o_orderpriority[1] AS p, o_orderdate AS d,
    (o_custkey % 90 + 10)::INT AS users, (o_custkey + 1000)::VARCHAR AS n FROM orders)"""
_HOSTS = _O + """, h AS (SELECT order_id, p, st, CASE WHEN p = '4' AND st <> 'F' THEN 'DL-LMS1' END AS lms, CASE WHEN p = '5' AND st <> 'F' THEN 'DL-SCR' END AS scr,
    CASE WHEN order_id % 3 = 0 AND p <> '5' THEN 'cust' || cust || '.portal.example.com' END AS url, p = '4' AND st <> 'F' AS managed, p = '1' AND st <> 'O' AS says FROM o),
  hosts AS (SELECT order_id, CASE WHEN lms IS NOT NULL OR url IS NOT NULL THEN 'Vendor-Hosted' WHEN managed THEN 'Managed-Hosted' WHEN scr IS NOT NULL OR says THEN 'Self-Hosted' END AS detected_hosting,
    CASE WHEN lms IS NOT NULL THEN lms || ' SKU' WHEN url IS NOT NULL THEN 'portal URL ' || url WHEN managed THEN '"AI Managed Phishing" in a document, no hosting SKU'
      WHEN scr IS NOT NULL THEN scr || ' SKU' WHEN says THEN 'estimate address says SCORM' END AS hosting_source,
    CASE WHEN p = '2' AND st = 'O' THEN 'Self-Hosted' END AS choice FROM h),
  hosting AS (SELECT order_id, detected_hosting, hosting_source, coalesce(choice, detected_hosting) AS hosting FROM hosts)"""
_TYPES = """types AS (SELECT order_id, CASE WHEN st <> 'F' THEN CASE WHEN p < '4' THEN 'Renewal' ELSE 'New Account' END END AS detected_type,
    CASE WHEN st <> 'F' THEN CASE WHEN p < '4' THEN '"RENEWAL PROPOSAL" in sow.pdf' ELSE '"ORGANIZATION INFORMATION" in sow.pdf' END END AS type_source,
    CASE WHEN p = '1' THEN 'New Account' WHEN st <> 'F' THEN CASE WHEN p < '4' THEN 'Renewal' ELSE 'New Account' END END AS order_type FROM o WHERE st <> 'X' AND (st IN ('O', 'P', 'F') OR p = '5'))"""
_END = "strftime(d + INTERVAL 12 MONTH, '%m/%d/%Y')"
_EXP = _O + f""", x AS (SELECT order_id, 'sow.pdf' AS source, {_END} AS date,
      'License Term: ' || strftime(d, '%-m/%-d/%Y') || ' to ' || strftime(d + INTERVAL 12 MONTH, '%m-%d-%Y') AS found_as FROM o WHERE st <> 'F' AND p <> '3'
    UNION ALL SELECT order_id, 'estimate.pdf', strftime(d + INTERVAL 13 MONTH, '%m/%d/%Y'), 'EXPIRATION DATE ' || strftime(d + INTERVAL 13 MONTH, '%m/%d/%Y') FROM o WHERE st <> 'O'),
  dates AS (SELECT order_id, date FROM x UNION ALL SELECT order_id, strftime(d + INTERVAL 12 MONTH, '%m/%d/20%y') FROM o),
  picked AS (SELECT order_id, count(DISTINCT date) AS n_values, count(*)::BIGINT AS n_stated, CASE WHEN count(DISTINCT date) = 1 THEN min(date) END AS date,
    CASE WHEN count(DISTINCT date) > 1 THEN array_to_string(list_sort(list_distinct(list(date))), '; ') END AS conflict FROM dates GROUP BY order_id)"""
_SKUS = _O + """, skus AS (SELECT order_id, 'sow.pdf' AS source, unnest(['CL-SST-ESS', 'DL-SSO', 'CL-' || n, 'PH-SAAS-PB', CASE p WHEN '4' THEN 'DL-LMS1' WHEN '5' THEN 'DL-SCR' END]) AS sku,
    unnest(['Upgrade from the 2021 topic' || n || ' bundle to the new one', 'Related Services: ' || CASE WHEN p < '3' THEN 'SSO in place.' ELSE 'SSO not yet in place' END,
      'Free text topic', 'Mail Test', 'Delivery']) AS description, unnest([users, NULL, 12, NULL, NULL]) AS users FROM o WHERE st <> 'F'
  UNION ALL SELECT order_id, 'estimate.pdf', unnest(['CL-SST-ESS2', 'SRV-CUS', 'DL-SSO']), unnest(['Main', 'Custom screens', 'SSO']),
    unnest([CASE WHEN p = '1' THEN users + 1 ELSE users END, NULL, NULL]) FROM o WHERE st <> 'O')"""
_LABELS = _O + """, l AS (SELECT order_id, p, unnest([
      {'k': CASE WHEN p <> '5' THEN 'portal_url' END, 'l': CASE WHEN p <> '5' THEN 'OD' END, 'v': 'Cust' || cust, 'i': 1},
      {'k': 'opp_name', 'l': 'Opp Name', 'v': 'Deal: ' || cust || '_' || users || ' users_2026', 'i': CASE WHEN p <> '5' THEN 2 ELSE 1 END},
      {'k': 'company', 'l': 'Company', 'v': 'Customer ' || cust || chr(10) || 'Suite 9', 'i': CASE WHEN p <> '5' THEN 3 ELSE 2 END},
      {'k': CASE WHEN st <> 'P' THEN 'billing_poc' END, 'l': CASE WHEN st <> 'P' THEN 'Billing POC' END, 'v': 'Bill Ng, bill' || cust || '@example.com', 'i': CASE WHEN p <> '5' THEN 5 ELSE 4 END},
      {'k': 'license_dates', 'l': 'License Dates', 'v': strftime(d, '%-m/%-d/%Y') || ' - ' || strftime(d + INTERVAL 12 MONTH, '%-m/%-d/%y'), 'i': 4 + (p <> '5')::INT + (st <> 'P')::INT},
      {'k': NULL, 'l': 'Link', 'v': 'https://example.com/a', 'i': 5 + (p <> '5')::INT + (st <> 'P')::INT},
      {'k': NULL, 'l': 'Company', 'v': 'Second', 'i': 9 + (p <> '5')::INT + (st <> 'P')::INT},
      {'k': NULL, 'l': 'Note', 'v': 'two', 'i': 10 + (p <> '5')::INT + (st <> 'P')::INT}]) AS r FROM o),
  labels2 AS (SELECT order_id, r.k AS key, r.l AS label, r.v AS value, r.i::INT AS line_no FROM l WHERE r.l IS NOT NULL)"""
_LIST = _O + """, pasted AS (SELECT order_id, unnest([0, 1, 2, 4, 11, 13, 14]) AS line_no, unnest(['no_number', 'item', 'item', 'item', 'item', 'repeated', 'no_number']) AS status,
    unnest([NULL, n, n || 'A', n || 'B', n || 'D', n, NULL]) AS number,
    unnest(['Name', 'Tabbed Course ' || n, 'Top 10 Spaced ' || n || 'A', 'Cell Course ' || n || 'B', 'Clip ' || n || 'D: What happens', 'Again ' || n, 'Custom thing']) AS name,
    unnest([NULL, users, users, users, NULL, NULL, NULL]) AS license_count FROM o)"""
_COUNTS = _SKUS + """, counts AS (SELECT order_id, users::BIGINT AS users, sku || ', ' || source AS stated_by FROM skus WHERE sku IN ('CL-SST-ESS', 'CL-SST-ESS2')
    UNION ALL SELECT order_id, users + CASE WHEN order_id % 5 = 0 THEN 2 ELSE 0 END, 'portal' FROM o
    UNION ALL SELECT order_id, users, 'opp name' FROM o)"""
_FACTS = """docfacts AS (SELECT order_id, 'Order number' AS label, '9' || lpad(cust, 6, '0') AS value, 'estimate.pdf' AS source FROM o WHERE st <> 'O'
    UNION ALL SELECT order_id, 'Prepared for', 'Customer ' || CASE WHEN p = '2' THEN 'Zed' ELSE cust END, 'sow.pdf' FROM o WHERE st <> 'F'
    UNION ALL SELECT order_id, 'OD POC', 'poc' || cust || '@example.com', 'estimate.pdf' FROM o WHERE st <> 'O'
    UNION ALL SELECT order_id, 'OD URL', CASE p WHEN '1' THEN 'NA SCORM' WHEN '2' THEN 'other' ELSE 'cust' || cust END, 'estimate.pdf' FROM o WHERE st <> 'O')"""

ORACLE = {
    "compare_lists": f"""WITH {_COMPARED} SELECT order_id, number, action, name, CASE WHEN action = 'add' AND lc = 5 THEN 'demo license (5) on portal' ELSE '' END AS note,
      CASE WHEN action IN ('add', 'review') THEN 'order' ELSE 'Portal' END AS source, CASE WHEN action NOT IN ('add', 'review') THEN lc END AS license_count FROM cmp""",
    "final_items": f"WITH {_COMPARED} SELECT order_id, count(*) AS n_items, min(lower(name)) AS first_name FROM cmp WHERE action IN ('add', 'reset') GROUP BY order_id",
    "removal_candidates": f"WITH {_CANDS} SELECT order_id, number, name FROM cand",
    "named_number_check": f"WITH {_NAMED} SELECT * FROM verdicts",
    "keyword_suggestions": f"""WITH {_CANDS}, words AS (SELECT DISTINCT l_suppkey AS order_id, unnest(string_split(p_name, ' ')) AS word FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'
        UNION SELECT DISTINCT l_suppkey, 'please' FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, 'take' FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, 'out' FROM lineitem WHERE l_returnflag = 'R'
        UNION SELECT l_suppkey, (l_partkey + 1000)::VARCHAR FROM lineitem WHERE l_returnflag = 'R' AND l_partkey + 1000 NOT BETWEEN 1990 AND 2039),
      hits AS (SELECT DISTINCT c.order_id, c.number, w2.word FROM cand c JOIN words w2 ON w2.order_id = c.order_id AND list_contains(string_split(lower(c.name), ' '), w2.word) WHERE w2.word NOT IN ('old', 'new', 'the', 'and', 'from', 'bundle', 'course', 'courses', 'remove') AND length(w2.word) >= 3)
      SELECT order_id, number, array_to_string(list_sort(list(word)), ', ') AS words FROM hits GROUP BY ALL""",
    "removal_plan": f"""WITH {_NAMED}, c AS (SELECT p.order_id, count(*) AS n_present, count(w.number) AS n_shared,
        count(*) FILTER (w.number IS NULL AND v.number IS NOT NULL) AS n_named FROM p LEFT JOIN w ON w.order_id = p.order_id AND w.number = p.number
        LEFT JOIN verdicts v ON v.order_id = p.order_id AND v.number = p.number AND v.verdict = 'suggest' GROUP BY p.order_id),
      g AS (SELECT c.*, coalesce(u.x, false) OR n_shared * 2 < n_present AS looks_partial, s.k FROM c
        LEFT JOIN (SELECT DISTINCT l_suppkey, true AS x FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000)) u ON u.l_suppkey = c.order_id
        LEFT JOIN (SELECT s_suppkey, s_acctbal < 0 AS k FROM supplier WHERE s_acctbal < 1000) s ON s.s_suppkey = c.order_id),
      h AS (SELECT *, coalesce(k, looks_partial) AS partial FROM g)
      SELECT order_id, n_present, n_shared, looks_partial, partial, CASE WHEN partial THEN n_named ELSE n_present - n_shared END AS n_ticked,
        looks_partial AND NOT partial AS warn_choice, NOT partial AND n_named > 0 AND n_present - n_shared > n_named AS warn_others FROM h""",
    "merge_first": """SELECT l_suppkey AS order_id, l_partkey::VARCHAR AS number, min(l_returnflag) AS source, arg_min(l_quantity, (l_returnflag, l_quantity))::INT AS ord FROM lineitem GROUP BY 1, 2""",
    "renumber_candidates": f"""WITH RECURSIVE {_COMPARED}, {_RATIOS}
      SELECT a.order_id, a.number, g.number AS replaces, round(r.ratio, 6) AS ratio FROM adds a JOIN gone g USING (order_id) JOIN ratios r ON r.a = a.key AND r.b = g.key
      WHERE r.ratio >= 0.85 QUALIFY row_number() OVER (PARTITION BY a.order_id, a.number ORDER BY r.ratio DESC, g.number) = 1""",
    "number_set_sizes": f"""WITH {_ITEMS} SELECT coalesce(w.order_id, p.order_id) AS order_id, CASE WHEN p.number IS NULL THEN 'wanted_only' WHEN w.number IS NULL THEN 'present_only' ELSE 'both' END AS part,
      count(*) AS n FROM w FULL JOIN p ON w.order_id = p.order_id AND w.number = p.number GROUP BY ALL""",
    "validate_items": """WITH e AS (SELECT DISTINCT l_suppkey AS order_id, CASE WHEN l_discount > 0.09 THEN '12X' ELSE (l_partkey + 1000) || 'P' END AS number, l_tax FROM lineitem WHERE l_tax > 0.01),
      r AS (SELECT *, row_number() OVER (PARTITION BY order_id, number ORDER BY l_tax) AS rn FROM e)
      SELECT order_id, CASE WHEN number = '12X' THEN 'bad_number' WHEN rn = 1 THEN 'item' ELSE 'repeated' END AS status, count(*) AS n FROM r GROUP BY ALL""",
    "read_label_value": f"WITH {_LABELS} SELECT * FROM labels2",
    "read_license_list": f"WITH {_LIST} SELECT * FROM pasted",
    "document_kind": f"""WITH {_O} SELECT order_id, 'sow.pdf' AS source, 'SOW' AS kind FROM o WHERE st <> 'F' UNION ALL SELECT order_id, 'estimate.pdf', 'Estimate' FROM o WHERE st <> 'O'
      UNION ALL SELECT order_id, 'extra.pdf', 'Unknown' FROM o WHERE p = '5'""",
    "expiration_dates": f"WITH {_EXP} SELECT * FROM x",
    "multi_year_notes": f"WITH {_O} SELECT order_id, 'Licensing Option Selected: 3 Year Licensing' AS note FROM o WHERE p = '1' AND st <> 'F'",
    "date_single_or_conflict": f"WITH {_EXP} SELECT * FROM picked",
    "order_type": f"WITH {_O}, {_TYPES} SELECT * FROM types",
    "sku_lines": f"WITH {_SKUS} SELECT * FROM skus WHERE sku IS NOT NULL",
    "archive_rows": f"""WITH {_O} SELECT order_id, 'sow.pdf' AS source, unnest(['Archive & Remove', 'Archive and Reset', 'Requested Date']) AS label,
      unnest(['Old topics ' || n || 'P, ' || n, 'N/A', 'TBD']) AS value FROM o WHERE st <> 'F'""",
    "sku_table_items": f"""WITH {_O} SELECT order_id, n || 'A' AS number, 'Read ' || n || 'A' AS name, '' AS note, 'sow.pdf' AS source FROM o WHERE st <> 'F'
      UNION ALL SELECT order_id, n, 'Free text topic ' || n, 'from SKU', 'sow.pdf' FROM o WHERE st <> 'F'""",
    "change_notes": f"""WITH {_O} SELECT order_id, unnest(['upgrade', 'archive_remove', 'archive_reset', 'archive_other']) AS kind, unnest(['CL-SST-ESS', 'Archive & Remove', 'Archive and Reset', 'Requested Date']) AS label,
      unnest(['Upgrade from the 2021 topic' || n || ' bundle to the new one', 'Old topics ' || n || 'P, ' || n, 'N/A', 'TBD']) AS text FROM o WHERE st <> 'F'""",
    "keep_existing_reasons": f"""WITH {_O} SELECT order_id, 'upgrade' AS sign, 'CL-SST-ESS' AS source, 'Upgrade from the 2021 topic' || n || ' bundle to the new one' AS evidence FROM o WHERE st <> 'F'
      UNION ALL SELECT order_id, 'rest_stays', 'sow.pdf', 'All other courses will remain' FROM o WHERE st <> 'F' AND p = '2'""",
    "sku_difference": f"""WITH {_SKUS}, k AS (SELECT DISTINCT order_id, CASE WHEN source = 'sow.pdf' THEN 'only_on_sow' ELSE 'only_on_estimate' END AS finding, sku, regexp_replace(sku, '[^A-Z]', '', 'g') AS key
        FROM skus JOIN o USING (order_id) WHERE st = 'P' AND sku IS NOT NULL)
      SELECT a.order_id, a.finding, a.sku FROM k a ANTI JOIN k b ON a.order_id = b.order_id AND a.key = b.key AND a.finding <> b.finding""",
    "license_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "license_count_check": f"""WITH {_COUNTS} SELECT order_id, count(DISTINCT users) AS n_counts, array_to_string(list(users || ' (' || stated_by || ')' ORDER BY stated_by), '; ') AS detail
      FROM counts GROUP BY order_id HAVING count(DISTINCT users) > 1""",
    "sku_pick": f"""WITH {_SKUS} SELECT order_id, 'DL-SSO' AS sku, CASE WHEN st = 'O' THEN 'Related Services: ' || CASE WHEN p < '3' THEN 'SSO in place.' ELSE 'SSO not yet in place' END ELSE 'SSO' END AS description,
      st <> 'O' AS bought, st <> 'F' AND p < '3' AS in_place FROM o""",
    "hosting": f"WITH {_HOSTS} SELECT * FROM hosting",
    "order_facts": f"""WITH {_HOSTS}, {_TYPES}, {_FACTS}, {_LABELS.split(', l AS', 1)[0].replace(_O, 'dummy AS (SELECT 1)')}, l AS{_LABELS.split(', l AS', 1)[1]}
      SELECT * FROM docfacts UNION ALL SELECT order_id, label, value, 'Order email' FROM labels2
      UNION ALL SELECT order_id, 'Order type', detected_type, type_source FROM types WHERE detected_type IS NOT NULL
      UNION ALL SELECT order_id, 'Order type', order_type, 'manual choice' FROM types WHERE order_type IS DISTINCT FROM detected_type
      UNION ALL SELECT order_id, 'Hosting', detected_hosting, hosting_source FROM hosting WHERE detected_hosting IS NOT NULL
      UNION ALL SELECT order_id, 'Hosting', hosting, 'manual choice' FROM hosting WHERE hosting IS DISTINCT FROM detected_hosting""",
    "order_warnings": f"""WITH {_O} SELECT order_id, 'missing_field' AS warning, 'training_poc' AS detail FROM o UNION ALL SELECT order_id, 'missing_field', 'portal_url' FROM o WHERE p = '5'
      UNION ALL SELECT order_id, 'missing_field', 'billing_poc' FROM o WHERE st = 'P'
      UNION ALL SELECT order_id, 'missing_document', 'SOW' FROM o WHERE st = 'F' UNION ALL SELECT order_id, 'missing_document', 'Estimate' FROM o WHERE st = 'O'
      UNION ALL SELECT order_id, 'unknown_document', 'extra.pdf' FROM o WHERE p = '5'
      UNION ALL SELECT order_id, 'url_differs', 'cust' || cust || '.portal.example.com vs other' FROM o WHERE p = '2' AND st <> 'O'
      UNION ALL SELECT order_id, 'company_differs', 'Customer ' || cust || chr(10) || 'Suite 9 vs Customer Zed' FROM o WHERE p = '2' AND st <> 'F'""",
    "message_templates": f"""WITH {_O} SELECT order_id, CASE WHEN st = 'O' THEN '[number?]' ELSE '9' || lpad(cust, 6, '0') END || ': Customer ' || cust || ': ' ||
      CASE WHEN st = 'O' THEN '[poc?]' ELSE 'poc' || cust || '@example.com' END AS subject, 'Bill' AS greeting FROM o""",
    "order_tasks": f"""WITH {_HOSTS}, {_TYPES}, {_EXP.replace(_O, 'd0 AS (SELECT 1)')}, t AS (SELECT o.*, hosting.hosting, types.order_type, picked.date AS exp_date,
        hosting.hosting IS NOT NULL AND hosting.hosting = 'Self-Hosted' AS selfh, hosting.hosting IS NOT NULL AND hosting.hosting = 'Managed-Hosted' AS managed FROM o LEFT JOIN hosting USING (order_id) LEFT JOIN types USING (order_id) LEFT JOIN picked USING (order_id)),
      r AS (SELECT order_id, list_filter([
        CASE WHEN NOT selfh THEN {{'title': CASE WHEN managed THEN 'Update managed expiration date' ELSE 'Update portal expiration date' END, 'h': 'Fulfillment', 'c': CASE WHEN managed THEN 'no standard for managed hosting' WHEN exp_date IS NULL THEN 'no single date' END,
          'd': coalesce(CASE WHEN managed THEN 'Managed-Hosted' WHEN p <> '2' THEN 'cust' || cust || '.portal.example.com' ELSE 'Portal' END || ': ' || exp_date, '')}} END,
        CASE WHEN st <> 'F' AND p = '1' THEN {{'title': 'License count change', 'h': 'Support', 'c': NULL, 'd': ''}} END,
        CASE WHEN o_custkey % 3 > 0 THEN {{'title': 'Add courses', 'h': 'Fulfillment', 'c': CASE WHEN st = 'F' THEN 'license count unknown' END,
          'd': array_to_string(list_transform(range(1, o_custkey % 3 + 1), lambda i: (o_custkey + 1000 + i)::VARCHAR), ', ') || ' | License count: ' || CASE WHEN st = 'F' THEN '[license count?]' ELSE users::VARCHAR END}} END,
        CASE WHEN o_custkey % 2 > 0 THEN {{'title': 'Remove demo courses', 'h': 'Fulfillment', 'c': NULL, 'd': ''}} END,
        CASE WHEN o_custkey % 4 > 0 THEN {{'title': 'Course archive', 'h': 'Support', 'c': NULL, 'd': ''}} END,
        CASE WHEN NOT (st <> 'F' AND p < '3') THEN {{'title': 'SSO', 'h': 'Support', 'c': CASE WHEN st = 'O' THEN 'offered but not bought' END, 'd': ''}} END,
        CASE WHEN st <> 'O' THEN {{'title': 'Customization', 'h': 'Customization', 'c': NULL, 'd': 'Order of customer ' || cust || ' | SRV-CUS: Custom screens'}} END,
        CASE WHEN st <> 'F' THEN {{'title': 'Phishing: hosted box', 'h': 'Fulfillment', 'c': 'offered but not bought', 'd': 'PH-SAAS-PB' || CASE WHEN p < '3' THEN ': Mail Test' ELSE '' END}} END,
        CASE WHEN p = '4' THEN {{'title': 'Phishing: firewall', 'h': 'Fulfillment', 'c': CASE WHEN managed THEN 'no standard for managed hosting' ELSE 'check who handles it' END, 'd': ''}} END,
        CASE WHEN p = '3' OR order_type = 'New Account' THEN {{'title': 'Communication materials', 'h': 'Support', 'c': CASE WHEN p <> '3' THEN 'not listed, given by default' END, 'd': ''}} END,
        CASE WHEN order_type = 'New Account' OR (NOT selfh AND (order_type = 'Renewal' OR order_type IS NULL)) THEN {{'title': 'Customer notification', 'h': 'Fulfillment ticket',
          'c': CASE WHEN order_type = 'New Account' AND hosting IS NULL THEN 'hosting unknown' WHEN order_type = 'Renewal' AND managed THEN 'write by hand' WHEN order_type IS NULL THEN 'order type unknown' END, 'd': 'Order of customer ' || cust}} END],
        lambda x: x IS NOT NULL) AS l FROM t), u AS (SELECT order_id, unnest(l) AS x, generate_subscripts(l, 1)::INT - 1 AS ord FROM r)
      SELECT order_id, ord, x.title AS title, x.h AS handled_by, x.d AS details, x.c AS confirm FROM u""",
    "order_record": f"""WITH {_O} SELECT order_id, CASE WHEN st <> 'O' THEN '9' || lpad(cust, 6, '0') END AS order_number, 'Customer ' || cust || chr(10) || 'Suite 9' AS company,
      CASE WHEN p <> '5' THEN 'cust' || cust || '.portal.example.com' WHEN st <> 'O' THEN 'cust' || cust || '.portal.example.com' END AS portal_url,
      CASE WHEN st <> 'O' THEN 'poc' || cust || '@example.com' END AS contact, CASE WHEN st <> 'O' THEN 'estimate.pdf' ELSE '' END AS bought_sources FROM o""",
}

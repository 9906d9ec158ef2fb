import zipfile

import pytest
from pyspark.sql import functions as F

from proofloom.operators import campaign as K
from proofloom.sources import files, packages
from tests.conftest import rows


def test_campaign_files(spark, tmp_path):
    header = "UserName,usermail ,Department"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfReport title\r\n" + header.encode() + b"\r\nAnn,ann@x.com,\"Ops, IT\"\r\n,,\r\nBob,bob@x.com\r\n")
    (tmp_path / "b.csv").write_bytes((header + "\nZoë,zoe@x.com,Büro\n").encode("cp1252"))
    cells = files.read_campaign_cells(spark, str(tmp_path))
    assert rows(files.campaign_table(cells, ["UserMail", "Department", "Missing"]), "UserMail", "Department", "Missing") == [
        ("ann@x.com", "Ops, IT", None), ("bob@x.com", None, None), ("zoe@x.com", "Büro", None)]
    (tmp_path / "c.csv").write_text("no,header\n1,2\n")
    broken = files.read_campaign_cells(spark, str(tmp_path))
    assert broken.filter("error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="header"):
        files.campaign_table(broken, ["UserMail"]).collect()


def test_sheets_keep_order_and_empty_ones(spark, tmp_path):
    df = spark.createDataFrame([("Fail", "a"), ("Mine", "b")], "sheet string, UserMail string")
    files.write_sheets(df, str(tmp_path / "s"))
    back, order = files.read_sheets(spark, str(tmp_path / "s"))
    assert rows(back, "sheet", "UserMail") == [("Fail", "a"), ("Mine", "b")]
    assert [r.sheet for r in order.collect()] == [*K.SHEET_ORDER, "Mine"]


def test_projection_csv_tsv_json(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    files.write_projection_csv(df, str(tmp_path / "p"), ["y", "z", "X"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "p"))) == [("1", None, "a")]
    files.write_tsv(df, str(tmp_path / "t"))
    assert rows(spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t"))) == [("a", "1")]
    files.write_report_json(df, str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j")), "x", "y") == [("a", 1)]


def test_runs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "site string, broken int")
    for i, kind in enumerate(("site", "update")):
        rec = files.run_records(df, F.lit(i), F.current_timestamp(), kind, F.col("broken") > 0)
        files.append_runs(rec, str(tmp_path / "r"))
    back = files.read_runs(spark, str(tmp_path / "r"), "update", "site string, broken int")
    assert rows(back, "run_id", "has_issues", "site", "broken") == [(1, False, "b", 0), (1, True, "a", 1)]


def test_packages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("html5/data/js/data.js", "window.globalProvideData('data', '{\"title\":\"It\\'s \\\\u00e9t\\\\u00e9\"}');")
        z.writestr("imsmanifest.xml", '<manifest xmlns="u"><organizations><organization><title>T</title></organization></organizations></manifest>')
    (tmp_path / "bad.zip").write_text("nonsense")
    e = packages.ingest_packages(spark, str(tmp_path)).cache()
    assert e.filter("error IS NOT NULL").count() == 1 and e.filter("entry IS NOT NULL").count() == 2
    js = e.filter("entry LIKE '%.js'").select(packages.decode_payload(F.decode("content", "UTF-8"), "data").alias("j"))
    assert js.select(F.get_json_object("j", "$.title")).first()[0] == "It's été"
    xml = e.filter("entry LIKE '%.xml'").select(packages.manifest_fields(F.decode("content", "UTF-8")).alias("m"))
    assert xml.first().m.course_title == "T"
    done = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "modificationTime", "length")
    assert packages.ingest_packages(spark, str(tmp_path), done).count() == 0


def test_logs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("10:00:00.123 1704103200123 | SCREEN abc\n1704103201000 | hello | there\njunk\n")
    assert rows(files.read_marker_log(spark, str(tmp_path / "m.txt")), "text") == [("abc",), ("hello | there",)]
    (tmp_path / "c.json").write_text('{"session_id":"s","t":1704103200123,"fn":"SetValue","args":["k","v"],"result":"true"}\n')
    assert rows(files.read_api_calls(spark, str(tmp_path / "c.json")), "fn", "args") == [("SetValue", ["k", "v"])]

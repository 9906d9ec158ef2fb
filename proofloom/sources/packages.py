"""Zipped course packages: entries, JavaScript payloads, manifest and options."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entries(batches):
    """Entries of each zip, one output batch per package; a bad zip is one error row."""
    for files in batches:
        for path, raw in zip(files["path"], files["content"]):
            out = []
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            out.append((path, name, z.read(name), None))
            except (zipfile.BadZipFile, RuntimeError, zlib.error) as e:
                out.append((path, None, None, f"cannot open: {e}"))
            yield pd.DataFrame(out, columns=["path", "entry", "content", "error"])


def ingest_packages(spark: SparkSession, paths: str | Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """(path, entry, content, error) of zip packages.

    ``done`` (path, modificationTime, length) lists packages taken before;
    unchanged ones are not opened again.
    """
    files = spark.read.format("binaryFile").load(paths)
    if done is not None:
        files = files.join(done.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")
    return files.select("path", "content").mapInPandas(_entries, "path string, entry string, content binary, error string")


@F.pandas_udf(T.StringType())
def unescape_js(texts: pd.Series) -> pd.Series:
    """Undo the escapes of a single-quoted JavaScript string; null on failure."""
    def one(text):
        try:
            return text.encode("raw_unicode_escape").decode("unicode_escape")
        except (UnicodeDecodeError, AttributeError):
            return None
    return texts.map(one)


def decode_payload(js: Column, kind: str) -> Column:
    """JSON text inside ``window.globalProvideData('<kind>', '{...}')``; null
    when there is none or it is not JSON."""
    inner = F.regexp_extract(js, rf"(?s)window\.globalProvideData\('\Q{kind}\E',\s*'(\{{.+\}})'", 1)
    raw = unescape_js(F.nullif(inner, F.lit("")))
    return F.when(F.try_parse_json(raw).isNotNull(), raw)


def manifest_fields(xml: Column) -> Column:
    """Course title and schema version, whatever the default namespace."""
    bare = F.regexp_replace(xml, r' xmlns="[^"]+"', "")
    title = F.trim(F.xpath_string(bare, F.lit("//organizations/organization/title")))
    version = F.trim(F.xpath_string(bare, F.lit("//metadata/schemaversion")))
    return F.struct(title.alias("course_title"), version.alias("scorm_version"))


def xml_option(xml: Column, name: str) -> Column:
    """Value of ``<option name=.. value=..>`` in either attribute order."""
    first = F.regexp_extract(xml, rf'<option\s+[^>]*?name="\Q{name}\E"[^>]*?value="([^"]+)"', 1)
    second = F.regexp_extract(xml, rf'<option\s+[^>]*?value="([^"]+)"[^>]*?name="\Q{name}\E"', 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def player_options(xml: Column) -> Column:
    """The author's player settings; booleans are null when not stated."""
    def flag(name: str) -> Column:
        return F.lower(xml_option(xml, name)) == "true"
    title = F.regexp_extract(xml, r'name="title_text"\s+value="([^"]+)"', 1)
    return F.struct(flag("playbackSpeedControl").alias("speed_control"), xml_option(xml, "flow").alias("navigation_flow"),
                    flag("sidebar_enabled").alias("sidebar"), flag("autonumber").alias("autonumber"),
                    F.nullif(title, F.lit("")).alias("player_title"))

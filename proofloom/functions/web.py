"""Link resolution, hosts and version strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = r"\d+\.\d+(?:\.\d+)?(?:\.\d+)?"


def host(url: Column) -> Column:
    """Authority part of an absolute or protocol-relative URL, else empty."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def site(url: Column) -> Column:
    """Host without a leading ``www.`` (the prefix only)."""
    return F.regexp_replace(host(url), r"^www\.", "")


def is_internal(url: Column, base: Column) -> Column:
    """Same site as ``base``, or a URL without a host."""
    return (site(url) == site(base)) | (host(url) == "")


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments of an absolute path resolved."""
    split = F.split(path, "/")
    parts = F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0)))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda acc, p: F.when(p == ".", acc)
                       .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .otherwise(F.concat(acc, F.array(p))))
    tail = F.when(last.isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(tail == "", joined).otherwise(F.regexp_replace(F.concat(joined, tail), "/+$", "/"))


def join_url(base: Column, ref: Column) -> Column:
    """``ref`` made absolute against ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_rest = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
    return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
            .when(F.startswith(ref, F.lit("/")), F.concat(root, without_dots(ref_path), ref_rest))
            .when(F.startswith(ref, F.lit("?")), F.concat(root, path, ref))
            .when(F.startswith(ref, F.lit("#")) | (ref == ""), F.concat(root, path, query, ref))
            .otherwise(F.concat(root, without_dots(F.concat(folder, ref_path)), ref_rest)))


def status_ok(code: Column) -> Column:
    """200 to 399; a request that failed or timed out is recorded as 0."""
    return F.coalesce(code, F.lit(0)).between(200, 399)


def extract_versions(text: Column) -> Column:
    """Installed and offered version in an update row.

    Labelled versions come first; with neither label the first two version
    numbers stand for them, and a single one is the offered version.
    """
    now = F.regexp_extract(text, rf"(?i)(?:have version|installed[:\s]+)\s*({VERSION})", 1)
    new = F.regexp_extract(text, rf"(?i)(?:update to|new version[:\s]+)\s*({VERSION})", 1)
    every = F.regexp_extract_all(text, F.lit(f"({VERSION})"), 1)
    bare = (now == "") & (new == "")
    current = F.when(bare & (F.size(every) >= 2), F.get(every, F.lit(0))).otherwise(now)
    offered = F.when(bare, F.coalesce(F.when(F.size(every) >= 2, F.get(every, F.lit(1)))
                                      .otherwise(F.get(every, F.lit(0))), F.lit(""))).otherwise(new)
    return F.struct(current.alias("current"), offered.alias("available"))


def core_version(text: Column) -> Column:
    """Installed and offered core version of an update page; both empty when it
    says that nothing is due."""
    v = r"\d+\.\d+(?:\.\d+)?"
    current = F.regexp_extract(text, rf"(?i)You are using WordPress\s+({v})|current version[:\s]+({v})", 0)
    current = F.regexp_extract(current, f"({v})", 1)
    offered = F.regexp_extract(text, rf"(?i)(?:updated version|new version)[^<]*?({v})", 1)
    other = F.regexp_extract(text, rf"(?i)WordPress\s+({v})\s+is available", 1)
    due = ~text.rlike("(?i)You have the latest version|WordPress is up to date|up to date")
    return F.struct(F.when(due, current).otherwise("").alias("current"),
                    F.when(due, F.coalesce(F.nullif(offered, F.lit("")), other)).otherwise("").alias("available"))

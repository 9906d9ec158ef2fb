"""Repeated titles and paragraphs, doubled words, spacing and dash findings.

Input is a screens table: a scope column (course or scene), a screen column
and either a title or the screen's text.  Row-local checks never shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .spread import first_per_key, salted_join, top_n_per_key
from .stored import merged


def text_rows(screens: DataFrame, text: str = "text", ord_name: str = "ord") -> DataFrame:
    """One row per text line, ``ord`` from 0, ``value`` trimmed, empty ones dropped."""
    keep = [c for c in screens.columns if c != text]
    rows = screens.select(*keep, F.posexplode(T.lines(F.col(text))).alias(ord_name, "value"))
    return rows.withColumn("value", F.trim("value")).filter(F.col("value") != "")


def text_runs(text: Column, **also: Column) -> Column:
    """The rows of ``text_rows`` of one text as an array of structs: ord, value and what is stated besides."""
    cut = F.transform(T.lines(text), lambda v, i: F.struct(i.alias("ord"), F.trim(v).alias("value"), *[c.alias(k) for k, c in also.items()]))
    return F.filter(cut, lambda r: r["value"] != "")


def _exempt(c: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(p)
    return hit


def duplicate_titles(screens: DataFrame, scope: Sequence[str], screen: str, title: str,
                     threshold: int = 1, exempt: Sequence[str] = (), shown: int = 5) -> DataFrame:
    """Titles used by more than ``threshold`` screens of one scope, ignoring case.

    ``shown`` screens are listed per title; ``duplicate_title_screens`` has all.
    """
    titled = (screens.select(*scope, screen, F.trim(F.col(title)).alias("__title"))
              .filter((F.col("__title") != "") & ~_exempt(F.col("__title"), exempt))
              .withColumn("title_key", F.lower("__title")))
    keys = [*scope, "title_key"]
    counted = (titled.groupBy(*keys)
               .agg(F.count("*").alias("n_screens"), F.min_by("__title", screen).alias("title"))
               .filter(F.col("n_screens") > threshold))
    listed = (top_n_per_key(titled, keys, [F.col(screen)], shown)
              .groupBy(*keys)
              .agg(F.sort_array(F.collect_list(screen)).alias("__first")))
    return counted.join(merged(listed), keys).select(
        *scope, "title_key", "title", "n_screens",
        F.array_join(F.col("__first").cast("array<string>"), ", ").alias("first_screens"))


def duplicate_title_screens(screens: DataFrame, scope: Sequence[str], screen: str,
                            title: str, threshold: int = 1) -> DataFrame:
    """Every screen whose title is repeated in its scope, with the repeat count."""
    titled = (screens.select(*scope, screen, F.lower(F.trim(F.col(title))).alias("title_key"))
              .filter(F.col("title_key") != ""))
    keys = [*scope, "title_key"]
    repeated = (titled.groupBy(*keys).agg(F.count("*").alias("n_screens"))
                .filter(F.col("n_screens") > threshold))
    return salted_join(titled, repeated, keys, spread_on=[screen])


def duplicate_paragraphs(rows: DataFrame, scope: Sequence[str], screen: str,
                         paragraph: str = "value", threshold: int = 1, min_chars: int = 40,
                         exempt: Sequence[str] = ()) -> DataFrame:
    """Exact paragraphs found on more than ``threshold`` different screens."""
    long_enough = rows.filter(F.length(paragraph) >= min_chars).filter(
        ~_exempt(F.col(paragraph), exempt))
    keys = [*scope, paragraph]
    per_screen = long_enough.groupBy(*keys, screen).agg(F.count("*").alias("__n"))
    return (per_screen.groupBy(*keys)
            .agg(F.count("*").alias("n_screens"), F.sum("__n").alias("n_uses"),
                 F.min(screen).alias("first_screen"))
            .filter(F.col("n_screens") > threshold))


def show_first_n(groups: DataFrame, scope: Sequence[str], order: Sequence[Column], n: int,
                 shown: Sequence[str]) -> DataFrame:
    """First ``n`` rows of each scope plus one row that counts the rest."""
    first = (top_n_per_key(groups, scope, order, n)
             .select(*scope, "rank_no", *shown, F.lit(0).cast("bigint").alias("n_more")))
    rest = (groups.groupBy(*scope).agg((F.count("*") - n).alias("n_more"))
            .filter(F.col("n_more") > 0)
            .select(*scope, F.lit(n + 1).alias("rank_no"),
                    *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in shown],
                    "n_more"))
    return first.unionByName(rest)


def doubled_words(screens: DataFrame, keep: Sequence[str], text: str,
                  adjacent_only: Sequence[str] = (), ignored: Sequence[str] = ()) -> DataFrame:
    """Screens with a word said twice; the screen's text runs are joined by a space first."""
    def literal(words: Sequence[str]) -> Column:
        return F.array(*[F.lit(w) for w in words]).cast("array<string>")
    joined = F.array_join(T.lines(F.col(text)), " ")
    hits = T.doubled_words(joined, literal(adjacent_only), literal(ignored))
    return (screens.select(*keep, hits.alias("__hits")).filter(F.size("__hits") > 0)
            .select(*keep, F.size("__hits").alias("n_words"),
                    F.array_join("__hits", ", ").alias("words")))


def spacing_array(c: Column, english: bool = True) -> Column:
    """All spacing findings of one text as an array of (kind, snippet)."""
    def found(kind: str, snippets: Column) -> Column:
        return F.transform(snippets, lambda s: F.struct(
            F.lit(kind).alias("kind"), F.trim(s).alias("snippet")))

    def parts(bare: Column) -> Column:
        told = [
            F.when(T.has_extra_spaces(c, bare), F.array(F.struct(
                F.lit("extra_space").alias("kind"), F.trim(c).alias("snippet")))).otherwise(
                F.array().cast("array<struct<kind:string,snippet:string>>")),
            found("missing_space", T.missing_space_after_punct(c, bare)),
        ]
        if english:
            told.append(found("spaced_em_dash", T.spaced_em_dashes(c, bare)))
            told.append(found("hyphen_as_dash", T.hyphens_as_dash(c, bare)))
        return F.concat(*told)

    return T.bound(T.remove_urls_emails(c), parts)


def spacing_findings(rows: DataFrame, keep: Sequence[str], value: str = "value",
                     english: bool = True) -> DataFrame:
    """Extra spaces, missing spaces after punctuation and (English only) spaced
    em-dashes and hyphens used as dashes, one row per finding."""
    return (rows.select(*keep, F.explode(spacing_array(F.col(value), english)).alias("__f"))
            .select(*keep, "__f.kind", "__f.snippet"))


def text_search(rows: DataFrame, keep: Sequence[str], term: str, value: str = "value",
                whole_word: bool = False) -> DataFrame:
    """Case-insensitive literal search; a blank term gives one prompt row.

    ``excerpt`` is the first 200 characters of the matching text, ``n_hits``
    how often the term occurs in the whole of it.
    """
    c = F.col(value)
    if not term.strip():
        return rows.sparkSession.range(1).select(
            *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keep],
            F.lit("enter a search term").alias("excerpt"), F.lit(0).alias("n_hits"))
    pattern = T.quoted_pattern(term.strip(), whole_word)
    return (rows.filter(c.rlike(pattern))
            .select(*keep, F.substring(F.trim(c), 1, 200).alias("excerpt"),
                    F.regexp_count(c, F.lit(pattern)).alias("n_hits")))


def term_consistency(screens: DataFrame, scope: Sequence[str], screen: str, text: str,
                     terms: dict[str, Sequence[str]], shown: int = 5) -> DataFrame:
    """Terms written in two or more forms inside one scope.

    ``terms`` maps a canonical form to its variants.  Matching is case
    sensitive and whole word; a capital at a sentence start is folded when the
    lower-case form is itself listed.
    """
    c = F.col(text)
    found = []
    for canonical, variants in terms.items():
        forms = [canonical, *variants]
        known = {f.lower() for f in forms}
        for form in forms:
            quoted = f"\\Q{form}\\E"
            said = F.contains(c, F.lit(form))
            total = F.when(said, F.regexp_count(c, F.lit(f"(?U)\\b{quoted}\\b"))).otherwise(0)
            folded = form[:1].lower() + form[1:]
            if form[:1].isupper() and folded in known:
                opening = F.when(said, F.regexp_count(
                    c, F.lit(f"(?U)(?:^|[.!?:;]\\s|\\n)\\s*\\b{quoted}\\b"))).otherwise(0)
            else:
                opening = F.lit(0)
            found.append(F.struct(F.lit(canonical).alias("term"), F.lit(form).alias("form"),
                                  (total - opening).alias("n")))
            if form[:1].isupper() and folded in known:
                found.append(F.struct(F.lit(canonical).alias("term"), F.lit(folded).alias("form"),
                                      opening.alias("n")))
    uses = (screens.select(*scope, screen, F.explode(F.filter(
                F.array(*found), lambda s: s["n"] > 0)).alias("__f"))
            .select(*scope, screen, "__f.term", "__f.form")
            .groupBy(*scope, "term", "form", screen).agg(F.lit(1).alias("__one")))
    per_form = uses.groupBy(*scope, "term", "form").agg(F.count("*").alias("n_screens"))
    mixed = (per_form.groupBy(*scope, "term").agg(F.count("*").alias("n_forms"))
             .filter(F.col("n_forms") > 1))
    where = (top_n_per_key(uses, [*scope, "term", "form"], [F.col(screen)], shown)
             .groupBy(*scope, "term", "form")
             .agg(F.array_join(F.sort_array(F.collect_list(screen)).cast("array<string>"), "; ")
                  .alias("first_screens")))
    return (per_form.join(merged(mixed), [*scope, "term"]).join(merged(where), [*scope, "term", "form"])
            .select(*scope, "term", "form", "n_forms", "n_screens", "first_screens"))


def first_title(rows: DataFrame, keys: Sequence[str], value: str = "value",
                ord_name: str = "ord") -> DataFrame:
    """The first text line of each screen, taken as its title."""
    return first_per_key(rows, keys, [F.col(ord_name)], [value])

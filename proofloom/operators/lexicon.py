"""Checks that ask whether a word is in a dictionary table.

A dictionary is a table (lang, word).  Words are reduced to one row per
(scope, word) before any join, so the commonest word costs one row, not one
row per use.  ``unknown_words`` keeps every use: there the dictionary goes to
the uses, spread over salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .spread import salted_join, top_n_per_key
from .stored import merged


def lexicon_from_texts(texts: DataFrame, lang: str, doc: str, text: str,
                       min_docs: int) -> DataFrame:
    """Words of three or more letters used by at least ``min_docs`` texts of a language."""
    used = (texts.select(F.col(lang).alias("lang"), F.col(doc).alias("__doc"),
                         F.explode(F.array_distinct(F.transform(
                             T.words(F.col(text)), F.lower))).alias("word")))
    return (used.groupBy("lang", "word").agg(F.count("*").alias("n_docs"))
            .filter(F.col("n_docs") >= min_docs))


def candidate_array(runs: Column) -> Column:
    """Distinct words of a screen worth looking up, from its text runs.

    All-caps words, words of 15 letters and more, and words that vanish when the runs are joined without a space (the
    tail of a split link) are left out.
    """
    spaced = T.words(F.array_join(runs, " "))
    tight = F.transform(T.words(F.array_join(runs, "")), F.lower)
    kept = F.filter(spaced, lambda w: (F.upper(w) != w) & (F.length(w) < 15))
    return F.array_intersect(F.array_distinct(F.transform(kept, F.lower)), tight)


def candidate_words(screens: DataFrame, keep: Sequence[str], runs: str) -> DataFrame:
    """``candidate_array`` of each screen, one row per word."""
    return screens.select(*keep, F.explode(candidate_array(F.col(runs))).alias("word"))


def most_used(lexicon: DataFrame, n: int = 8192) -> DataFrame:
    """The ``n`` words (lang, word) of a lexicon with ``n_docs`` that most texts use."""
    return lexicon.orderBy(F.desc("n_docs"), "lang", "word").limit(n).select("lang", "word")


def unknown_words(words: DataFrame, lexicon: DataFrame, ignore: DataFrame | None = None, common: DataFrame | None = None) -> DataFrame:
    """Rows of ``words`` whose word is in neither list (lists have one ``word`` column).

    ``common`` are words of the lists, few enough for every task: their uses, mostly the larger part, are not exchanged.
    """
    if common is not None:
        words = words.join(common.select("word"), "word", "left_anti")
    known = lexicon.select("word") if ignore is None else lexicon.select("word").unionByName(ignore.select("word"))
    # The lists go to the words, which are read once; a word of any number of uses is spread over the salts.
    return salted_join(words.filter("word is not null"), known.distinct(), ["word"], "left_anti")


def unknown_word_report(unknown: DataFrame, screen: str, shown: int = 3) -> DataFrame:
    """Word, how many screens use it, and the first ``shown`` of them."""
    seen = unknown.groupBy("word", screen).agg(F.lit(1).alias("__one"))
    counts = seen.groupBy("word").agg(F.count("*").alias("n_screens"))
    where = (top_n_per_key(seen, ["word"], [F.col(screen)], shown).groupBy("word")
             .agg(F.array_join(F.sort_array(F.collect_list(screen)).cast("array<string>"), "; ")
                  .alias("first_screens")))
    return counts.join(where, "word").select("word", "n_screens", "first_screens")


def untranslated(rows: DataFrame, keys: Sequence[str], lang: str, value: str,
                 lexicon: DataFrame, allowed: DataFrame | None = None,
                 source_lang: str = "en", minimum: int = 3, common: DataFrame | None = None) -> DataFrame:
    """Text elements with ``minimum`` or more words of the source language that
    the element's own language does not know.

    ``lexicon`` is (lang, word), ``common`` some of it as in ``unknown_words``.
    Elements without a language, or in one the lexicon does not cover, are
    skipped.  Only foreign words are counted.
    """
    has_lang = rows.withColumn("__lang", T.language_base(F.col(lang))).filter(
        F.col("__lang").isNotNull() & (F.col("__lang") != source_lang))
    found = F.transform(T.words(F.col(value), 2), F.lower)
    used = (has_lang.filter(F.size(found) >= minimum)
            .select(*keys, F.col("__lang").alias("lang"), F.explode(found).alias("word")))
    if common is not None:
        used = used.join(common, ["lang", "word"], "left_anti")
    source = lexicon.filter(F.col("lang") == source_lang).select("word").distinct()
    if allowed is not None:
        source = source.join(allowed.select("word").distinct(), "word", "left_anti")
    foreign = (used.groupBy("lang", "word").agg(F.lit(1).alias("__one")).drop("__one")
               .join(lexicon.select("lang").distinct(), "lang", "left_semi")
               .join(source, "word", "left_semi")
               .join(lexicon.select("lang", "word").distinct(), ["lang", "word"], "left_anti"))
    hits = salted_join(used, foreign, ["lang", "word"], spread_on=list(keys))
    return (hits.groupBy(*keys, "lang", "word").agg(F.count("*").alias("__n"))
            .groupBy(*keys, "lang")
            .agg(F.sum("__n").alias("n_words"), F.count("*").alias("n_distinct"),
                 F.min("word").alias("first_word"))
            .filter(F.col("n_words") >= minimum))


def unspaced_acronyms(words: DataFrame, lexicon: DataFrame, always_flag: DataFrame, ignore: DataFrame) -> DataFrame:
    """Rows of ``words`` (one per ``word``) that should be letter-spaced; see ``acronym_report`` for the lists."""
    flag = always_flag.select("word", F.lit(True).alias("__flag")).distinct()
    skip = ignore.select("word", F.lit(True).alias("__skip")).distinct()
    known = lexicon.select(F.upper("word").alias("word"), F.lit(True).alias("__known")).distinct()
    return (words.join(flag, "word", "left").join(merged(skip), "word", "left").join(merged(known), "word", "left")
            .filter(F.col("__flag").isNotNull() | (F.col("__skip").isNull() & F.col("__known").isNull()))
            .drop("__flag", "__skip", "__known"))


def acronym_report(screens: DataFrame, screen: str, text: str, lexicon: DataFrame,
                   always_flag: DataFrame, ignore: DataFrame, shown: int = 3) -> DataFrame:
    """All-caps words that should be letter-spaced.

    A word on ``always_flag`` is reported whatever the other lists say; a word
    on ``ignore`` never; any other word when the dictionary lacks it.
    """
    seen = (screens.select(screen, F.explode(F.array_distinct(
        T.all_caps_runs(F.col(text)))).alias("word"))
        .groupBy("word", screen).agg(F.lit(1).alias("__one")))
    counts = seen.groupBy("word").agg(F.count("*").alias("n_screens"))
    kept = unspaced_acronyms(counts, lexicon, always_flag, ignore)
    where = (top_n_per_key(seen, ["word"], [F.col(screen)], shown).groupBy("word")
             .agg(F.array_join(F.sort_array(F.collect_list(screen)).cast("array<string>"), "; ")
                  .alias("first_screens")))
    return (kept.join(where, "word")
            .select("word", T.letter_spaced(F.col("word")).alias("suggested"),
                    "n_screens", "first_screens"))


def suspicious_hyphen_pairs(rows: DataFrame, keep: Sequence[str], value: str, lexicon: DataFrame,
                            allowed: DataFrame, prefixes: Sequence[str],
                            suffixes: Sequence[str]) -> DataFrame:
    """Hyphenated tokens that may hide a dash, with the places that use them.

    A token is an ordinary compound when it is allowed, starts with a known
    prefix, ends with a known suffix, or all its parts of two or more letters
    are dictionary words (and there is at least one such part).
    """
    uses = rows.select(*keep, F.explode(T.hyphen_pairs(F.col(value))).alias("token"))
    return suspicious_tokens(uses, lexicon, allowed, prefixes, suffixes)


def suspicious_tokens(uses: DataFrame, lexicon: DataFrame, allowed: DataFrame, prefixes: Sequence[str],
                      suffixes: Sequence[str]) -> DataFrame:
    """Rows of ``uses`` whose hyphenated ``token`` is no ordinary compound; see ``suspicious_hyphen_pairs``."""
    tokens = uses.groupBy("token").agg(F.count("*").alias("n_uses"))
    parts = F.split("token", "-")
    tokens = (tokens.withColumn("__parts", parts)
              .filter(~F.element_at("__parts", 1).isin(*prefixes)
                      & ~F.element_at("__parts", -1).isin(*suffixes))
              .join(allowed.select(F.col("word").alias("token")).distinct(), "token", "left_anti"))
    judged = tokens.select("token", F.explode(F.array_distinct(
        F.filter("__parts", lambda p: F.length(p) >= 2))).alias("word"))
    known = judged.join(merged(lexicon.select("word").distinct().withColumn("__known", F.lit(1))), "word", "left")
    verdict = (known.groupBy("token")
               .agg(F.count("*").alias("__n"), F.count("__known").alias("__k"))
               .filter(F.col("__n") == F.col("__k")).select("token"))
    bad = tokens.join(merged(verdict), "token", "left_anti").select("token", "n_uses")
    return salted_join(uses, bad, ["token"])

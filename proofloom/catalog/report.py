"""The report of all package checks, over the courses that ``packages`` makes of the documents.

The questions of a conversation lie on the screens of the course of its number; the lexicon is the words that three or
more documents of a language use.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import packages as PK
from . import few_splits, table
from . import texts as TX
from .packages import _DRV, _GUESS, _OBJ, _PRED, _SCREENS
from .texts import LEXICON, LINES, TERMS
from ..operators import lexicon as L
from ..operators.stored import stored
from ..operators.text_checks import text_runs
from ..plans.package_report import Vocabulary, run_all_checks


def _report(spark, sf, english=True, dual=False):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    if few_splits(spark.read.parquet(f"{sf}/documents.parquet")):  # dealt over the cores once, not by each reader
        docs = stored(docs, "documents")
    screens = stored(PK.screens(spark, sf, docs), "course-screens")
    place = F.concat(F.lit("s"), (F.col("course_id") * 25 + F.col("ord") % 25).cast("string"))
    questions = stored(PK.questions(spark, sf).withColumn("question_id", F.col("slide_id")).withColumn("slide_id", place), "questions")
    customers = stored(PK.packages(spark, sf), "packages")
    said = docs.select(F.floor(F.col("doc_id") / 25).alias("course_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("slide_id"),
                       text_runs(F.col("text"), lang=F.col("lang")).alias("told"))
    words = stored(TX.lexicon(spark, sf, docs), "lexicon")
    upper = F.upper("word").alias("word")
    known = Vocabulary(lexicon=words, common=stored(L.most_used(words), "common-words"), always_spaced=words.filter("word = 'the'").select(upper), never_spaced=words.filter("lang = 'de'").select(upper),
                       terms=TERMS, prefixes=TX.HYPHEN_PREFIXES, suffixes=TX.HYPHEN_SUFFIXES, adjacent_only=TX.ADJACENT_ONLY, may_double=TX.DOUBLED_IGNORE)
    found = run_all_checks(customers, PK._overrides(spark, sf), screens, said, PK.objects(spark, sf, TX.rows(spark, sf, docs)), questions, english=english,
                           dual_path=dual, menu=PK.menu_items(spark, sf, screens), vocabulary=known)
    return found.groupBy("course_id", "check_id", "level").agg(F.count("*").alias("n"))


def q_report(spark, sf):
    return _report(spark, sf)


def q_report_dual(spark, sf):
    return _report(spark, sf, dual=True)


def q_report_other(spark, sf):
    """Courses that are not in English: no word lists of English, but what was left untranslated."""
    return _report(spark, sf, english=False)


QUERIES = {"package_findings": q_report, "package_findings_dual_path": q_report_dual, "package_findings_not_english": q_report_other}


def _sql(english: bool = True, dual: bool = False) -> str:
    """Counts per check and level from the SQL of each check, over the same courses."""
    limit = 2 if dual else 1
    T, P = TX.ORACLE, PK.ORACLE
    dashes = r"""UNION ALL SELECT doc_id, len(regexp_extract_all(c, '\s—\s?|—\s')) FROM r
          UNION ALL SELECT doc_id, len(regexp_extract_all(c, '--+')) + len(regexp_extract_all(c, '[A-Za-z] - [A-Za-z]')) FROM r""" if english else ""
    parts = [
        f"SELECT course_id, 'overview' AS check_id, 'info' AS level, 1 AS n FROM ({P['course_overview']})",
        f"SELECT course_id, 'paths', CASE topology WHEN 'none' THEN 'warn' ELSE 'info' END, 1 FROM ({P['path_topology']})",
        f"SELECT course_id, 'driver', level, 1 FROM (WITH {_DRV} SELECT * FROM drvf)",
        f"SELECT course_id, 'scoring', level, 1 FROM ({P['config_facts']})",
        f"SELECT course_id, 'speed_control', level, 1 FROM ({P['speed_control']})",
        f"SELECT course_id, 'option_order', 'warn', n FROM ({P['option_order']}) WHERE needs_check AND slide_id[2:]::INT % 4 <> 3",
        f"""SELECT course_id, 'duplicate_title', 'warn', 1 FROM (WITH {_SCREENS} SELECT course_id, scene_id, lower(trim(slide_title)) AS t FROM scr
          WHERE trim(slide_title) <> '' GROUP BY ALL HAVING count(*) > {limit})""",
        f"""SELECT course_id, 'duplicate_paragraph', 'warn', 1 FROM (WITH {LINES} SELECT doc_id // 25 AS course_id, value FROM lines WHERE length(value) >= 40
          GROUP BY ALL HAVING count(DISTINCT doc_id) > {limit})""",
        f"SELECT doc_id // 25, 'doubled_words', 'warn', 1 FROM ({T['doubled_words']})",
        f"SELECT doc_id // 25, 'spacing', 'warn', n FROM (WITH {LINES}, r AS (SELECT doc_id, value, " + TX._REMOVED.format(c="value") + r""" AS c FROM lines)
          SELECT doc_id, (regexp_matches(c, '(^|[^:]) {2,}') AND NOT regexp_matches(value, '^[A-Ha-h][.)]\s'))::INT AS n FROM r
          UNION ALL SELECT doc_id, len(regexp_extract_all(c, '[?!;,][A-Za-z]')) FROM r """ + dashes + ") WHERE n > 0",
        f"SELECT course_id, 'previous_button', level, 1 FROM (WITH {_SCREENS}, {_PRED} SELECT * FROM predf)",
        f"""SELECT course_id, 'menu_mismatch', 'warn', 1 FROM (WITH {_SCREENS}, m AS (SELECT course_id, min(ord) AS f FROM scr WHERE is_in_menu GROUP BY 1)
          SELECT s.course_id FROM m JOIN scr s ON s.course_id = m.course_id AND s.ord BETWEEN f AND f + 9 WHERE trim(slide_title) <> '')""",
    ]
    if english:
        terms = T["term_consistency"].replace("SELECT source, doc_id, text,", "SELECT doc_id // 25 AS source, doc_id, text,", 1)
        pairs = T["suspicious_hyphen_pairs"].replace("replace(text, ', ', '-')", "text").replace("FROM lexicon WHERE lang = 'en'", "FROM lexicon")
        parts += [
            f"SELECT DISTINCT source, 'terminology', 'warn', 1, term FROM ({terms})",
            f"SELECT DISTINCT doc_id // 25, 'spelling', 'warn', 1, word FROM ({T['unknown_words']})",
            f"SELECT DISTINCT doc_id // 25, 'hyphen_pair', 'warn', 1, token FROM ({pairs})",
        ]
    else:
        parts.append(f"SELECT doc_id // 25, 'untranslated', 'warn', 1 FROM ({T['untranslated']})")
    if dual:
        scope = f"""WITH {_SCREENS} SELECT slide_id, course_id FROM scr WHERE path = 'Accessible'
          OR course_id NOT IN (SELECT course_id FROM scr WHERE path = 'Accessible')"""
        seen = r"""SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}'))) AS word
          FROM documents"""
        parts += [
            f"""SELECT DISTINCT course_id, 'accessible_path', 'fail', 1, 'x' FROM (WITH {_SCREENS} SELECT course_id FROM scr
              WHERE course_id NOT IN (SELECT course_id FROM scr WHERE path = 'Accessible'))""",
            f"SELECT course_id, 'tab_order', level, 1 FROM ({P['tab_findings']}) SEMI JOIN ({scope}) USING (slide_id)",
            f"SELECT course_id, 'tab_duplicates', 'warn', 1 FROM ({P['tab_duplicates']}) SEMI JOIN ({scope}) USING (slide_id)",
            f"SELECT course_id, 'reading_order', 'warn', 1 FROM ({P['reading_order_jumps']}) SEMI JOIN ({scope}) USING (slide_id)",
            f"SELECT course_id, 'titles', 'warn', 1 FROM (WITH {_GUESS} SELECT * FROM guess) SEMI JOIN ({scope}) USING (slide_id) WHERE on_screen_title IS NOT NULL",
            f"""SELECT DISTINCT course_id, 'radio_guidance', 'warn', 1, slide_id FROM (WITH {LINES}, t AS (
                SELECT 's' || doc_id AS slide_id, string_agg(value, ' ' ORDER BY ord) AS said FROM lines GROUP BY doc_id)
              SELECT conv_id AS course_id, slide_id, said FROM conversations JOIN t ON slide_id = 's' || (conv_id * 25 + turn % 25)
              WHERE turn % 4 <> 3 AND role IN ('system', 'user')) SEMI JOIN ({scope}) USING (slide_id)
              WHERE NOT (regexp_matches(said, '(?i)\\btab\\b') AND regexp_matches(said, '(?i)\\b(arrow|select|selects|move|moving|key|keys|choice|choices|option|options|answer|answers)\\b'))""",
            f"""SELECT DISTINCT doc_id // 25, 'acronym', 'warn', 1, word FROM (WITH {LEXICON}, seen AS ({seen}) SELECT doc_id, word, 's' || doc_id AS slide_id FROM seen
              WHERE word = 'THE' AND word IN (SELECT upper(word) FROM lexicon) OR word NOT IN (SELECT upper(word) FROM lexicon)) SEMI JOIN ({scope}) USING (slide_id)""",
        ]
    told = " UNION ALL ".join(f"SELECT * FROM ({p}) AS f(course_id, check_id, level, n" + (", x)" if "DISTINCT" in p[:15] else ")")
                              if "DISTINCT" not in p[:15] else f"SELECT course_id, check_id, level, n FROM ({p}) AS f(course_id, check_id, level, n, x)" for p in parts)
    return f"SELECT course_id, check_id, level, sum(n)::BIGINT AS n FROM ({told}) GROUP BY ALL"


ORACLE = {"package_findings": _sql(), "package_findings_dual_path": _sql(dual=True), "package_findings_not_english": _sql(english=False)}

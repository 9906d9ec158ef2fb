"""Text checks over ``documents``: a source is a scene, a document a screen,
its first line the screen's title and every line a paragraph."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table
from ..functions import text as T
from ..operators import lexicon as L
from ..operators import text_checks as C

# Own sample vocabulary, written for the test tables.
ADJACENT_ONLY = ["the", "de", "la", "der", "que"]
DOUBLED_IGNORE = ["en", "an"]
TERMS = {"that": ["That"], "with": ["With"], "of the": ["Of the"], "avec": ["Avec"], "nicht": ["Nicht"]}
HYPHEN_PREFIXES = ["re", "co"]
HYPHEN_SUFFIXES = ["based", "like"]

LINES = """lines AS (
  SELECT doc_id, lang, source, ord - 1 AS ord, trim(value) AS value
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS value,
               generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)
  WHERE trim(value) <> '')"""
TITLES = LINES + """, titles AS (
  SELECT doc_id, any_value(source) AS source, arg_min(value, ord) AS title FROM lines GROUP BY doc_id)"""
# Links, addresses and the like blanked, in the order the library blanks them.
BLANKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
  '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}', ' ', 'gi'), 'https?://[^\s]+|www\.[^\s]+', ' ', 'gi'),
  '//[^\s]+', ' ', 'g'), '%[\p{{L}}\p{{N}}_]+%', ' ', 'g'), '[^\s]*_player\.[^\s]*', ' ', 'g')"""
WORDS = "regexp_extract_all(" + BLANKED + ", '[a-zA-Z]{{{n},}}')"
LEXICON = """lexicon AS (
  SELECT lang, word FROM (SELECT DISTINCT doc_id, lang, unnest(list_transform(""" + WORDS.format(
    c="text", n=3) + """, lambda w: lower(w))) AS word FROM documents) GROUP BY lang, word HAVING count(*) >= 3)"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def rows(spark, sf, told=None):
    """Lines of all documents, or of those ``told``."""
    return C.text_rows((docs(spark, sf) if told is None else told).select("doc_id", "lang", "source", "text"))


def titles(spark, sf, told=None):
    return C.first_title(rows(spark, sf, told), ["doc_id", "source"]).withColumnRenamed("value", "title")


def lexicon(spark, sf, told=None):
    return L.lexicon_from_texts(docs(spark, sf) if told is None else told, "lang", "doc_id", "text", 3)


def q_duplicate_titles(spark, sf):
    return C.duplicate_titles(titles(spark, sf), ["source"], "doc_id", "title")


def q_duplicate_title_screens(spark, sf):
    return C.duplicate_title_screens(titles(spark, sf), ["source"], "doc_id", "title")


def q_duplicate_paragraphs(spark, sf):
    return C.duplicate_paragraphs(rows(spark, sf), ["source"], "doc_id")


def q_duplicate_paragraphs_dual(spark, sf):
    return C.duplicate_paragraphs(rows(spark, sf).withColumn("scope", F.lit("all")), ["scope"],
                                  "doc_id", threshold=2, exempt=[r"^The ", r"(?i)estion"])


def q_duplicate_paragraphs_shown(spark, sf):
    dup = q_duplicate_paragraphs(spark, sf)
    return C.show_first_n(dup, ["source"], [F.desc("n_screens"), F.col("value")], 3,
                          ["value", "n_screens"])


def q_doubled_words(spark, sf):
    return C.doubled_words(docs(spark, sf), ["doc_id", "source"], "text", ADJACENT_ONLY, DOUBLED_IGNORE)


def q_spacing_findings(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("html", "<[^>]+>", " ").alias("value"))
    return (C.spacing_findings(pages, ["page_id"]).groupBy("page_id", "kind")
            .agg(F.count("*").alias("n")))


def q_text_search(spark, sf):
    return C.text_search(rows(spark, sf), ["doc_id", "ord"], "THAT.", "value")


def q_text_search_whole_word(spark, sf):
    return C.text_search(rows(spark, sf), ["doc_id", "ord"], "avec", "value", whole_word=True)


def q_term_consistency(spark, sf):
    return C.term_consistency(docs(spark, sf), ["source"], "doc_id", "text", TERMS)


def q_unknown_words(spark, sf):
    screens = docs(spark, sf).select("doc_id", T.lines(F.col("text")).alias("runs"))
    return L.unknown_words(L.candidate_words(screens, ["doc_id"], "runs"),
                           lexicon(spark, sf).select("word"))


def q_unknown_word_report(spark, sf):
    return L.unknown_word_report(q_unknown_words(spark, sf), "doc_id")


def q_untranslated(spark, sf):
    return L.untranslated(rows(spark, sf), ["doc_id", "ord"], "lang", "value", lexicon(spark, sf))


def q_acronym_report(spark, sf):
    screens = docs(spark, sf).select("doc_id", F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("text"))
    words = lexicon(spark, sf)
    flag = words.filter("word = 'the'").select(F.upper("word").alias("word"))
    skip = words.filter("lang = 'de'").select(F.upper("word").alias("word"))
    return L.acronym_report(screens, "doc_id", "text", words.filter("lang <> 'de'"), flag, skip)


def q_hyphen_pairs(spark, sf):
    joined = docs(spark, sf).select("doc_id", F.regexp_replace("text", ", ", "-").alias("value"))
    words = lexicon(spark, sf)
    return (L.suspicious_hyphen_pairs(joined, ["doc_id"], "value", words.filter("lang = 'en'"),
                                      words.filter("lang = 'none'"), HYPHEN_PREFIXES, HYPHEN_SUFFIXES)
            .groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.max("n_uses").alias("n_uses")))


def q_lexicon(spark, sf):
    return lexicon(spark, sf)


QUERIES = {
    "duplicate_titles": q_duplicate_titles,
    "duplicate_title_screens": q_duplicate_title_screens,
    "duplicate_paragraphs": q_duplicate_paragraphs,
    "duplicate_paragraphs_dual": q_duplicate_paragraphs_dual,
    "duplicate_paragraphs_shown": q_duplicate_paragraphs_shown,
    "doubled_words": q_doubled_words,
    "spacing_findings": q_spacing_findings,
    "text_search": q_text_search,
    "text_search_whole_word": q_text_search_whole_word,
    "term_consistency": q_term_consistency,
    "lexicon_from_texts": q_lexicon,
    "unknown_words": q_unknown_words,
    "unknown_word_report": q_unknown_word_report,
    "untranslated": q_untranslated,
    "acronym_report": q_acronym_report,
    "suspicious_hyphen_pairs": q_hyphen_pairs,
}

_DUP = LINES + """, dup AS (
  SELECT source, value, count(DISTINCT doc_id) AS n_screens, count(*) AS n_uses, min(doc_id) AS first_screen
  FROM lines WHERE length(value) >= 40 GROUP BY source, value HAVING count(DISTINCT doc_id) > 1)"""
_TITLE_KEYS = TITLES + """, keyed AS (SELECT *, lower(title) AS title_key FROM titles)"""
_FORMS = [(t, f) for t, vs in TERMS.items() for f in (t, *vs)]
_TERMS_SQL = "WITH forms(term, form) AS (VALUES " + ", ".join(
    f"('{t}', '{f}')" for t, f in _FORMS) + r"""),
toks AS (SELECT source, doc_id, text,
   list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM documents),
counted AS (
  SELECT source, doc_id, term, form,
    CASE WHEN contains(form, ' ')
      THEN len(regexp_extract_all(' ' || regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ',
               '[^\p{L}\p{N}_]' || replace(form, ' ', '  ') || '[^\p{L}\p{N}_]'))
      ELSE len(list_filter(t, lambda x: x = form)) END AS total,
    CASE WHEN form <> lower(form)
      THEN len(list_filter(regexp_extract_all(text, '(?:^|[.!?:;]\s|\n)\s*([\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+)?)', 1),
               lambda x: x = form OR starts_with(x, form || ' '))) ELSE 0 END AS opening
  FROM toks, forms),
uses AS (
  SELECT source, doc_id, term, form FROM counted WHERE total - opening > 0
  UNION SELECT source, doc_id, term, lower(form) FROM counted WHERE opening > 0),
per AS (SELECT source, term, form, count(*) AS n_screens,
   array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), '; ') AS first_screens FROM uses GROUP BY ALL)
SELECT p.*, n_forms FROM per p JOIN (SELECT source, term, count(*) AS n_forms FROM per GROUP BY ALL HAVING count(*) > 1)
USING (source, term)"""
_CAND = LEXICON + ", cand AS (SELECT doc_id, unnest(list_intersect(list_distinct(list_transform(list_filter(" \
    + WORDS.format(c="replace(text, chr(10), ' ')", n=3) \
    + ", lambda w: upper(w) <> w AND length(w) < 15), lambda w: lower(w))), list_transform(" \
    + WORDS.format(c="replace(text, chr(10), '')", n=3) + ", lambda w: lower(w)))) AS word FROM documents)" \
    + ", unknown AS (SELECT * FROM cand WHERE word NOT IN (SELECT word FROM lexicon))"
_PARTS = r"""WITH p AS (SELECT doc_id, source,
    list_transform(regexp_extract_all(replace(text, chr(10), ' '), '([\p{L}\p{M}\p{N}_]+)([^\p{L}\p{M}\p{N}_]*)', 1), lambda x: lower(x)) AS w,
    list_transform(regexp_extract_all(replace(text, chr(10), ' '), '([\p{L}\p{M}\p{N}_]+)([^\p{L}\p{M}\p{N}_]*)', 2),
      lambda x: regexp_full_match(x, '\s+')) AS g FROM documents),
  s AS (SELECT doc_id, source, w, g, list_reduce(list_transform(range(1, len(w) + 1), lambda i: {'i': i, 'nxt': 0::BIGINT, 'hits': []::VARCHAR[]}),
      lambda a, e: CASE
        WHEN e.i < a.nxt OR length(w[e.i]) < 2 OR NOT g[e.i] THEN {'i': e.i, 'nxt': a.nxt, 'hits': a.hits}
        WHEN coalesce(g[e.i + 1] AND w[e.i + 2] = w[e.i], false) THEN {'i': e.i, 'nxt': e.i + 3, 'hits': list_append(a.hits, w[e.i])}
        WHEN coalesce(w[e.i + 1] = w[e.i], false) THEN {'i': e.i, 'nxt': e.i + 2, 'hits': list_append(a.hits, w[e.i])}
        ELSE {'i': e.i, 'nxt': a.nxt, 'hits': a.hits} END,
      {'i': 0::BIGINT, 'nxt': 0::BIGINT, 'hits': []::VARCHAR[]}).hits AS near,
    list_filter(range(1, len(w)), lambda i: g[i] AND w[i] = w[i + 1]) AS pairs FROM p),
  h AS (SELECT doc_id, source, list_sort(list_distinct(list_filter(list_concat(
      list_filter(near, lambda x: NOT list_contains({adj}, x)),
      list_filter(list_transform(pairs, lambda i: w[i]), lambda x: list_contains({adj}, x))),
      lambda x: NOT list_contains({ign}, x)))) AS hits FROM s)
  SELECT doc_id, source, len(hits) AS n_words, array_to_string(hits, ', ') AS words FROM h WHERE len(hits) > 0"""
_REMOVED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
  '\s?(?:[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}})\s?', ' ', 'gi'), '\s?(?:https?://[^\s]+|www\.[^\s]+)\s?', ' ', 'gi'),
  '\s?//[^\s]+\s?', ' ', 'g'), '\s?[^\s]*_player\.[^\s]*\s?', ' ', 'g')"""
ORACLE = {
    "duplicate_titles": f"""WITH {_TITLE_KEYS}
      SELECT source, title_key, arg_min(title, doc_id) AS title, count(*) AS n_screens,
        array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ', ') AS first_screens
      FROM keyed GROUP BY source, title_key HAVING count(*) > 1""",
    "duplicate_title_screens": f"""WITH {_TITLE_KEYS}
      SELECT source, title_key, doc_id, n_screens FROM (SELECT *, count(*) OVER (PARTITION BY source, title_key) AS n_screens
      FROM keyed) WHERE n_screens > 1""",
    "duplicate_paragraphs": f"WITH {_DUP} SELECT * FROM dup",
    "duplicate_paragraphs_dual": f"""WITH {LINES}
      SELECT 'all' AS scope, value, count(DISTINCT doc_id) AS n_screens, count(*) AS n_uses, min(doc_id) AS first_screen
      FROM lines WHERE length(value) >= 40 AND NOT starts_with(value, 'The ') AND NOT contains(lower(value), 'estion')
      GROUP BY value HAVING count(DISTINCT doc_id) > 2""",
    "duplicate_paragraphs_shown": f"""WITH {_DUP}, r AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_screens DESC, value) AS rank_no FROM dup)
      SELECT source, rank_no, value, n_screens, 0 AS n_more FROM r WHERE rank_no <= 3
      UNION ALL SELECT source, 4, NULL, NULL, count(*) - 3 FROM dup GROUP BY source HAVING count(*) > 3""",
    "text_search": f"""WITH {LINES} SELECT doc_id, ord, substr(value, 1, 200) AS excerpt,
      len(regexp_extract_all(lower(value), 'that\\.')) AS n_hits FROM lines WHERE contains(lower(value), 'that.')""",
    "text_search_whole_word": f"""WITH {LINES}, t AS (SELECT *, len(list_filter(regexp_split_to_array(lower(value),
      '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x = 'avec')) AS n_hits FROM lines)
      SELECT doc_id, ord, substr(value, 1, 200) AS excerpt, n_hits FROM t WHERE n_hits > 0""",
    "term_consistency": _TERMS_SQL,
    "lexicon_from_texts": """WITH w AS (SELECT DISTINCT doc_id, lang, unnest(list_transform(""" + WORDS.format(
        c="text", n=3) + """, lambda w: lower(w))) AS word FROM documents)
      SELECT lang, word, count(*) AS n_docs FROM w GROUP BY lang, word HAVING count(*) >= 3""",
    "unknown_words": f"WITH {_CAND} SELECT * FROM unknown",
    "unknown_word_report": f"""WITH {_CAND} SELECT word, count(*) AS n_screens,
      array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), '; ') AS first_screens FROM unknown GROUP BY word""",
    "untranslated": f"WITH {LINES}, {LEXICON}" + """, e AS (SELECT doc_id, ord, lang, list_transform(""" + WORDS.format(
        c="value", n=2) + """, lambda w: lower(w)) AS ws FROM lines WHERE lang <> 'en'),
      u AS (SELECT doc_id, ord, lang, unnest(ws) AS word FROM e WHERE len(ws) >= 3)
      SELECT doc_id, ord, lang, count(*) AS n_words, count(DISTINCT word) AS n_distinct, min(word) AS first_word FROM u
      WHERE word IN (SELECT word FROM lexicon WHERE lang = 'en')
        AND NOT EXISTS (SELECT 1 FROM lexicon x WHERE x.lang = u.lang AND x.word = u.word)
      GROUP BY ALL HAVING count(*) >= 3""",
    "acronym_report": f"WITH {LEXICON}" + r""", seen AS (SELECT DISTINCT doc_id, unnest(list_filter(
        regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '[^\p{L}\p{M}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}'))) AS word FROM documents)
      SELECT word, trim(regexp_replace(word, '(.)', '\1 ', 'g')) AS suggested, count(*) AS n_screens,
        array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), '; ') AS first_screens
      FROM seen WHERE word = 'THE' OR (word NOT IN (SELECT upper(word) FROM lexicon WHERE lang = 'de')
        AND word NOT IN (SELECT upper(word) FROM lexicon WHERE lang <> 'de')) GROUP BY word""",
    "doubled_words": _PARTS.replace("{adj}", str(ADJACENT_ONLY)).replace("{ign}", str(DOUBLED_IGNORE)),
    "suspicious_hyphen_pairs": f"WITH {LEXICON}" + r""", u AS (SELECT doc_id, lower(unnest(regexp_extract_all(
        regexp_replace(""" + _REMOVED.format(c="replace(text, ', ', '-')") + r""", '[\p{L}\p{M}\p{N}_]*[0-9_\x{00C0}-\x{024F}\p{M}][\p{L}\p{M}\p{N}_]*', '#', 'g'),
        '[A-Za-z]+(?:-[A-Za-z]+)+'))) AS token FROM documents),
      t AS (SELECT token, count(*) AS n_uses, string_split(token, '-') AS parts FROM u GROUP BY token),
      lx AS (SELECT list(word) AS known FROM lexicon WHERE lang = 'en'),
      bad AS (SELECT token, n_uses FROM t, lx WHERE NOT list_contains(['re', 'co'], parts[1]) AND NOT list_contains(['based', 'like'], parts[-1])
        AND NOT (len(list_filter(parts, lambda x: length(x) >= 2)) > 0 AND len(list_filter(parts, lambda x: length(x) >= 2
          AND NOT list_contains(known, x))) = 0))
      SELECT doc_id, token, count(*) AS n, max(n_uses) AS n_uses FROM u JOIN bad USING (token) GROUP BY doc_id, token""",
    "spacing_findings": r"""WITH v AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS value FROM pages),
      r AS (SELECT page_id, value, """ + _REMOVED.format(c="value") + r""" AS c FROM v),
      k AS (SELECT page_id, 'extra_space' AS kind, (regexp_matches(c, '(^|[^:]) {2,}') AND NOT regexp_matches(value, '^[A-Ha-h][.)]\s'))::INT AS n FROM r
        UNION ALL SELECT page_id, 'missing_space', len(regexp_extract_all(c, '[?!;,][A-Za-z]')) FROM r
        UNION ALL SELECT page_id, 'spaced_em_dash', len(regexp_extract_all(c, '\s—\s?|—\s')) FROM r
        UNION ALL SELECT page_id, 'hyphen_as_dash', len(regexp_extract_all(c, '--+')) + len(regexp_extract_all(c, '[A-Za-z] - [A-Za-z]')) FROM r)
      SELECT page_id, kind, n FROM k WHERE n > 0""",
}

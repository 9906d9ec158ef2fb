"""Text normalisation and text-hygiene predicates as Column expressions.

Java regular expressions treat ``\\w`` and ``\\b`` as ASCII unless ``(?U)`` is
set; every pattern that meets prose sets it, so accented words stay whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token shapes shared by the text checks.
URL = r"https?://\S+|www\.\S+"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
            ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'))


# What cleaning changes in a line and in a text of several: anything else stays as it is.
UNCLEAN = r"(?U)[\u200b\ufeff]|[^\S ]|  |^ | \z"
UNCLEAN_LINES = r"(?U)[\u200b\ufeff\x1c-\x1e]|[^\S\n ]| [ \n]|\n |^ |[ \n]\z"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def clean_text(c: Column) -> Column:
    """Zero-width characters dropped, every run of whitespace one space, trimmed."""
    visible = F.regexp_replace(c, r"[\u200b\ufeff]", "")
    spaced = F.trim(F.regexp_replace(visible, r"(?U)[\s\u00a0]+", " "))
    return F.when(~c.rlike(UNCLEAN), c).otherwise(spaced)


def lines(c: Column) -> Column:
    """Text lines without a trailing empty one, as ``array<string>``."""
    parts = F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    return F.when(F.length(c) > 0, parts).otherwise(empty_strings())


def clean_lines(c: Column) -> Column:
    """``clean_text`` of each line, joined again; the line breaks that end a text go."""
    t = F.regexp_replace(F.regexp_replace(c, f"(?:{LINE_BREAK})$", ""), LINE_BREAK, "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[\u200b\ufeff]", ""), r"(?U)[^\S\n]+", " ")
    cleaned = F.coalesce(F.trim(F.regexp_replace(t, " ?\n ?", "\n")), F.lit(""))
    return F.when(~c.rlike(UNCLEAN_LINES), c).otherwise(cleaned)


def normalise_title(c: Column) -> Column:
    """Case and spacing folded, sentence punctuation treated as spacing."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)[\\s?.!…]+", " ")))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def spaced_key(c: Column) -> Column:
    """Lower-case words separated by single spaces, punctuation gone."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def capitals_key(c: Column) -> Column:
    """Only the capital letters: spelling variants of one SKU share it."""
    return F.regexp_replace(c, "[^A-Z]", "")


def names_overlap(a: Column, b: Column) -> Column:
    """One name, folded, contains the other; false when either is empty."""
    ka, kb = spaced_key(a), spaced_key(b)
    return (ka != "") & (kb != "") & (F.contains(ka, kb) | F.contains(kb, ka))


def strip_html(c: Column) -> Column:
    bare = F.regexp_replace(c, "<[^>]+>", "")
    for entity, plain in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return F.trim(bare)


def unescape_entities(c: Column) -> Column:
    """Decimal and hexadecimal references plus the six named entities.

    ``&amp;`` is undone last so that an escaped entity is decoded once only.
    """
    pieces = F.split(c, r"(?=&#[0-9]{1,6};)|(?<=&#[0-9]{1,6};)|"
                        r"(?=&#[xX][0-9a-fA-F]{1,5};)|(?<=&#[xX][0-9a-fA-F]{1,5};)")

    def decode(p: Column) -> Column:
        dec = F.regexp_extract(p, r"^&#([0-9]{1,6});$", 1)
        hexa = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,5});$", 1)
        code = (F.when(dec != "", dec.cast("int"))
                .when(hexa != "", F.conv(hexa, 16, 10).cast("int")))
        return F.when(code.isNotNull(), _code_point(code)).otherwise(p)

    out = F.array_join(F.transform(pieces, decode), "")
    for entity, plain in ENTITIES[1:]:
        out = F.replace(out, F.lit(entity), F.lit(plain if entity != "&nbsp;" else "\u00a0"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _code_point(code: Column) -> Column:
    """Character of a Unicode code point, through its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _has_link(c: Column, *marks: str) -> Column:
    """Whether a text holds a sign without which there is no address, link, token or one of ``marks``."""
    found = F.contains(F.lower(c), F.lit("www."))
    for mark in ("@", "//", "_player.", *marks):
        found = found | F.contains(c, F.lit(mark))
    return found


def remove_urls_emails(c: Column) -> Column:
    """Addresses, links and player tokens replaced by one space each, taking up
    to one neighbouring space so that removal never creates a double space."""
    def removed(t: Column) -> Column:
        out = F.regexp_replace(t, rf"(?i)\s?(?:{EMAIL})\s?", " ")
        out = F.regexp_replace(out, rf"(?i)\s?(?:{URL})\s?", " ")
        out = F.regexp_replace(out, r"\s?//\S+\s?", " ")
        out = F.regexp_replace(out, r"\s?\S*_player\.\S*\s?", " ")
        return F.when(~_has_link(t), t).otherwise(out)

    return bound(c, removed)


def blank_urls_emails(c: Column) -> Column:
    """As above, plus variable references, without absorbing neighbours; used
    before words are taken from the text."""
    def blanked(t: Column) -> Column:
        out = F.regexp_replace(t, f"(?i){EMAIL}", " ")
        out = F.regexp_replace(out, f"(?i){URL}", " ")
        out = F.regexp_replace(out, r"//\S+", " ")
        out = F.regexp_replace(out, r"(?U)%\w+%", " ")
        out = F.regexp_replace(out, r"\S*_player\.\S*", " ")
        return F.when(~_has_link(t, "%"), t).otherwise(out)

    return bound(c, blanked)


def has_extra_spaces(c: Column, bare: Column | None = None) -> Column:
    """Two or more spaces not after a colon, outside lettered answer options.

    ``bare`` is, here and below, the text without links where it is at hand."""
    option = c.rlike(r"^[A-Ha-h][.)]\s")
    return ~option & (remove_urls_emails(c) if bare is None else bare).rlike(r"(?<!:) {2,}")


def _snippets(c: Column, pattern: str, around: int) -> Column:
    """Each match of ``pattern`` with up to ``around`` characters on both sides."""
    def beside(found: Column) -> Column:
        return bound(F.split(c, pattern), lambda gaps: F.transform(found, lambda m, i: F.concat(
            F.right(F.element_at(gaps, i + 1), F.lit(around)), m,
            F.left(F.element_at(gaps, i + 2), F.lit(around)))))

    return bound(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1),
                 lambda found: F.when(F.size(found) == 0, found).otherwise(beside(found)))


def missing_space_after_punct(c: Column, bare: Column | None = None) -> Column:
    """Snippets where ``? ! ; ,`` touches the next letter."""
    return _snippets(remove_urls_emails(c) if bare is None else bare, r"[?!;,][A-Za-z]", 15)


def spaced_em_dashes(c: Column, bare: Column | None = None) -> Column:
    return _snippets(remove_urls_emails(c) if bare is None else bare, r"(?<=\s)—|—(?=\s)", 20)


def hyphens_as_dash(c: Column, bare: Column | None = None) -> Column:
    """Doubled hyphens and single hyphens spaced between letters."""
    return _snippets(remove_urls_emails(c) if bare is None else bare, r"--+|(?<=[A-Za-z]) - (?=[A-Za-z])", 20)


def hyphen_pairs(c: Column) -> Column:
    """Unspaced hyphenated tokens, lower case, in order."""
    found = F.regexp_extract_all(remove_urls_emails(c),
                                 F.lit(r"(?U)(\b[A-Za-z]+(?:-[A-Za-z]+)+\b)"), 1)
    return F.when(~F.contains(c, F.lit("-")), empty_strings()).otherwise(F.transform(found, F.lower))


def doubled_words(c: Column, adjacent_only: Column, ignored: Column) -> Column:
    """Words said twice, lower case, sorted and distinct.

    Words of ``adjacent_only`` count only back to back; any other word of two
    or more characters also counts with one word between.
    """
    near = F.transform(F.regexp_extract_all(
        c, F.lit(r"(?iU)\b(\w{2,})\s+(?:\w+\s+)?\1\b"), 1), F.lower)
    touching = F.transform(F.regexp_extract_all(
        c, F.lit(r"(?iU)\b(\w+)\s+\1\b"), 1), F.lower)
    hits = F.array_union(
        F.array_except(near, adjacent_only), F.array_intersect(touching, adjacent_only))
    return F.sort_array(F.array_distinct(F.array_except(hits, ignored)))


def words(c: Column, minimum: int = 3) -> Column:
    """Plain alphabetic words in order, links and addresses removed first."""
    return F.regexp_extract_all(blank_urls_emails(c), F.lit(rf"([a-zA-Z]{{{minimum},}})"), 1)


def all_caps_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)(\b[A-Z]{2,}\b)"), 1)


def letter_spaced(word: Column) -> Column:
    return F.regexp_replace(word, "(?<=.)(?=.)", " ")


def quoted_pattern(term: str, whole_word: bool = False) -> str:
    """Case-insensitive literal pattern; a whole word has no word character on
    either side, so terms that start or end with punctuation still match."""
    literal = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?iU)(?<!\\w){literal}(?!\\w)" if whole_word else f"(?iu){literal}"


def language_base(code: Column) -> Column:
    """``de-DE``, ``de_DE`` and ``DE`` give ``de``; anything else null."""
    base = F.regexp_extract(F.trim(code), r"^([A-Za-z]{2})(?:[-_][A-Za-z]{2})?$", 1)
    return F.lower(F.nullif(base, F.lit("")))


def language_in_name(name: Column) -> Column:
    """First ``xx-YY`` pair that is not part of a longer run of letters."""
    pair = F.regexp_extract(name, r"(?<![A-Za-z])([A-Za-z]{2})[-_][A-Za-z]{2}(?![A-Za-z])", 1)
    return F.lower(F.nullif(pair, F.lit("")))


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs compare as numbers."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)

    def number(r: Column) -> Column:
        digits = F.regexp_replace(r, r"^0+(?=\d)", "")
        n = F.length(digits)
        # Longer runs sort behind all of up to 20 digits, by their length first.
        return F.when(n <= 20, F.lpad(digits, 20, "0")).otherwise(
            F.concat(F.lit(":"), F.lpad(n.cast("string"), 10, "0"), digits))

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(r)).otherwise(r)), "\u0001")


def show_first(items: Column, n: int) -> Column:
    """First ``n`` items and the number left over, as one line."""
    more = F.size(items) - n
    shown = F.array_join(F.slice(items, 1, n), "; ")
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)

"""Column functions on headings, numbers and titles.

Every function takes and returns Columns and stays inside the JVM, except the two accent folds, which
need Unicode decomposition and run as Arrow-batched pandas UDFs. Regular expressions use (?U) where
Unicode white space or digits matter and (?d) so that a dot matches all but a newline.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: White space as Python's str.split() and \s see it: Java's Unicode class and U+001C to U+001F.
WS = r"[\s\x1C-\x1F]"

# Titles that only announce a table of contents, without accents.
TOC_TITLES = ["sommaire", "table des matieres", "table de matieres", "table of contents", "contents", "toc"]
TOC_HEADINGS = ["sommaire", "table des matieres", "table de matieres", "table of contents", "contents", "summary", "toc"]
TOC_KEYWORDS = ["sommaire", "table des matieres", "table de matieres", "table of contents"]
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _strip(c: Column, letters: str) -> Column:
    return _sub(c, f"(?U)^[{letters}]+|[{letters}]+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: nested expressions would repeat it each time it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


# F1-F3 -------------------------------------------------------------------------------------------


def clean_text(c: Column | str) -> Column:
    """One space for each run of white space, none at the ends; null gives ''."""
    return F.trim(_sub(F.coalesce(_c(c), F.lit("")), f"(?U){WS}+", " "))


normalize_space = clean_text


def normalize_key(c: Column | str) -> Column:
    return clean_text(F.replace(F.lower(clean_text(c)), F.lit("’"), F.lit("'")))


# F4-F5 -------------------------------------------------------------------------------------------


def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn"))


def _compat_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))


def _round_exactly(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


@lru_cache
def _udf(f, kind: str):
    """A pandas UDF needs a session for its type, so it is made at its first use."""
    return pandas_udf(f, kind)


def strip_accents(c: Column | str) -> Column:
    """Canonical decomposition without non-spacing marks."""
    return _udf(_without_marks, "string")(_c(c))


def fold_compat(c: Column | str) -> Column:
    """Compatibility decomposition without combining characters: a ligature becomes its letters."""
    return _udf(_compat_fold, "string")(_c(c))


# F6-F8 -------------------------------------------------------------------------------------------


def slugify(c: Column | str, fallback: Column | str = "section") -> Column:
    """a-z0-9 in runs joined by '-'; the fallback where nothing is left."""
    s = _sub(strip_accents(F.lower(clean_text(c))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(_sub(s, "^-+|-+$", ""), F.lit("")), fallback if isinstance(fallback, Column) else F.lit(fallback))


# F9-F11 ------------------------------------------------------------------------------------------


def roman_to_int(c: Column | str) -> Column:
    """Subtractive value from the right, any order of letters; null for anything else."""
    up = F.upper(_c(c))
    place = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("before"))
    fold = F.aggregate(
        F.reverse(F.split(up, "")),
        start,
        lambda acc, ch: F.struct((acc["total"] + F.when(place[ch] < acc["before"], -place[ch]).otherwise(place[ch])).alias("total"), place[ch].alias("before")),
        lambda acc: acc["total"],
    )
    return F.when(up.rlike("^[IVXLCDM]+$"), fold)


def detect_page_marker(c: Column | str) -> Column:
    """n of a text that is 'PAGE n' in any case, else null."""
    m = F.regexp_extract(clean_text(c), r"(?iU)^PAGE\s+(\d+)$", 1)
    return F.nullif(m, F.lit("")).cast("int")


# F12-F18 -----------------------------------------------------------------------------------------


def is_noise_title(c: Column | str) -> Column:
    def noise(t: Column) -> Column:
        return (
            (t == "")
            | t.isin(TOC_TITLES)
            | t.rlike(r"(?U)^page\s+\d+(\s+sur)?$")
            | t.rlike(r"(?U)^page\s+\d+\s+sur\s+\d+$")
            | t.contains("version")
            | t.contains("isbn")
            | t.contains("tous droits reserves")
            | t.rlike(r"(?U)^[\d\W_]+$")
        )

    return let(_strip(strip_accents(F.lower(clean_text(c))), r" :;.\-"), noise)


def clean_number_spacing(c: Column | str) -> Column:
    """'1 . T' and '1 .1 T' and '1. 1 T' with the number closed up; also inner ' . ' between digits."""
    t = clean_text(c)
    t = _sub(t, r"(?U)^(\d+)\s+\.\s+", "$1. ")
    t = _sub(t, r"(?U)^(\d+)\s+\.(\d+)", "$1.$2")
    t = _sub(t, r"(?U)^(\d+)\.\s+(\d+)", "$1.$2")
    t = _sub(t, r"(?U)(?<=\d)\s+\.\s+(?=\d)", ".")
    return clean_text(t)


def extract_number(c: Column | str) -> Column:
    """The decimal number (without a last dot) or roman numeral that a title starts with, else null."""

    def number(t: Column) -> Column:
        decimal = _sub(F.regexp_extract(t, r"(?Ud)^(\d+(?:\.\d+)*\.?)\s+.+$", 1), r"\.+$", "")
        roman = F.upper(F.regexp_extract(t, r"(?Uid)^([IVXLCDM]+)\s*[.\-:]\s+.+$", 1))
        return F.when(decimal != "", decimal).when(roman != "", roman)

    return let(clean_number_spacing(c), number)


def ensure_number_in_title(title: Column | str, number: Column | str) -> Column:
    both = F.struct(clean_number_spacing(title).alias("t"), _sub(clean_text(number), r"\.+$", "").alias("n"))

    def ensure(x: Column) -> Column:
        t, n = x["t"], x["n"]
        led = F.startswith(t, n) & F.substring(t, F.length(n) + 1, F.lit(1)).rlike(r"(?U)^[.\s\-:]")
        return F.when((n == "") | led, t).otherwise(F.concat(n, F.lit(". "), t))

    return let(both, ensure)


def page_contains_toc_keyword(c: Column | str) -> Column:
    t = strip_accents(F.lower(F.coalesce(_c(c), F.lit(""))))
    out = t.rlike(r"(?U)\bcontents\b")
    for k in TOC_KEYWORDS:
        out = out | t.contains(k)
    return out


def clean_toc_line(c: Column | str) -> Column:
    return clean_text(clean_number_spacing(_sub(clean_text(c), r"\.{2,}", " ")))


def parse_toc_line(c: Column | str, total_pages: Column) -> Column:
    """STRUCT(title, page, number) of a line 'title page', else null."""
    pattern = r"(?Ud)^(.+?)\s+(\d{1,4})$"
    parts = let(clean_toc_line(c), lambda line: F.struct(F.regexp_extract(line, pattern, 1).alias("title"), F.regexp_extract(line, pattern, 2).try_cast("int").alias("page")))
    entry = let(parts, lambda x: F.struct(clean_number_spacing(x["title"]).alias("title"), x["page"].alias("page")))
    noise = is_noise_title(parts["title"])
    full = let(
        F.struct(entry["title"].alias("title"), entry["page"].alias("page"), noise.alias("noise"), total_pages.alias("total")),
        lambda x: F.when(x["page"].between(1, x["total"]) & ~x["noise"], let(F.struct(x["title"].alias("title"), x["page"].alias("page"), extract_number(x["title"]).alias("number")), lambda y: F.struct(ensure_number_in_title(y["title"], y["number"]).alias("title"), y["page"].alias("page"), y["number"].alias("number")))),
    )
    return full


# F19-F24 -----------------------------------------------------------------------------------------


def is_image_placeholder(c: Column | str) -> Column:
    return F.lower(_c(c)).rlike(r"(?U)^img-\d+\.(jpeg|jpg|png|webp)$")


def is_page_number_noise(c: Column | str) -> Column:
    return F.lower(clean_text(c)).rlike(r"(?U)^(page\s+\d+(\s+sur\s+\d+)?|\d+)$")


def is_repeated_footer(c: Column | str) -> Column:
    t = F.lower(clean_text(c))
    return t.contains("isbn") | strip_accents(t).contains("tous droits reserves") | (t.contains("version") & t.rlike(r"(?U)\d{4}|\d+\.\d+"))


def heading_info(c: Column | str) -> Column:
    """STRUCT(kind, page, number, numbering_type, title, clean_title, depth, roman_index), null where a text is no explicit heading."""
    return let(clean_text(c), _heading_info)


def _heading_info(t: Column) -> Column:
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def info(kind, page, number, numbering, clean, depth, roman):
        return F.struct(F.lit(kind).alias("kind"), page.alias("page"), number.alias("number"), numbering.alias("numbering_type"), (none_s if kind == "page_marker" else t).alias("title"), clean.alias("clean_title"), depth.alias("depth"), roman.alias("roman_index"))

    decimal, roman, bullet = r"(?Ud)^(\d+(?:\.\d+)*\.?)\s+(.+)$", r"(?Uid)^([IVXLCDM]+)\s*[.\-:]\s+(.+)$", r"(?Ud)^-\s+(.+)$"
    get = lambda p, k: F.regexp_extract(t, p, k)
    n = _sub(get(decimal, 1), r"\.+$", "")
    page = detect_page_marker(t)
    return (
        F.when(page.isNotNull(), info("page_marker", page, none_s, none_s, none_s, none_i, none_i))
        .when(is_image_placeholder(t), F.lit(None))
        .when(t.rlike(decimal), info("heading", none_i, n, F.lit("decimal"), clean_text(get(decimal, 2)), F.size(F.split(n, r"\.")), none_i))
        .when(t.rlike(roman), info("heading", none_i, F.upper(get(roman, 1)), F.lit("roman"), clean_text(get(roman, 2)), F.lit(1), roman_to_int(get(roman, 1))))
        .when(t.rlike(bullet), info("heading", none_i, none_s, F.lit("bullet"), clean_text(get(bullet, 1)), F.lit(99), none_i))
    )


def is_generic_toc_heading(title: Column | str, number: Column | str) -> Column:
    return _c(number).isNull() & _strip(strip_accents(F.lower(clean_text(title))), " :;.").isin(TOC_HEADINGS)


def parent_decimal_number(c: Column | str) -> Column:
    """The number without its last part; null for a single part."""
    return F.nullif(F.regexp_extract(_c(c), r"^(.*)\.[^.]*$", 1), F.lit(""))


# F25-F32: three profiles of titles --------------------------------------------------------------------


def eval_normalize_title(c: Column | str) -> Column:
    t = fold_compat(F.coalesce(_c(c), F.lit("")))
    t = F.translate(t, "’‘`´–—", "''''--")
    t = clean_text(F.lower(t))
    t = _sub(t, r"(?U)\s*[-–—]+\s*", " - ")
    return clean_text(_sub(t, r"(?U)\s*[:;,.]+\s*$", ""))


def report_normalize_text(c: Column | str) -> Column:
    """As the evaluator's, but curly quotes and dashes stay and hyphens aren't spaced."""
    t = clean_text(F.lower(F.translate(fold_compat(F.coalesce(_c(c), F.lit(""))), "`", "'")))
    return clean_text(_sub(t, r"(?U)\s*[:;,.]+\s*$", ""))


def stability_normalize_title(c: Column | str) -> Column:
    return clean_text(F.replace(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("’"), F.lit("'")))


def figure_norm(c: Column | str) -> Column:
    return F.trim(_sub(F.translate(_sub(F.lower(F.coalesce(_c(c), F.lit(""))), f"(?U)^{WS}+|{WS}+$", ""), "’`", "''"), f"(?U){WS}+", " "))


LEADING = r"(?Uid)^\s*((?:\d+(?:\.\d+)*\.?)|(?:[ivxlcdm]+\.?))\s+(.*)$"


def _edges(c: Column | str) -> Column:
    return _sub(F.coalesce(_c(c), F.lit("")), f"(?U)^{WS}+|{WS}+$", "")


def leading_number(c: Column | str) -> Column:
    """STRUCT(number, body) of a title; number '' where none leads."""
    return let(_edges(c), _split_leading)


def _split_leading(raw: Column) -> Column:
    return F.when(raw.rlike(LEADING), F.struct(_edges(F.regexp_extract(raw, LEADING, 1)).alias("number"), _edges(F.regexp_extract(raw, LEADING, 2)).alias("body"))).otherwise(F.struct(F.lit("").alias("number"), raw.alias("body")))


def eval_visible_heading(title: Column | str, number: Column | str) -> Column:
    t, n = _edges(title), _edges(number)
    dotted = F.when(n.rlike(r"(?Ui)^(\d+(?:\.\d+)*|[ivxlcdm]+)$"), F.concat(n, F.lit("."))).otherwise(n)
    return F.when(t.rlike(LEADING) | (n == ""), t).otherwise(_edges(F.concat(dotted, F.lit(" "), t)))


def report_visible_heading(title: Column | str, number: Column | str) -> Column:
    t, n = _edges(title), _edges(number)
    return F.when(t.rlike(LEADING) | (n == ""), t).otherwise(_edges(F.concat(n, F.lit(" "), t)))


def eval_heading_full(title: Column | str, number: Column | str) -> Column:
    return eval_normalize_title(eval_visible_heading(title, number))


def eval_heading_text_only(title: Column | str, number: Column | str) -> Column:
    return eval_normalize_title(leading_number(eval_visible_heading(title, number))["body"])


def report_title(title: Column | str, number: Column | str) -> Column:
    return report_normalize_text(report_visible_heading(title, number))


# F33-F37 -----------------------------------------------------------------------------------------


def stable_id(prefix: Column | str, *parts: Column) -> Column:
    """prefix_ and 12 hex digits of SHA-1 over the cleaned parts; null parts are skipped, empty ones kept."""
    cleaned = [F.when(p.isNotNull(), clean_text(p)) for p in parts]
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(F.sha1(F.concat_ws("||", *cleaned)), 1, 12))


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def jaccard(both: Column, a: Column, b: Column) -> Column:
    """From the sizes of the intersection and of the two sets; 1 if both are empty."""
    return F.when(a + b == 0, 1.0).otherwise(safe_div(both, a + b - both))


def dice(both: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(safe_div(2 * both, a + b))


def py_round(x: Column, digits: Column) -> Column:
    """Rounding of the exact binary value, half to even; for report sinks only."""
    return _udf(_round_exactly, "double")(x, digits)


def mean_std(x: Column) -> tuple[Column, Column]:
    """Mean and population deviation from integer sums; null without rows."""
    n, s, q = F.count(x), F.sum(x.cast("long")), F.sum((x * x).cast("long"))
    mean = F.try_divide(s.cast("double"), n.cast("double"))
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.try_divide((q * n - s * s).cast("double"), (n * n).cast("double"))))


# F38-F42 -----------------------------------------------------------------------------------------


def safe_id(c: Column | str) -> Column:
    return F.concat(F.lit("n_"), _sub(figure_norm(c), "[^a-z0-9_]+", "_"))


def wrap_label(c: Column | str, width: int = 26) -> Column:
    """Words in lines of at most ``width``, greedily; a first word that is longer leaves an empty first line."""
    words = F.filter(F.split(clean_text(c), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("open"))

    def step(acc, w):
        extra = F.length(w) + F.when(acc["open"], 1).otherwise(0)
        fits = acc["used"] + extra <= width
        text = F.when(fits, F.concat(acc["text"], F.when(acc["open"], " ").otherwise(""), w)).otherwise(F.concat(acc["text"], F.lit("\n"), w))
        return F.struct(text.alias("text"), F.when(fits, acc["used"] + extra).otherwise(F.length(w)).alias("used"), F.lit(True).alias("open"))

    return F.aggregate(words, start, step, lambda acc: acc["text"])


def section_kind(leaf: Column, depth: Column) -> Column:
    """KC for a leaf, MODULE for an inner section under the course, else UNIT."""
    return F.when(leaf, "KC").when(depth == 1, "MODULE").otherwise("UNIT")


def parse_toc_pages(c: Column | str) -> Column:
    """A comma list of page numbers as an array, null if there is none."""
    parts = F.filter(F.transform(F.split(_c(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(parts, lambda x: x.cast("int")))


# P4-P6 -------------------------------------------------------------------------------------------


def page_list(start: Column, end: Column) -> Column:
    return F.when(start <= end, F.sequence(start, end)).when(start.isNotNull(), F.array(start)).when(end.isNotNull(), F.array(end)).otherwise(F.array().cast("array<int>"))


def predicted_pages(evidence: Column, start: Column, end: Column, profile: str = "eval") -> Column:
    """Pages of a predicted node. ``report`` falls back to the range where a list of evidence has no integer; ``eval`` doesn't."""
    listed = F.array_sort(F.array_distinct(F.filter(evidence, lambda x: x.isNotNull())))
    span = F.when(start.isNotNull(), F.sequence(start, F.greatest(start, F.coalesce(end, start)))).otherwise(F.array().cast("array<int>"))
    has = F.coalesce(F.size(evidence) > 0, F.lit(False)) if profile == "eval" else F.coalesce(F.size(listed) > 0, F.lit(False))
    return F.when(has, listed).otherwise(span)

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


CASES = [
    (T.clean_text, "  a  b\x1c\n ", "a b"),
    (T.clean_text, None, ""),
    (T.normalize_key, "L’Axe  X", "l'axe x"),
    (T.strip_accents, "Éàç ﬁ Ł", "Eac ﬁ Ł"),
    (T.fold_compat, "ﬁ é", "fi e"),
    (T.slugify, "1. Principe général du fonctionnement", "1-principe-general-du-fonctionnement"),
    (T.slugify, "!!", "section"),
    (T.roman_to_int, "xiv", 14),
    (T.roman_to_int, "IIX", 10),
    (T.roman_to_int, "A", None),
    (T.detect_page_marker, " page  12 ", 12),
    (T.detect_page_marker, "page 12 x", None),
    (T.is_noise_title, "Conversion", True),
    (T.is_noise_title, "Table des matières :", True),
    (T.is_noise_title, "Page 3 sur 9", True),
    (T.is_noise_title, "12 - 3", True),
    (T.is_noise_title, "Principe", False),
    (T.clean_number_spacing, "1 . Principe", "1. Principe"),
    (T.clean_number_spacing, "1 .1 Titre", "1.1 Titre"),
    (T.clean_number_spacing, "1. 1 Titre", "1.1 Titre"),
    (T.extract_number, "1.7.4. Synthèse", "1.7.4"),
    (T.extract_number, "I - Introduction", "I"),
    (T.extract_number, "Plain", None),
    (T.page_contains_toc_keyword, "x Table des matières", True),
    (T.page_contains_toc_keyword, "discontents", False),
    (T.is_image_placeholder, "IMG-3.png", True),
    (T.is_page_number_noise, "Page 3 sur 4", True),
    (T.is_repeated_footer, "Version 2.1", True),
    (T.is_repeated_footer, "Version finale", False),
    (T.parent_decimal_number, "1.2.3", "1.2"),
    (T.parent_decimal_number, "1", None),
    (T.eval_normalize_title, "L’axe sous-titre :", "l'axe sous - titre"),
    (T.report_normalize_text, "L’axe sous-titre :", "l’axe sous-titre"),
    (T.stability_normalize_title, " L’Été ", "l'été"),
    (T.safe_id, "A b-c", "n_a_b_c"),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES, ids=[f"{c[0].__name__}-{k}" for k, c in enumerate(CASES)])
def test_scalar(spark, f, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(f("v").alias("x")).first()["x"] == want


def test_structs(spark):
    assert tuple(one(spark, T.parse_toc_line("v", F.lit(40)), v="1.1 Notion de compétence .... 6")) == ("1.1 Notion de compétence", 6, "1.1")
    assert one(spark, T.parse_toc_line("v", F.lit(5)), v="Notion .... 6") is None
    assert tuple(one(spark, T.leading_number("v"), v="Civil engineering")) == ("Civil", "engineering")
    h = one(spark, T.heading_info("v"), v="IV: Titre  long")
    assert (h["number"], h["numbering_type"], h["clean_title"], h["depth"], h["roman_index"]) == ("IV", "roman", "Titre long", 1, 4)
    assert one(spark, T.heading_info("v"), v="img-2.png") is None
    assert one(spark, T.ensure_number_in_title("t", "n"), t="1 Foo", n="1") == "1 Foo"
    assert one(spark, T.ensure_number_in_title("t", "n"), t="Foo", n="2.") == "2. Foo"


def test_headings_diverge(spark):
    assert one(spark, T.eval_heading_full("t", "n"), t="Foo", n="1") == "1. foo"
    assert one(spark, T.report_title("t", "n"), t="Foo", n="1") == "1 foo"


def test_numbers(spark):
    r = spark.range(1).select(T.dice(F.lit(0), F.lit(0), F.lit(0)), T.dice(F.lit(0), F.lit(0), F.lit(3)), T.jaccard(F.lit(0), F.lit(0), F.lit(0)), T.py_round(F.lit(0.125), F.lit(2)), T.py_round(F.lit(2.675), F.lit(2))).first()
    assert tuple(r) == (1.0, 0.0, 1.0, 0.12, 2.67)
    assert one(spark, T.wrap_label("v", 5), v="abcdefg hi jk") == "\nabcdefg\nhi jk"
    assert one(spark, T.parse_toc_pages("v"), v="2, 3,") == [2, 3]
    assert one(spark, T.page_list(F.col("a"), F.col("b")), a=5, b=3) == [5]

import pytest
from pyspark.sql import functions as F

import lodestone as L
from lodestone.functions import kernels, text
from lodestone.functions.similarity import compare_components, date_components, parse_date


def one(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_own_nicknames(spark):
    assert one(spark, lambda c: text.normalize_name(c, {"zed": "zedekiah"}), "mr zed bill") == "Zedekiah Bill"
    assert one(spark, lambda c: text.normalize_name(c, {}), "bill") == "Bill"
    for short, name in (("robby", "Robert"), ("davey", "David"), ("gabe", "Gabriel"), ("rick", "Richard"), ("russ", "Russell")):
        assert one(spark, text.normalize_name, f"{short} smith") == f"{name} Smith"


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_phone, "1 (555) 123-4567", "5551234567"), (text.normalize_phone, None, ""), (text.normalize_phone, "555.123", "555123"),
        (text.normalize_address, "12 Main St., Apt 4", "12 main street apartment 4"), (text.normalize_email, "  A@B.Com ", "a@b.com"),
        (text.normalize_name, "Dr. Who", "Dr. Who"), (text.normalize_name, "mr bob o'brien jr", "Robert O'Brien"), (text.normalize_name, "mike", "Michael"),
        (text.normalize_name, "bill", "William"), (text.normalize_name, "jr", "Jr"), (text.normalize_name, "", ""), (text.normalize_name, "élise 3rd", "Élise 3Rd"),
        (text.normalize_string, " A   b\t", "a b"), (text.clean, "NaN", ""), (text.clean, None, ""),
    ],
)
def test_normal_forms(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (L.levenshtein_similarity, "kitten", "sitting", 1 - 3 / 7), (L.levenshtein_similarity, "", "", 1.0), (L.levenshtein_similarity, "a", None, 0.0),
        (L.levenshtein_similarity, "café", "cafe", 0.75), (L.jaro_winkler_similarity, "MARTHA", "MARHTA", 0.961111), (L.jaro_winkler_similarity, "", "", 1.0),
        (L.jaro_winkler_similarity, "abcxyz", "abcqrs", 0.666667), (L.token_set_ratio, "a b c", "c b", 1.0), (L.token_set_ratio, "", "x", 0.0),
        (L.token_set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0), (L.token_sort_ratio, "new york mets", "mets york new", 1.0),
        (L.numeric_similarity, "10", "9", 0.9), (L.numeric_similarity, "x", "9", 0.0), (L.numeric_similarity, "5", "5.0", 1.0), (L.numeric_similarity, "-1", "1", -1.0),
        (L.date_similarity, "1980-01-15", "01/15/1980", 1.0), (L.date_similarity, "1980-01-15", "15 Jan 1980", 1.0), (L.date_similarity, "2020-01-01", "2020-01-02", 1 / (1 + 1 / 365)),
        (L.date_similarity, "2019-12-31", "2020-01-01", 1 / (1 + 1 / 365 + 0.5)), (L.date_similarity, "", "2020-01-01", 0.0), (L.date_similarity, "soon", "soon", 1.0),
        (L.date_similarity, "born 1980-01-15", "1980-01-15", 1.0), (L.date_similarity, "13/01/1980", "1980-01-13", 1.0),
    ],
)
def test_similarities(spark, f, a, b, want):
    assert one(spark, f, a, b) == pytest.approx(want, abs=1e-6)


def test_lcs_against_the_table():
    import itertools

    for a, b in itertools.product(["", "abc", "abcbdab", "bdcaba", "aaaa"], repeat=2):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert kernels.lcs_length(a, b) == t[-1][-1]


def test_token_ratios_by_hand():
    assert kernels.token_set(["a x"], ["a y"])[0] == pytest.approx(max(1 - 2 / 6, 1 - 2 / 4))
    assert kernels.token_sort(["b a"], ["a c"])[0] == pytest.approx(2 * 2 / 6)


def test_lanes_equal_single_pairs():
    import random

    r = random.Random(5)
    text = lambda: "".join(r.choice("abcé\U0001f600 \0") for _ in range(r.choice((0, 1, 2, 5, 20, 63, 64, 65, 90))))
    a, b = [text() for _ in range(400)], [text() for _ in range(400)]
    a[:50] = b[:50]
    assert kernels.lcs_lengths(a, b).tolist() == [kernels.lcs_length(x, y) for x, y in zip(a, b, strict=True)]
    found = kernels._apart(a, b, kernels._jaro_lanes, kernels.jaro, float)
    assert found == pytest.approx([kernels.jaro(x, y) for x, y in zip(a, b, strict=True)], abs=1e-12)


def test_dates(spark):
    assert str(one(spark, parse_date, "January 5, 2020")) == "2020-01-05"
    assert one(spark, parse_date, "2020-02-30") is None
    parts = lambda x, y: one(spark, lambda a, b: compare_components(date_components(a), date_components(b)), x, y)
    assert one(spark, date_components, "born 1980-01-15!") == (1980, 1, 15) and one(spark, date_components, "02/31/1980") == (1980, 2, 31)
    assert one(spark, date_components, "soon") is None and one(spark, date_components, "31/12/1999") == (1999, 12, 31)
    assert parts("x 1980-01-15", "1980-01-15 y") == 1.0 and parts("soon", "1980-01-15") == 0.0
    assert parts("1980-01-15", "1980-01-16") == pytest.approx(max(0.8, 0.7 / (1 + 1 / 365)))
    assert parts("02/31/1980", "1980-02-10") == pytest.approx(0.5 * 0.8)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("1980-1-5", "1980-01-05"), ("01-15-1980", "1980-01-15"), ("15-01-1980", "1980-01-15"), ("1980/01/15", "1980-01-15"), ("1/2/1980", "1980-01-02"), ("13/2/1980", "1980-02-13"),
        ("1980.1.15", "1980-01-15"), ("1.15.1980", "1980-01-15"), ("15.1.1980", "1980-01-15"), ("19800115", "1980-01-15"), ("01151980", "1980-01-15"), ("15011980", "1980-01-15"),
        ("January 15, 1980", "1980-01-15"), ("15 january 1980", "1980-01-15"), ("JAN 15, 1980", "1980-01-15"), ("15 Jan 1980", "1980-01-15"), ("15-Jan-1980", "1980-01-15"),
        ("1980-Jan-15", "1980-01-15"), ("Jan-15-1980", "1980-01-15"), ("15/Jan/1980", "1980-01-15"), ("1980/jan/15", "1980-01-15"), ("jan/15/1980", "1980-01-15"), ("may 5, 2020", "2020-05-05"),
        ("1/5/80", "1980-01-05"), ("1-5-20", "2020-01-05"), ("25/12/68", "2068-12-25"), ("12/25/69", "1969-12-25"), ("May 2020", "2020-05-01"), ("Sep 2020", "2020-09-01"), ("september 2020", "2020-09-01"),
        ("1980-01-15 10:30", "1980-01-15"), ("1980-01-15T10:30:05.25", "1980-01-15"), ("1980-13-15", None), ("1980-02-30", None), ("sept 2020", None), ("15-january-1980", None), ("1980-01/15", None),
        ("jan-15/1980", None), ("15 foo 1980", None), ("198-1-15", None), ("soon", None), ("", None), (None, None), ("99999999", None),
    ],
)
def test_date_formats(spark, value, want):
    found = one(spark, parse_date, value)
    assert (str(found) if found else None) == want


def test_batch_and_sql_names(spark):
    assert L.batch_similarity("levenshtein", ["a", "ab"], ["a", "ac"]) == [1.0, 0.5]
    with pytest.raises(ValueError):
        L.batch_similarity("levenshtein", ["a"], [])
    L.register(spark)
    assert spark.sql("SELECT jaro_winkler_similarity('abc', 'abc')").first()[0] == 1.0

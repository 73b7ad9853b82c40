"""Similarity of two columns, by semantic type.  All return a double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.kernels import batched, jaro_winkler, token_set, token_sort

ALGORITHMS = ("levenshtein", "jaro_winkler", "token_set_ratio", "token_sort_ratio", "numeric_similarity", "date_similarity")

# The date formats that are tried, in order; M and d may have one digit or two.
DATE_FORMATS = (
    "yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "yyyy.M.d", "M.d.yyyy", "d.M.yyyy",
    "yyyyMMdd", "MMddyyyy", "ddMMyyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy",
    "d-MMM-yyyy", "yyyy-MMM-d", "MMM-d-yyyy", "d/MMM/yyyy", "yyyy/MMM/d", "MMM/d/yyyy",
    "M/d/yy", "M-d-yy", "d/M/yy", "d-M-yy", "MMMM yyyy", "MMM yyyy",
)
# Two-digit years from here on belong to the last century.
PIVOT_YEAR = 69
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    a, b = _text(a), _text(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return batched(jaro_winkler)(_text(a), _text(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    return batched(token_set)(_text(a), _text(b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return batched(token_sort)(_text(a), _text(b))


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 if equal, else 1 - |a - b| / max(|a|, |b|, 1); 0 for what is no number."""
    x, y = (c.try_cast("string").try_cast("double") for c in (a, b))
    apart = F.lit(1.0) - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return F.coalesce(F.when(x == y, F.lit(1.0)).otherwise(apart), F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is read there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, m, d).try_cast("date")


def _of_figures(p: Column, dotted: Column) -> Column:
    """A date of three figures in a row: the year first or last, months before days where both fit."""
    a, m, z = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
    short = F.concat(F.when(z.try_cast("int") >= PIVOT_YEAR, F.lit("19")).otherwise(F.lit("20")), z)
    return (
        F.when((F.length(a) == 4) & (F.length(z) <= 2), _iso(a, m, z))
        .when((F.length(a) <= 2) & (F.length(z) == 4), F.coalesce(_iso(z, a, m), _iso(z, m, a)))
        .when((F.length(a) <= 2) & (F.length(z) == 2) & ~dotted, F.coalesce(_iso(short, a, m), _iso(short, m, a)))
    )


def _of_name(s: Column) -> Column:
    """A date with the whole name of a month between spaces, or a short one between spaces, dashes or slashes."""
    known = F.array(*[F.lit(x) for x in MONTHS], *[F.lit(x[:3]) for x in MONTHS])

    def dated(at: Column) -> Column:
        number = (F.pmod(at - 1, F.lit(12)) + 1).cast("string")
        brief = (at > 12) | (at == 5)
        found = lambda pattern, y, d: F.when(s.rlike(pattern), _iso(F.regexp_extract(s, pattern, y), number, F.regexp_extract(s, pattern, d)))
        spaced = F.coalesce(found(r"^[a-z]+ (\d{1,2}), (\d{4})$", 2, 1), found(r"^(\d{1,2}) [a-z]+ (\d{4})$", 2, 1), F.when(s.rlike(r"^[a-z]+ \d{4}$"), _iso(F.right(s, F.lit(4)), number, F.lit("1"))))
        tied = F.coalesce(found(r"^(\d{1,2})([-/])[a-z]{3}\2(\d{4})$", 3, 1), found(r"^(\d{4})([-/])[a-z]{3}\2(\d{1,2})$", 1, 3), found(r"^[a-z]{3}([-/])(\d{1,2})\1(\d{4})$", 3, 2))
        return F.when(at > 0, F.coalesce(spaced, F.when(brief, tied)))

    return _let(F.array_position(known, F.regexp_extract(s, "([a-z]+)", 1)), dated)


def parse_date(c: Column) -> Column:
    """The first of DATE_FORMATS that reads the whole string; null if none does.

    Month names may be in any case, and a time of day is ignored.  A month and a
    year stand for the first day of the month.  A string is taken apart by its
    shape, and a date is made of the parts once.
    """

    def read(s: Column) -> Column:
        part = lambda at, n: F.substring(s, at, n)
        tight = F.coalesce(_iso(part(1, 4), part(5, 2), part(7, 2)), _iso(part(5, 4), part(1, 2), part(3, 2)), _iso(part(5, 4), part(3, 2), part(1, 2)))
        figures = _let(F.split(s, "[-/.]"), lambda p: _of_figures(p, s.contains(".")))
        return F.when(s.rlike(r"^\d{1,4}([-/.])\d{1,2}\1\d{1,4}$"), figures).when(s.rlike(r"^\d{8}$"), tight).when(s.rlike("[a-z]"), _of_name(s))

    low = F.lower(F.trim(_text(c)))
    return _let(F.when(low.contains(":"), F.regexp_replace(low, r"[t ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$", "")).otherwise(low), read)


def date_components(c: Column) -> Column:
    """Struct (y, m, d) found in a string; m and d may form no real date."""
    first, either, tight = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", r"(\d{4})(\d{2})(\d{2})"

    def read(s: Column) -> Column:
        def found(pattern: str, order: tuple[int, int, int], check: bool) -> Column:
            def tried(p: Column) -> Column:
                real = _iso(F.lpad(p["y"].cast("string"), 4, "0"), p["m"].cast("string"), p["d"].cast("string")).isNotNull()
                return F.when(p["m"].between(1, 12) & (p["d"].between(1, 31) & real if check else p["y"].isNotNull()), p)

            parts = F.struct(*[F.regexp_extract(s, pattern, k).try_cast("int").alias(n) for n, k in zip("ymd", order, strict=True)])
            return F.when(s.rlike(pattern), _let(parts, tried))

        return F.coalesce(found(first, (1, 2, 3), True), found(either, (3, 1, 2), True), found(either, (3, 2, 1), True), found(either, (3, 1, 2), False), found(tight, (1, 2, 3), True))

    return _let(F.trim(_text(c)), read)


def compare_components(a: Column, b: Column) -> Column:
    """Shares for an equal year, month and day; near days count too where both are real."""

    def compared(v: Column) -> Column:
        a, b = v["a"], v["b"]
        equal = lambda f, w: F.when(a[f] == b[f], F.lit(w)).otherwise(F.lit(0.0))
        parts = equal("y", 0.5) + equal("m", 0.3) + equal("d", 0.2)
        when = lambda x: _iso(F.lpad(x["y"].cast("string"), 4, "0"), x["m"].cast("string"), x["d"].cast("string"))
        days = F.abs(F.datediff(when(a), when(b)))
        same = (a["y"] == b["y"]) & (a["m"] == b["m"]) & (a["d"] == b["d"])
        near = F.greatest(parts, F.lit(0.7) / (F.lit(1.0) + days / F.lit(365.0)))
        return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(same, F.lit(1.0)).otherwise(F.coalesce(F.when(days.isNotNull(), near), parts * 0.5))

    return _let(F.struct(a.alias("a"), b.alias("b")), compared)


def date_similarity(a: Column, b: Column) -> Column:
    """1 for one day, falling with the distance; by components or letters where a side is no date."""

    def score(v: Column) -> Column:
        days = F.abs(F.datediff(v["x"], v["y"])) / F.lit(365.0)
        parsed = F.lit(1.0) / (F.lit(1.0) + days + F.lit(0.5) * F.abs(F.year(v["x"]) - F.year(v["y"])))
        bare = lambda c: F.regexp_replace(F.lower(c), r"[-/.\s]", "")
        letters = F.when(bare(v["a"]) == bare(v["b"]), F.lit(1.0)).otherwise(F.lit(0.5) * levenshtein_similarity(bare(v["a"]), bare(v["b"])))
        parts = _let(F.struct(date_components(v["a"]).alias("p"), date_components(v["b"]).alias("q")), lambda w: F.when(w["p"].isNotNull() & w["q"].isNotNull(), compare_components(w["p"], w["q"])))
        # only what is needed is computed: components of what is no date, letters of what has none
        return F.when((v["a"] == "") | (v["b"] == ""), F.lit(0.0)).otherwise(F.coalesce(parsed, parts, letters))

    x, y = F.trim(_text(a)), F.trim(_text(b))
    return _let(F.struct(x.alias("a"), y.alias("b"), parse_date(x).alias("x"), parse_date(y).alias("y")), score)


def similarity(algorithm: str, a: Column, b: Column) -> Column:
    """The similarity of an algorithm by name; a null or blank side scores 0."""
    known = {
        "levenshtein": levenshtein_similarity, "jaro_winkler": jaro_winkler_similarity, "token_set_ratio": token_set_ratio,
        "token_sort_ratio": token_sort_ratio, "numeric_similarity": numeric_similarity, "date_similarity": date_similarity,
    }
    if algorithm not in known:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    blank = (F.trim(_text(a)) == "") | (F.trim(_text(b)) == "")
    return F.when(blank, F.lit(0.0)).otherwise(known[algorithm](a, b))


def batch_similarity(algorithm: str, left: list, right: list) -> list[float]:
    """Pairwise scores of two lists of equal length, through the active session."""
    if len(left) != len(right):
        raise ValueError("both lists must have the same length")
    if not left:
        return []
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    known = {"levenshtein": levenshtein_similarity, "jaro_winkler": jaro_winkler_similarity, "token_set_ratio": token_set_ratio}
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(left, right, strict=True))], "i int, a string, b string")
    return [r[0] for r in rows.select(known[algorithm](F.col("a"), F.col("b")).alias("s"), "i").orderBy("i").collect()]


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions of the session."""
    for name, many in (("jaro_winkler_similarity", jaro_winkler), ("token_set_ratio", token_set), ("token_sort_ratio", token_sort)):
        spark.udf.register(name, batched(many))


__all__ = ["ALGORITHMS", "DATE_FORMATS", "batch_similarity", "similarity"]

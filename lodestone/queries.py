"""The registered queries of the linkage engine, each with its SQL.

People are made from ``customer`` by key arithmetic that both engines run, and a
second table is the first with typing errors, so that the truth is known.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import similarity as sim
from lodestone.functions import text
from lodestone.operators import blocking
from lodestone.operators.clustering import cluster
from lodestone.operators.evaluate import evaluate, score_distribution
from lodestone.operators.matching import label_histogram, match, prepare
from lodestone.operators.search import search
from lodestone.plans.lineage import cut, ensure_checkpoint_dir, remove_folder
from lodestone.plans.profile import column_types
from lodestone.plans.runner import run
from lodestone.plans.specs import Settings, analyze_columns, map_query
from lodestone.sources.loaders import clean_strings, load_source
from lodestone.sources.sinks import cluster_summary, largest_clusters, size_histogram, write_results
from lodestone.streaming.matching import match_stream

FIRST = "James,Maria,Robert,Linda,William,Susan,Bob,Karen,Bill,Nancy,Mike,Helen"
LAST = "Smith,Johnson,Brown,Garcia,Miller,Davis,Lopez,Wilson,Anderson,Thomas,Taylor,Moore,Jackson,Martin,Lee,Perez,White,Harris,Clark,Young"

#: Columns of the people, in SQL that Spark and DuckDB both read.
PEOPLE = {
    "id": "c_custkey",
    "name": f"split_part('{FIRST}', ',', CAST(c_custkey % 12 + 1 AS INT)) || ' ' || split_part('{LAST}', ',', CAST((c_custkey * 7) % 20 + 1 AS INT))",
    "email": f"lower(split_part('{LAST}', ',', CAST((c_custkey * 7) % 20 + 1 AS INT))) || CAST(c_custkey AS STRING) || '@mail' || CAST(c_custkey % 5 AS STRING) || '.com'",
    "phone": "'555-' || lpad(CAST((c_custkey * 7919) % 1000 AS STRING), 3, '0') || '-' || lpad(CAST((c_custkey * 104729) % 10000 AS STRING), 4, '0')",
    "balance": "c_acctbal",
}
#: What the second table makes of them.
TYPED = {
    "id": "id",
    "full_name": "CASE WHEN id % 5 = 0 THEN substring(name, 1, length(name) - 1) WHEN id % 7 = 0 THEN 'Dr ' || upper(name) WHEN id % 11 = 0 THEN name || ' Jr' ELSE name END",
    "email": "CASE WHEN id % 4 = 0 THEN upper(email) WHEN id % 9 = 0 THEN replace(email, 'mail', 'mial') WHEN id % 13 = 0 THEN '' ELSE email END",
    "phone": "CASE WHEN id % 3 = 0 THEN '1 (' || substring(phone, 1, 3) || ') ' || substring(phone, 5, 8) ELSE phone END",
    "balance": "CASE WHEN id % 6 = 0 THEN balance + 1 ELSE balance END",
}
COLUMNS = [
    {"source1": "name", "source2": "full_name", "weight": 0.4, "algorithm": "jaro_winkler"},
    {"source1": "email", "source2": "email", "weight": 0.3, "algorithm": "levenshtein"},
    {"source1": "phone", "source2": "phone", "weight": 0.2, "algorithm": "levenshtein"},
    {"source1": "balance", "source2": "balance", "weight": 0.1},
]
#: Keys of a whole local phone number, which need no cap: blocks stay small as the table grows.
SETTINGS = Settings(threshold=0.85, blocking_columns=("phone",), blocking_strategies=("suffix_8",))
#: Rows that meet no later row stay by themselves; ``cluster_fallback`` compares them.
CLUSTER_SETTINGS = Settings(threshold=0.85, blocking_columns=("phone",), blocking_strategies=("suffix_8",), fallback_rows=0)
RECORD = {"full_name": "bill brown", "email": "brown8@mail3.com", "phone": "555 352 7832"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {c}" for c, e in PEOPLE.items()])


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in TYPED.items()])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- scalar functions -------------------------------------------------------


def clean_load(spark, d):
    return clean_strings(_read(spark, d, "part").selectExpr("p_partkey", "'  ' || upper(p_name) || '   x ' AS p_name", "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'NaN' ELSE p_brand END AS p_brand"))


def normalizers(spark, d):
    t = typed(spark, d)
    address = "CAST(id AS STRING) || ' Main St., Apt ' || CAST(id % 9 AS STRING) || (CASE WHEN id % 2 = 0 THEN '  Oak Blvd' ELSE ' ELM AVE' END)"
    return t.select("id", text.normalize_phone(F.col("phone")).alias("phone"), text.normalize_email(F.col("email")).alias("email"), text.normalize_name(F.col("full_name")).alias("name"), text.normalize_address(F.expr(address)).alias("address"), text.normalize_string(F.expr("'  ' || full_name || '  Z'")).alias("string"))


def similarity_levenshtein(spark, d):
    p = _read(spark, d, "part")
    return _rounded(p.select("p_partkey", sim.levenshtein_similarity(F.col("p_name"), F.col("p_type")).alias("score")))


def similarity_jaro_winkler(spark, d):
    p = _read(spark, d, "part")
    return _rounded(p.select("p_partkey", sim.jaro_winkler_similarity(F.col("p_name"), F.col("p_type")).alias("score")))


def similarity_numeric(spark, d):
    return _rounded(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sim.numeric_similarity(F.col("l_quantity"), F.col("l_extendedprice") - F.lit(30000)).alias("score")))


def similarity_date(spark, d):
    o = _read(spark, d, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS a", "date_format(date_add(o_orderdate, CAST(o_orderkey % 900 AS INT)), 'M/d/yyyy') AS b")
    return _rounded(o.select("o_orderkey", sim.date_similarity(F.col("a"), F.col("b")).alias("score")))


def similarity_token_ratios(spark, d):
    t = _read(spark, d, "part").selectExpr("p_partkey", "lower(p_name) AS a", "lower(p_type || ' ' || p_name) AS b", "lower(p_type) AS c")
    set_, sort = sim.token_set_ratio, sim.token_sort_ratio
    return _rounded(t.select("p_partkey", set_(F.col("a"), F.col("b")).alias("set_contained"), set_(F.col("a"), F.col("c")).alias("set_ratio"), sort(F.col("a"), F.col("c")).alias("sort_ratio")))


#: How the dates of ``date_formats`` are written, by the order's key.
WRITTEN = ("yyyy-M-d", "M/d/yyyy", "yyyy.M.d", "yyyyMMdd", "MMMM d, yyyy", "d MMM yyyy", "M/d/yy", "MMM yyyy")


def date_formats(spark, d):
    text = F.get(F.array(*[F.date_format("o_orderdate", f) for f in WRITTEN]), (F.col("o_orderkey") % len(WRITTEN)).cast("int"))
    return _read(spark, d, "orders").select("o_orderkey", sim.parse_date(text).cast("string").alias("parsed"))


def date_components(spark, d):
    """Components within other text, and their comparison with those of a later day."""
    a = "CASE o_orderkey % 5 WHEN 0 THEN 'due ' || date_format(o_orderdate, 'yyyy-MM-dd') || '!' WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN 3 THEN 'n' || date_format(o_orderdate, 'yyyyMMdd') ELSE 'soon' END"
    o = _read(spark, d, "orders").selectExpr("o_orderkey", f"{a} AS a", "'to ' || date_format(date_add(o_orderdate, CAST(o_orderkey % 700 AS INT)), 'yyyy/MM/dd') AS b")
    p = o.select("o_orderkey", sim.date_components(F.col("a")).alias("p"), sim.date_components(F.col("b")).alias("q"))
    return _rounded(p.select("o_orderkey", F.concat_ws("-", "p.y", "p.m", "p.d").alias("found"), sim.compare_components(F.col("p"), F.col("q")).alias("score")))


# --- sources, sinks, configuration, streams -------------------------------------


@contextmanager
def _folder(spark):
    """A folder of the shared storage that goes when its results are read and cut."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_folder(spark, path)


def csv_source(spark, d):
    """A table written as CSV and loaded again: types inferred, null words as nulls, strings cleaned."""
    with _folder(spark) as folder:
        odd = _read(spark, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 4 = 0 THEN 'N/A' WHEN s_suppkey % 4 = 1 THEN '  \"A, ' || s_name || '\"  B ' ELSE s_name END AS label", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal", "s_suppkey % 2 = 0 AS even")
        write_results(odd, f"{folder}/supplier.csv")
        return cut(load_source(spark, f"{folder}/supplier.csv"))


def sinks(spark, d):
    """Rows that went through each file format."""
    nations = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label")
    with _folder(spark) as folder:
        for kind in ("csv", "json", "parquet"):
            write_results(nations, f"{folder}/n.{kind}")
        read = {"csv": load_source(spark, f"{folder}/n.csv"), "json": clean_strings(spark.read.json(f"{folder}/n.json")), "parquet": load_source(spark, f"{folder}/n.parquet")}
        parts = [df.select(F.lit(kind).alias("kind"), "id", "label") for kind, df in read.items()]
        return cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def config_clusters(spark, d):
    """A configuration run from source to sink; its output is read back."""
    with _folder(spark) as folder:
        _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label").orderBy("id").coalesce(1).write.parquet(f"{folder}/in.parquet")
        columns = [{"column": "label", "algorithm": "levenshtein"}]
        run(spark, {"mode": "clustering", "source1": f"{folder}/in.parquet", "output": f"{folder}/out.parquet", "clustering": {"columns": columns, "threshold": 0.4, "use_blocking": False}}, check_files=False)
        return cut(spark.read.parquet(f"{folder}/out.parquet"))


def stream_match(spark, d):
    """The nations as a stream against the regions."""
    columns = [{"source1": "label", "source2": "label", "algorithm": "levenshtein"}]
    regions = _read(spark, d, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS label")
    with _folder(spark) as folder:
        nations = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label")
        nations.write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(nations.schema).parquet(f"{folder}/in")
        settings = Settings(threshold=0.3, use_blocking=False, return_all_matches=True)
        match_stream(stream, regions, f"{folder}/out", f"{folder}/state", columns, settings, "id", "id", once=True).awaitTermination()
        return _rounded(cut(spark.read.parquet(f"{folder}/out").drop("batch")))


# --- profiles and blocking ----------------------------------------------------


def semantic_types(spark, d):
    found = column_types(prepare(typed(spark, d), "id"), ["full_name", "email", "phone", "balance"])
    return spark.createDataFrame(sorted(found.items()), "column_name string, semantic_type string")


def query_mapping(spark, d):
    found = map_query({"FULL_NAME": "x", "mail": "y", "phone": "z", "blank": " "}, typed(spark, d))
    return spark.createDataFrame([(m["source1"], m["source2"]) for m in found], "query_key string, master_column string")


ALL_STRATEGIES = ("first_char", "two_gram", "three_gram", "last_three", "word_prefix", "word_suffix")


def _keys(spark, d):
    return blocking.key_table(prepare(typed(spark, d), "id"), ["full_name", "email"], ALL_STRATEGIES)


def blocking_keys(spark, d):
    return _keys(spark, d).withColumnRenamed("__idx", "id")


def blocking_sizes(spark, d):
    return blocking.block_sizes(_keys(spark, d))


def blocking_statistics(spark, d):
    return blocking.blocking_stats(_keys(spark, d), 100, True)


def _pairs(spark, d, **how):
    left, right = prepare(people(spark, d), "id"), prepare(typed(spark, d), "id")
    settings = Settings(blocking_strategies=("last_three", "three_gram"), fallback_rows=0, **how)
    return blocking.candidate_pairs(left, right, analyze_columns(left, right, COLUMNS[1:3]), settings)


def candidates_skip(spark, d):
    return _pairs(spark, d, max_block_size=60)


def candidates_trim(spark, d):
    return _pairs(spark, d, max_block_size=15, skip_high_cardinality=False)


def candidates_truncate(spark, d):
    return _pairs(spark, d, max_block_size=60, max_candidates=4)


def candidates_fallback(spark, d):
    return _pairs(spark, d, max_block_size=60, max_candidates=3, candidate_trim_strategy="fallback")


def candidate_statistics(spark, d):
    left, right = prepare(people(spark, d), "id"), prepare(typed(spark, d), "id")
    settings = Settings(blocking_strategies=("last_three", "three_gram"), max_block_size=60, max_candidates=4)
    return blocking.candidate_stats(left, right, analyze_columns(left, right, COLUMNS[1:3]), settings)


# --- matching, search, clustering ---------------------------------------------


def match_best(spark, d):
    return _rounded(match(people(spark, d), typed(spark, d), COLUMNS, SETTINGS, "id", "id"))


def match_all(spark, d):
    settings = Settings(**{**SETTINGS.__dict__, "return_all_matches": True, "threshold": 0.7, "undecided_range": 0.1})
    return _rounded(match(people(spark, d), typed(spark, d), COLUMNS, settings, "id", "id"))


def match_labels(spark, d):
    return label_histogram(match(people(spark, d), typed(spark, d), COLUMNS, SETTINGS, "id", "id"))


def match_unblocked(spark, d):
    n = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label")
    r = _read(spark, d, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS label")
    columns = [{"source1": "label", "source2": "label", "algorithm": "levenshtein"}]
    return _rounded(match(n, r, columns, Settings(threshold=0.3, use_blocking=False, return_all_matches=True), "id", "id"))


def match_auto(spark, d):
    """Columns of equal names, by their types, with equal weights."""
    n = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label", "n_regionkey + 1 AS rank")
    r = _read(spark, d, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS key", "r_name AS label", "r_regionkey + 1 AS rank")
    return _rounded(match(n, r, None, Settings(threshold=0.5, use_blocking=False), "id", "key"))


def match_fallback(spark, d):
    """Nations that meet no region in any block are compared with all of them."""
    n = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label")
    r = _read(spark, d, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS label")
    columns = [{"source1": "label", "source2": "label", "algorithm": "levenshtein"}]
    settings = Settings(threshold=0.2, undecided_range=0.1, blocking_strategies=("first_char",), return_all_matches=True)
    return _rounded(match(n, r, columns, settings, "id", "id"))


def _nations(spark, d, **how):
    n = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS label")
    return cluster(n, [{"column": "label", "algorithm": "levenshtein"}], Settings(threshold=0.4, **how), "id")


def cluster_unblocked(spark, d):
    return _nations(spark, d, use_blocking=False)


def cluster_fallback(spark, d):
    """Nations that meet no later one in any block are compared with all later ones."""
    return _nations(spark, d, blocking_strategies=("last_three",))


SEARCHED = [{"source1": "full_name", "source2": "full_name", "algorithm": "jaro_winkler"}, {"source1": "email", "source2": "email", "algorithm": "levenshtein"}, {"source1": "phone", "source2": "phone", "algorithm": "levenshtein"}]


def search_record(spark, d):
    return _rounded(search(RECORD, typed(spark, d), SEARCHED, Settings(threshold=0.5), 10, "id"))


def search_threshold(spark, d):
    """All rows from a threshold of its own on, with the labels of the settings."""
    return _rounded(search(RECORD, typed(spark, d), SEARCHED, Settings(threshold=0.7), 0, "id", threshold=0.5))


def both_tables(spark, d):
    a = people(spark, d).selectExpr("id * 2 AS id", "name", "email", "phone")
    return a.unionByName(typed(spark, d).selectExpr("id * 2 + 1 AS id", "full_name AS name", "email", "phone"))


def _clusters(spark, d):
    columns = [{"column": "name", "weight": 0.4, "algorithm": "jaro_winkler"}, {"column": "email", "weight": 0.3, "algorithm": "levenshtein"}, {"column": "phone", "weight": 0.3, "algorithm": "levenshtein"}]
    return cluster(both_tables(spark, d), columns, CLUSTER_SETTINGS, "id")


def cluster_people(spark, d):
    return _clusters(spark, d).select("id", "cluster_id", "cluster_size")


def cluster_report(spark, d):
    return cluster_summary(_clusters(spark, d))


def cluster_histogram(spark, d):
    return size_histogram(_clusters(spark, d))


def cluster_largest(spark, d):
    return largest_clusters(_clusters(spark, d))


def evaluate_matches(spark, d):
    found = match(people(spark, d), typed(spark, d), COLUMNS, SETTINGS, "id", "id").where("match_result = 'accept'")
    truth = people(spark, d).selectExpr("id AS source1_index", "id AS source2_index")
    return _rounded(evaluate(found, truth))


def match_distribution(spark, d):
    return _rounded(score_distribution(match(people(spark, d), typed(spark, d), COLUMNS, SETTINGS, "id", "id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        match_best, match_all, match_labels, match_unblocked, match_auto, match_fallback, cluster_unblocked, cluster_fallback, match_distribution, evaluate_matches, search_record, search_threshold,
        cluster_people, cluster_report, cluster_histogram, cluster_largest, clean_load, normalizers,
        similarity_levenshtein, similarity_jaro_winkler, similarity_numeric, similarity_date, similarity_token_ratios, date_formats, date_components,
        csv_source, sinks, config_clusters, stream_match, semantic_types, query_mapping, blocking_keys, blocking_sizes, blocking_statistics,
        candidates_skip, candidates_trim, candidates_truncate, candidates_fallback, candidate_statistics,
    )
}

# --- SQL ------------------------------------------------------------------------

_VARCHAR = lambda e: e.replace("AS STRING", "AS VARCHAR").replace("length(name) - 1", "CAST(length(name) - 1 AS BIGINT)")
_TABLES = "people AS (SELECT {} FROM customer), typed AS (SELECT {} FROM people)".format(
    ", ".join(f"{_VARCHAR(e)} AS {c}" for c, e in PEOPLE.items()), ", ".join(f"{_VARCHAR(e)} AS {c}" for c, e in TYPED.items())
)
_CLEAN = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
_P = f"p AS (SELECT id, {_CLEAN.format('name')} AS name, {_CLEAN.format('email')} AS email, {_CLEAN.format('phone')} AS phone, balance FROM people)"
_T = f"t AS (SELECT id, {_CLEAN.format('full_name')} AS full_name, {_CLEAN.format('email')} AS email, {_CLEAN.format('phone')} AS phone, balance FROM typed)"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_PHONE = f"CASE WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN substring({_DIGITS}, 2) ELSE {_DIGITS} END"


def _name_sql(c: str) -> str:
    """Title and suffix off, the three nicknames that occur replaced, two words in title case."""
    bare = f"regexp_replace(regexp_replace(trim(lower({c})), '^dr ', ''), ' jr$', '')"
    first, last = f"split_part({bare}, ' ', 1)", f"split_part({bare}, ' ', 2)"
    full = f"CASE {first} WHEN 'bob' THEN 'robert' WHEN 'bill' THEN 'william' WHEN 'mike' THEN 'michael' ELSE {first} END"
    return f"(upper(substring({full}, 1, 1)) || substring({full}, 2) || ' ' || upper(substring({last}, 1, 1)) || substring({last}, 2))"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN trim({a}) = '' OR trim({b}) = '' THEN 0.0 ELSE 1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def _num(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE coalesce(1.0 - abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0), 0.0) END"


def _key_sql(table: str, columns: list[str], strategies: tuple[str, ...]) -> str:
    out = []
    for i, c in enumerate(columns):
        word, end = f"split_part({c}, ' ', 1)", f"split_part({c}, ' ', -1)"
        made = {
            "first_char": [("first", f"CASE WHEN regexp_matches(substring({c}, 1, 1), '[a-z0-9]') THEN substring({c}, 1, 1) ELSE '#' END", f"length({c}) > 0")],
            "two_gram": [("2gram", f"substring({c}, 1, 2)", f"length({c}) >= 2")],
            "three_gram": [("3gram", f"substring({c}, 1, 3)", f"length({c}) >= 3")],
            "last_three": [("last3", f"right({c}, 3)", f"length({c}) >= 3")],
            "word_prefix": [("word1", f"substring({word}, 1, 2)", f"length({word}) >= 2"), ("word1", f"substring({word}, 1, 3)", f"length({word}) >= 3")],
            "word_suffix": [("wordN", f"substring({end}, 1, 2)", f"{c} LIKE '% %' AND length({end}) >= 2")],
        }
        out += [f"SELECT {i} AS pair, '{g}' AS grp, {f} AS frag, id FROM {table} WHERE {w}" for s in strategies for g, f, w in made[s]]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(out) + ")"


_TWO = ("last_three", "three_gram")


def _pairs_sql(left: list[str], right: list[str], limit: int, skip: bool = True) -> str:
    capped = f"SELECT * FROM rk QUALIFY count(*) OVER (PARTITION BY pair, grp, frag) <= {limit}" if skip else f"SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY pair, grp, frag ORDER BY id) <= {limit}"
    return (
        f"lk AS ({_key_sql('p', left, _TWO)}), rk AS ({_key_sql('t', right, _TWO)}), ck AS ({capped}), "
        "pairs AS (SELECT lk.id AS idx1, ck.id AS idx2, min(CASE lk.grp WHEN '3gram' THEN 1 ELSE 2 END) AS tier FROM lk JOIN ck ON lk.pair = ck.pair AND lk.grp = ck.grp AND lk.frag = ck.frag GROUP BY 1, 2)"
    )


_BASE = f"WITH {_TABLES}, {_P}, {_T}"


def _match_sql(threshold: float, band: float, every: bool) -> str:
    low, high = threshold - band, threshold + band
    scores = (
        f"CASE WHEN p.name = '' OR t.full_name = '' THEN 0.0 ELSE jaro_winkler_similarity({_name_sql('p.name')}, {_name_sql('t.full_name')}) END AS s0, "
        f"{_lev('p.email', 't.email')} AS s1, {_lev('(' + _PHONE.format('p.phone') + ')', '(' + _PHONE.format('t.phone') + ')')} AS s2, {_num('p.balance', 't.balance')} AS s3"
    )
    full = "(0.4 * s0 + 0.3 * s1 + 0.2 * s2 + 0.1 * s3) / (0.4 + 0.3 + 0.2 + 0.1)"
    a, b, c = "s0 >= 0.99", "(0.4 * s0 + 0.3 * s1) / 0.7 >= 0.99", "(0.4 * s0 + 0.3 * s1 + 0.2 * s2) / 0.9 >= 0.99"
    mean = full if every else f"CASE WHEN {a} THEN s0 WHEN {b} THEN (0.4 * s0 + 0.3 * s1) / 0.7 WHEN {c} THEN (0.4 * s0 + 0.3 * s1 + 0.2 * s2) / 0.9 ELSE {full} END"
    shown = ["s0", "s1", "s2", "s3"] if every else ["s0", f"CASE WHEN NOT ({a}) THEN s1 END", f"CASE WHEN NOT ({a}) AND NOT ({b}) THEN s2 END", f"CASE WHEN NOT ({a}) AND NOT ({b}) AND NOT ({c}) THEN s3 END"]
    best = f"o >= {low!r}" if every else "o > 0 QUALIFY row_number() OVER (PARTITION BY idx1 ORDER BY (o >= 0.99) DESC, CASE WHEN o >= 0.99 THEN 0 ELSE o END DESC, idx2) = 1"
    label = f"CASE WHEN o >= {high!r} THEN 'accept' WHEN o <= {low!r} THEN 'reject' ELSE 'undecided' END"
    names = ["name", "email", "phone", "balance"]
    return (
        f"{_BASE}, pairs AS (SELECT p.id AS idx1, t.id AS idx2 FROM p JOIN t ON right(p.phone, 8) = right(t.phone, 8) WHERE length(p.phone) >= 8 AND length(t.phone) >= 8), "
        f"sc AS (SELECT idx1, idx2, {scores} FROM pairs JOIN p ON p.id = idx1 JOIN t ON t.id = idx2), ov AS (SELECT *, {mean} AS o FROM sc), "
        f"m AS (SELECT p.id AS source1_id, p.name AS source1_name, p.email AS source1_email, p.phone AS source1_phone, p.balance AS source1_balance, "
        "t.id AS source2_id, t.full_name AS source2_full_name, t.email AS source2_email, t.phone AS source2_phone, t.balance AS source2_balance, "
        + ", ".join(f"round({e}, 6) AS score_{n}" for e, n in zip(shown, names, strict=True))
        + f", round(o, 6) AS overall_score, {label} AS match_result, idx1 AS source1_index, idx2 AS source2_index "
        f"FROM (SELECT * FROM ov WHERE {best}) b JOIN p ON p.id = idx1 JOIN t ON t.id = idx2) "
    )


_BEST = _match_sql(0.85, 0.05, False)
_CLUSTER = (
    f"WITH RECURSIVE {_TABLES}, {_P}, {_T}, u AS (SELECT id * 2 AS id, name, email, phone FROM p UNION ALL SELECT id * 2 + 1, full_name, email, phone FROM t), "
    "c AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON right(a.phone, 8) = right(b.phone, 8) AND a.id < b.id WHERE length(a.phone) >= 8 AND length(b.phone) >= 8), "
    "e AS (SELECT i, j FROM c JOIN u a ON a.id = i JOIN u b ON b.id = j WHERE (0.4 * "
    f"(CASE WHEN a.name = '' OR b.name = '' THEN 0.0 ELSE jaro_winkler_similarity({_name_sql('a.name')}, {_name_sql('b.name')}) END) + 0.3 * ({_lev('a.email', 'b.email')}) + 0.3 * "
    f"({_lev('(' + _PHONE.format('a.phone') + ')', '(' + _PHONE.format('b.phone') + ')')})) / (0.4 + 0.3 + 0.3) >= 0.85), "
    "both_ways AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e), "
    "reach(node, r) AS (SELECT id, id FROM u UNION SELECT b.j, reach.r FROM reach JOIN both_ways b ON b.i = reach.node), "
    "roots AS (SELECT node AS id, min(r) AS root FROM reach GROUP BY 1), "
    "cl AS (SELECT id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster_id, count(*) OVER (PARTITION BY root) AS cluster_size FROM roots) "
)
def _nations_sql(met: str) -> str:
    """Clusters of nations; ``met`` is the condition on i and j under which blocks bring them together."""
    return (
        "WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS label FROM nation), "
        f"m AS (SELECT i.id AS i, j.id AS j FROM n i JOIN n j ON i.id < j.id WHERE {met}), "
        "c AS (SELECT i, j FROM m UNION SELECT i.id, j.id FROM n i JOIN n j ON i.id < j.id WHERE i.id NOT IN (SELECT i FROM m)), "
        f"e AS (SELECT c.i, c.j FROM c JOIN n a ON a.id = c.i JOIN n b ON b.id = c.j WHERE {_lev('a.label', 'b.label')} >= 0.4), "
        "both_ways AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e), "
        "reach(node, r) AS (SELECT id, id FROM n UNION SELECT b.j, reach.r FROM reach JOIN both_ways b ON b.i = reach.node), "
        "roots AS (SELECT node AS id, min(r) AS root FROM reach GROUP BY 1) "
        "SELECT n.id, label, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster_id, count(*) OVER (PARTITION BY root) AS cluster_size FROM roots JOIN n ON n.id = roots.id"
    )


#: Longest common subsequences by the rows of their table, for the texts x and y of each (kind, k).
_TOKENS = (
    "WITH RECURSIVE t AS (SELECT p_partkey AS k, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type || ' ' || p_name), ' ') AS b, string_split(lower(p_type), ' ') AS c FROM part), "
    "o AS (SELECT k, 'contained' AS kind, list_distinct(a) AS a, list_distinct(b) AS b FROM t UNION ALL SELECT k, 'set', list_distinct(a), list_distinct(c) FROM t), "
    "q AS (SELECT k, 'sort' AS kind, array_to_string(list_sort(a), ' ') AS x, array_to_string(list_sort(c), ' ') AS y, 0 AS i FROM t UNION ALL "
    "SELECT k, kind, array_to_string(list_sort(list_filter(a, lambda z: NOT list_contains(b, z))), ' '), array_to_string(list_sort(list_filter(b, lambda z: NOT list_contains(a, z))), ' '), "
    "length(array_to_string(list_sort(list_filter(a, lambda z: list_contains(b, z))), ' ')) FROM o), "
    "l AS (SELECT k, kind, x, y, 0 AS pos, list_transform(range(length(y) + 1), lambda z: 0) AS r FROM q UNION ALL "
    "SELECT k, kind, x, y, pos + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(best[1:j])) FROM (SELECT *, list_transform(range(1, length(y) + 2), "
    "lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(r[j], r[j - 1] + CASE WHEN substring(y, j - 1, 1) = substring(x, pos + 1, 1) THEN 1 ELSE 0 END) END) AS best FROM l WHERE pos < length(x))), "
    "s AS (SELECT q.k, q.kind, q.i, CASE WHEN q.i > 0 THEN 1 ELSE 0 END AS gap, length(q.x) AS nx, length(q.y) AS ny, r[-1] AS lcs FROM q JOIN l ON l.k = q.k AND l.kind = q.kind AND l.pos = length(q.x)), "
    "v AS (SELECT k, kind, CASE WHEN kind = 'sort' THEN 2.0 * lcs / (nx + ny) WHEN i > 0 AND (nx = 0 OR ny = 0) THEN 1.0 WHEN i = 0 THEN 2.0 * lcs / (nx + ny) "
    "ELSE greatest(1 - (nx + ny - 2.0 * lcs) / (2 * i + 2 * gap + nx + ny), 1 - (gap + nx) * 1.0 / (2 * i + gap + nx), 1 - (gap + ny) * 1.0 / (2 * i + gap + ny)) END AS s FROM s) "
    "SELECT k AS p_partkey, round(max(s) FILTER (kind = 'contained'), 6) AS set_contained, round(max(s) FILTER (kind = 'set'), 6) AS set_ratio, round(max(s) FILTER (kind = 'sort'), 6) AS sort_ratio FROM v GROUP BY k"
)
_PARTS = (
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INT) AS b, o_orderkey % 5 = 2 AND day(o_orderdate) <= 12 AS turned FROM orders), "
    "c AS (SELECT o_orderkey, b, CASE WHEN o_orderkey % 5 < 4 THEN year(a) END AS y, CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN turned THEN day(a) ELSE month(a) END END AS m, "
    "CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN turned THEN month(a) ELSE day(a) END END AS d FROM o) "
    "SELECT o_orderkey, concat_ws('-', y, m, d) AS found, round(CASE WHEN y IS NULL THEN 0.0 WHEN make_date(y, m, d) = b THEN 1.0 ELSE greatest("
    "(CASE WHEN y = year(b) THEN 0.5 ELSE 0.0 END) + (CASE WHEN m = month(b) THEN 0.3 ELSE 0.0 END) + (CASE WHEN d = day(b) THEN 0.2 ELSE 0.0 END), "
    "0.7 / (1.0 + abs(date_diff('day', make_date(y, m, d), b)) / 365.0)) END, 6) AS score FROM c"
)
_SIZES = "(SELECT cluster_id, max(cluster_size) AS cluster_size FROM cl GROUP BY 1)"
_DATES = "SELECT o_orderkey, abs(date_diff('day', a, b)) / 365.0 AS days, abs(year(a) - year(b)) AS years FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) AS b FROM orders)"
_SCORED_RECORD = (
    f"{_BASE}, q AS (SELECT t.*, jaro_winkler_similarity('William Brown', {_name_sql('full_name')}) AS s0, {_lev('email', repr(RECORD['email']))} AS s1, "
    f"{_lev('(' + _PHONE.format('phone') + ')', repr('5553527832'))} AS s2 FROM t WHERE substring(full_name, 1, 1) = 'b' OR substring(full_name, 1, 3) = 'bil' OR right(full_name, 3) = 'own' "
    "OR substring(email, 1, 1) = 'b' OR substring(email, 1, 3) = 'bro' OR right(email, 3) = 'com' OR substring(phone, 1, 1) = '5' OR substring(phone, 1, 3) = '555' OR right(phone, 3) = '832') "
)



def _record_sql(threshold: float, labelled: float) -> str:
    """Rows from ``threshold`` less the band on, with labels by ``labelled``."""
    low, high = labelled - 0.05, labelled + 0.05
    return (
        _SCORED_RECORD + f"SELECT round(o, 6) AS overall_score, CASE WHEN o >= {high!r} THEN 'accept' WHEN o <= {low!r} THEN 'reject' ELSE 'undecided' END AS match_result, id AS master_index, id AS master_id, full_name AS master_full_name, "
        "email AS master_email, phone AS master_phone, balance AS master_balance, round(s0, 6) AS score_full_name, round(s1, 6) AS score_email, round(s2, 6) AS score_phone, "
        + ", ".join(f"'{v}' AS query_{k}" for k, v in RECORD.items())
        + f" FROM (SELECT *, (s0 + s1 + s2) / 3.0 AS o FROM q) WHERE o >= {threshold - 0.05!r}"
    )


ORACLES = {
    "match_best": _BEST + "SELECT * FROM m",
    "match_all": _match_sql(0.7, 0.1, True) + "SELECT * FROM m",
    "match_labels": _BEST + "SELECT match_result, count(*) AS n FROM m GROUP BY 1",
    "match_distribution": _BEST + "SELECT count(*) AS n, round(avg(o), 6) AS mean_score, round(min(o), 6) AS min_score, round(max(o), 6) AS max_score FROM (SELECT o FROM ov WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY idx1 ORDER BY (o >= 0.99) DESC, CASE WHEN o >= 0.99 THEN 0 ELSE o END DESC, idx2) = 1)",
    "evaluate_matches": _BEST + "SELECT tp AS true_positives, n - tp AS false_positives, total - tp AS false_negatives, round(tp / n, 6) AS precision, round(tp / total, 6) AS recall, round(2.0 * tp / (n + total), 6) AS f1 FROM (SELECT count(*) AS n, count(*) FILTER (source1_index = source2_index) AS tp, (SELECT count(*) FROM people) AS total FROM m WHERE match_result = 'accept')",
    "match_unblocked": "SELECT n_nationkey::BIGINT AS source1_id, lower(n_name) AS source1_label, r_regionkey::BIGINT AS source2_id, lower(r_name) AS source2_label, round(s, 6) AS score_label, round(s, 6) AS overall_score, "
    f"CASE WHEN s >= {0.3 + 0.05!r} THEN 'accept' WHEN s <= {0.3 - 0.05!r} THEN 'reject' ELSE 'undecided' END AS match_result, n_nationkey::BIGINT AS source1_index, r_regionkey::BIGINT AS source2_index "
    f"FROM (SELECT *, 1.0 - CAST(levenshtein(lower(n_name), lower(r_name)) AS DOUBLE) / greatest(length(n_name), length(r_name)) AS s FROM nation, region) WHERE s >= {0.3 - 0.05!r}",
    "match_auto": f"WITH s AS (SELECT n_nationkey::BIGINT AS i, r_regionkey::BIGINT AS j, lower(n_name) AS a, lower(r_name) AS b, n_regionkey + 1 AS x, r_regionkey + 1 AS y FROM nation, region), "
    f"v AS (SELECT *, {_lev('a', 'b')} AS s0, {_num('x', 'y')} AS s1 FROM s), o AS (SELECT *, CASE WHEN s0 >= 0.99 THEN s0 ELSE (s0 + s1) / 2.0 END AS o FROM v) "
    "SELECT i AS source1_id, a AS source1_label, x AS source1_rank, j AS source2_key, b AS source2_label, y AS source2_rank, round(s0, 6) AS score_label, round(s1, 6) AS score_rank, round(o, 6) AS overall_score, "
    f"CASE WHEN o >= {0.5 + 0.05!r} THEN 'accept' WHEN o <= {0.5 - 0.05!r} THEN 'reject' ELSE 'undecided' END AS match_result, i AS source1_index, j AS source2_index FROM o WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY o DESC, j) = 1",
    "match_fallback": "WITH n AS (SELECT n_nationkey::BIGINT AS id, lower(n_name) AS label FROM nation), r AS (SELECT r_regionkey::BIGINT AS id, lower(r_name) AS label FROM region), "
    f"s AS (SELECT n.id AS i, r.id AS j, n.label AS a, r.label AS b, {_lev('n.label', 'r.label')} AS s FROM n, r WHERE substring(n.label, 1, 1) = substring(r.label, 1, 1) OR substring(n.label, 1, 1) NOT IN (SELECT substring(label, 1, 1) FROM r)) "
    "SELECT i AS source1_id, a AS source1_label, j AS source2_id, b AS source2_label, round(s, 6) AS score_label, round(s, 6) AS overall_score, "
    f"CASE WHEN s >= {0.2 + 0.1!r} THEN 'accept' WHEN s <= {0.2 - 0.1!r} THEN 'reject' ELSE 'undecided' END AS match_result, i AS source1_index, j AS source2_index FROM s WHERE s >= {0.2 - 0.1!r}",
    "cluster_unblocked": _nations_sql("true"),
    "config_clusters": _nations_sql("true"),
    "csv_source": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN '\"a, ' || lower(s_name) || '\" b' ELSE lower(s_name) END AS label, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal, s_suppkey % 2 = 0 AS even FROM supplier",
    "sinks": "SELECT kind, CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS label FROM nation, (VALUES ('csv'), ('json'), ('parquet')) AS k(kind)",
    "cluster_fallback": _nations_sql("right(i.label, 3) = right(j.label, 3)"),
    "search_record": _record_sql(0.5, 0.5) + " ORDER BY o DESC, id LIMIT 10",
    "search_threshold": _record_sql(0.5, 0.7),
    "cluster_people": _CLUSTER + "SELECT * FROM cl",
    "cluster_report": _CLUSTER + f"SELECT total_records, total_clusters, singleton_clusters, multi_record_clusters, total_records - singleton_clusters AS duplicate_records FROM (SELECT CAST(sum(cluster_size) AS BIGINT) AS total_records, count(*) AS total_clusters, count(*) FILTER (cluster_size = 1) AS singleton_clusters, count(*) FILTER (cluster_size > 1) AS multi_record_clusters FROM {_SIZES})",
    "cluster_histogram": _CLUSTER + f"SELECT cluster_size, count(*) AS n FROM {_SIZES} GROUP BY 1",
    "cluster_largest": _CLUSTER + f"SELECT * FROM {_SIZES} ORDER BY cluster_size DESC, cluster_id LIMIT 10",
    "clean_load": "SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '   x '), '\\s+', ' ', 'g')) AS p_name, CASE WHEN p_partkey % 3 = 2 THEN lower(p_brand) ELSE '' END AS p_brand FROM part",
    "normalizers": f"WITH {_TABLES} SELECT id, {_PHONE.format('phone')} AS phone, lower(email) AS email, {_name_sql('full_name')} AS name, id::VARCHAR || ' main street apartment ' || (id % 9)::VARCHAR || (CASE WHEN id % 2 = 0 THEN ' oak boulevard' ELSE ' elm avenue' END) AS address, lower(full_name) || ' z' AS string FROM typed",
    "similarity_levenshtein": "SELECT p_partkey, round(1.0 - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)), 6) AS score FROM part",
    "similarity_jaro_winkler": "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS score FROM part",
    "similarity_numeric": "SELECT l_orderkey, l_linenumber, round(" + _num("l_quantity", "(l_extendedprice - 30000)") + ", 6) AS score FROM lineitem",
    "similarity_date": f"SELECT o_orderkey, round(1.0 / (1.0 + days + 0.5 * years), 6) AS score FROM ({_DATES})",
    "similarity_token_ratios": _TOKENS,
    "date_formats": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 8 = 7 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS parsed FROM orders",
    "date_components": _PARTS,
    "semantic_types": "SELECT * FROM (VALUES ('balance', 'numeric'), ('email', 'email'), ('full_name', 'string_name'), ('phone', 'phone')) AS x(column_name, semantic_type)",
    "query_mapping": "SELECT * FROM (VALUES ('FULL_NAME', 'full_name'), ('mail', 'email'), ('phone', 'phone')) AS x(query_key, master_column)",
    "blocking_keys": f"{_BASE} {_key_sql('t', ['full_name', 'email'], ALL_STRATEGIES)}",
    "blocking_sizes": f"{_BASE} SELECT pair, grp, frag, count(*) AS size FROM ({_key_sql('t', ['full_name', 'email'], ALL_STRATEGIES)}) GROUP BY 1, 2, 3",
    "blocking_statistics": f"{_BASE} SELECT count(*) FILTER (size > 100) AS skipped_keys, CAST(0 AS BIGINT) AS trimmed_keys, max(size) AS largest_block FROM (SELECT count(*) AS size FROM ({_key_sql('t', ['full_name', 'email'], ALL_STRATEGIES)}) GROUP BY pair, grp, frag)",
    "candidate_statistics": f"{_BASE}, {_pairs_sql(['email', 'phone'], ['email', 'phone'], 60)} SELECT count(*) AS matched_rows, CAST(sum(n) AS BIGINT) AS candidates, count(*) FILTER (n > 4) AS capped_rows FROM (SELECT count(*) AS n FROM pairs GROUP BY idx1)",
    "candidates_skip": f"{_BASE}, {_pairs_sql(['email', 'phone'], ['email', 'phone'], 60)} SELECT idx1, idx2 FROM pairs",
    "candidates_trim": f"{_BASE}, {_pairs_sql(['email', 'phone'], ['email', 'phone'], 15, False)} SELECT idx1, idx2 FROM pairs",
    "candidates_truncate": f"{_BASE}, {_pairs_sql(['email', 'phone'], ['email', 'phone'], 60)} SELECT idx1, idx2 FROM pairs QUALIFY row_number() OVER (PARTITION BY idx1 ORDER BY idx2) <= 4",
    "candidates_fallback": f"{_BASE}, {_pairs_sql(['email', 'phone'], ['email', 'phone'], 60)}, n AS (SELECT *, min(tier) OVER (PARTITION BY idx1) AS best, count(*) OVER (PARTITION BY idx1) AS every FROM pairs), "
    "o AS (SELECT *, count(*) FILTER (tier = best) OVER (PARTITION BY idx1) AS own FROM n) SELECT idx1, idx2 FROM o WHERE every <= 3 OR own > 3 OR tier = best QUALIFY row_number() OVER (PARTITION BY idx1 ORDER BY idx2) <= 3",
}
ORACLES["stream_match"] = ORACLES["match_unblocked"]

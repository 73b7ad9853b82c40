import json
import time

import pytest
from pyspark.sql import functions as F

import lodestone as L
from lodestone.cli import main, shown
from lodestone.operators.blocking import candidate_pairs, self_pairs
from lodestone.operators.components import connected_components
from lodestone.operators.evaluate import coverage, false_positive_rate
from lodestone.plans.config import check_config, validate_config
from lodestone.plans.jobs import JobQueue, JobStore
from lodestone.plans.profile import detect_type
from lodestone.plans.specs import PairSpec, Settings, map_query
from lodestone.sources.loaders import load_source, s3_problem, with_index
from lodestone.sources.sinks import summary_report, write_results

PEOPLE = [(0, "John Smith", "john@a.com", "555-123-4567"), (1, "Mary Jones", "mary@a.com", "555-222-3333"), (2, "Ann Lee", None, None), (3, "", "", ""), (4, "Pat Doe", "pat@d.com", "555-888-9999"), (5, "Eve Fox", "eve@f.com", "555-777-1111")]
OTHERS = [(0, "Mary Jones", "mary@a.com", "(555) 222-3333"), (1, "Jon Smith", "john@a.com", "555 123 4567"), (2, "Zed Qux", "zed@q.org", "1")]


def people(spark, rows=PEOPLE):
    return spark.createDataFrame(rows, "id long, name string, email string, phone string")


def test_best_match(spark):
    out = {r["source1_index"]: r for r in L.match(people(spark), people(spark, OTHERS), [{"source1": c, "source2": c} for c in ("name", "email", "phone")], left_key="id", right_key="id").collect()}
    assert (out[0]["source2_index"], out[0]["match_result"]) == (1, "accept")
    assert (out[1]["source2_index"], out[1]["overall_score"], out[1]["score_email"]) == (0, 1.0, None)
    assert 3 not in out and coverage(people(spark).selectExpr("id AS source1_index"), 6) == 1.0


def test_all_matches_hold_the_best(spark):
    columns = [{"source1": "name", "source2": "name"}, {"source1": "email", "source2": "email", "weight": 2}]
    settings = {"threshold": 0.8, "undecided_range": 0.1, "early_termination": False}
    best = L.match(people(spark), people(spark, OTHERS), columns, settings, "id", "id").where("overall_score >= 0.7")
    every = L.match(people(spark), people(spark, OTHERS), columns, {**settings, "return_all_matches": True}, "id", "id")
    keys = lambda df: {(r[0], r[1]) for r in df.select("source1_index", "source2_index").collect()}
    assert keys(best) <= keys(every)


def test_empty_and_unknown(spark):
    none = people(spark, []).limit(0)
    assert L.match(none, people(spark), [{"source1": "name", "source2": "name"}], left_key="id", right_key="id").count() == 0
    with pytest.raises(ValueError, match="nope"):
        L.match(people(spark), people(spark), [{"source1": "nope", "source2": "name"}])


def test_clusters(spark):
    rows = [(i, n, e, "") for i, (n, e) in enumerate([("john smith", "j@a.com"), ("john smith", "j@a.com"), ("mary", "m@a.com"), ("jon smith", "j@a.com"), ("zed", "z@q.org")])]
    out = L.cluster(people(spark, rows), ["name", "email"], {"threshold": 0.8}, key="id")
    assert {r["id"]: (r["cluster_id"], r["cluster_size"]) for r in out.collect()} == {0: (0, 3), 1: (0, 3), 3: (0, 3), 2: (1, 1), 4: (2, 1)}
    report = summary_report(out)
    assert "Total Clusters: 3" in report and "Duplicate Records: 3" in report


def test_unblocked_rows_meet_all_rows_of_a_large_table(spark):
    n = 10_001
    df = spark.range(n).select(F.col("id").alias("__idx"), F.lit("").alias("name"))
    specs = [PairSpec("name", "name", "string_name", "string_name")]
    for settings in (Settings(use_blocking=False), Settings(use_blocking=False, fallback_rows=0), Settings()):
        assert self_pairs(df, specs, settings).agg(F.count(F.lit(1)), F.sum("idx1")).first()[0] == n * (n - 1) // 2
    assert candidate_pairs(df.limit(2), df, specs, Settings(use_blocking=False)).count() == 2 * n
    # in blocked matching the bound of the reference stays
    assert candidate_pairs(df.limit(2), df, specs, Settings()).count() == 0
    assert candidate_pairs(df.limit(2), df.limit(n - 1), specs, Settings()).count() == 2 * (n - 1)
    assert self_pairs(df, specs, Settings(fallback_rows=0)).count() == 0


def test_long_suffixes_of_chosen_columns_give_keys(spark):
    columns = [{"source1": "name", "source2": "name"}, {"source1": "phone", "source2": "phone"}]
    settings = {"blocking_columns": ["phone"], "blocking_strategies": ["suffix_8"], "fallback_rows": 0, "threshold": 0.1, "return_all_matches": True}
    out = L.match(people(spark), people(spark, OTHERS), columns, settings, "id", "id")
    assert {(r["source1_index"], r["source2_index"]) for r in out.collect()} == {(1, 0)}
    with pytest.raises(ValueError, match="email"):
        L.match(people(spark), people(spark, OTHERS), columns, {**settings, "blocking_columns": ["email"]}, "id", "id")


def test_csv_values_over_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,name\n1,"Ann\nLee"\n2,Bob\n')
    assert sorted(r["name"] for r in load_source(spark, str(tmp_path / "m.csv"), multi_line=True).collect()) == ["ann lee", "bob"]


def test_components_of_a_long_path_and_a_star(spark):
    path = spark.range(999).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    star = spark.range(2001, 2300).select(F.lit(2000).cast("long").alias("u"), F.col("id").alias("v"))
    out = connected_components(path.unionByName(star).unionByName(star))
    assert {tuple(r) for r in out.groupBy("component").count().collect()} == {(0, 1000), (2000, 300)}


def test_search(spark):
    out = L.search({"name": "Mary Jones", "email": "mary@a.com"}, people(spark), settings={"threshold": 0.5}, key="id").collect()
    assert out[0]["master_id"] == 1 and out[0]["match_result"] == "accept"
    assert map_query({"Mail": "x", "x": ""}, people(spark)) == [{"source1": "Mail", "source2": "email", "weight": 1.0}]


@pytest.mark.parametrize(
    ("values", "name", "want"),
    [
        (["a@b.co"] * 3, "x", "email"), (["1980-01-15"] * 3, "dob", "phone"), (["1/5/80"] * 3, "d", "date"), (["blue"], "full_name", "string_name"),
        (["Anna Bell", "Tom Hay"], "x", "string_name"), (["robert k", "k"], "x", "string_name"), (["blue"], "x", "string_general"), ([], "name", "string_general"),
    ],
)
def test_types(values, name, want):
    assert detect_type(values, name) == want


def test_evaluation(spark):
    found = spark.createDataFrame([(0, 0), (1, 2), (1, 2)], "source1_index long, source2_index long")
    truth = spark.createDataFrame([(0, 0), (1, 1)], "source1_index long, source2_index long")
    r = L.evaluate(found, truth).first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["f1"]) == (1, 1, 1, 0.5)
    m = L.match(people(spark), people(spark, OTHERS), left_key="id", right_key="id")
    assert coverage(m, 4) > 0 and 0 <= false_positive_rate(m, 4) <= 1


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n,flag\n1," Ann  LEE ",5551234567,True\n2,N/A,,False\n')
    df = load_source(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "n": "bigint", "flag": "boolean"}
    assert [r["name"] for r in df.orderBy("id").collect()] == ["ann lee", ""]
    for kind in ("csv", "parquet", "json"):
        write_results(df, str(tmp_path / f"out.{kind}"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    with pytest.raises(FileNotFoundError):
        load_source(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        load_source(spark, {"table": "t"})


def test_a_cluster_must_name_its_checkpoint_folder(tmp_path, spark):
    from types import SimpleNamespace as Plain

    from lodestone.plans.lineage import ensure_checkpoint_dir, remove_folder

    def session(master, known):
        none = Plain(isDefined=lambda: False)
        sc = Plain(master=master, setCheckpointDir=lambda f: None, _jsc=Plain(sc=lambda: Plain(getCheckpointDir=lambda: none)))
        return Plain(sparkContext=sc, conf=Plain(get=lambda k, d: known))

    assert ensure_checkpoint_dir(session("yarn", "hdfs:///c")) == "hdfs:///c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session("spark://host:7077", None))
    (tmp_path / "x").mkdir()
    remove_folder(spark, str(tmp_path / "x"))
    remove_folder(spark, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_row_positions(spark):
    rows = with_index(spark.range(1000, numPartitions=7))
    assert [r["__idx"] for r in rows.orderBy("id").collect()] == list(range(1000))


def test_config_and_cli(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("name,email\nann lee,a@x.com\nbob ray,b@x.com\n")
    monkeypatch.setenv("WHERE", str(tmp_path))
    config = {"source1": "${WHERE}/a.csv", "source2": "${WHERE}/a.csv", "output": "${WHERE}/out.csv", "matching": {"threshold": 0.9}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config))
    assert validate_config(str(path))["source1"].endswith("a.csv")
    assert main([str(path)]) == 0
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == 2
    for bad in ({"mode": "clustering"}, {"mode": "search"}, {"matching": {"threshold": 2}}, {"source1": "${NOT_THERE_AT_ALL}"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            check_config({**config, **bad})
    with pytest.raises(FileNotFoundError):
        validate_config(str(tmp_path / "none.json"))


def test_stream_against_master(spark, tmp_path):
    from lodestone.streaming.matching import match_stream

    people(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, name string, email string, phone string").parquet(str(tmp_path / "in"))
    q = match_stream(stream, people(spark, OTHERS), str(tmp_path / "out"), str(tmp_path / "cp"), [{"source1": c, "source2": c} for c in ("name", "email")], left_key="id", right_key="id", once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("source1_index = 1").first()["source2_index"] == 0


def test_jobs(tmp_path):
    store = JobStore(str(tmp_path / "jobs"))
    store.save("a", {"x": 1})
    assert store.get("a")["config"] == {"x": 1} and len(store.list()) == 1 and store.delete("a") and not store.delete("a")
    ran = []
    q = JobQueue(lambda j: ran.append(j["name"]), workers=0, state=str(tmp_path / "q.json"))
    q.enqueue("low", {}, "low")
    gone = q.enqueue("gone", {})
    q.enqueue("high", {}, "high")
    assert [j["name"] for j in q.waiting()] == ["high", "gone", "low"] and q.position(gone) == 2
    assert q.cancel(gone) and q.is_cancelled(gone)
    again = JobQueue(lambda j: ran.append(j["name"]), workers=1, state=str(tmp_path / "q.json"))
    for _ in range(100):
        if len(ran) == 2:
            break
        time.sleep(0.05)
    again.stop()
    assert ran == ["high", "low"]


def test_cancel_interrupts_a_running_job(spark):
    slow = lambda j: spark.range(8, numPartitions=8).selectExpr("reflect('java.lang.Thread', 'sleep', 120000L) IS NULL AS x").collect() if j["config"]["slow"] else None
    q = JobQueue(slow, workers=1, spark=spark)
    key = q.enqueue("slow", {"slow": True})
    tracker = spark.sparkContext.statusTracker()
    for _ in range(200):
        if q.active() and tracker.getActiveJobsIds():
            break
        time.sleep(0.05)
    assert q.cancel(key)
    after = q.enqueue("after", {"slow": False})
    for _ in range(400):
        if q.status(after)["status"] == "completed":
            break
        time.sleep(0.05)
    q.stop()
    assert (q.status(key)["status"], q.status(after)["status"]) == ("cancelled", "completed")


def test_s3_problems(spark):
    for address in ("s3://", "s3://bucket", "s3:///key.csv"):
        with pytest.raises(ValueError, match="names no bucket or no key"):
            load_source(spark, address)
    said = {"NoSuchBucket: x": "no bucket b", "NoSuchKey": "nothing at s3://b/k.csv", "Status Code: 403": "no access", "No AWS Credentials provided": "no credentials", "odd": "cannot read s3://b/k.csv: odd"}
    for text, want in said.items():
        assert want in str(s3_problem("s3://b/k.csv", OSError(text)))
    with pytest.raises(ValueError, match="s3://b/k.csv"):
        load_source(spark, "s3://b/k.csv")


def test_shown_search_results(spark):
    master = people(spark)
    found = L.search({"name": "mary jones", "email": "mary@a.com"}, master, None, {"threshold": 0.6}, key="id")
    first = shown(found).split("\n")
    assert first[0] == "1. 1.000 accept" and "   name: mary jones" in first and not any("index" in line for line in first)
    assert shown(found.limit(0)) == "No row reaches the threshold."

"""Sources: CSV and Parquet by any path that Spark reads, JDBC tables, frames."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import NULL_TOKENS, clean
from lodestone.plans.lineage import cut

#: What a JDBC source must be told.
JDBC_KEYS = ("host", "user", "password", "database")


def clean_strings(df: DataFrame) -> DataFrame:
    """All string columns cleaned; null becomes the empty string."""
    return df.select(*[clean(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def with_index(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` with a long ``__idx``.

    With ``key`` it is that unique whole-number column.  Without one it is the
    0-based position of the row: ids that grow within a partition are shifted by
    the sizes of the partitions before it, from a table of one row a partition.  Rows
    are cut to shared storage first, so that positions hold when a part is lost.
    """
    if key is not None:
        return df.withColumn("__idx", F.col(key).cast("long"))
    rows = cut(df.withColumn("__mono", F.monotonically_increasing_id()))
    part = F.shiftright("__mono", 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    # a row for each partition of the input, whose number does not follow the rows' number
    shift = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __start long"))
    own = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(shift, part == F.col("__part")).withColumn("__idx", F.col("__start") + own).drop("__mono", "__part", "__start")


def is_s3(source) -> bool:
    return isinstance(source, str) and source.startswith(("s3://", "s3a://"))


def is_table(source, credentials: Mapping | None) -> bool:
    """A bare name with credentials at hand is a database table."""
    return isinstance(source, str) and bool(credentials) and "/" not in source and not source.endswith((".csv", ".parquet"))


def jdbc_options(credentials: Mapping) -> dict[str, str]:
    missing = [k for k in JDBC_KEYS if not credentials.get(k)]
    if missing:
        raise ValueError(f"Missing database credentials: {', '.join(missing)}")
    port = credentials.get("port", 3306)
    return {
        "url": f"jdbc:mysql://{credentials['host']}:{port}/{credentials['database']}",
        "user": credentials["user"], "password": credentials["password"], "driver": credentials.get("driver", "com.mysql.cj.jdbc.Driver"),
    }


def s3_options(spark: SparkSession, credentials: Mapping | None) -> None:
    """Explicit keys for s3a; without them the default provider chain holds."""
    if not credentials:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if credentials.get("aws_access_key_id"):
        conf.set("fs.s3a.access.key", credentials["aws_access_key_id"])
        conf.set("fs.s3a.secret.key", credentials["aws_secret_access_key"])
    conf.set("fs.s3a.endpoint.region", credentials.get("region_name", "us-east-1"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, types inferred, the usual null words as nulls.

    Large files are split among tasks.  Only with ``multi_line`` may a quoted value
    hold line breaks, and then each file is one task.
    """
    try:
        raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"CSV file not found: {path}") from e
        raise ValueError(f"Error reading CSV file: {e}") from e
    nulled = raw.select(*[F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return infer_types(nulled)


def s3_path(address: str) -> str:
    """The s3a form of an s3 address; one without a bucket or a key raises ValueError."""
    bucket, _, key = address.split("://", 1)[1].partition("/")
    if not bucket or not key:
        raise ValueError(f"{address} names no bucket or no key; write s3://bucket/key")
    return f"s3a://{bucket}/{key}"


def s3_problem(address: str, e: Exception) -> ValueError:
    """What is wrong with an s3 address, from the words of a failure."""
    bucket, said = address.split("://", 1)[1].partition("/")[0], str(e)
    known = (
        (("NoSuchBucket", "bucket does not exist"), f"there is no bucket {bucket}"),
        (("NoSuchKey", "PATH_NOT_FOUND", "FileNotFound", "CSV file not found"), f"there is nothing at {address}"),
        (("AccessDenied", "403", "Forbidden"), f"no access to {address}: check the keys and the rights of the role"),
        (("NoAuthWithAWS", "No AWS Credentials", "Unable to load credentials"), f"no credentials for {address}: give s3_credentials, or set them in the environment"),
    )
    return ValueError(next((text for words, text in known if any(w in said for w in words)), f"cannot read {address}: {said}"))


def infer_types(df: DataFrame) -> DataFrame:
    """Strings that all read as whole numbers, numbers or booleans take that type, in one pass."""
    tests = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(f"`{c}`"))
        tests += [
            F.count(x).alias(f"n{i}"), F.count(F.when(x.rlike(r"^[+-]?\d{1,18}$"), x)).alias(f"i{i}"),
            F.count(F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x)).alias(f"f{i}"),
            F.count(F.when(x.isin("True", "False", "true", "false", "TRUE", "FALSE"), x)).alias(f"b{i}"),
        ]
    seen = df.agg(*tests).first() if tests else {}
    out = []
    for i, c in enumerate(df.columns):
        n = seen[f"n{i}"]
        kind = "string" if not n else "long" if seen[f"i{i}"] == n else "double" if seen[f"f{i}"] == n else "boolean" if seen[f"b{i}"] == n else "string"
        x = F.col(f"`{c}`")
        out.append((x if kind == "string" else F.trim(x).cast(kind)).alias(c))
    return df.select(*out)


def _read_path(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, multi_line)


def load_source(spark: SparkSession, source, credentials: Mapping | None = None, s3_credentials: Mapping | None = None, cleaned: bool = True, multi_line: bool = False) -> DataFrame:
    """A frame from a path, an s3 address, a table name, a table object or a frame.

    ``multi_line``: CSV values may hold line breaks.  Strings are cleaned unless ``cleaned`` is false.  What is none of these
    raises ValueError.
    """
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, Mapping):
        reader = spark.read.format("jdbc").options(**jdbc_options({**(credentials or {}), **source}), dbtable=source["table"])
        if source.get("partition_column"):
            reader = reader.options(partitionColumn=source["partition_column"], lowerBound=source["lower_bound"], upperBound=source["upper_bound"], numPartitions=source.get("partitions", 64))
        df = reader.load()
    elif is_table(source, credentials):
        df = spark.read.format("jdbc").options(**jdbc_options(credentials), dbtable=source).load()
    elif isinstance(source, str):
        if is_s3(source):
            s3_options(spark, s3_credentials)
            try:
                df = _read_path(spark, s3_path(source), multi_line)
            except (PySparkException, Py4JError, OSError) as e:
                raise s3_problem(source, e) from e
        else:
            df = _read_path(spark, source, multi_line)
    else:
        raise ValueError(f"Unsupported source: {source!r}")
    return clean_strings(df) if cleaned else df

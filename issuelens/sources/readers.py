"""Sources: landed issue pages (JSON), issue CSV snapshots, prediction logs, uploads.

Every reader uses an explicit schema (no inference pass over the data) and
is a plain ``spark.read`` so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.functions import text as TX

# --------------------------------------------------------------- issue pages
LABEL_T = T.StructType([T.StructField("name", T.StringType())])
PAGE_ISSUE_SCHEMA = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("labels", T.ArrayType(LABEL_T)),
    T.StructField("comments", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("closed_at", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("pull_request", T.StringType()),
])
PAGE_SCHEMA = T.StructType(PAGE_ISSUE_SCHEMA.fields + [T.StructField("repo", T.StringType())])

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def land_issue_pages(issues: DataFrame, path: str) -> str:
    """Write issues as API-shaped JSON pages, one folder per repository.

    Stands in for the collection client: each repository's pages land under
    ``repo=<name>``; nulls are omitted from the records like absent keys.
    """
    pages = issues.select(
        "repo",
        F.col("number"),
        F.col("title"),
        F.col("body"),
        F.transform(F.col("labels"), lambda x: F.struct(x.alias("name"))).alias("labels"),
        F.col("comments"),
        F.date_format(F.col("created_at"), ISO).alias("created_at"),
        F.date_format(F.col("created_at") + F.expr("INTERVAL 1 HOUR"), ISO).alias("updated_at"),
        F.when(F.col("state") == "closed", F.date_format(F.col("created_at") + F.expr("INTERVAL 2 HOURS"), ISO)
               ).alias("closed_at"),
        F.col("state"),
        F.struct(F.col("author").alias("login")).alias("user"),
        F.when(F.col("is_pr"), F.concat(F.lit("https://api.example/pulls/"), F.col("number").cast("string"))
               ).alias("pull_request"),
    )
    pages.write.mode("overwrite").partitionBy("repo").json(path)
    return path


def read_issue_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages -> raw page rows (repo injected from the folder name)."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def normalize_issue_pages(pages: DataFrame) -> DataFrame:
    """Flat issue rows with the collection defaults.

    labels[].name joined with ", "; title/body/timestamps default "";
    comments 0; state and user.login default "unknown" (a null user keeps
    the row instead of dropping it).
    """
    names = F.transform(F.coalesce(F.col("labels"), F.array().cast(T.ArrayType(LABEL_T))),
                        lambda x: F.coalesce(x["name"], F.lit("")))
    return pages.select(
        F.col("number"),
        F.col("repo"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("body"), F.lit("")).alias("body"),
        F.array_join(names, ", ").alias("labels"),
        F.coalesce(F.col("comments"), F.lit(0)).cast("bigint").alias("comments"),
        F.coalesce(F.col("created_at"), F.lit("")).alias("created_at"),
        F.coalesce(F.col("updated_at"), F.lit("")).alias("updated_at"),
        F.coalesce(F.col("closed_at"), F.lit("")).alias("closed_at"),
        F.coalesce(F.col("state"), F.lit("unknown")).alias("state"),
        F.coalesce(F.col("user.login"), F.lit("unknown")).alias("user"),
        F.col("pull_request").isNotNull().alias("_is_pr"),
    )


# ------------------------------------------------------------------ CSV
ISSUE_CSV_SCHEMA = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("repo", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("comments", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("closed_at", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("user", T.StringType()),
])

# Whitespace trimming is on by default for CSV writes; values must round-trip exactly.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType = ISSUE_CSV_SCHEMA) -> DataFrame:
    """Header CSV with quoted multi-line bodies and doubled quotes.

    Whole-number columns are read as text first: frames with missing values
    are written as ``3.0`` or ``nan``, which must not read as null and 0.
    """
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.LongType) else f.dataType)
                         for f in schema])
    rows = spark.read.schema(text).options(**CSV_OPTIONS, mode="PERMISSIVE").csv(path)
    return rows.select(*[TX.whole_number(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.LongType)
                         else F.col(f.name) for f in schema])


# ------------------------------------------------------------ prediction log
PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("issue_number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("comments", T.LongType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probabilities", T.StructType([
        T.StructField("simple", T.DoubleType()),
        T.StructField("moderate", T.DoubleType()),
        T.StructField("complex", T.DoubleType()),
    ])),
])


def prediction_rows(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Rows of the prediction log."""
    return df.select(
        F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "repo", "issue_number", "title", "labels", "comments", "complexity", "confidence",
        F.struct(F.col("p_simple").alias("simple"), F.col("p_moderate").alias("moderate"),
                 F.col("p_complex").alias("complex")).alias("probabilities"),
    )


def prediction_record(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Rows -> one JSON text per prediction (the log line)."""
    rows = prediction_rows(df, ts_col)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """JSONL log; blank and malformed lines are dropped; a missing log reads as empty."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - existence check only
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], PREDICTION_LOG_SCHEMA)
    return spark.read.schema(PREDICTION_LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def flatten_prediction_log(log: DataFrame) -> DataFrame:
    return log.select(
        "timestamp", "repo", "issue_number", "title",
        F.array_join(F.col("labels"), ",").alias("labels"),
        "comments", "complexity", "confidence",
        F.col("probabilities.simple").alias("p_simple"),
        F.col("probabilities.moderate").alias("p_moderate"),
        F.col("probabilities.complex").alias("p_complex"),
    )


# ------------------------------------------------------------------ uploads
def upload_normalize(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploaded issue table -> (accepted scoring requests, rejected rows).

    Needs a ``title`` column (raises otherwise, like the form).  ``body``
    defaults to "", ``labels`` is comma text split and trimmed with blanks
    dropped (null-safe), ``comments`` defaults to 0; rows with a blank
    title go to the rejected side output.
    """
    cols = df.columns
    if "title" not in cols:
        raise ValueError("Missing required columns: ['title']")

    def opt(c, default=None, t="string"):
        if c not in cols:
            return F.lit(default).cast(t)
        return F.col(c).cast(t) if t == "string" else TX.whole_number(F.col(c))

    out = df.select(
        opt("number", None, "bigint").alias("number"),
        opt("repo").alias("repo"),
        opt("author").alias("author"),
        F.col("title").cast("string").alias("title"),
        F.coalesce(opt("body"), F.lit("")).alias("body"),
        TX.split_trim_list(opt("labels")).alias("labels"),
        F.coalesce(opt("comments", None, "bigint"), F.lit(0).cast("bigint")).alias("comments"),
    )
    ok = F.length(TX.py_strip(F.coalesce(F.col("title"), F.lit("")))) > 0
    return out.where(ok), out.where(~ok)

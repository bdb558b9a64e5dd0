"""Sources and sinks (S1–S9): typed readers, partitioned writers, judge request shards and their manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope import schema as S
from replyscope.functions import fixed, text


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The annotation table with its declared schema (no inference pass over the files)."""
    return spark.read.schema(S.ANNOTATIONS).parquet(path)


def read_gold(spark: SparkSession, path: str, reply_col: str = "generated_req_output") -> DataFrame:
    """S2 + P1/P2: the gold table, projected to (nat_instr_id, generated_req_output)."""
    df = spark.read.parquet(path)
    return df.select("nat_instr_id", F.col(reply_col).alias("generated_req_output"))


def read_runs(spark: SparkSession, path: str, mode: str | None = None, model: str | None = None,
              run: str | None = None) -> DataFrame:
    """S3: one run of a results dataset partitioned by ``mode/model/run`` — the filters prune partitions, so only
    the chosen folders are listed and read."""
    df = spark.read.parquet(path)
    for col, val in (("mode", mode), ("model", model), ("run", run)):
        if val is not None:
            df = df.where(F.col(col) == val)
    return df


def read_scores(spark: SparkSession, path: str, approach: str | None = None, models: Sequence[str] | None = None,
                modes: Sequence[str] | None = None) -> DataFrame:
    """Score rows of several runs from one dataset partitioned by ``approach/model/mode`` (partition pruning)."""
    df = spark.read.parquet(path)
    if approach is not None:
        df = df.where(F.col("approach") == approach)
    if models is not None:
        df = df.where(F.col("model").isin(*models))
    if modes is not None:
        df = df.where(F.col("mode").isin(*modes))
    return df


def read_scores_selected(spark: SparkSession, path: str, selection: DataFrame) -> DataFrame:
    """The rows of the runs that the table ``selection`` names by any of the dataset's partition columns (``approach``, ``model``,
    ``mode``, ``run``), with its further columns. The run table is joined on the partition columns, so only the folders of runs that it
    holds at run time are read (dynamic partition pruning); no run is named in the plan. One row of ``selection`` per run."""
    df = spark.read.parquet(path)
    by = [c for c in ("approach", "model", "mode", "run") if c in df.columns and c in selection.columns]
    if not by:
        raise ValueError("selection names none of the partition columns")
    return df.join(selection, by)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                sort_within: Sequence[str] = ()) -> None:
    """Write Parquet, partitioned by the given columns (dynamic partition overwrite keeps other partitions)."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report (tens of rows) as one CSV file with a header; only the finished rows move to one task."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def shard_of(row: Column, rows_per_shard: int = fixed.JUDGE_ROWS_PER_SHARD) -> Column:
    """The shard of a row: the first row id of its block of ``rows_per_shard`` ids."""
    return row - F.pmod(row, F.lit(rows_per_shard))


def judge_request_lines(prompts: DataFrame, model: str = fixed.JUDGE_REQUEST_MODEL,
                        rows_per_shard: int = fixed.JUDGE_ROWS_PER_SHARD, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """S8 + T13: one JSON request line per judge prompt: ``{custom_id, method, url, body: {model, messages,
    max_tokens}}``. ``custom_id`` is ``request-{row}-{k}``, followed by the other ``keys`` (the run), so ids of several runs stay
    apart; ``shard`` groups the rows of a run by blocks of ``rows_per_shard`` ids."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(fixed.JUDGE_SYSTEM_REQUESTS).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"),
                    F.lit(fixed.JUDGE_REQUEST_MAX_TOKENS).alias("max_tokens"))
    run = [k for k in keys if k != "row_id"]
    custom_id = F.concat_ws("-", text.request_id(F.col("row_id"), F.col("k")), *run)
    req = F.struct(
        custom_id.alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(fixed.JUDGE_REQUEST_URL).alias("url"),
        body.alias("body"),
    )
    return prompts.where(F.col("prompt").isNotNull()).select(
        *run,
        shard_of(F.col("row_id"), rows_per_shard).alias("shard"),
        custom_id.alias("custom_id"),
        F.to_json(req).alias("line"),
    )


def write_request_shards(lines: DataFrame, path: str) -> DataFrame:
    """S8 + S9: add the request lines that ``path`` does not hold yet (by ``custom_id``) and return the manifest of all published
    requests: ``(*run, shard, n_requests, n_bytes)``.

    The new lines go to a folder of their own, ``requests/commit=<id>`` (Parquet, ``shard`` a column, rows of a shard
    together and in order). They are published by the rows of ``manifest`` that name the commit, written last, in one file,
    and counted from the lines as stored. So a run that dies before leaves nothing that readers see, a rerun adds only
    what is missing, and one without anything new adds nothing. Lines repeated within the input count once."""
    import uuid

    spark, base = lines.sparkSession, path.rstrip("/")
    run = [c for c in lines.columns if c not in ("shard", "custom_id", "line")]
    new = lines.dropDuplicates(["custom_id"])
    if exists(spark, f"{base}/manifest"):
        new = new.join(read_requests(spark, base).select("custom_id"), "custom_id", "left_anti")
    folder = f"{base}/requests/commit={uuid.uuid4().hex}"
    new = new.select(*run, "shard", "custom_id", "line")
    new.repartition(*run, "shard").sortWithinPartitions(*run, "shard", "custom_id").write.parquet(folder)
    stored = spark.read.schema(new.schema).parquet(folder).groupBy(*run, "shard").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.octet_length("line") + F.lit(1)).alias("n_bytes"),
    )
    # One row per shard: few rows, in one file, so that a commit is published as a whole.
    stored.withColumn("commit", F.lit(folder.rsplit("=", 1)[1])).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return read_manifest(spark, base)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published requests and bytes per run and shard."""
    m = spark.read.parquet(f"{path.rstrip('/')}/manifest")
    by = [c for c in m.columns if c not in ("n_requests", "n_bytes", "commit")]
    return m.groupBy(*by).agg(F.sum("n_requests").alias("n_requests"), F.sum("n_bytes").alias("n_bytes"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The published request lines: those of the commits that the manifest names. Folders of other commits are not read (dynamic
    partition pruning on ``commit``)."""
    base = path.rstrip("/")
    commits = spark.read.parquet(f"{base}/manifest").where("n_requests > 0").select("commit").distinct()
    return spark.read.parquet(f"{base}/requests").join(commits, "commit", "left_semi").drop("commit")


def read_request_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The published request lines of one shard, one JSON text per row; the filter reaches the files."""
    return read_requests(spark, path).where(F.col("shard") == shard)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet dataset exists at ``path`` (any file system Spark can read). Only a missing or empty folder counts as
    none; any other failure to read is raised, so that finished work is never taken for missing."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir`` that nothing else uses; not made yet."""
    import uuid

    from replyscope.session import shared_dir

    return shared_dir(spark, f"tables/{name}-{uuid.uuid4().hex}")


def application_folder(spark: SparkSession, name: str) -> str:
    """The folder ``name`` of this Spark application under the shared ``spark.checkpoint.dir``, the same at each call."""
    from replyscope.session import shared_dir

    return shared_dir(spark, f"tables/{spark.sparkContext.applicationId}/{name}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet under the cluster's shared ``spark.checkpoint.dir`` and read it
    back, so later reports over the same table (e.g. scores used by several comparisons) do not recompute it, and a
    lost executor only re-reads files. Each call writes a fresh folder."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

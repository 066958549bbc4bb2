"""Writers. All are actions; tables go out as Parquet unless CSV is asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.staging import staged


def _save(df: DataFrame, path: str, fmt: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def write_splits(df: DataFrame, path: str, keys: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Features and target by split; entity keys stay behind."""
    _save(df.drop(*keys), path, fmt, by=["split"])


def write_split_files(df: DataFrame, folder: str, name: str, keys: Sequence[str] = ()) -> None:
    """{folder}/{name}_train.csv and _test.csv, the layout load_split reads; each is a folder of part files."""
    for split in ("train", "test"):
        _save(df.where(F.col("split") == split).drop("split", *keys), f"{folder.rstrip('/')}/{name}_{split}.csv", "csv")


def write_serialized(df: DataFrame, path: str, styles: Sequence[str] = tuple(spec.STYLE_COLUMNS), fmt: str = "parquet") -> None:
    """The texts of the chosen styles and the target label, by split when there is one."""
    texts = [c for s, c in spec.STYLE_COLUMNS.items() if s in styles]
    by = ["split"] if "split" in df.columns else []
    _save(df.select(*texts, "target_col", *by), path, fmt, by=by)


def write_responses(
    df: DataFrame, path: str, total_examples: int, batch_size: int, run_tag: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Answers by dataset, serialization and model; a run tag becomes part of the model name. Returns run metadata.

    Every answer is computed once: which runs there are is observed while writing, and they are counted from what was
    written. Parquet: one table partitioned by run, of which only the written runs are replaced. CSV: the layout that
    read_responses reads, {path}/{dataset}/{serialization}/{model}_raw_responses.csv, each a folder of part files.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    model = F.col("model") if run_tag is None else F.concat("model", F.lit(f"_{run_tag}"))
    keyed = df.withColumn("model", model)
    by = ["dataset", "serialization", "model"]
    if fmt == "csv":
        written = staged(keyed)
        for run in written.select(*by).distinct().collect():
            mine = written.where(F.struct(*by) == F.struct(*[F.lit(v) for v in run])).drop(*by)
            _save(mine, f"{root}/{run['dataset']}/{run['serialization']}/{run['model']}_raw_responses.csv", "csv")
        file = F.concat(F.lit(f"{root}/"), "dataset", F.lit("/"), "serialization", F.lit("/"), "model", F.lit("_raw_responses.csv"))
    else:
        seen = Observation()
        observed = keyed.observe(seen, F.collect_set(F.struct(*by)).alias("runs"))
        writer = observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        writer.format(fmt).save(root)
        runs = spark.createDataFrame([tuple(r) for r in seen.get["runs"]], "dataset string, serialization string, model string")
        written = spark.read.schema(keyed.schema).format(fmt).load(root).join(F.broadcast(runs), by, "left_semi")
        file = F.concat(F.lit(root), *[F.concat(F.lit(f"/{c}="), F.col(c)) for c in by])
    return written.groupBy(*by).agg(F.count("*").alias("n_examples")).withColumns(
        {
            "total_examples": F.lit(total_examples).cast("bigint"),
            "run_tag": F.lit(run_tag).cast("string"),
            "batch_size": F.lit(batch_size),
            "output_file": file,
        }
    )


def append_run_log(df: DataFrame, path: str) -> None:
    """Append finished runs with the time of writing and their order in this call, so that they survive an interruption of later ones."""
    logged = {"logged_at": F.current_timestamp(), "logged_row": F.monotonically_increasing_id()}
    df.withColumns(logged).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str, keys: Sequence[str] = spec.RESULT_KEY) -> DataFrame:
    """Latest row per run key: of the last call, and of rows of one call the last. Logs without that order are read, too."""
    from tabspark.operators.results import keep_last

    log = spark.read.option("mergeSchema", True).parquet(path)
    row = F.coalesce("logged_row", F.lit(-1)) if "logged_row" in log.columns else F.lit(-1)
    return keep_last(log, keys, F.struct("logged_at", row)).drop("logged_row")


def write_results(df: DataFrame, path: str, order: Sequence[str] = spec.RESULT_KEY, fmt: str = "csv") -> None:
    """One sorted result table."""
    _save(df.orderBy(*[c for c in order if c in df.columns]), path, fmt)


def write_run_metadata(spark: SparkSession, path: str, version: str, layer: int, seed: int, datasets: Sequence[str], parameters: Mapping) -> None:
    """One JSON row describing a run."""
    row = [(version, layer, seed, list(datasets), {k: str(v) for k, v in parameters.items()})]
    schema = "version string, layer_index int, seed int, datasets array<string>, parameters map<string,string>"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").json(path)

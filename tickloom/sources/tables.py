"""Table sources and sinks: parquet tables, keyed inserts and upserts, catalogs, model versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.columns import snake_case_columns
from tickloom.session import stage

TICK_KEYS = ("ticker", "trade_date", "sec")
FILL_KEYS = ("exec_time", "symbol")
TRADE_KEYS = ("trade_date", "entry_time")


def write_ticks(df: DataFrame, path: str, order: Sequence[str] = ("ticker", "sec"), files: int | None = None) -> None:
    """A4: parquet partitioned by day, sorted inside each file.

    Range partitioning on (day, order) cuts a large day into several files of equal size instead of
    sending a whole day to one task.
    """
    by = ["trade_date", *order]
    spread = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.partitionBy("trade_date").parquet(path)


def write_trades(df: DataFrame, path: str) -> None:
    """A4."""
    write_ticks(df, path, ("ticker", "entry_sec"))


def first_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the lowest ``order``; duplicates fold before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return g.select(*keys, "_r.*").select(*df.columns)


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows of ``batch`` to append: first row of each key that ``target`` does not hold.

    When the day is part of the key, only the days of the batch are read from a target partitioned by
    day (dynamic partition pruning through the semi join).
    """
    held = target.select(*keys)
    if "trade_date" in keys:
        held = held.join(batch.select("trade_date").distinct(), "trade_date", "left_semi")
    return first_by_key(batch, keys, order).join(held, list(keys), "left_anti").select(*batch.columns)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The partition columns of a stored table, from its folder names."""
    df = spark.read.parquet(path)
    part = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit("([^/=]+)=[^/]*/"))
    found = df.select(part.alias("p")).limit(1).collect()
    return [c for c in (found[0]["p"] if found else []) if c in df.columns]


def append_absent(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: str) -> None:
    """A6 on a stored table; new rows go to the table's own partitions.

    A batch without the table's partition columns fails.
    """
    by = partition_columns(spark, path)
    if missing := [c for c in by if c not in batch.columns]:
        raise ValueError(f"the table is partitioned by {missing}, which the batch lacks")
    new = stage(insert_absent(spark.read.parquet(path), batch, keys, order))
    new.write.mode("append").partitionBy(*by).parquet(path) if by else new.write.mode("append").parquet(path)


def upsert_stored(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], seq: str = "seq") -> None:
    """A7 on a stored table: only the partitions that the batch touches are read and written anew.

    The partition columns must be among the keys, so that a row's new version is in the partition of its old one. An unpartitioned table is written
    anew as a whole. The new rows are a written table before anything is replaced.
    """
    by = partition_columns(spark, path)
    if missing := [c for c in by if c not in keys]:
        raise ValueError(f"the table is partitioned by {missing}, which is no key")
    target = spark.read.parquet(path)
    held = target.join(batch.select(*by).distinct(), by, "left_semi") if by else target
    new = stage(upsert_latest(held, batch, keys, seq).select(*target.columns))
    writer = new.write.mode("overwrite")
    writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic").parquet(path) if by else writer.parquet(path)


def upsert_latest(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Union of both with the row of the highest ``seq`` per key (batch rows win ties)."""
    both = target.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_b"]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "_b")).alias("_r"))
    return g.select(*keys, "_r.*")


def read_catalog(catalog: DataFrame) -> DataFrame:
    """Newest first, reader column names, no file path."""
    return catalog.orderBy(F.desc("data_date")).select(
        "filename", F.lit(None).cast("string").alias("filepath"), "status", F.col("error_info").alias("reasons"), F.col("date_checked")
    )


# fixed values: stored name -> report header of the trade summary
SUMMARY_HEADERS = {
    "trade_date": "Date", "trade_id": "Trade Id", "ticker": "Ticker", "entry_time": "Entry Time", "exit_time": "Exit Time",
    "time_in_trade": "Time in Trade", "dollar_change": "Dollar Change", "running_percent_by_ticker": "Running Percent By Ticker",
    "running_percent_all": "Running Percent All", "total_investment": "Total Investment", "entry_price": "Entry Price",
    "exit_price": "Exit Price", "trade_type": "Trade Type", "qty": "Qty", "best_exit_price": "Best Exit Price",
    "best_exit_time_in_trade": "Best Exit Time In Trade", "worst_exit_price": "Worst Exit Price", "worst_exit_percent": "Worst Exit Percent",
    "worst_exit_time_in_trade": "Worst Exit Time In Trade", "entry_atr14": "Entry Atr14", "entry_atr28": "Entry Atr28",
    "entry_volatility_percent": "Entry Volatility Percent", "entry_volatility_ratio": "Entry Volatility Ratio", "entry_adx28": "Entry Adx28",
    "entry_adx14": "Entry Adx14", "entry_adx7": "Entry Adx7", "trade_holding_reached": "Trade Holding Reached",
    "trade_best_exit_percent": "Trade Best Exit Percent", "trade_percent_change": "Trade Percent Change",
}


def read_trade_summaries(trades: DataFrame) -> DataFrame:
    """By date and entry time, with report headers."""
    ordered = trades.orderBy("trade_date", "entry_time")
    return ordered.withColumnsRenamed({k: v for k, v in SUMMARY_HEADERS.items() if k in trades.columns})


def prepare_summaries(df: DataFrame, day: str = "date") -> DataFrame:
    """A10: report headers to stored names, 'MM-DD-YY' text to a date."""
    return snake_case_columns(df).withColumn("trade_date", F.to_date(F.try_to_timestamp(day, F.lit("MM-dd-yy")))).drop(day)


def upload_trade_summaries(target: DataFrame, df: DataFrame, order: str = "trade_id") -> DataFrame:
    """A10: the prepared rows that the table does not hold yet."""
    return insert_absent(target, prepare_summaries(df), TRADE_KEYS, order)


def next_model_versions(diagnostics: DataFrame, models: DataFrame) -> DataFrame:
    """Highest version + 0.01 per model; 0.10 for a model without one."""
    last = diagnostics.groupBy("model_name").agg(F.max("version_id").alias("_v"))
    start = F.lit("0.09").cast("decimal(4,2)")
    return models.select("model_name").join(last, "model_name", "left").select(
        "model_name", (F.coalesce("_v", start) + F.lit("0.01").cast("decimal(4,2)")).cast("decimal(4,2)").alias("version_id")
    )


# fixed values: statistic columns of the diagnostics table, by prefix
DIAGNOSTIC_COLUMNS = {
    "response_dist": (
        "count", "min", "max", "mean", "median", "std_dev", "p1", "p5", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "skewness",
        "kurtosis_excess", "frac_lt_0", "frac_ge_target", "frac_between_0_0p1",
    ),
    "all_samples": (
        "data_points_count", "unique_trades_count", "mean_residual", "std_deviation_of_residuals", "min_residual", "max_residual",
        "correlation_btw_fitted_residuals", "variance_ratio_high_low_fitted_values",
    ),
    "per_trade": (
        "trades_count", "mean_residual", "std_deviation_of_residuals", "min_residual", "max_residual", "correlation_btw_fitted_residuals",
        "variance_ratio_high_low_fitted_values",
    ),
    "trade_test": (
        "trades", "overall_roi_total", "days", "avg_per_trade", "avg_per_trade_divided_by_6", "overall_avg_per_day_BAD_METRIC",
        "overall_avg_per_day_divided_by_6_BAD_METRIC", "avg_red_day", "avg_green_day",
    ),
}


def flatten_diagnostics(nested: DataFrame, keep: Sequence[str] = ("model_name", "version_id")) -> DataFrame:
    """Struct columns named by prefix -> the known wide columns; absent fields are null, unknown
    fields are dropped. A response distribution may hold its percentiles in a ``percentiles`` struct."""
    cols: list[Column] = [F.col(c) for c in keep]
    fields = {f.name: f.dataType for f in nested.schema.fields}
    for prefix, names in DIAGNOSTIC_COLUMNS.items():
        have = set(fields[prefix].names) if prefix in fields else set()
        inner = set(fields[prefix]["percentiles"].dataType.names) if "percentiles" in have else set()
        for n in names:
            if n in have:
                c = F.col(f"{prefix}.{n}")
            elif n in inner:
                c = F.col(f"{prefix}.percentiles.{n}")
            else:
                c = F.lit(None)
            cols.append(c.cast("double").alias(f"{prefix}_{n}"))
    return nested.select(*cols)


def bulk_load(target: DataFrame, source: DataFrame, mapping: Mapping[str, str], dates: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """The listed dates of a source with its columns mapped; a missing column is an error."""
    missing = [c for c in mapping if c not in source.columns]
    if missing:
        raise ValueError(f"source misses columns: {missing}")
    picked = source.where(F.col("trade_date").isin(*[F.to_date(F.lit(d)) for d in dates]))
    return insert_absent(target, picked.select(*[F.col(a).alias(b) for a, b in mapping.items()]), keys, order)

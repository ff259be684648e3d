"""Family C: checks of tick and trade files, one status row per file.

A tick file is a set of rows (filename, line, ...). Gaps are measured in line order; a file may be
large, so its lines are handled in blocks of lines (operators.blocks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.operators import blocks
from tickloom.session import MARKET_HOURS, SessionSpec

# fixed values: accepted headers of tick files and of broker reports, file name parts
TICK_HEADER = ("Ticker", "Price", "Val", "Avg", "Atr14", "Atr28", "Rsi", "Volume", "Adx28", "Adx14", "Adx7", "Volatility Percent", "Volatility Ratio", "Time")
TICK_HEADER_WARMUP = TICK_HEADER[:12] + ("Early Morning Atr Warmup Fix",) + TICK_HEADER[12:]
REPORT_HEADER = ("Exec Time", "Spread", "Side", "Qty", "Pos Effect", "Symbol", "Exp", "Strike", "Type", "Price", "Net Price", "Price Improvement", "Order Type")
TICK_SUFFIX = "_Raw_Market_Data.csv"
ON_DEMAND = "On_Demand"
LINES_PER_BLOCK = 100_000


def _pad2(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def normalize_tick_filename(name: Column) -> Column:
    """struct(status ok / changed / bad, filename) from the first date token between underscores."""
    token = r"(?:^|_)(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})(?=_|\.csv$)"
    part = lambda i: F.regexp_extract(name, token, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    canonical = F.concat(_pad2(part(1)), F.lit("-"), _pad2(part(2)), F.lit("-"), year, F.lit(TICK_SUFFIX))
    found = part(3) != ""
    return F.struct(
        F.when(~found, "bad").when(canonical == name, "ok").otherwise("changed").alias("status"),
        F.when(found, canonical).alias("filename"),
    )


def normalize_trade_filename(name: Column) -> Column:
    """MM-DD-YYYY-TradeActivity[_On_Demand].csv; repairs a bare date, unpadded parts and ISO order.
    The date must exist."""
    # ISO order, then a bare date, then padding; whatever is not canonical afterwards is bad
    fixed = F.regexp_replace(name, r"^(\d{4})-(\d{2})-(\d{2})(-TradeActivity(?:_On_Demand)?\.csv)$", "$2-$3-$1$4")
    fixed = F.regexp_replace(fixed, r"^(\d{2}-\d{2}-\d{4})\.csv$", "$1-TradeActivity.csv")
    fixed = F.regexp_replace(fixed, r"^(\d)-", "0$1-")
    fixed = F.regexp_replace(fixed, r"^(\d{2})-(\d)-", "$1-0$2-")
    day = F.try_to_timestamp(F.regexp_extract(fixed, r"^(\d{2}-\d{2}-\d{4})-TradeActivity(?:_On_Demand)?\.csv$", 1), F.lit("MM-dd-yyyy"))
    canonical = F.when(day.isNotNull(), fixed)
    return F.struct(
        F.when(canonical.isNull(), "bad").when(canonical == name, "ok").otherwise("changed").alias("status"),
        canonical.alias("filename"),
    )


def exclude_on_demand(files: DataFrame) -> DataFrame:
    """On-demand files fail with a fixed reason."""
    return files.where(F.col("filename").contains(ON_DEMAND)).select("filename", F.lit("on demand data").alias("reason"))


def check_header(lines: DataFrame, headers: Sequence[Sequence[str]] = (TICK_HEADER, TICK_HEADER_WARMUP)) -> DataFrame:
    """C4: lines (filename, line, text) -> one row per problem: a wrong first line, or a repeated header."""
    accepted = [",".join(h) for h in headers]
    is_header = F.trim("text").isin(*accepted)
    wrong = (F.col("line") == 1) & ~is_header
    again = (F.col("line") > 1) & is_header
    return lines.where(wrong | again).select("filename", "line", F.when(wrong, "wrong header").otherwise("repeated header").alias("problem"))


def check_ticker_counts(rows: DataFrame, tolerance: int = 5) -> DataFrame:
    """Difference between the largest and the smallest ticker of a file; bad from ``tolerance`` on."""
    per = rows.groupBy("filename", "ticker").agg(F.count("ticker").alias("_n"))
    spread = F.max(F.when(F.col("ticker").isNotNull(), F.col("_n"))) - F.min(F.when(F.col("ticker").isNotNull(), F.col("_n")))
    return per.groupBy("filename").agg(F.countDistinct("ticker").alias("tickers"), spread.alias("spread")).withColumn(
        "ok", (F.col("tickers") > 0) & F.coalesce(F.col("spread") < tolerance, F.lit(False))
    )


def line_gaps(rows: DataFrame, by_ticker: bool = False, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Time since the previous line of the file (optionally of the same ticker)."""
    keys = ["filename", "ticker"] if by_ticker else ["filename"]
    block = F.floor(F.col("line") / lines_per_block)
    prev = blocks.carry_value(rows, keys, block, ["line"], F.col("sec"), "prev_sec", inclusive=False)
    return prev.withColumn("gap", F.col("sec") - F.col("prev_sec")).drop("prev_sec")


def check_time_gaps(rows: DataFrame, gap: int = 7, by_ticker: bool = False) -> DataFrame:
    """(filename, line, gap) where a line is ``gap`` seconds or more after the line before."""
    return line_gaps(rows.select("filename", "line", "sec", *(["ticker"] if by_ticker else [])), by_ticker).where(F.col("gap") >= gap).select("filename", "line", "gap")


def check_open_coverage(rows: DataFrame, minimum: int = 20, window: int = 60, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """Rows in the first ``window`` seconds of the session."""
    inside = F.col("sec").between(session.open_sec, session.open_sec + window - 1)
    return rows.groupBy("filename").agg(F.count(F.when(inside, 1)).alias("open_rows")).withColumn("ok", F.col("open_rows") >= minimum)


def assert_no_gap(rows: DataFrame, limit: int = 6) -> DataFrame:
    """Largest step per file; a step above ``limit`` is an error."""
    g = line_gaps(rows.select("filename", "line", "sec")).groupBy("filename").agg(F.max("gap").alias("largest_gap"))
    text = F.concat(F.lit("time gap in "), F.col("filename"))
    return g.withColumn("largest_gap", F.when(F.col("largest_gap") > limit, F.raise_error(text).cast("int")).otherwise(F.col("largest_gap")))


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def check_required_values(rows: DataFrame, cols: Sequence[str], first: int = 5) -> DataFrame:
    """Per file the missing values per column and the first lines that miss any.

    The rank filter keeps at most ``first`` lines per file in each task before the shuffle.
    """
    any_missing = F.lit(False)
    for c in cols:
        any_missing = any_missing | _missing(c)
    counts = rows.groupBy("filename").agg(*[F.count(F.when(_missing(c), 1)).alias(f"missing_{c}") for c in cols])
    w = Window.partitionBy("filename").orderBy("line")
    top = rows.where(any_missing).select("filename", "line").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first)
    lines = top.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("first_lines"))
    return counts.join(lines, "filename", "left")


def check_report_columns(headers: DataFrame) -> DataFrame:
    """(filename, header text) -> ok when it is exactly the broker header."""
    return headers.select("filename", (F.split("header", ",") == F.array(*[F.lit(c) for c in REPORT_HEADER])).alias("ok"))


def apply_waivers(failures: DataFrame, waivers: DataFrame, keys: Sequence[str] = ("filename", "line")) -> DataFrame:
    """C11: drops only the waived rows."""
    return failures.join(waivers, list(keys), "left_anti")


def validate_files(files: DataFrame, failures: Sequence[DataFrame], checked: Column) -> DataFrame:
    """Failures (filename, reason) -> one row per file: status, sorted distinct reasons, date.

    A file has a handful of distinct reasons, so the collected set stays small.
    """
    every = failures[0].select("filename", "reason")
    for f in failures[1:]:
        every = every.unionByName(f.select("filename", "reason"))
    reasons = every.groupBy("filename").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return files.join(reasons, "filename", "left").select(
        "filename", F.when(F.col("reasons").isNull(), "validated-cleaned").otherwise("error").alias("status"), "reasons", checked.alias("date_checked")
    )


def tick_failures(rows: DataFrame, files: DataFrame, required: Sequence[str], tolerance: int = 5, gap: int = 7, minimum: int = 20,
                  window: int = 60, session: SessionSpec = MARKET_HOURS, waivers: DataFrame | None = None) -> list[DataFrame]:
    """The checks of a tick file as (filename, reason) frames; gap rows are counted after waivers."""
    gaps = check_time_gaps(rows, gap)
    if waivers is not None:
        gaps = apply_waivers(gaps, waivers)
    reason = lambda df, text: df.select("filename", F.lit(text).alias("reason"))
    names = files.where(normalize_tick_filename(F.col("filename"))["status"] == "bad")
    found = file_profile(rows, required, window, session).select("filename", F.explode(F.array_compact(F.array(
        F.when((F.col("tickers") == 0) | (F.col("spread") >= tolerance), "ticker counts differ"),
        F.when(F.col("open_rows") < minimum, "open not covered"),
        F.when(F.col("missing_rows") > 0, "missing values"),
    ))).alias("reason"))
    return [exclude_on_demand(files), reason(names, "bad filename"), reason(gaps.select("filename").distinct(), "time gaps"), found]


def file_profile(rows: DataFrame, required: Sequence[str], window: int, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """Ticker counts, open coverage and missing values of every file from one scan."""
    inside = F.col("sec").between(session.open_sec, session.open_sec + window - 1)
    per = rows.groupBy("filename", "ticker").agg(
        F.count("ticker").alias("_n"), F.count(F.when(inside, 1)).alias("_open"), F.count(F.when(_any(required), 1)).alias("_miss")
    )
    known = F.when(F.col("ticker").isNotNull(), F.col("_n"))
    return per.groupBy("filename").agg(
        F.count("ticker").alias("tickers"), (F.max(known) - F.min(known)).alias("spread"), F.sum("_open").alias("open_rows"), F.sum("_miss").alias("missing_rows")
    )


def _any(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | _missing(c)
    return out


def usable_dates(df: DataFrame, catalog: DataFrame, key: str = "trade_date") -> DataFrame:
    """C14: rows of dates whose file passed."""
    return df.join(catalog.where("status = 'validated-cleaned'").select(key).distinct(), key, "left_semi")


def count_valid_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Row count per file, null for files in error."""
    n = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("_n"))
    return catalog.join(n, "filename", "left").select("filename", "status", F.when(F.col("status") != "error", F.col("_n")).alias("data_rows"))


def has_ticks_for_trade(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """Whether the ticker has a tick at or after the entry of the trade."""
    last = ticks.groupBy("ticker", "trade_date").agg(F.max("sec").alias("_last"))
    return trades.join(last, ["ticker", "trade_date"], "left").withColumn("has_ticks", F.coalesce(F.col("entry_sec") <= F.col("_last"), F.lit(False))).drop("_last")


def validate_training_input(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """C17: row and null counts of the required columns; absent columns are an error."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"training input misses columns: {absent}")
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in required]
    return df.agg(F.count(F.lit(1)).alias("n"), *nulls)

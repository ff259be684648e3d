"""Family B: projections and scalar column operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numbers import pct_of, round_to
from tickloom.operators import blocks
from tickloom.session import MARKET_HOURS, SessionSpec


def drop_if_exists(df: DataFrame, *names: str) -> DataFrame:
    """B1."""
    return df.drop(*names)


def repair_shifted_columns(df: DataFrame) -> DataFrame:
    """B2: a file whose last columns slipped by one: vol percent holds the time, ratio the vol percent."""
    return df.select(
        *[c for c in df.columns if c not in ("time", "vol", "ratio")],
        F.col("ratio").try_cast("double").alias("vol"),
        round_to(F.try_divide(F.col("atr14"), F.col("atr28"))).alias("ratio"),
        F.col("vol").alias("time"),
    )


def filter_ticker(df: DataFrame, *tickers: str) -> DataFrame:
    """B3."""
    return df.where(F.col("ticker").isin(*tickers))


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """B4."""
    return df.select(*names)


def reorder_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns first, in that order, then the others."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Skipped when ``old`` is absent."""
    return df.withColumnRenamed(old, new)


def normalize_numeric_text(text: Column) -> Column:
    """B7: '1.500' -> '1.5', '2.0' -> '2'; text that is not a number stays."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(r"^[+-]?\d+\.\d+$"), plain).otherwise(text)


def round_columns(df: DataFrame, names: Sequence[str], digits: int) -> DataFrame:
    """Missing columns are skipped, nulls stay."""
    present = [n for n in names if n in df.columns]
    return df.withColumns({n: round_to(n, digits) for n in present})


def volatility_percent(atr14: Column, price: Column) -> Column:
    """B9."""
    return pct_of(atr14, price)


def volatility_ratio(atr14: Column, atr28: Column) -> Column:
    """B10."""
    return round_to(F.try_divide(atr14, atr28))


def warmup_vol_fix(vol: Column, sec: Column, session: SessionSpec = MARKET_HOURS) -> Column:
    """The first minutes of the session scaled up; null from minute 14 on."""
    m = F.floor(sec / 60) - session.open_minute
    # fixed values: factor per minute range
    return F.when(m < 9, round_to(vol * 1.8)).when(m < 12, round_to(vol * 1.6)).when(m < 14, round_to(vol * 1.2))


def effective_vol(vol: Column, warmup: Column, sec: Column, session: SessionSpec = MARKET_HOURS) -> Column:
    """The warm-up column during the first 14 minutes, else vol."""
    return F.when(sec < session.open_sec + 840, warmup).otherwise(vol)


def shift_times(df: DataFrame, keys: Sequence[str], correct_start: int) -> DataFrame:
    """Moves all times of a file so that its first row starts at ``correct_start``.

    The first time of a file is one aggregated row, joined back; the file is not sorted.
    """
    first = df.groupBy(*keys).agg(F.min_by("sec", "line").alias("_first"))
    return df.join(first, list(keys)).withColumn("sec", (F.col("sec") - F.col("_first") + correct_start).cast("int")).drop("_first")


def snake_case(name: str) -> str:
    return "_".join(name.strip().lower().replace("-", " ").split())


def snake_case_columns(df: DataFrame) -> DataFrame:
    """B19: 'Entry Time' -> entry_time."""
    return df.toDF(*[snake_case(c) for c in df.columns])


def underscore_columns(df: DataFrame) -> DataFrame:
    """B19: 'Entry Time' -> Entry_Time."""
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def clean_qty(text: Column) -> Column:
    """B20: '+4' -> 4."""
    return F.regexp_replace(F.trim(text), r"^\+", "").try_cast("double").cast("int")


def clean_price(text: Column) -> Column:
    """B20."""
    return F.trim(text).try_cast("double")


def side_code(side: Column) -> Column:
    """Buy 1, short 0, anything else null."""
    return F.when(side == "buy", 1).when(side == "short", 0)


def bool_code(flag: Column) -> Column:
    return F.when(flag, 1).when(~flag, 0)


def target_code(text: Column) -> Column:
    """Outcome text -> class; an unmapped value is an error."""
    # fixed values: outcome classes
    return (
        F.when(text == "-0.5", 0).when(text.isin("-0.1", "neither"), 1).when(text == "0.9", 2)
        .otherwise(F.raise_error(F.concat(F.lit("unmapped target value: "), F.coalesce(text, F.lit("null")))).cast("int"))
    )


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based alphabetical code of a category.

    Codes are numbered over ranges of the distinct values and joined back.
    """
    values = blocks.in_ranges(df.select(column).where(F.col(column).isNotNull()).distinct(), [column])
    codes = blocks.row_numbers(values, [], F.col("_range"), [column], "_rn").select(column, (F.col("_rn") - 1).cast("int").alias(out))
    return df.join(codes, column, "left").na.fill({out: -1})


def model_features(minutes: Column, vol: Column) -> list[Column]:
    """Hours since open and log(1 + vol)."""
    return [(minutes / F.lit(60.0)).alias("hours"), F.log1p(vol).alias("log_vol")]


def abs_features(macd: Column, rsi: Column) -> list[Column]:
    """B23."""
    return [F.abs(macd).alias("macd_abs"), round_to(F.abs(rsi - F.lit(50.0)), 2).alias("rsi_distance")]


def drop_leaky_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drops result columns; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {missing}")
    return df.drop(*names)


def round_key(key: Column) -> Column:
    """Numeric parts of an 'a|b|c' key with one decimal, other parts unchanged."""

    def part(p: Column) -> Column:
        number = p.try_cast("double")
        return F.when(number.isNull(), p).otherwise(F.format_string("%.1f", round_to(number, 1)))

    return F.array_join(F.transform(F.split(key, r"\|"), part), "|")


def parse_ladder(text: Column) -> Column:
    """B26: 'a|b|c' -> array of doubles; blank or null -> empty array."""
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p).try_cast("double"))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.expr("cast(array() as array<double>)")).otherwise(parts)

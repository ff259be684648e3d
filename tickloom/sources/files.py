"""Text sources and sinks: tick CSV files, broker reports, summary CSV, file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.functions.clock import hms_to_sec, parse_mdy
from tickloom.functions.columns import clean_price, clean_qty
from tickloom.operators import blocks
from tickloom.operators.trades import dense_trade_id
from tickloom.operators.validate import REPORT_HEADER

_TICK_FIELDS = [
    ("ticker", "string"), ("price", "double"), ("macd_val", "double"), ("macd_avg", "double"), ("atr14", "double"), ("atr28", "double"),
    ("rsi", "int"), ("volume", "int"), ("adx28", "int"), ("adx14", "int"), ("adx7", "int"), ("volatility_percent", "double"),
    ("volatility_ratio", "double"), ("time", "string"),
]
_WARMUP = ("vol_warmup", "double")


# the accepted column heads of a tick file and their canonical names (fixed values of the format)
TICK_HEADS = {
    "Ticker": "ticker", "Price": "price", "Val": "macd_val", "Avg": "macd_avg", "Atr14": "atr14", "Atr28": "atr28", "Rsi": "rsi", "Volume": "volume",
    "Adx28": "adx28", "Adx14": "adx14", "Adx7": "adx7", "Volatility Percent": "volatility_percent", "Early Morning Atr Warmup Fix": "vol_warmup",
    "Volatility Ratio": "volatility_ratio", "Time": "time",
}


def read_ticks_csv(spark: SparkSession, paths: str | Sequence[str], warmup: bool | None = None, sep: str = ",") -> DataFrame:
    """A1: headered tick CSV, columns taken by the names in each file's own header.

    Files of the 14- and the 15-column form and files with reordered columns may be read in one call; ``vol_warmup`` is null in the short
    form. With ``warmup`` given, a file of the other form fails. A header with an unknown, repeated or missing name fails. Lines that do not parse keep their text in ``_corrupt_record``.
    Files are split for reading as usual: each line meets its file's header in a join on the file path.
    """
    schema = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in [*_TICK_FIELDS, _WARMUP]))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumn("_start", F.monotonically_increasing_id())
    first = lines.where(F.col("_block") == 0).groupBy("path").agg(F.min_by("value", "_start").alias("head"))
    names = F.transform(F.split("head", sep), lambda x: F.trim(F.regexp_replace(x, "[\"\ufeff\r]", "")))
    known = F.create_map(*[F.lit(x) for pair in TICK_HEADS.items() for x in pair])
    short = F.array_sort(F.array(*[F.lit(h) for h in TICK_HEADS if h != "Early Morning Atr Warmup Fix"]))
    full = F.array_sort(F.array(*[F.lit(h) for h in TICK_HEADS]))
    ok = F.lit(False)
    for form in [short] * (not warmup) + [full] * (warmup is not False):
        ok = ok | (F.array_sort("names") == form)
    heads = first.withColumn("names", names).withColumn("order", F.when(ok, F.transform("names", lambda x: F.try_element_at(known, x))).otherwise(F.raise_error(F.concat(F.lit("unknown tick header: "), "head"))))
    rows = lines.join(heads.select("path", "head", "order"), "path").where((F.col("value") != F.col("head")) & (F.length("value") > 0))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(TICK_HEADS) + 1)), {"sep": sep})
    rows = rows.withColumn("_c", F.array(*[cells[f"c{i}"] for i in range(len(TICK_HEADS) + 1)]))
    at = lambda n: F.get("_c", F.array_position("order", n).cast("int") - 1)
    typed = [F.when(F.array_position("order", f.name) > 0, at(f.name).try_cast(f.dataType)).alias(f.name) for f in schema]
    bad = F.lit(False)
    for f in schema:
        bad = bad | ((F.array_position("order", f.name) > 0) & at(f.name).isNotNull() & at(f.name).try_cast(f.dataType).isNull())
    bad = bad | F.get("_c", F.size("order")).isNotNull() | F.get("_c", F.size("order") - 1).isNull()
    out = rows.select(*typed, F.when(bad, F.col("value")).alias("_corrupt_record"), "file_name")
    return out.withColumn("sec", hms_to_sec(F.col("time")))


def date_from_filename(name: Column) -> Column:
    """A2: the date in <date>_..., ..._<date>.csv or <date>-... names."""
    return parse_mdy(F.regexp_extract(name, r"(\d{1,2}-\d{1,2}-(?:\d{4}|\d{2}))(?:[_.-]|$)", 1))


def with_file_date(df: DataFrame, name: str = "file_name") -> DataFrame:
    """A2: trade_date from the file name, and date + time of day as a timestamp without zone."""
    dated = df.withColumn("trade_date", date_from_filename(F.col(name)))
    d, s = F.col("trade_date"), F.col("sec")
    stamp = F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("decimal(16,6)"))
    return dated.withColumn("date_time", stamp) if "sec" in df.columns else dated


_REPORT_SCHEMA = ", ".join(f"c{i} string" for i in range(len(REPORT_HEADER)))
_FILL_NAMES = ("exec_time", "spread", "side", "qty", "pos_effect", "symbol", "exp", "strike", "type", "price", "net_price", "price_improvement", "order_type")


def parse_trade_reports(reports: DataFrame, name: str = "file_name", text: str = "value") -> DataFrame:
    """A3: whole report texts -> fills.

    The filled-orders block starts at the 'Exec Time' header and ends before a blank line or 'Canceled
    Orders'. One or two leading commas are cut. A report is one row, so lines keep their order without
    a shuffle.
    """
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    numbered = F.transform(F.col("_l"), lambda x, i: F.struct(i.alias("i"), x.alias("t")))
    r = reports.select(name, lines.alias("_l")).withColumn("_n", numbered)
    r = r.withColumn("_head", F.array_min(F.transform(F.filter("_n", lambda e: e["t"].rlike("^,{0,2}Exec Time")), lambda e: e["i"])))
    stop = F.filter("_n", lambda e: (e["i"] > F.col("_head")) & ((e["t"] == "") | e["t"].startswith("Canceled Orders")))
    r = r.where("_head is not null").withColumn("_end", F.coalesce(F.array_min(F.transform(stop, lambda e: e["i"])), F.size("_l")))
    body = F.slice("_n", F.col("_head") + F.lit(2), F.greatest(F.col("_end") - F.col("_head") - 1, F.lit(0)))
    rows = r.select(name, F.explode(body).alias("e")).select(
        name, F.col("e.i").alias("line"), F.from_csv(F.regexp_replace("e.t", "^,{1,2}", ""), _REPORT_SCHEMA).alias("c")
    )
    f = rows.select(name, "line", *[F.col(f"c.c{i}").alias(n) for i, n in enumerate(_FILL_NAMES)])
    stamp = F.coalesce(F.try_to_timestamp("exec_time", F.lit("M/d/yy HH:mm:ss")), F.try_to_timestamp("exec_time", F.lit("MM-dd-yyyy HH:mm:ss")))
    return f.withColumns({
        "exec_time": stamp.cast("timestamp_ntz"), "qty": clean_qty(F.col("qty")),
        "price": clean_price(F.col("price")), "net_price": clean_price(F.col("net_price")),
    })


def report_headers(reports: DataFrame, name: str = "file_name", text: str = "value") -> DataFrame:
    """The header line of each report (null if it has none), for check_report_columns."""
    found = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x).rlike("^,{0,2}Exec Time"))
    return reports.select(name, F.regexp_replace(F.trim(F.try_element_at(found, F.lit(1))), "^,{1,2}", "").alias("header"))


def read_trade_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A3."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return parse_trade_reports(whole)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """A5."""
    df.write.option("header", True).csv(path)


def new_files(catalog: DataFrame, listing: DataFrame, recheck: bool = False) -> DataFrame:
    """Listed files that are not tracked, plus failed ones when rechecking."""
    fresh = listing.join(catalog, "filename", "left_anti").select("filename")
    if not recheck:
        return fresh
    failed = listing.join(catalog.where("status = 'error'"), "filename", "left_semi").select("filename")
    return fresh.unionByName(failed)


def matched_days(trade_files: DataFrame, tick_files: DataFrame) -> DataFrame:
    """One trade file and one tick file per date that has both (first name by order)."""
    def dated(df: DataFrame, out: str) -> DataFrame:
        return df.select(date_from_filename(F.col("filename")).alias("trade_date"), "filename").where("trade_date is not null").groupBy("trade_date").agg(F.min("filename").alias(out))

    return dated(trade_files, "trade_file").join(dated(tick_files, "tick_file"), "trade_date")


def route_by_status(df: DataFrame, path: str) -> None:
    """Approved and erroneous rows in their own folders; an existing destination is an error."""
    df.write.mode("errorifexists").partitionBy("status").parquet(path)


def split_at_ordinal(lines: DataFrame, n: int, keys: Sequence[str] = ("filename",), order: str = "line") -> tuple[DataFrame, DataFrame]:
    """The first ``n`` lines of each file, and the rest."""
    numbered = blocks.row_numbers(lines, list(keys), F.floor(F.col(order) / 100_000), [order], "_rn")
    return numbered.where(F.col("_rn") <= n).drop("_rn"), numbered.where(F.col("_rn") > n).drop("_rn")


def combine_daily(spark: SparkSession, folder: str, schema: str, pattern: str = "summary*") -> DataFrame:
    """All daily summary files (bulk files do not match the pattern, empty files give no rows),
    with ids 1..n by date and entry time."""
    df = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).csv(folder)
    return dense_trade_id(df)

"""Queries of family A. Files are written below the shared folder from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.clock import sec_to_hms
from tickloom.functions.columns import volatility_percent, volatility_ratio
from tickloom.operators import stats
from tickloom.operators.validate import TICK_HEADER, TICK_HEADER_WARMUP
from tickloom.plans.fixtures import view
from tickloom.plans.q_stats import _SUM
from tickloom.plans.q_validate import CATALOG, LINES, tick_catalog, tick_lines
from tickloom.plans.registry import query, rint
from tickloom.session import shared_dir
from tickloom.sources import files, tables

T = ("ticks",)


@query("A1_read_ticks_csv", T, f"select ticker, price, atr14, atr28, rsi, volume, adx28, sec, {rint('atr14/price*100.0D', 2)} as volatility_percent, case when tick_id % 3 = 1 then price end as vol_warmup, cast(null as varchar) as _corrupt_record from ticks")
def _(spark, sf):
    """Files of the 14-column form, of the 15-column form and with reordered columns, read in one call."""
    t = view(spark, sf, "ticks")
    out = t.select(
        "tick_id", F.col("ticker").alias("Ticker"), F.col("price").alias("Price"), F.lit(0.0).alias("Val"), F.lit(0.0).alias("Avg"), F.col("atr14").alias("Atr14"), F.col("atr28").alias("Atr28"),
        F.col("rsi").alias("Rsi"), F.col("volume").alias("Volume"), F.col("adx28").alias("Adx28"), F.col("adx14").alias("Adx14"), F.col("adx7").alias("Adx7"),
        volatility_percent(F.col("atr14"), F.col("price")).alias("Volatility Percent"), F.col("price").alias("Early Morning Atr Warmup Fix"),
        volatility_ratio(F.col("atr14"), F.col("atr28")).alias("Volatility Ratio"), sec_to_hms(F.col("sec")).alias("Time"),
    )
    forms = [TICK_HEADER, TICK_HEADER_WARMUP, TICK_HEADER[:-1][::-1] + TICK_HEADER[-1:]]
    paths = [shared_dir(spark) for _ in forms]
    for i, (head, path) in enumerate(zip(forms, paths)):
        files.write_summary_csv(out.where(f"tick_id % 3 = {i}").select(*head), path)
    return files.read_ticks_csv(spark, paths).select("ticker", "price", "atr14", "atr28", "rsi", "volume", "adx28", "sec", "volatility_percent", "vol_warmup", "_corrupt_record")


@query("A2_with_file_date", T, f"with {LINES} select filename, line, trade_date, trade_date + to_seconds(sec) as date_time from lines")
def _(spark, sf):
    rows = tick_lines(spark, sf).select("filename", "line", "sec")
    return files.with_file_date(rows, "filename").select("filename", "line", "trade_date", "date_time")


@query("A3_read_trade_report", ("fills",), """
select ticker as symbol, cast(trade_date as timestamp) + to_seconds(sec) as exec_time, qty, net_price, case when qty > 0 then 'BUY' else 'SELL' end as side from fills""")
def _(spark, sf):
    f = view(spark, sf, "fills")
    hms = sec_to_hms(F.col("sec"))
    stamp = F.when(F.col("fill_id") % 2 == 0, F.concat_ws(" ", F.date_format("trade_date", "M/d/yy"), hms)).otherwise(F.concat_ws(" ", F.date_format("trade_date", "MM-dd-yyyy"), hms))
    qty = F.when(F.col("qty") > 0, F.concat(F.lit("+"), F.col("qty").cast("string"))).otherwise(F.col("qty").cast("string"))
    line = F.concat(F.lit(","), F.concat_ws(",", stamp, F.lit("STOCK"), F.when(F.col("qty") > 0, "BUY").otherwise("SELL"), qty, F.lit("AUTO"), "ticker", F.lit(""), F.lit(""), F.lit("STOCK"), F.col("net_price").cast("string"), F.col("net_price").cast("string"), F.lit(".00"), F.lit("STP")))
    head = "Today's Trade Activity\n\nWorking Orders\n,Time Placed,Spread\n\nFilled Orders\n,Exec Time,Spread,Side,Qty,Pos Effect,Symbol,Exp,Strike,Type,Price,Net Price,Price Improvement,Order Type\n"
    # one report per ticker and half hour of a day keeps every text short
    parts = f.select("trade_date", "ticker", F.floor(F.col("sec") / 1800).alias("b"), F.struct((-F.col("sec")).alias("s"), "fill_id", line.alias("line")).alias("x"))
    texts_ = parts.groupBy("trade_date", "ticker", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    tail = F.when(F.col("b") % 2 == 0, "\n\nCanceled Orders\nanything").otherwise("")
    path = shared_dir(spark)
    # reports are separated by a record separator, so that one text file holds many of them
    texts_.select(F.concat(F.lit(head), "body", tail).alias("value")).write.option("lineSep", "\x1e").text(path)
    reports = spark.read.option("lineSep", "\x1e").text(path).withColumn("file_name", F.lit("report"))
    return files.parse_trade_reports(reports).select("symbol", "exec_time", "qty", "net_price", "side")


@query("A4_write_ticks", T, "select ticker, trade_date, sec, tick_id, price from ticks")
def _(spark, sf):
    path = shared_dir(spark)
    tables.write_ticks(view(spark, sf, "ticks").select("ticker", "trade_date", "sec", "tick_id", "price"), path)
    return spark.read.parquet(path).select("ticker", "trade_date", "sec", "tick_id", "price")


@query("A4_write_trades", ("trades",), "select trade_id, ticker, trade_date, entry_sec, side from trades")
def _(spark, sf):
    path = shared_dir(spark)
    tables.write_trades(view(spark, sf, "trades").select("trade_id", "ticker", "trade_date", "entry_sec", "side"), path)
    return spark.read.parquet(path).select("trade_id", "ticker", "trade_date", "entry_sec", "side")


@query("A5_write_summary_csv", ("wide_trades",), f"select trade_date, {_SUM} from wide_trades group by trade_date")
def _(spark, sf):
    s = stats.day_summary(view(spark, sf, "wide_trades"))
    path = shared_dir(spark)
    files.write_summary_csv(s, path)
    return spark.read.schema(s.schema).option("header", True).csv(path)


_TARGET = "tick_id % 3 = 0"


_NOT_HELD = "not exists (select 1 from ticks o where o.tick_id % 3 = 0 and o.ticker = t.ticker and o.trade_date = t.trade_date and o.sec = t.sec)"


@query("A6_insert_absent", T, f"select ticker, trade_date, sec, min(tick_id)*2 as ord, min_by(price, tick_id) as price from ticks t where tick_id % 2 = 0 and {_NOT_HELD} group by ticker, trade_date, sec")
def _(spark, sf):
    t = view(spark, sf, "ticks").select("tick_id", "ticker", "trade_date", "sec", "price")
    half = t.where("tick_id % 2 = 0").withColumn("ord", F.col("tick_id") * 2).drop("tick_id")
    batch = half.withColumn("ord", F.col("ord") + 1).unionByName(half)
    return tables.insert_absent(t.where(_TARGET), batch, tables.TICK_KEYS, "ord")


@query("A6_append_absent", T, f"""
with n as (select ticker, trade_date, sec, min(tick_id)*2 as ord, min_by(price, tick_id) as price from ticks t where tick_id % 2 = 0 and {_NOT_HELD} group by ticker, trade_date, sec)
select * from n union all select ticker, trade_date, sec, tick_id*2 as ord, price from ticks where tick_id % 3 = 0""")
def _(spark, sf):
    """The stored form, on a table that write_ticks has partitioned by day."""
    t = view(spark, sf, "ticks").select("ticker", "trade_date", "sec", (F.col("tick_id") * 2).alias("ord"), "price", "tick_id")
    path = shared_dir(spark)
    tables.write_ticks(t.where(_TARGET).drop("tick_id"), path)
    half = t.where("tick_id % 2 = 0").drop("tick_id")
    tables.append_absent(spark, path, half.withColumn("ord", F.col("ord") + 1).unionByName(half), tables.TICK_KEYS, "ord")
    return spark.read.parquet(path).select("ticker", "trade_date", "sec", "ord", "price")


@query("A7_upsert_stored", T, """
with o as (select ticker, trade_date, sec, 1 as seq, max_by(price, tick_id) as price from ticks where tick_id % 3 > 0 group by ticker, trade_date, sec),
n as (select ticker, trade_date, sec, 2 as seq, max_by(price, tick_id) + 1 as price from ticks where tick_id % 3 < 2 and day(trade_date) % 2 = 0 group by ticker, trade_date, sec)
select * from n union all select * from o where not exists (select 1 from n where n.ticker = o.ticker and n.trade_date = o.trade_date and n.sec = o.sec)""")
def _(spark, sf):
    """The stored form: days that the batch doesn't touch stay as they are."""
    t = view(spark, sf, "ticks").select("ticker", "trade_date", "sec", "tick_id", "price")
    latest = lambda df, seq, add: df.groupBy(*tables.TICK_KEYS).agg(F.lit(seq).alias("seq"), (F.max_by("price", "tick_id") + add).alias("price"))
    path = shared_dir(spark)
    tables.write_ticks(latest(t.where("tick_id % 3 > 0"), 1, 0), path)
    tables.upsert_stored(spark, path, latest(t.where("tick_id % 3 < 2 and day(trade_date) % 2 = 0"), 2, 1), tables.TICK_KEYS)
    return spark.read.parquet(path).select("ticker", "trade_date", "sec", "seq", "price")


@query("A7_upsert_latest", ("ticks",), """
select trade_date, case when day(trade_date) % 2 = 0 then 'rechecked' else 'first' end as status, case when day(trade_date) % 2 = 0 then 2 else 1 end as seq, count(*) as n from ticks group by trade_date""")
def _(spark, sf):
    days = view(spark, sf, "ticks").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    old = days.withColumn("status", F.lit("first")).withColumn("seq", F.lit(1))
    new = days.where(F.dayofmonth("trade_date") % 2 == 0).withColumn("status", F.lit("rechecked")).withColumn("seq", F.lit(2))
    return tables.upsert_latest(old, new, ["trade_date"])


@query("A8_read_catalog", T, f"with {CATALOG} select filename, cast(null as varchar) as filepath, status, reasons, date_checked from cat")
def _(spark, sf):
    cat, _rows = tick_catalog(spark, sf)
    return tables.read_catalog(cat.withColumnsRenamed({"reasons": "error_info", "trade_date": "data_date"}))


@query("A9_read_trade_summaries", ("trades",), 'select trade_date as "Date", trade_id as "Trade Id", ticker as "Ticker", entry_sec as "Entry Time", entry_price as "Entry Price", side as "Trade Type" from trades')
def _(spark, sf):
    t = view(spark, sf, "trades").select("trade_date", "trade_id", "ticker", F.col("entry_sec").alias("entry_time"), "entry_price", F.col("side").alias("trade_type"))
    return tables.read_trade_summaries(t)


@query("A10_upload_trade_summaries", ("trades",), """
select min(trade_id) as trade_id, entry_sec as entry_time, trade_date, min_by(ticker, trade_id) as ticker from trades t
where not exists (select 1 from trades o where o.trade_id % 4 = 0 and o.trade_date = t.trade_date and o.entry_sec = t.entry_sec) group by trade_date, entry_sec""")
def _(spark, sf):
    t = view(spark, sf, "trades")
    text = t.select(F.date_format("trade_date", "MM-dd-yy").alias("Date"), F.col("trade_id").alias("Trade Id"), F.col("entry_sec").alias("Entry Time"), F.col("ticker").alias("Ticker"))
    target = t.where("trade_id % 4 = 0").select("trade_date", F.col("entry_sec").alias("entry_time"))
    return tables.upload_trade_summaries(target, text)


@query("A11_next_model_versions", ("wide_trades",), """
with d as (select ticker as model_name, max(cast(cast(adx28 as decimal(6, 2))/100 as decimal(4, 2))) as v from wide_trades where ticker <> 'RF' group by ticker)
select m.model_name, cast(coalesce(d.v, 0.09) + 0.01 as decimal(4, 2)) as version_id from (select distinct ticker as model_name from wide_trades) m left join d on d.model_name = m.model_name""")
def _(spark, sf):
    t = view(spark, sf, "wide_trades")
    diag = t.where("ticker <> 'RF'").select(F.col("ticker").alias("model_name"), (F.col("adx28").cast("decimal(6,2)") / 100).cast("decimal(4,2)").alias("version_id"))
    return tables.next_model_versions(diag, t.select(F.col("ticker").alias("model_name")).distinct())


@query("A12_flatten_diagnostics", ("samples",), "select 'target' as model_name, cast(0.1 as decimal(4, 2)) as version_id, " + ", ".join(
    f"{ {('response_dist', 'count'): 'count(y)::double', ('response_dist', 'mean'): rint('avg(y)', 6), ('response_dist', 'p50'): rint('quantile_cont(y, 0.5)', 6), ('all_samples', 'data_points_count'): 'count(*)::double', ('all_samples', 'mean_residual'): rint('avg(y - y_hat)', 6)}.get((p, n), 'cast(null as double)') } as {p}_{n}"
    for p, names in tables.DIAGNOSTIC_COLUMNS.items() for n in names
) + " from samples")
def _(spark, sf):
    s = view(spark, sf, "samples")
    dist = stats.response_distribution(s).select(
        F.struct("count", "mean", F.struct("p50").alias("percentiles"), F.lit(1.0).alias("not_a_column")).alias("response_dist")
    )
    res = stats.residual_diagnostics(s).select(F.struct(F.col("n").alias("data_points_count"), "mean_residual").alias("all_samples"))
    nested = dist.select(F.lit("target").alias("model_name"), F.lit("0.10").cast("decimal(4,2)").alias("version_id"), "response_dist", res.scalar().alias("all_samples"))
    return tables.flatten_diagnostics(nested)


@query("A13_new_files", T, f"with {CATALOG}, l as (select distinct filename, day(trade_date) as d from lines) select filename from l where d % 3 = 0 union all select l.filename from l join cat c on c.filename = l.filename where c.status = 'error' and l.d % 3 <> 0")
def _(spark, sf):
    cat, rows = tick_catalog(spark, sf)
    tracked = cat.where(F.dayofmonth("trade_date") % 3 != 0).select("filename", "status")
    return files.new_files(tracked, rows.select("filename").distinct(), recheck=True)


@query("A14_matched_days", ("filenames",), """
with d as (select filename, file_id, try_strptime(regexp_extract(filename, '(\\d{1,2}-\\d{1,2}-\\d{4})[_.-]', 1), '%m-%d-%Y')::date as trade_date from filenames),
  a as (select trade_date, min(filename) as trade_file from d where file_id % 6 = 0 and trade_date is not null group by trade_date),
  b as (select trade_date, min(filename) as tick_file from d where file_id % 6 = 1 and trade_date is not null group by trade_date)
select a.trade_date, a.trade_file, b.tick_file from a join b on a.trade_date = b.trade_date""")
def _(spark, sf):
    f = view(spark, sf, "filenames")
    return files.matched_days(f.where("file_id % 6 = 0").select("filename"), f.where("file_id % 6 = 1").select("filename"))


@query("A15_route_by_status", T, f"with {CATALOG} select filename, status, reasons from cat")
def _(spark, sf):
    cat, _rows = tick_catalog(spark, sf)
    path = shared_dir(spark)
    files.route_by_status(cat.select("filename", "status", "reasons"), path)
    return spark.read.parquet(path).select("filename", F.col("status").cast("string"), "reasons")


@query("A16_split_at_ordinal", T, f"with {LINES} select filename, line, case when line - 1 <= 100 then 'head' else 'rest' end as part from lines")
def _(spark, sf):
    head, rest = files.split_at_ordinal(tick_lines(spark, sf).select("filename", "line"), 100)
    return head.withColumn("part", F.lit("head")).unionByName(rest.withColumn("part", F.lit("rest")))


@query("A17_combine_daily", ("trades",), "select trade_id, ticker, trade_date, entry_sec, row_number() over (order by trade_date, entry_sec, trade_id) as trade_no from trades")
def _(spark, sf):
    """Folders summary_<n> and bulk_all, and summary_empty with a header and no rows: only the summaries count."""
    path = shared_dir(spark)
    t = view(spark, sf, "trades").select("trade_id", "ticker", "trade_date", "entry_sec")
    for i in range(2):
        files.write_summary_csv(t.where(f"trade_id % 2 = {i}"), f"{path}/summary_{i}")
    files.write_summary_csv(t.limit(0), f"{path}/summary_empty")
    files.write_summary_csv(t, f"{path}/bulk_all")
    return files.combine_daily(spark, f"{path}/summary*", "trade_id bigint, ticker string, trade_date date, entry_sec int", "part-*")


@query("A18_bulk_load", T, f"select min(tick_id) as tick_id, ticker, trade_date, sec, min_by(price, tick_id) as last from ticks t where trade_date in (date '2024-01-05', date '2024-01-17') and {_NOT_HELD} group by ticker, trade_date, sec")
def _(spark, sf):
    t = view(spark, sf, "ticks")
    mapping = {"tick_id": "tick_id", "ticker": "ticker", "trade_date": "trade_date", "sec": "sec", "price": "last"}
    return tables.bulk_load(t.where(_TARGET), t, mapping, ["2024-01-05", "2024-01-17"], tables.TICK_KEYS, "tick_id")

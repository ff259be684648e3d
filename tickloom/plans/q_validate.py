"""Queries of family C. Tick files are the ticks of one day in time order; line 2 is the first data row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import blocks, validate as v
from tickloom.plans.fixtures import staged, view
from tickloom.plans.registry import query
from tickloom.session import FULL_DAY

LINES = (
    "lines as (select *, row_number() over (partition by trade_date order by sec, tick_id) + 1 as line, "
    "concat(strftime(trade_date, '%m-%d-%Y'), case when day(trade_date) % 10 = 7 then '_On_Demand' else '' end, '_Raw_Market_Data.csv') as filename from ticks)"
)
NAMES = (
    "names as (select file_id, case cast(file_id % 5 as int) when 0 then replace(filename, '-TradeActivity.csv', '_Raw_Market_Data.csv') "
    "when 1 then concat('Raw_Market_Data_', replace(filename, '-TradeActivity', '')) when 2 then replace(filename, '-TradeActivity_On_Demand', '_Raw_Market_Data') "
    "else filename end as name from filenames)"
)


def tick_lines(spark, sf):
    return staged(spark, sf, "tick_lines", _number_lines)


def _number_lines(spark, sf):
    t = view(spark, sf, "ticks")
    ranged = blocks.in_ranges(t, ["trade_date", "sec", "tick_id"])
    numbered = blocks.row_numbers(ranged, ["trade_date"], F.col("_range"), ["sec", "tick_id"], "line").drop("_range")
    demand = F.when(F.dayofmonth("trade_date") % 10 == 7, "_On_Demand").otherwise("")
    return numbered.withColumn("line", F.col("line") + 1).withColumn(
        "filename", F.concat(F.date_format("trade_date", "MM-dd-yyyy"), demand, F.lit("_Raw_Market_Data.csv"))
    )


def tick_names(spark, sf):
    f, n = view(spark, sf, "filenames"), F.col("filename")
    k = F.col("file_id") % 5
    name = (
        F.when(k == 0, F.replace(n, F.lit("-TradeActivity.csv"), F.lit("_Raw_Market_Data.csv")))
        .when(k == 1, F.concat(F.lit("Raw_Market_Data_"), F.replace(n, F.lit("-TradeActivity"), F.lit(""))))
        .when(k == 2, F.replace(n, F.lit("-TradeActivity_On_Demand"), F.lit("_Raw_Market_Data"))).otherwise(n)
    )
    return f.select("file_id", name.alias("name"))


@query("C1_normalize_tick_filename", ("filenames",), f"""
with {NAMES}, d as (select *, regexp_extract(name, '(?:^|_)(\\d{{1,2}}-\\d{{1,2}}-(?:\\d{{4}}|\\d{{2}}))(?:_|\\.csv$)', 1) as t from names),
  c as (select *, case when t <> '' then concat(lpad(split_part(t, '-', 1), 2, '0'), '-', lpad(split_part(t, '-', 2), 2, '0'), '-', case when length(split_part(t, '-', 3)) = 2 then '20' else '' end, split_part(t, '-', 3), '_Raw_Market_Data.csv') end as canon from d)
select file_id, name, case when canon is null then 'bad' when canon = name then 'ok' else 'changed' end as status, canon as canonical from c""")
def _(spark, sf):
    n = tick_names(spark, sf).withColumn("r", v.normalize_tick_filename(F.col("name")))
    return n.select("file_id", "name", "r.status", F.col("r.filename").alias("canonical"))


TRADE_NAMES = (
    "tn as (select file_id, filename, case when regexp_matches(filename, '^\\d{1,2}-\\d{1,2}-\\d{4}-TradeActivity(_On_Demand)?\\.csv$') then "
    "concat(lpad(split_part(filename, '-', 1), 2, '0'), '-', lpad(split_part(filename, '-', 2), 2, '0'), '-', split_part(filename, '-', 3), '-', split_part(filename, '-', 4)) "
    "when regexp_matches(filename, '^\\d{2}-\\d{2}-\\d{4}\\.csv$') then replace(filename, '.csv', '-TradeActivity.csv') "
    "when regexp_matches(filename, '^\\d{4}-\\d{2}-\\d{2}-TradeActivity(_On_Demand)?\\.csv$') then "
    "concat(split_part(filename, '-', 2), '-', split_part(filename, '-', 3), '-', split_part(filename, '-', 1), '-', split_part(filename, '-', 4)) end as fixed from filenames), "
    "ts as (select file_id, filename, case when fixed is null or try_strptime(substr(fixed, 1, 10), '%m-%d-%Y') is null then 'bad' when fixed = filename then 'ok' else 'changed' end as status, "
    "case when try_strptime(substr(fixed, 1, 10), '%m-%d-%Y') is not null then fixed end as canonical from tn)"
)


@query("C2_normalize_trade_filename", ("filenames",), f"with {TRADE_NAMES} select * from ts")
def _(spark, sf):
    n = view(spark, sf, "filenames").withColumn("r", v.normalize_trade_filename(F.col("filename")))
    return n.select("file_id", "filename", "r.status", F.col("r.filename").alias("canonical"))


@query("C3_exclude_on_demand", ("filenames",), "select filename, 'on demand data' as reason from filenames where filename like '%On\\_Demand%' escape '\\'")
def _(spark, sf):
    return v.exclude_on_demand(view(spark, sf, "filenames"))


@query("C4_check_header", ("ticks",), f"""
with {LINES} select filename, line, 'repeated header' as problem from lines where tick_id % 97 = 0
union all select distinct filename, 1, 'wrong header' from lines where day(trade_date) % 6 = 0""")
def _(spark, sf):
    rows = tick_lines(spark, sf)
    good, bad = ",".join(v.TICK_HEADER), ",".join(reversed(v.TICK_HEADER))
    body = F.when(F.col("tick_id") % 97 == 0, good).otherwise(F.concat_ws(",", "ticker", "price", "sec"))
    heads = rows.select("filename", F.lit(1).cast("long").alias("line"), F.when(F.dayofmonth("trade_date") % 6 == 0, bad).otherwise(good).alias("text")).distinct()
    return v.check_header(rows.select("filename", "line", body.alias("text")).unionByName(heads))


@query("C5_check_ticker_counts", ("ticks",), f"""
with {LINES}, n as (select filename, ticker, count(*) as n from lines group by filename, ticker)
select filename, count(*) as tickers, max(n) - min(n) as spread, max(n) - min(n) < 20 as ok from n group by filename""")
def _(spark, sf):
    return v.check_ticker_counts(tick_lines(spark, sf), 20)


_GAPS = "gaps as (select * from (select filename, line, sec - lag(sec) over (partition by filename order by line) as gap from lines) q where gap >= {g})"


@query("C6_check_time_gaps", ("ticks",), f"with {LINES}, {_GAPS.replace('{g}', '900')} select * from gaps")
def _(spark, sf):
    return v.check_time_gaps(tick_lines(spark, sf), 900)


@query("C6_check_time_gaps_by_ticker", ("ticks",), f"with {LINES} select * from (select filename, line, sec - lag(sec) over (partition by filename, ticker order by line) as gap from lines) q where gap >= 3600")
def _(spark, sf):
    return v.check_time_gaps(tick_lines(spark, sf), 3600, by_ticker=True)


@query("C7_check_open_coverage", ("ticks",), f"with {LINES} select filename, count(*) filter (where sec < 3600) as open_rows, count(*) filter (where sec < 3600) >= 12 as ok from lines group by filename")
def _(spark, sf):
    return v.check_open_coverage(tick_lines(spark, sf), 12, 3600, FULL_DAY)


@query("C8_assert_no_gap", ("ticks",), f"with {LINES} select filename, max(gap) as largest_gap from (select filename, sec - lag(sec) over (partition by filename order by line) as gap from lines) q group by filename")
def _(spark, sf):
    return v.assert_no_gap(tick_lines(spark, sf), 86400)


@query("C9_check_required_values", ("ticks",), f"""
with {LINES}, m as (select filename, line from lines where atr14 is null qualify row_number() over (partition by filename order by line) <= 5),
  f as (select filename, string_agg(cast(line as varchar), ',' order by line) as first_lines from m group by filename)
select c.*, f.first_lines from (select filename, count(*) filter (where atr14 is null) as missing_atr14, count(*) filter (where price is null) as missing_price, count(*) filter (where ticker is null) as missing_ticker from lines group by filename) c
left join f on f.filename = c.filename""")
def _(spark, sf):
    return v.check_required_values(tick_lines(spark, sf), ("atr14", "price", "ticker"))


@query("C10_check_report_columns", ("filenames",), "select filename, file_id % 4 <> 0 as ok from filenames")
def _(spark, sf):
    good, bad = ",".join(v.REPORT_HEADER), ",".join(v.REPORT_HEADER[:-1])
    return v.check_report_columns(view(spark, sf, "filenames").select("filename", F.when(F.col("file_id") % 4 == 0, bad).otherwise(good).alias("header")))


@query("C11_waivers", ("ticks",), f"with {LINES}, {_GAPS.replace('{g}', '900')} select g.* from gaps g where not exists (select 1 from lines w where w.filename = g.filename and w.line = g.line and w.tick_id % 2 = 0)")
def _(spark, sf):
    rows = tick_lines(spark, sf)
    return v.apply_waivers(v.check_time_gaps(rows, 900), rows.where("tick_id % 2 = 0").select("filename", "line"))


CATALOG = (
    f"{LINES}, {_GAPS.replace('{g}', '2400')}, fails as (select distinct filename, 'on demand data' as reason from lines where day(trade_date) % 10 = 7 "
    "union all select filename, 'ticker counts differ' from (select filename, ticker, count(*) as n from lines group by filename, ticker) q group by filename having max(n) - min(n) >= 30 "
    "union all select distinct filename, 'time gaps' from gaps "
    "union all select filename, 'open not covered' from lines group by filename having count(*) filter (where sec < 3600) < 8 "
    "union all select distinct filename, 'missing values' from lines where atr14 is null and day(trade_date) % 5 = 1), "
    "rs as (select filename, string_agg(reason, '; ' order by reason) as reasons from fails group by filename), "
    "cat as (select f.filename, f.trade_date, case when rs.reasons is null then 'validated-cleaned' else 'error' end as status, rs.reasons, date '2024-02-01' as date_checked "
    "from (select distinct filename, trade_date from lines) f left join rs on rs.filename = f.filename)"
)


def tick_catalog(spark, sf):
    # only every fifth day counts a missing ATR, so that some files pass
    rows = tick_lines(spark, sf).withColumn("atr", F.when(F.dayofmonth("trade_date") % 5 == 1, F.col("atr14")).otherwise(0.0))
    files = rows.select("filename", "trade_date").distinct()
    fails = v.tick_failures(rows, files.select("filename"), ("atr", "price", "ticker"), tolerance=30, gap=2400, minimum=8, window=3600, session=FULL_DAY)
    out = v.validate_files(files.select("filename"), fails, F.lit("2024-02-01").cast("date"))
    return out.join(files, "filename"), rows


@query("C12_validate_ticks", ("ticks",), f"with {CATALOG} select filename, status, reasons, date_checked from cat")
def _(spark, sf):
    return tick_catalog(spark, sf)[0].drop("trade_date")


@query("C13_validate_trade_logs", ("filenames",), f"""
with {TRADE_NAMES}, k as (select filename, bool_or(status = 'bad') as bad, bool_or(filename like '%On\\_Demand%' escape '\\') as od, bool_or(file_id % 4 = 0) as cols from ts group by filename)
select filename, case when bad or cols then 'error' else 'validated-cleaned' end as status,
  nullif(concat_ws('; ', case when bad then 'bad filename' end, case when cols then 'wrong columns' end), '') as reasons, date '2024-02-01' as date_checked from k""")
def _(spark, sf):
    f = view(spark, sf, "filenames")
    good, bad = ",".join(v.REPORT_HEADER), ",".join(v.REPORT_HEADER[:-1])
    cols = v.check_report_columns(f.select("filename", F.when(F.col("file_id") % 4 == 0, bad).otherwise(good).alias("header"))).where("not ok")
    names = f.where(v.normalize_trade_filename(F.col("filename"))["status"] == "bad")
    fails = [names.select("filename", F.lit("bad filename").alias("reason")), cols.select("filename", F.lit("wrong columns").alias("reason"))]
    return v.validate_files(f.select("filename").distinct(), fails, F.lit("2024-02-01").cast("date"))


@query("C14_usable_dates", ("ticks", "trades"), f"with {CATALOG} select trade_id, trade_date from trades t where exists (select 1 from cat c where c.trade_date = t.trade_date and c.status = 'validated-cleaned')")
def _(spark, sf):
    cat, _rows = tick_catalog(spark, sf)
    return v.usable_dates(view(spark, sf, "trades").select("trade_id", "trade_date"), cat)


@query("C15_count_valid_rows", ("ticks",), f"with {CATALOG} select c.filename, c.status, case when c.status <> 'error' then n.n end as data_rows from cat c left join (select filename, count(*) as n from lines group by filename) n on n.filename = c.filename")
def _(spark, sf):
    cat, rows = tick_catalog(spark, sf)
    return v.count_valid_rows(rows, cat)


@query("C16_has_ticks_for_trade", ("ticks", "trades"), """
select t.trade_id, coalesce(t.entry_sec + 43200 <= (select max(k.sec) from ticks k where k.ticker = t.ticker and k.trade_date = t.trade_date), false) as has_ticks from trades t""")
def _(spark, sf):
    later = view(spark, sf, "trades").withColumn("entry_sec", F.col("entry_sec") + 43200)
    return v.has_ticks_for_trade(later, view(spark, sf, "ticks")).select("trade_id", "has_ticks")


@query("C17_validate_training_input", ("ticks",), "select count(*) as n, count(*) filter (where price is null) as null_price, count(*) filter (where atr14 is null) as null_atr14 from ticks")
def _(spark, sf):
    return v.validate_training_input(view(spark, sf, "ticks"), ("price", "atr14"))

"""Queries of family B and of the scalar functions of family K."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import clock, columns as c
from tickloom.functions.numbers import roi, round_to
from tickloom.plans import texts
from tickloom.plans.fixtures import view
from tickloom.plans.q_validate import LINES, tick_lines
from tickloom.plans.registry import query, rint
from tickloom.session import SessionSpec

T = ("ticks",)
WT = ("wide_trades",)
EARLY = SessionSpec(0, 86400)


def _ticks(spark, sf, *cols):
    return view(spark, sf, "ticks").select("tick_id", *cols)


_HMS = "concat(lpad(cast(sec // 3600 as varchar), 2, '0'), ':', lpad(cast(sec % 3600 // 60 as varchar), 2, '0'), ':', lpad(cast(sec % 60 as varchar), 2, '0'))"


@query("B1_drop_if_exists", T, "select tick_id, price from ticks")
def _(spark, sf):
    return c.drop_if_exists(_ticks(spark, sf, "price", F.lit(0.5).alias("Macd Z-Score")), "Macd Z-Score", "not there")


@query("B2_repair_shifted_columns", T, f"select tick_id, atr14, atr28, {_HMS} as time, {rint('atr14/price*100.0D', 2)} as vol, {rint('atr14/atr28', 2)} as ratio from ticks")
def _(spark, sf):
    t = _ticks(spark, sf, "atr14", "atr28", "sec", "price")
    slipped = t.select("tick_id", "atr14", "atr28", clock.sec_to_hms(F.col("sec")).alias("vol"), c.volatility_percent(F.col("atr14"), F.col("price")).cast("string").alias("ratio"), F.lit(None).cast("string").alias("time"))
    return c.repair_shifted_columns(slipped)


@query("B3_filter_ticker", WT, "select trade_id, ticker from wide_trades where ticker in ('AF', 'RF')")
def _(spark, sf):
    return c.filter_ticker(view(spark, sf, "wide_trades").select("trade_id", "ticker"), "AF", "RF")


@query("B4_keep_columns", T, "select ticker, price, sec from ticks")
def _(spark, sf):
    return c.keep_columns(view(spark, sf, "ticks"), ["ticker", "price", "sec"])


@query("B5_reorder_columns", T, "select ticker, sec, tick_id, price from ticks")
def _(spark, sf):
    return c.reorder_columns(_ticks(spark, sf, "price", "ticker", "sec"), ["ticker", "sec"])


@query("B6_rename_column", T, "select tick_id, price as last from ticks")
def _(spark, sf):
    return c.rename_column(c.rename_column(_ticks(spark, sf, "price"), "price", "last"), "absent", "x")


@query("B7_normalize_numeric_text", T, """
select tick_id, case cast(tick_id % 4 as int) when 0 then cast(tick_id as varchar) when 1 then concat(cast(tick_id as varchar), '.5') when 2 then 'n/a' else cast(tick_id as varchar) end as clean from ticks""")
def _(spark, sf):
    k, n = F.col("tick_id") % 4, F.col("tick_id").cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit(".00"))).when(k == 1, F.concat(n, F.lit(".500"))).when(k == 2, F.lit("n/a")).otherwise(n)
    return _ticks(spark, sf).select("tick_id", c.normalize_numeric_text(raw).alias("clean"))


@query("B8_round_columns", T, f"select tick_id, {rint('price', 1)} as price, {rint('atr14', 1)} as atr14 from ticks")
def _(spark, sf):
    return c.round_columns(_ticks(spark, sf, "price", "atr14"), ["price", "atr14", "absent"], 1)


@query("B9_volatility_percent", T, f"select tick_id, {texts.VOL} as vol from ticks")
def _(spark, sf):
    return _ticks(spark, sf, c.volatility_percent(F.col("atr14"), F.col("price")).alias("vol"))


@query("B10_volatility_ratio", T, f"select tick_id, {rint('atr14/atr28', 2)} as ratio from ticks")
def _(spark, sf):
    return _ticks(spark, sf, c.volatility_ratio(F.col("atr14"), F.col("atr28")).alias("ratio"))


_VOL = "v as (select tick_id, sec, " + texts.VOL + " as vol from ticks)"
_WARM = f"case when sec // 60 < 9 then {rint('vol*1.8D', 2)} when sec // 60 < 12 then {rint('vol*1.6D', 2)} when sec // 60 < 14 then {rint('vol*1.2D', 2)} end"


@query("B11_warmup_vol_fix", T, f"with {_VOL} select tick_id, {_WARM} as fix from v")
def _(spark, sf):
    t = view(spark, sf, "ticks").withColumn("vol", c.volatility_percent(F.col("atr14"), F.col("price")))
    return t.select("tick_id", c.warmup_vol_fix(F.col("vol"), F.col("sec"), EARLY).alias("fix"))


@query("B12_effective_vol", T, f"with {_VOL} select tick_id, case when sec < 840 then {_WARM} else vol end as eff from v")
def _(spark, sf):
    t = view(spark, sf, "ticks").withColumn("vol", c.volatility_percent(F.col("atr14"), F.col("price")))
    fix = c.warmup_vol_fix(F.col("vol"), F.col("sec"), EARLY)
    return t.select("tick_id", c.effective_vol(F.col("vol"), fix, F.col("sec"), EARLY).alias("eff"))


@query("B13_shift_times", T, f"with {LINES} select tick_id, cast(sec - first_value(sec) over (partition by filename order by line) + 23400 as int) as sec from lines")
def _(spark, sf):
    return c.shift_times(tick_lines(spark, sf).select("filename", "line", "tick_id", "sec"), ["filename"], 23400).select("tick_id", "sec")


@query("B14_minutes_since_open", T, "select tick_id, cast(round_even((sec - 23400)/60.0D, 0) as int) as minutes from ticks")
def _(spark, sf):
    return _ticks(spark, sf, clock.minutes_since_open(F.col("sec")).alias("minutes"))


@query("B15_minutes_since_open_floor", T, "select tick_id, cast(sec // 60 - 390 as int) as minutes from ticks")
def _(spark, sf):
    return _ticks(spark, sf, clock.minutes_since_open_floor(F.col("sec")).alias("minutes"))


@query("B16_seconds_since_open", T, "select tick_id, cast(sec - 23400 as int) as seconds from ticks")
def _(spark, sf):
    return _ticks(spark, sf, clock.seconds_since_open(F.col("sec")).alias("seconds"))


@query("B17_hms", T, f"select tick_id, {_HMS} as hms, case when tick_id % 5 = 0 then null else sec end as parsed from ticks")
def _(spark, sf):
    hms = clock.sec_to_hms(F.col("sec"))
    text = F.when(F.col("tick_id") % 5 == 0, F.concat(hms, F.lit(":x"))).otherwise(hms)
    return _ticks(spark, sf, hms.alias("hms"), clock.hms_to_sec(text).alias("parsed"))


@query("B18_normalize_date_text", ("filenames",), "select o_orderkey as file_id, strftime(cast(o_orderdate as date), '%m-%d-%Y') as day from orders")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").cast("date").alias("d"))
    short = F.concat_ws("/", F.month("d"), F.dayofmonth("d"), F.year("d"))
    text = F.when(F.col("file_id") % 2 == 0, short).otherwise(F.date_format("d", "M-dd-yyyy"))
    return o.select("file_id", clock.normalize_date_text(text).alias("day"))


@query("B19_snake_case_columns", T, "select tick_id as trade_id, price as entry_price, sec as time_in_trade from ticks")
def _(spark, sf):
    return c.snake_case_columns(_ticks(spark, sf, "price", "sec").toDF("Trade Id", "Entry Price", "Time in Trade"))


@query("B19_underscore_columns", T, 'select tick_id as "Trade_Id", price as "Entry_Price" from ticks')
def _(spark, sf):
    return c.underscore_columns(_ticks(spark, sf, "price").toDF("Trade Id", "Entry Price"))


@query("B20_clean_qty_price", ("fills",), "select fill_id, qty, net_price as price from fills")
def _(spark, sf):
    f = view(spark, sf, "fills")
    signed = F.when(F.col("qty") > 0, F.concat(F.lit("+"), F.col("qty").cast("string"))).otherwise(F.col("qty").cast("string"))
    return f.select("fill_id", c.clean_qty(signed).alias("qty"), c.clean_price(F.concat(F.lit(" "), F.col("net_price").cast("string"))).alias("price"))


@query("B21_encode_categoricals", ("trades",), """
select trade_id, case side when 'buy' then 1 else 0 end as side_code, cast(dense_rank() over (order by ticker) - 1 as int) as ticker_code,
  case when exit_price > entry_price then 1 else 0 end as up_code, cast(trade_id % 3 as int) as target_code from trades""")
def _(spark, sf):
    t = view(spark, sf, "trades")
    outcome = F.element_at(F.array(F.lit("-0.5"), F.lit("neither"), F.lit("0.9")), (F.col("trade_id") % 3 + 1).cast("int"))
    return c.category_codes(t, "ticker", "ticker_code").select(
        "trade_id", c.side_code(F.col("side")).alias("side_code"), "ticker_code", c.bool_code(F.col("exit_price") > F.col("entry_price")).alias("up_code"), c.target_code(outcome).alias("target_code")
    )


@query("B22_model_features", WT, f"select trade_id, {rint('duration_sec/60.0D', 6)} as hours, {rint('ln(1 + vol)', 6)} as log_vol from wide_trades")
def _(spark, sf):
    t = view(spark, sf, "wide_trades").select("trade_id", *c.model_features(F.col("duration_sec"), F.col("vol")))
    return c.round_columns(t, ["hours", "log_vol"], 6)


@query("B23_abs_features", T, f"select tick_id, {rint('abs(price - 100.0D)', 3)} as macd_abs, abs(rsi - 50)::double as rsi_distance from ticks")
def _(spark, sf):
    return c.round_columns(_ticks(spark, sf, *c.abs_features(F.col("price") - 100.0, F.col("rsi"))), ["macd_abs"], 3)


@query("B24_drop_leaky_columns", ("trades",), "select trade_id, ticker, entry_sec, side from trades")
def _(spark, sf):
    return c.drop_leaky_columns(view(spark, sf, "trades"), ["ep", "exit_sec", "exit_price", "entry_price", "trade_date"])


@query("B25_round_key", WT, "select trade_id, concat('either|', printf('%.1f', round_even(vol*10, 0)/10), '|', printf('%.1f', adx28::double)) as key from wide_trades")
def _(spark, sf):
    t = view(spark, sf, "wide_trades")
    return t.select("trade_id", c.round_key(F.concat_ws("|", F.lit("either"), F.col("vol").cast("string"), F.col("adx28").cast("string"))).alias("key"))


@query("B26_parse_ladder", WT, "select trade_id, case when trade_id % 7 = 0 then 0 else 3 end as rungs, case when trade_id % 7 = 0 then null else pct_change end as last from wide_trades")
def _(spark, sf):
    t = view(spark, sf, "wide_trades")
    text = F.when(F.col("trade_id") % 7 == 0, "").otherwise(F.concat_ws("|", F.lit("0.1"), F.col("best_pct").cast("string"), F.col("pct_change").cast("string")))
    steps = c.parse_ladder(text)
    return t.select("trade_id", F.size(steps).alias("rungs"), F.try_element_at(steps, F.lit(-1)).alias("last"))


@query("B27_roi", ("trades",), f"select trade_id, {rint(texts._roi('exit_price').replace('t.', ''), 2)} as roi from trades")
def _(spark, sf):
    return view(spark, sf, "trades").select("trade_id", roi(F.col("entry_price"), F.col("exit_price"), F.col("side")).alias("roi"))


@query("K_scalar_functions", T, f"""
select tick_id, upper(substr(ticker, 1, 3)) as head, lpad(cast(tick_id as varchar), 8, '0') as padded, strftime(trade_date, '%m-%d-%y') as day_text, {rint('exp(atr28) - 1', 6)} as expm1, {rint('power(10.0D, atr28)', 6)} as pow10,
  cast(trunc((price - 100.0D)*10) as int) as tenths, starts_with(ticker, 'p') as starts_p, greatest(rsi, adx28) as biggest, list_position([1, 2, 3], tick_id % 4) as pos from ticks""")
def _(spark, sf):
    p = F.array_position(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]), F.col("tick_id") % 4).cast("int")
    return view(spark, sf, "ticks").select(
        "tick_id", F.upper(F.substring("ticker", 1, 3)).alias("head"), F.lpad(F.col("tick_id").cast("string"), 8, "0").alias("padded"), F.date_format("trade_date", "MM-dd-yy").alias("day_text"),
        round_to(F.expm1("atr28"), 6).alias("expm1"), round_to(F.pow(F.lit(10.0), F.col("atr28")), 6).alias("pow10"), ((F.col("price") - 100.0) * 10).cast("int").alias("tenths"),
        F.col("ticker").startswith("p").alias("starts_p"), F.greatest("rsi", "adx28").alias("biggest"), F.when(p > 0, p).alias("pos"),
    )


@query("K_map_json_functions", T, """
select tick_id, '{"ticker":"' || ticker || '","sec":' || sec || '}' as text, ticker as ticker_back, sec as sec_back, case when tick_id % 2 = 0 then rsi else adx28 end as picked, 2 as n_keys from ticks""")
def _(spark, sf):
    t = view(spark, sf, "ticks")
    text = F.to_json(F.struct("ticker", "sec"))
    back = F.from_json(text, "ticker string, sec int")
    levels = F.create_map(F.lit("rsi"), F.col("rsi"), F.lit("adx28"), F.col("adx28"))
    key = F.when(F.col("tick_id") % 2 == 0, "rsi").otherwise("adx28")
    return t.select("tick_id", text.alias("text"), back["ticker"].alias("ticker_back"), back["sec"].alias("sec_back"), F.element_at(levels, key).alias("picked"), F.size(F.map_keys(levels)).alias("n_keys"))

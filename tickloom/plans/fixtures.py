"""Market-shaped inputs derived from the provided tables.

Each view exists once as SQL text. Spark runs it over the parquet files of a folder; the check engine
runs the same text with double literals rewritten (see ``check_sql``). ``fills`` and ``trades`` are
also built with this library's own operators (``fills_df``, ``trades_df``), which cut hot groups.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators import blocks
from tickloom.session import shared_dir

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": (
        (),
        """
select event_type as ticker, cast(ts as date) as trade_date,
  cast(hour(ts)*3600 + minute(ts)*60 + cast(floor(second(ts)) as int) as int) as sec, event_id as tick_id,
  round(100.0D + (value - 50.0D)/50.0D, 3) as price,
  case when event_id % 211 = 0 then null else round(0.05D + (event_id % 97)/100.0D, 3) end as atr14,
  round(0.05D + (event_id % 89)/100.0D, 3) as atr28,
  cast(event_id % 101 as int) as rsi, cast(user_id*100 as int) as volume,
  cast(event_id % 61 as int) as adx28, cast(event_id % 53 as int) as adx14, cast(event_id % 47 as int) as adx7
from events""",
    ),
    "fills": (
        ("ticks",),
        """
select ticker, trade_date, sec, tick_id as fill_id, price as net_price,
  (case when n % 3 = 0 then 2 else -1 end)
  * (case when cast(floor(n/3.0D) as int) % 2 = 0 then 1 else -1 end) as qty
from (select ticker, trade_date, sec, tick_id, price,
    row_number() over (partition by trade_date, ticker order by sec, tick_id) - 1 as n
  from ticks where tick_id % 5 = 0) p""",
    ),
    "trades": (
        ("fills",),
        """
select trade_date, ticker, cast(ep as bigint) as ep, min(fill_id) as trade_id, min(sec) as entry_sec, max(sec) as exit_sec,
  min_by(net_price, fill_id) as entry_price, max_by(net_price, fill_id) as exit_price,
  case when min_by(qty, fill_id) > 0 then 'buy' else 'short' end as side
from (select *, sum(case when coalesce(prev, 0) = 0 then 1 else 0 end)
          over (partition by trade_date, ticker order by sec, fill_id) as ep
      from (select *, lag(pos) over (partition by trade_date, ticker order by sec, fill_id) as prev
            from (select *, sum(qty) over (partition by trade_date, ticker order by sec, fill_id) as pos
                  from fills) r) l) e
group by trade_date, ticker, ep having max_by(pos, fill_id) = 0""",
    ),
    "wide_trades": (
        (),
        """
select l_orderkey*10 + l_linenumber as trade_id,
  concat(min(l_returnflag), min(l_linestatus)) as ticker, cast(min(l_shipdate) as date) as trade_date,
  cast(23400 + min(l_partkey) % 9000 as int) as entry_sec,
  cast(60 + (min(l_suppkey) % 97)*30 as int) as duration_sec,
  round(max(l_tax)*10, 2) as vol, round(max(l_quantity)/50, 2) as ratio,
  cast(min(l_partkey) % 61 as int) as adx28, cast(min(l_partkey) % 53 as int) as adx14,
  cast(min(l_partkey) % 47 as int) as adx7,
  min(l_partkey) % 3 = 0 as rsi_extreme, max(l_extendedprice) as dollar_change,
  round((max(l_discount) - 0.05D)*20, 2) + 0.0D as pct_change,
  round((max(l_discount) - 0.05D)*20 + (min(l_partkey) % 7)*0.2D, 2) + 0.0D as best_pct
from lineitem group by l_orderkey, l_linenumber""",
    ),
    "filenames": (
        (),
        """
select o_orderkey as file_id, case cast(o_orderkey % 6 as int)
  when 0 then concat(m2, '-', d2, '-', y, '-TradeActivity.csv')
  when 1 then concat(m2, '-', d2, '-', y, '.csv')
  when 2 then concat(m1, '-', d1, '-', y, '-TradeActivity_On_Demand.csv')
  when 3 then concat(y, '-', m2, '-', d2, '-TradeActivity.csv')
  when 4 then concat('13-32-', y, '-TradeActivity.csv')
  else concat('notes_', y, '.txt') end as filename
from (select o_orderkey, cast(year(o_orderdate) as string) as y,
  cast(month(o_orderdate) as string) as m1, cast(day(o_orderdate) as string) as d1,
  lpad(cast(month(o_orderdate) as string), 2, '0') as m2,
  lpad(cast(day(o_orderdate) as string), 2, '0') as d2 from orders) q""",
    ),
    "predictions": (
        (),
        """
select doc_id, quality as label, (doc_id*37 % 100)/100.0D as prob,
  case when (doc_id*37 % 100)/100.0D >= 0.5D then 1 else 0 end as pred from labels""",
    ),
    "samples": (
        (),
        """
select event_id as sample_id, user_id as trade_id, value/100.0D as y,
  value/100.0D + ((event_id % 21) - 10)/50.0D as y_hat from events""",
    ),
}
_TABLES = ("events", "lineitem", "orders", "labels")


def _needed(names: tuple[str, ...]) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in found:
            found.append(name)

    for n in names:
        visit(n)
    return found


def check_sql(body: str, *views: str) -> str:
    """``body`` with the views it needs as leading CTEs, in the dialect of the check engine."""
    ctes = [f"{n} as ({VIEWS[n][1].strip()})" for n in _needed(views)]
    text = body.strip()
    if text.lower().startswith("with "):
        text = "with " + ", ".join([*ctes, text[5:]]) if ctes else text
    elif ctes:
        text = "with " + ", ".join(ctes) + "\n" + text
    return re.sub(r"(\d+\.\d+)D", r"\1::double", text)


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """fills and trades are inputs of many queries: built once per application, then read as tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        path = shared_dir(spark)
        build(spark, sf_dir).write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view; fills and trades go through the library's own operators."""
    if name == "fills":
        return staged(spark, sf_dir, name, fills_df)
    if name == "trades":
        return staged(spark, sf_dir, name, trades_df)
    deps = _needed((name,))
    tables = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in _TABLES]
    ctes = [f"{n} as ({VIEWS[n][1].strip()})" for n in deps]
    return spark.sql("with " + ", ".join(tables + ctes) + f" select * from {name}")


def fills_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = view(spark, sf_dir, "ticks").where("tick_id % 5 = 0").select("ticker", "trade_date", "sec", "tick_id", "price")
    numbered = blocks.row_numbers(fifth, ["ticker", "trade_date"], blocks.time_block(), ["sec", "tick_id"], "n")
    n = F.col("n") - 1
    return numbered.select(
        "ticker", "trade_date", "sec", F.col("tick_id").alias("fill_id"), F.col("price").alias("net_price"),
        (F.when(n % 3 == 0, 2).otherwise(-1) * F.when(F.floor(n / 3.0) % 2 == 0, 1).otherwise(-1)).cast("int").alias("qty"),
    )


def trades_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators import trades as ops

    fills = ops.position_episodes(view(spark, sf_dir, "fills"))
    return ops.trade_times(fills).select(
        "trade_date", "ticker", "ep", "trade_id", "entry_sec", "exit_sec", "entry_price", "exit_price", "side"
    )

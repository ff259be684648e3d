"""Run registered queries against their check text, as the driver does."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def check_rows(sf_dir: str, sql: str) -> pa.Table:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    tab = con.sql(sql).to_arrow_table()
    return tab


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def rows_of(tab: pa.Table):
    names = sorted(tab.column_names)
    cols = [tab.column(n).to_pylist() for n in names]
    return names, sorted((tuple(_norm(v) for v in r) for r in zip(*cols)), key=repr), [_kind(tab.schema.field(n).type) for n in names]


def diff(spark_tab: pa.Table, check_tab: pa.Table) -> str | None:
    an, ar, at = rows_of(spark_tab)
    bn, br, bt = rows_of(check_tab)
    if an != bn:
        return f"columns {an} != {bn}"
    if at != bt:
        return f"types {[(n, x, y) for n, x, y in zip(an, at, bt) if x != y]}"
    if len(ar) != len(br):
        return f"rows {len(ar)} != {len(br)}; spark-only {[r for r in ar[:2000] if r not in br[:4000]][:2]}"
    bad = [(x, y) for x, y in zip(ar, br) if x != y]
    return f"{len(bad)} of {len(ar)} rows differ, first {bad[:2]} cols {an}" if bad else None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("tickloom-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:]
    spark = session()
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            tab = fn(spark, sf).toArrow()
            took = time.time() - start
            if name in checks:
                t1 = time.time()
                msg = diff(tab, check_rows(sf, checks[name]))
                extra = f"check {time.time() - t1:.1f}s"
            else:
                msg, extra = None, "rows only"
            status = "ok" if msg is None else "FAIL"
        except Exception as e:  # noqa: BLE001
            took, tab, extra = time.time() - start, None, ""
            msg, status = f"{type(e).__name__}: {str(e)[:1500]}", "FAIL"
        failed += status == "FAIL"
        print(f"{status} {name} rows={tab.num_rows if tab is not None else '-'} {took:.2f}s {extra} {msg or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(min(main(sys.argv[1:]), 1))

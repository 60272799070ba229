"""Run the registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return ("number", str(value.quantize(decimal.Decimal("0.01"))))
    if isinstance(value, float):
        return ("float", repr(round(value, 9)))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table_of(names: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def sql_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    found = db.execute(sql)
    names = [column[0] for column in found.description]
    return table_of(names, found.fetchall())


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    return table_of(df.columns, df.collect())


def differences(spark: SparkSession, folder: str, build, sql: str) -> str | None:
    """None where both sides agree, else a short description."""
    ours_names, ours = spark_rows(build(spark, folder))
    names, theirs = sql_rows(folder, sql)
    if ours_names != names:
        return f"columns {ours_names} against {names}"
    if ours != theirs:
        only_ours = list((ours - theirs).items())[:3]
        only_theirs = list((theirs - ours).items())[:3]
        return f"{sum(ours.values())} against {sum(theirs.values())} rows; only ours {only_ours}; only theirs {only_theirs}"
    if not ours:
        return "no rows on either side"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from brookhouse.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    for name, build in entry.queries().items():
        if wanted and not any(part in name for part in wanted):
            continue
        begin = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            result = differences(spark, folder, build, sql) if sql else f"{len(spark_rows(build(spark, folder))[1])} rows, no SQL"
        except Exception as error:  # report and go on
            result = "ERROR " + str(error)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - begin:.1f}s {result or ''}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

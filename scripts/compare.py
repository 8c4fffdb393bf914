"""Runs registered queries and their SQL on one folder of tables and reports differences.

    python scripts/compare.py [--dir DIR] [NAME...]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from evidencia import catalogue  # noqa: E402
from evidencia.sources.driver_tables import TABLES  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def compare(frame, found) -> str:
    """Empty if both hold the same rows."""
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=key)
    if mine == theirs:
        return ""
    odd = next(((a, b) for a, b in zip(mine, theirs) if a != b), ("", ""))
    return f"{len(mine)} and {len(theirs)} rows; first difference {odd[0]} and {odd[1]}"


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--dir", default="/root/testdata/sf0.001")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{a.dir}/{t}.parquet'")
    sql = catalogue.oracle_sql()
    for name, f in catalogue.queries().items():
        if a.names and name not in a.names:
            continue
        try:
            frame = f(spark, a.dir)
            print(name, compare(frame, db.execute(sql[name])) or "same" if name in sql else f"{frame.count()} rows", frame.count(), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "FAILED", str(e)[:600], flush=True)


if __name__ == "__main__":
    main()

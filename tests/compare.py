"""Run registered queries against their oracle on one scale folder and compare values."""

from __future__ import annotations

import math
import sys
import time


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "~nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, connection, name, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return "rows-only", len(got), took, 0.0, got[:2]
    started = time.time()
    relation = connection.sql(sql)
    columns = relation.columns
    want = rows_of(columns, relation.fetchall())
    oracle_took = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), took, oracle_took, (sorted(df.columns), sorted(columns))
    if got != want:
        missing = [w for w in want if w not in set(got)][:2]
        extra = [g for g in got if g not in set(want)][:2]
        return f"DIFF rows {len(got)}/{len(want)}", len(got), took, oracle_took, (extra, missing)
    return "ok", len(got), took, oracle_took, got[:1]


def main(argv):
    import duckdb
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf_dir, wanted = argv[0], argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in ("region nation customer supplier part orders lineitem events documents embeddings"
                  " pages benchmark labels conversations").split():
        connection.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            state, n, took, oracle_took, sample = check(spark, connection, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            state, n, took, oracle_took, sample = "ERROR", 0, 0.0, 0.0, str(error)[:1500]
        bad += state not in ("ok", "rows-only")
        note = "" if state == "ok" and n else f" {str(sample)[:1500]}"
        print(f"{name:34s} {state:12s} rows={n} {took:.1f}s/{oracle_took:.1f}s{note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Compare registered queries with their SQL twins; `python -m tests.parity [folder] [name…]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(folder) / name}.parquet')")
    return con


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and an SQL result; empty when equal as multisets."""
    result = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in result.description}
    want_names = [d[0] for d in result.description]
    want_rows = result.fetchall()
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    problems = []
    if sorted(want_names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(want_names)}"]
    for name in want_names:
        if got_types[name] != want_types[name]:
            problems.append(f"type of {name}: {got_types[name]} != {want_types[name]}")
    order = sorted(want_names)
    place = [want_names.index(n) for n in order]
    want = sorted((tuple(row[i] for i in place) for row in want_rows), key=repr)
    got = sorted((tuple(row[n] for n in order) for row in df.collect()), key=repr)
    if len(want) != len(got):
        problems.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {order}: {bad[0][0]} != {bad[0][1]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from evidence.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problems = differences(df, con, oracles[name])
                note = "ok" if not problems else "DIFF " + "; ".join(problems)
            else:
                problems, note = [], f"rows {len(df.collect())}"
        except Exception as error:  # report and go on
            problems, note = ["error"], "ERROR " + str(error)[:1500]
        failed += bool(problems)
        print(f"{name:32s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))

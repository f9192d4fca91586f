"""Run every query and its SQL side by side: ``python -m checks.compare [sf_dir] [names]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# DuckDB's names for Spark's result types.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, sf_dir: str, function, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences; compared by column name, any row order."""
    df = function(spark, sf_dir)
    columns, ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names, theirs = _rows([d[0] for d in result.description], result.fetchall())
    problems = []
    kinds = {n: TYPES.get(t, t) for n, t in df.dtypes}
    their_kinds = {d[0]: str(d[1]) for d in result.description}
    if columns != names:
        problems.append(f"columns {columns} != {names}")
    elif kinds != their_kinds:
        problems.append(f"types {kinds} != {their_kinds}")
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows != {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs)
             if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first:\n  spark  {str(wrong[0][0])[:600]}"
                        f"\n  duckdb {str(wrong[0][1])[:600]}")
    return len(ours), problems


def main() -> int:
    from checks.oracles import all_oracles
    from checks.queries import all_queries
    from clipquest.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = all_queries(), all_oracles()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(8), connection(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            count, problems = compare(spark, con, sf_dir, queries[name], oracles[name])
        except Exception as error:
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:900]}"]
        failed += bool(problems)
        print(f"{'ok  ' if not problems else 'FAIL'} {name:26s} {count:8d} rows {time.time() - start:6.1f} s",
              *problems, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

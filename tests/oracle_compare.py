"""Run registered queries and their checking SQL side by side.

    python tests/oracle_compare.py SF_DIR [KEY ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(path):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_cell(x) for x in value)
    return value


_KIND = {"bigint": "int", "int": "int", "integer": "int", "long": "int", "hugeint": "int", "string": "str",
         "varchar": "str", "double": "float", "float": "float", "boolean": "bool", "smallint": "int"}


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_cell(r[k]) for k in order) for r in rows)


def compare(spark, con, path, key, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, path)
    names, kinds = df.columns, {f.name: f.dataType.simpleString() for f in df.schema}
    left = _rows(df.collect(), names)
    if sql is None:
        return None if sum(left.values()) else "no rows"
    cursor = con.execute(sql)
    other = [d[0] for d in cursor.description]
    other_kinds = {d[0]: str(d[1]).lower() for d in cursor.description}
    if sorted(names) != sorted(other):
        return f"columns {sorted(names)} != {sorted(other)}"
    right = _rows(cursor.fetchall(), other)
    for n in names:
        a, b = _KIND.get(kinds[n], kinds[n]), _KIND.get(other_kinds[n], other_kinds[n])
        if a != b or kinds[n] == "int" or other_kinds[n] in ("integer", "hugeint"):
            return f"type of {n}: {kinds[n]} != {other_kinds[n]}"
    if not left:
        return "no rows on either side" if not right else f"0 != {sum(right.values())} rows"
    if left != right:
        a, b = left - right, right - left
        return (f"{sum(left.values())} vs {sum(right.values())} rows; only Spark {sum(a.values())}: "
                f"{list(a)[:2]}; only SQL {sum(b.values())}: {list(b)[:2]}")
    return None


def main():
    from oncolattice.catalog import ORACLE, QUERIES
    from oncolattice.session import get_session
    path, keys = sys.argv[1], sys.argv[2:]
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(path), 0
    for key in keys or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, path, key, QUERIES[key], ORACLE.get(key))
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {key} {'' if key in ORACLE else '(rows only) '}{time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main()

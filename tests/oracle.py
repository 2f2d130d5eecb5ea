"""Compare registered queries with their SQL twins.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_norm(r[i]) for i in order]) for r in rows)


_SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(df, con, statement: str) -> tuple[bool, str]:
    names = df.columns
    ours = [tuple(r) for r in df.collect()]
    result = con.execute(statement)
    their_names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).upper() for d in result.description}
    theirs = result.fetchall()
    if sorted(names) != sorted(their_names):
        return False, f"columns {sorted(names)} != {sorted(their_names)}"
    odd = []
    for f in df.schema.fields:
        want = _SPARK_TYPES.get(f.dataType.simpleString())
        if want and want not in types[f.name] and types[f.name] not in ("STRING", "NUMBER"):
            odd.append(f"{f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    a, b = normal(names, ours), normal(their_names, theirs)
    note = f"{len(a)} rows" + (f"; types {odd}" if odd else "")
    if a == b:
        return True, note
    in_a, in_b = set(a), set(b)
    only_a, only_b = sorted(in_a - in_b)[:2], sorted(in_b - in_a)[:2]
    return False, f"{len(a)} vs {len(b)} rows\n   ours   {only_a}\n   theirs {only_b}\n   columns {sorted(names)} {odd}"


def main() -> int:
    import __spark_entry__ as entry
    from placewise.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("oracle", spark__master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="10g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, twins = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not args[1:] or any(q.startswith(a) for a in args[1:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in twins:
                ok, note = compare(df, con, twins[name])
            else:
                n = df.count()
                ok, note = n > 0, f"{n} rows (no twin)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {time.time()-start:6.1f}s {note}", flush=True)
    print(f"{len(wanted)-bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

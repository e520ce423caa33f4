"""Run registered queries against their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    return str(v)


def kind(type_text: str) -> str:
    t = type_text.lower()
    if t.startswith(("bigint", "int", "smallint", "tinyint", "hugeint", "long")):
        return "int" if not t.startswith("hugeint") else "hugeint"
    if t.startswith(("double", "float")):
        return "double"
    if t.startswith(("varchar", "string")):
        return "string"
    return t


def compare(spark, name: str, query, sql: str | None, sf_dir: str, con) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(v) for v in r) for r in df.select(*columns).collect())
    took = time.time() - start
    if sql is None:
        return False, f"{len(rows)} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    order = [names.index(c) for c in sorted(names)]
    expected = sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())
    if columns != sorted(names):
        return False, f"columns {columns} != {sorted(names)}"
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {c: (mine[c], types[c]) for c in columns if kind(types[c]) not in (mine[c], "number") and mine[c] != "void"
             and not (kind(types[c]) == mine[c])}
    wrong = {c: p for c, p in wrong.items() if p[1] not in ("NUMBER", "STRING", "bool", "Date", "DATETIME")}
    if rows != expected:
        only = [r for r in rows if r not in set(expected)][:2]
        other = [r for r in expected if r not in set(rows)][:2]
        return False, f"{len(rows)} vs {len(expected)} rows; {columns}\n   spark only {only}\n   sql only   {other}"
    return True, f"{len(rows)} rows, {took:.1f}s" + (f" types {wrong}" if wrong else "")


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = make_session()
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]):
            continue
        try:
            ok, note = compare(spark, name, query, sqls.get(name), sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

"""Runs registered queries against their SQL twins."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result, empty when equal."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, res.fetchall())
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} vs {len(theirs)}")
    columns = sorted(names)
    if mine != theirs:
        a, b = set(mine), set(theirs)
        out.append(f"{columns}")
        out += [f"only spark: {r}" for r in sorted(a - b, key=str)[:3]] + [f"only sql:   {r}" for r in sorted(b - a, key=str)[:3]]
    return out or ([] if mine == theirs else ["values differ"])


def main(sf_dir: str, wanted: list[str]) -> None:
    from hearthline.session import local_session
    import __spark_entry__ as entry

    spark, con = local_session(), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = differences(df, con, oracles[name])
                note = f"{len(oracles[name])}"
            else:
                diff, note = [], f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            diff, note = [str(e)[:1500]], "error"
        print(f"{'ok ' if not diff else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if diff:
            bad.append(name)
            print("   " + "\n   ".join(d[:700] for d in diff), flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1], sys.argv[2:])

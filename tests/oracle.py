"""Side-by-side comparison of a Spark result with DuckDB on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None:
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def canonical(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in at) for r in rows)


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    want = canonical(result.fetchall(), [c[0] for c in result.description])
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == want

"""Row-for-row comparison of a Spark query with DuckDB on the same tables."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def difference(spark, sf_dir, query, sql):
    """Rows only in Spark, rows only in DuckDB."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted("|".join(text(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted("|".join(text(r[names.index(c)]) for c in cols) for r in got.fetchall())
    if ours == theirs:
        return [], []
    return sorted(set(ours) - set(theirs))[:3] or ours[:1], sorted(set(theirs) - set(ours))[:3]

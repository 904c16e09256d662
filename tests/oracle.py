"""Compare a query with its DuckDB SQL, as sets of rows with equal column names."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            pdf[c] = pdf[c].round(6) + 0.0
    text = pdf.astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"}).replace(r"\.0$", "", regex=True)
    return list(pdf.columns), sorted(map(tuple, text.values.tolist()))


def same(spark, query, sql):
    assert rows(query(spark, DATA).toPandas()) == rows(connect().execute(sql).df())

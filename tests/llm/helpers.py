"""What the tests share."""

import glob
import os
import random

import duckdb

D = os.environ.get("FEDSEEK_TEST_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def duck(folder=D):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(df, want):
    """Rows of a DataFrame and a DuckDB relation as sorted lists over the relation's columns."""
    got = sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr)
    return got, sorted(want.fetchall(), key=repr)


def frame(spark, texts, source="s", extra=""):
    """documents of texts, ids from 0 on."""
    rows = [(i, x, "en", source if isinstance(source, str) or source is None else source[i], len(x or "")) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed=0, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

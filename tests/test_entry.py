import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier documents".split()


def plain(df):
    cols = sorted(df.columns)
    blank = lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v)
    return df[cols].map(blank).sort_values(cols).reset_index(drop=True)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_phone_normalized", "q_hospital_key", "q_region_lookup", "q_name_parse", "q_specialty_native", "q_infer", "q_edit_pairs", "q_idem"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = plain(entry.queries()[name](spark, DIR).toPandas()), plain(con.sql(entry.oracle_sql()[name]).df())
    assert len(got) and got.equals(want)


def test_match_best_covers_all_records(spark):
    """Against all pairs in DuckDB, over every record on both sides."""
    from rostra.functions.text import compare_key, hospital_key
    from rostra.queries import records

    r = records(spark, DIR)
    k = r.select(r["ordinal"].alias("o"), compare_key("nom").alias("n"), r["specialite"].alias("sp"), compare_key("ville").alias("c"), hospital_key("hopital").alias("h")).toPandas()  # noqa: F841
    want = duckdb.sql("""WITH x AS (
      SELECT a.o AS ordinal, b.o AS match, levenshtein(a.n, b.n)::INTEGER AS distance FROM k a JOIN k b ON a.o <> b.o AND a.n <> '' AND b.n <> '' AND levenshtein(a.n, b.n) <= 2
        AND levenshtein(a.c, b.c) <= 3 AND (a.sp = b.sp OR a.sp = '' OR b.sp = '') AND (a.h = b.h OR a.h = '' OR b.h = ''))
    SELECT ordinal, match, distance FROM x QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY distance, match) = 1""").df()
    got = entry.queries()["q_match_best"](spark, DIR).toPandas()
    assert plain(got).equals(plain(want)) and set(got["ordinal"] % 3) == set(got["match"] % 3) == {0, 1, 2}

"""Queries that have SQL, against DuckDB, over the smallest test tables and over small ones with odd rows."""

import os

import duckdb
import pytest
from strandline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCUMENTS = [
    (1, "a b c a b c\n\nx #1 a.b@c.de 1.2.3.4 999.1.1.1", "en", "s", 9), (2, None, None, None, None), (3, "", "en", "t", 0), (4, " \t\n", "xx", "t", 3),
    (5, "card 4111 1111 1111 1111 and 4111111111111112, call +1 (555) 555-0101 or +12", "de", "u", 60), (6, "w " * 70, "en", None, 140), (6, "w " * 70, "en", None, 140),
    (7, "línea é\nlínea é\n\nfin <|x|> 378282246310005", "es", "v", 30), (None, "Released under the MIT License.\nmore", "en", "s", 30),
]


def plain(x):
    return repr(round(x, 3)) if isinstance(x, float) else repr(x)


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            kind = "/*.parquet" if os.path.isdir(f"{folder}/{t}.parquet") else ""
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet{kind}'")
    df, relation = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall())
    return ours


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert same(spark, SF, name)


@pytest.mark.parametrize("name", ["mixing_targets", "quality_base", "pii_base_counts", "op7_license_digests"])
def test_odd_rows_match_sql(spark, tmp_path, name):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(same(spark, str(tmp_path), name)) == len(DOCUMENTS)

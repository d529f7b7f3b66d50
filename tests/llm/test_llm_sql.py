"""The queries with SQL against DuckDB, on the smallest tables and on odd ones made here."""

from pathlib import Path

import duckdb
import pytest
from test_llm_operators import BASE, TURNS, conversations, documents, licence_texts

from tessera.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
TABLES = ("documents", "pages", "labels", "conversations")


def told(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if Path(path).is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    columns, got = told(queries()[name](spark, str(folder)))
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall())
    return len(got)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, repeats, notices of all licences, hosts that differ."""
    folder = tmp_path_factory.mktemp("odd")
    texts = [(1000 + i, t, "en", "abc"[i % 3], 0) for i, (t, _) in enumerate(licence_texts())]
    # The SQL of op4 takes memory with the square of a text's words.
    short = [(r[0], r[1] and r[1][:4000], *r[2:]) for r in BASE + texts]
    documents(spark, short).write.parquet(f"{folder}/documents.parquet")
    hosts = ["bad.spam.org", "fine.spam.org", "www.example.com", "a.b.net", "1.2.3.4", "new.co.uk", "x.new.co.uk", ""]
    pages = [(i, f"http://{hosts[i % 8]}/{'en' if i % 3 else 'es'}/{i}") for i in range(400)] + [(400, None), (401, "no scheme"), (None, "HTTP://X.Y"), (5, "http://twice.org:80?q"), (402, "http://long.org/" + "p" * 300_000)]
    spark.createDataFrame([(*p, "<p>") for p in pages], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    labels = [(i, int(i % 8 != 0), int(i % 56 == 1)) for i in range(350)] + [(8, 1, 1), (9, None, None), (None, 0, 0), (99999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = TURNS + [(10, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(1300)] + [(11, 0, "assistant", "x" * 100_000)]
    conversations(spark, turns).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_agree_with_sql(spark, odd, name):
    assert compared(spark, odd, name) > 0
    if DATA.exists():
        assert compared(spark, DATA, name) > 0


def test_verdicts_and_parts_all_occur(spark, odd):
    every = queries()
    assert {r[0] for r in every["op5_url_filters"](spark, str(odd)).filter("rule IS NULL").select("verdict").distinct().collect()} == {"allow", "block"}
    chat = every["op9_chat_formatting"](spark, str(odd)).selectExpr("count(prompt) AS p", "count(chosen) AS c", "count(rejected) AS r", "count(single) AS s").first()
    assert min(chat) > 0
    assert {r[0] for r in every["op4_quality_rules"](spark, str(odd)).select("kept").distinct().collect()} == {True, False}

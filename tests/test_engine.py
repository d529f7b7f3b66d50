"""The dialect, the store and transactions."""

import threading

import pytest

from tessera.plans.parser import parse
from tessera.plans.tokens import ParseError
from tessera.store.cli import repl
from tessera.store.session import Engine
from tessera.streaming.replica import apply_commits, last_applied, replicate


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


@pytest.fixture
def session(engine):
    return engine.session()


def run(session, *statements):
    out = ""
    for text in statements:
        out = session.execute(text)
        assert not out.startswith("ERR"), out
    return out.splitlines()[:-1]


def lighthouses(session):
    """A table of five lights and one of the keepers' visits."""
    run(
        session,
        "CREATE TABLE light (nr INT, coast VARCHAR(40), height FLOAT, lit BOOL, since TIMESTAMP)",
        "INSERT INTO light VALUES (11, 'north', 61.5, true, 1200000000), (12, 'north', 18.25, false, 1300000000), (13, 'west', 44.0, true, 1100000000)",
        "INSERT INTO light VALUES (14, 'south', 27.75, true, 1250000000);",
        "INSERT INTO light VALUES (15, NULL, 33.0, NULL, 1000000000)",
        "CREATE TABLE visit (light INT, keeper VARCHAR, hours INT)",
        "INSERT INTO visit VALUES (11, 'ada', 4), (11, 'eli', 7), (13, 'ada', 2), (14, 'noor', 9), (77, 'eli', 1)",
    )
    return session


def test_filters_and_orders(session):
    s = lighthouses(session)
    assert sorted(run(s, "SELECT nr FROM light WHERE height >= 33")) == ["11", "13", "15"]
    assert run(s, "SELECT nr FROM light WHERE lit != true") == ["12"]  # unknown is not different
    assert run(s, "SELECT nr FROM light WHERE coast IS NULL") == ["15"]
    assert run(s, "SELECT nr FROM light WHERE NOT coast LIKE '%th' AND nr BETWEEN 12 AND 14") == ["13"]
    assert run(s, "SELECT nr FROM light ORDER BY since DESC LIMIT 2 OFFSET 1") == ["14", "11"]
    assert run(s, "SELECT DISTINCT coast FROM light WHERE lit = true ORDER BY coast DESC") == ["west", "south", "north"]


def test_changes_of_rows(session):
    s = lighthouses(session)
    run(s, "UPDATE light SET lit = true, height = height + 1 WHERE nr = 12", "DELETE FROM light WHERE coast = 'west'")
    assert sorted(run(s, "SELECT nr, height, lit FROM light")) == ["11 | 61.5 | true", "12 | 19.25 | true", "14 | 27.75 | true", "15 | 33 | NULL"]
    run(s, "DELETE FROM light WHERE nr > 1000", "DELETE FROM light")
    assert run(s, "SELECT COUNT(*) FROM light") == ["0"]


def test_changes_rewrite_only_segments_with_a_hit(session):
    s = lighthouses(session)
    paths = lambda: [x["path"] for x in s.engine.log.latest()["tables"]["light"]["segments"]]
    before = paths()
    assert len(before) == 3
    run(s, "UPDATE light SET height = 1 WHERE nr = 14")
    assert set(before) - set(paths()) == {before[1]} and len(paths()) == 3
    run(s, "DELETE FROM light WHERE nr = 999")
    after = paths()
    run(s, "DELETE FROM light WHERE nr = 15")
    assert set(paths()) == set(after) - {before[2]} and run(s, "SELECT name, rows FROM sys_tables WHERE name = 'light'") == ["light | 4"]
    assert sorted(run(s, "SELECT nr FROM light")) == ["11", "12", "13", "14"]


def test_aggregates_joins_windows(session):
    s = lighthouses(session)
    assert run(s, "SELECT COUNT(*), COUNT(lit), SUM(height), MIN(since), MAX(coast) FROM light") == ["5 | 4 | 184.5 | 1000000000 | west"]
    assert sorted(run(s, "SELECT keeper, SUM(hours) AS h FROM visit GROUP BY keeper HAVING SUM(hours) > 6")) == ["eli | 8", "noor | 9"]
    assert sorted(run(s, "SELECT keeper, coast FROM visit JOIN light ON light = nr WHERE hours < 8")) == ["ada | north", "ada | west", "eli | north"]
    got = run(s, "SELECT nr, keeper FROM light LEFT JOIN visit ON nr = light")
    assert len(got) == 6 and {"12 | NULL", "15 | NULL"} <= set(got)
    assert "NULL | eli" in run(s, "SELECT nr, keeper FROM light RIGHT JOIN visit ON nr = light")
    assert len(run(s, "SELECT * FROM light CROSS JOIN visit")) == 25
    got = run(s, "SELECT keeper, light, RANK() OVER (PARTITION BY keeper ORDER BY hours) AS r, SUM(hours) OVER (PARTITION BY keeper ORDER BY light) AS so_far FROM visit")
    assert sorted(got) == ["ada | 11 | 2 | 4", "ada | 13 | 1 | 6", "eli | 11 | 2 | 7", "eli | 77 | 1 | 8", "noor | 14 | 1 | 9"]


def test_subqueries_and_steps(session):
    s = lighthouses(session)
    assert run(s, "SELECT nr FROM light WHERE height = (SELECT MAX(height) FROM light WHERE coast != 'north')") == ["13"]
    assert run(s, "SELECT keeper FROM visit WHERE light NOT IN (SELECT nr FROM light)") == ["eli"]
    assert run(s, "WITH tall AS (SELECT nr, coast FROM light WHERE height > 30), seen AS (SELECT nr, hours FROM tall JOIN visit ON nr = light) SELECT nr, SUM(hours) FROM seen GROUP BY nr ORDER BY nr") == ["11 | 11", "13 | 2"]


def test_case_and_cast(session):
    s = lighthouses(session)
    got = run(s, "SELECT nr, CASE WHEN height > 50 THEN 'tall' WHEN lit = true THEN 'lit' ELSE coast END FROM light")
    assert sorted(got) == ["11 | tall", "12 | north", "13 | lit", "14 | lit", "15 | NULL"]
    assert sorted(run(s, "SELECT CASE keeper WHEN 'ada' THEN 1 END AS c FROM visit")) == ["1", "1", "NULL", "NULL", "NULL"]
    assert run(s, "SELECT CAST(nr AS VARCHAR) || '!' AS t, CAST('7' AS INT) * 2 AS n, CAST(height AS INT) AS h FROM light WHERE nr = 14") == ["14! | 14 | 27"]
    assert session.execute("SELECT CAST(coast AS INT) FROM light WHERE nr = 11").startswith("ERR EXEC")


def test_using_and_natural(session):
    run(session, "CREATE TABLE p (k INT, z VARCHAR, x INT)", "CREATE TABLE q (k INT, z VARCHAR, y INT)", "INSERT INTO p VALUES (1,'a',10),(2,'b',20)", "INSERT INTO q VALUES (2,'b',200),(2,'c',250),(3,'c',300)")
    assert sorted(run(session, "SELECT * FROM p JOIN q USING (k)")) == ["2 | b | 20 | b | 200", "2 | b | 20 | c | 250"]
    assert run(session, "SELECT * FROM p NATURAL JOIN q") == ["2 | b | 20 | 200"]
    assert sorted(run(session, "SELECT k, p.k, q.k, y FROM p FULL JOIN q USING (k, z)")) == ["1 | 1 | NULL | NULL", "2 | 2 | 2 | 200", "2 | NULL | 2 | 250", "3 | NULL | 3 | 300"]
    assert session.execute("SELECT * FROM p JOIN q USING (x)").startswith("ERR EXEC")


def test_side_biased_names(session):
    run(session, "CREATE TABLE a (dept_id INT, x INT)", "CREATE TABLE b (dept_id INT, y INT)", "INSERT INTO a VALUES (1,10),(2,20)", "INSERT INTO b VALUES (2,200),(3,300)")
    assert run(session, "SELECT * FROM a JOIN b ON dept_id = dept_id") == ["2 | 20 | 2 | 200"]
    assert sorted(run(session, "SELECT dept_id, y FROM a FULL JOIN b ON dept_id = dept_id")) == ["1 | NULL", "2 | 200", "NULL | 300"]


def test_schema_changes(session):
    run(session, "CREATE TABLE t (id INT, name VARCHAR, age INT)", "INSERT INTO t VALUES (1,'a',30)")
    run(session, "ALTER TABLE t ADD COLUMN active BOOL", "ALTER TABLE t RENAME age TO years", "INSERT INTO t VALUES (2,'b',40,true)")
    assert run(session, "SELECT id, years FROM t WHERE active = false") == ["1 | 30"]
    run(session, "ALTER TABLE t DROP COLUMN name")
    assert sorted(run(session, "SELECT * FROM t")) == ["1 | 30 | false", "2 | 40 | true"]
    run(session, "CREATE INDEX i ON t (years) USING HASH")
    assert run(session, "SELECT id FROM t WHERE years = 40") == ["2"]
    assert run(session, "SELECT name, rows FROM sys_tables") == ["t | 2"]
    run(session, "DROP INDEX i", "DROP TABLE t")
    assert session.execute("SELECT * FROM t").startswith("ERR EXEC")


def test_types_round_trip(session):
    run(session, "CREATE TABLE t (a INT, b VARCHAR, c BOOL, d FLOAT, e TIMESTAMP, f JSON, g UUID, h SIGNED_INT)")
    run(session, "INSERT INTO t VALUES (1, 'it''s', true, 1.5, 1690000000, '{}', '00112233-4455-6677-8899-aabbccddeeff', -5)")
    assert run(session, "SELECT * FROM t") == ["1 | it's | true | 1.5 | 1690000000 | {} | 00112233445566778899aabbccddeeff | -5"]
    assert session.execute("INSERT INTO t (a) VALUES (-1)").startswith("ERR EXEC")
    assert session.execute("INSERT INTO t (a, b) VALUES (1, 2)").startswith("ERR EXEC")


def test_explain_is_the_plan_that_runs(session):
    s = lighthouses(session)
    assert run(s, "EXPLAIN SELECT nr FROM light WHERE nr = 13")[-1].strip() == "-> Scan parquet [IsNotNull(c0), EqualTo(c0,13)]"
    names = [line.strip().split(" ")[1] for line in run(s, "EXPLAIN SELECT keeper, SUM(hours) FROM visit JOIN light ON light = nr GROUP BY keeper ORDER BY keeper LIMIT 2")]
    assert names[0] == "TakeOrderedAndProject" and names.count("HashAggregate") == 2 and names.count("Scan") == 2 and any("Join" in n for n in names)
    assert run(s, "EXPLAIN DELETE FROM light WHERE nr > 12")[0] == "-> Delete" and run(s, "EXPLAIN INSERT INTO light VALUES (1, 'x', 1.0, true, 1)") == ["-> Insert"]
    assert any("Window" in line for line in run(s, "EXPLAIN SELECT ROW_NUMBER() OVER (ORDER BY nr) FROM light"))


def test_errors():
    for text in ("SELECT * FROM t trailing words", "SELEC 1", "SELECT MIN(*) FROM t", "CREATE TABLE t (a BLOB)", "INSERT INTO t VALUES (a)", "SELECT * FROM t WHERE", "DELETE FROM t; SELECT 1", "SELECT 'open"):
        with pytest.raises(ParseError):
            parse(text)


def test_transactions(engine):
    a, b = engine.session(), engine.session()
    run(a, "CREATE TABLE t (id INT, val INT)", "INSERT INTO t VALUES (1, 100)")
    run(b, "BEGIN")
    assert run(b, "SELECT val FROM t") == ["100"]
    run(a, "UPDATE t SET val = 200 WHERE id = 1")
    assert run(b, "SELECT val FROM t") == ["100"]  # reads repeat
    run(b, "COMMIT")
    assert run(b, "SELECT val FROM t") == ["200"]
    run(a, "BEGIN", "INSERT INTO t VALUES (2, 1)", "UPDATE t SET val = 7", "DELETE FROM t WHERE id = 2")
    assert run(a, "SELECT * FROM t") == ["1 | 7"]  # sees its own
    assert run(b, "SELECT * FROM t") == ["1 | 200"]
    assert a.execute("BEGIN").startswith("ERR EXEC")
    run(a, "ROLLBACK")
    assert run(a, "SELECT * FROM t") == ["1 | 200"]
    # The first writer wins; inserts alone go on top of each other.
    run(a, "BEGIN", "UPDATE t SET val = 1")
    run(b, "UPDATE t SET val = 2")
    assert "another session" in a.execute("COMMIT")
    run(a, "BEGIN", "INSERT INTO t VALUES (3, 3)")
    run(b, "INSERT INTO t VALUES (4, 4)")
    run(a, "COMMIT")
    assert sorted(run(b, "SELECT id FROM t")) == ["1", "3", "4"]
    assert run(engine.session(), "PREPARE x") == []


def test_concurrent_inserts(engine):
    run(engine.session(), "CREATE TABLE t (id INT, val INT)")

    def work(k):
        s = engine.session()
        for i in range(4):
            assert s.execute(f"INSERT INTO t VALUES ({10 * k + i}, {k})") == "OK\n"

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert run(engine.session(), "SELECT COUNT(*) FROM t") == ["12"]


def test_uncommitted_rows_are_gone_after_a_crash(spark, engine):
    run(engine.session(), "CREATE TABLE t (id INT)")
    lost = engine.session()
    run(lost, "BEGIN", "INSERT INTO t VALUES (1), (2), (3)")
    lost.sql("SELECT * FROM t").collect()
    assert run(Engine(spark, engine.root).session(), "SELECT COUNT(*) FROM t") == ["0"]


def test_read_only_and_prompt(spark, engine):
    run(engine.session(), "CREATE TABLE t (id INT)")
    reader = Engine(spark, engine.root, read_only=True)
    assert reader.session().execute("INSERT INTO t VALUES (1)").startswith("ERR EXEC")
    out = []
    repl(engine, ["SELECT COUNT(*) FROM t", ".help", "BEGIN", ".quit", "never"], out.append)
    assert out[0] == "0\nOK\n" and out[-1] == "(txn) > "


def test_router(session):
    assert session.execute("ROUTER GET k").startswith("ERR EXEC")
    assert session.execute("ROUTER ADD n1") == "OK\n" and session.execute("router add n2") == "OK\n"
    assert session.execute("ROUTER GET k") in ("n1\n", "n2\n")
    session.execute("ROUTER REMOVE n1")
    assert session.execute("ROUTER GET k") == "n2\n"
    assert session.execute("ROUTER NOPE").startswith("ERR PARSER")


def test_replica(spark, engine, tmp_path):
    leader = engine.session()
    run(leader, "CREATE TABLE t (id INT, val VARCHAR)", "INSERT INTO t VALUES (1,'a'),(2,'b')", "DELETE FROM t WHERE id = 1")
    follower = Engine(spark, f"file://{tmp_path}/copy")
    replicate(engine, follower, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert run(follower.session(), "SELECT * FROM t") == ["2 | b"]
    assert last_applied(follower) == 3
    run(leader, "BEGIN", "INSERT INTO t VALUES (3,'c')", "UPDATE t SET val = 'z' WHERE id = 2", "COMMIT")
    replicate(engine, follower, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sorted(run(follower.session(), "SELECT * FROM t")) == ["2 | z", "3 | c"]
    # A batch that comes again changes nothing.
    again = spark.createDataFrame([(1, ["INSERT INTO t VALUES (9,'x')"])], "commit long, statements array<string>")
    assert apply_commits(follower, again) == 0

"""Operators on literal rows: nulls, ties, empty inputs, errors."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.ring import Ring
from tessera.operators import aggregate, change, cte, join, scan, sort, window
from tessera.operators import predicate as p
from tessera.plans.lower import BindError
from tessera.plans.parser import parse
from tessera.plans.tokens import ParseError, tokenise
from tessera.sources.result_text import as_lines, format_rows
from tessera.sources.tables import rows
from tessera.types import TypeMismatch, to_value

PEOPLE = [("id", "INT"), ("age", "INT"), ("name", "VARCHAR")]


@pytest.fixture(scope="module")
def people(spark):
    return rows(spark, PEOPLE, [(1, 30, "alice"), (2, 20, "bob"), (3, 40, "carol"), (4, 25, "dave")])


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters(people):
    assert ids(p.filter_rows(people, p.compare("age", ">=", 30))) == [1, 3]
    assert len(ids(p.filter_rows(people, p.compare("age", ">=", 20), p.compare("age", "<=", 30)))) == 3
    assert ids(p.filter_rows(people)) == [1, 2, 3, 4]
    assert ids(scan.search(people, "id", 3)) == [3]
    assert ids(scan.index_scan_range(people, "id", 2, 3)) == [2, 3]
    assert p.project_at(people, 2, 0).columns == ["name", "id"]


def test_sort_and_limit(people):
    assert ids(sort.limit(sort.order_by(people, ("id", False)), 2, 1)) == [2, 3]
    assert [r["age"] for r in sort.order_by(people, ("age", False)).collect()] == [20, 25, 30, 40]
    assert ids(sort.top_k(people, [("age", True)], 2)) == [3, 1]


def test_null_order(spark):
    df = rows(spark, [("id", "INT"), ("v", "INT")], [(1, None), (2, 5), (3, 1)])
    assert ids(sort.order_by(df, ("v", False))) == [1, 3, 2] and ids(sort.order_by(df, ("v", True))) == [2, 3, 1]


def test_aggregates(people):
    got = aggregate.aggregate(people, [], n=("COUNT", "*"), s=("SUM", "age"), lo=("MIN", "age"), hi=("MAX", "age"), mean=("AVG", "age")).first()
    assert tuple(got) == (4, 115, 20, 40, 28.75)
    nothing = aggregate.aggregate(people.filter("false"), [], n=("COUNT", "*"), s=("SUM", "age")).first()
    assert tuple(nothing) == (0, None)
    with pytest.raises(ValueError, match="needs a column"):
        aggregate.aggregate_of("SUM")


def test_nulls_group_together_and_never_join(spark):
    df = rows(spark, [("k", "INT"), ("v", "INT")], [(None, 1), (None, 2), (1, 3)])
    got = {r["k"]: (r["n"], r["m"]) for r in aggregate.aggregate(df, ["k"], n=("COUNT", "*"), m=("COUNT", "k")).collect()}
    assert got == {None: (2, 0), 1: (1, 1)}
    assert join.hash_join(df, df, "k", "k").count() == 1
    assert join.join(df, df, [("k", "=", "k")], "full").count() == 5


def test_windows_share_no_value_between_ties(spark):
    df = rows(spark, [("id", "INT"), ("v", "INT")], [(1, 5), (2, 5), (3, 7)])
    got = window.running(df, "s", "SUM", "v", [], [("v", False), ("id", False)])
    assert sorted(r["s"] for r in got.collect()) == [5, 10, 17]
    assert sorted(r["r"] for r in window.rank(df, "r", [], [("v", False)]).collect()) == [1, 1, 3]
    assert sorted(r["r"] for r in window.rank(df, "r", [], [], ["id"]).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="needs an order"):
        window.row_number(df, "r", [], [])


def test_changes(people):
    assert ids(change.delete_rows(people, F.col("id") == 2)) == [1, 3, 4]
    assert change.delete_rows(people).count() == 0
    assert [r["age"] for r in change.update_rows(people, {"age": F.col("age") + 1}, F.col("id") > 2).collect()] == [30, 20, 41, 26]
    assert change.insert_rows(people, [(5, 1, "eve")]).count() == 5
    assert change.add_column(people, "ok", "BOOL").first()["ok"] is False
    assert change.rename_column(people, "age", "years").columns == ["id", "years", "name"]
    with pytest.raises(ValueError, match="exists"):
        change.add_column(people, "age", "INT")


def test_conditions_that_are_unknown_delete_nothing(spark):
    df = rows(spark, [("id", "INT"), ("v", "INT")], [(1, None), (2, 3)])
    assert ids(change.delete_rows(df, F.col("v") == 3)) == [1]


def test_steps_see_the_ones_before(people):
    got = cte.with_steps({"p": people}, lambda t: t["b"], a=lambda t: t["p"].filter("age > 20"), b=lambda t: t["a"].filter("age < 40"))
    assert ids(got) == [1, 4]


def test_scalar_subquery(people):
    oldest = aggregate.aggregate(people, [], m=("MAX", "age"))
    assert ids(p.compare_scalar(people, "age", "=", oldest)) == [3]
    assert ids(p.compare_scalar(people, "age", "=", people.filter("false").select("age"))) == []


def test_result_text(spark, people):
    assert format_rows([(1, None, True, 1.5, b"\x0f")]) == "1 | NULL | true | 1.5 | 0f\nOK\n"
    assert [r["line"] for r in as_lines(people).collect()][0] == "1 | 30 | alice"


@pytest.mark.parametrize(("value", "kind"), [(-1, "INT"), (1 << 63, "SIGNED_INT"), ("x", "INT"), (True, "INT"), (1, "BOOL"), (1, "VARCHAR"), ("zz", "UUID"), ("1", "FLOAT")])
def test_values_that_do_not_fit(value, kind):
    with pytest.raises(TypeMismatch):
        to_value(value, kind)


def test_ring(spark):
    ring = Ring("a", "b", "c")
    before = {k: ring.get(str(k)) for k in range(500)}
    ring.add("d")
    moved = {k for k in before if ring.get(str(k)) != before[k]}
    assert all(ring.get(str(k)) == "d" for k in moved) and 0 < len(moved) < 300
    ring.remove("d")
    assert {k: ring.get(str(k)) for k in range(500)} == before
    got = spark.range(300).select(ring.column(F.col("id")).alias("n")).groupBy("n").count().collect()
    assert {r["n"] for r in got} == {"a", "b", "c"}
    with pytest.raises(LookupError):
        Ring().get("x")


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(max_size=60) | st.lists(st.sampled_from("SELECT * FROM t WHERE ( ) , ' 1 AND a = ; ORDER BY LIMIT WITH AS".split()), max_size=15).map(" ".join))
def test_any_text_parses_or_raises_a_parse_error(text):
    try:
        parse(text)
    except ParseError:
        pass


def test_tokens():
    assert [t.text for t in tokenise("SELECT a_1, 'it''s' -- x\n <= 1.5e3 /* y */ \"Q q\"")][:-1] == ["SELECT", "a_1", ",", "it's", "<=", "1.5e3", "Q q"]


def test_names_that_do_not_bind(spark, tmp_path):
    from tessera.store.session import CatalogueError, Engine

    session = Engine(spark, f"file://{tmp_path}/db").session()
    session.run(parse("CREATE TABLE t (id INT)"))
    with pytest.raises(BindError):
        session.sql("SELECT nope FROM t")
    with pytest.raises(CatalogueError):
        session.sql("SELECT id FROM missing")
    with pytest.raises(CatalogueError):
        session.run(parse("CREATE TABLE t (id INT)"))


# Joins whose keys are few and whose pairs are many


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_join_on_a_key_and_an_order_makes_every_pair_once(spark, monkeypatch, op):
    monkeypatch.setattr(join, "CHUNK_ROWS", 3)
    monkeypatch.setattr(join, "BLOCK_CHUNKS", 2)
    values = [None, -0.0, 0.0, 1.5, 1.5, 1.5, 2.0, 7.25, float("nan"), float("inf")]
    left = [(i, k, values[(i * 7 + k) % 10]) for k in (1, 2, 3) for i in range(40)] + [(0, 1, 1.5)] * 9 + [(1, None, 2.0), (2, 4, 2.0)]
    right = [(i, k, values[(i * 3 + k) % 10]) for k in (1, 2, 5) for i in range(25)] + [(0, 1, 1.5)] * 8 + [(1, None, 2.0)]
    l = spark.createDataFrame(left, "id int, k int, `v v` double")
    r = spark.createDataFrame(right, "id int, k long, w double")
    got = join.join(l, r, [("k", "=", "k"), ("v v", op, "w")], residual=F.col("l.id") != F.col("r.id") + 30)
    assert got.columns == ["id", "k", "v v", "id", "k", "w"] and "Generate inline" in plan(got)

    plain = l.alias("l").join(r.alias("r"), (F.col("l.k") == F.col("r.k")) & p.compare(F.col("v v"), op, F.col("w")) & (F.col("l.id") != F.col("r.id") + 30))
    shown = [sorted(map(repr, df.select("l.id", "l.k", "v v", F.col("r.id").alias("r_id"), F.col("r.k").alias("r_k"), "w").collect())) for df in (got, plain)]
    assert shown[0] == shown[1] and len(shown[0]) > 500


def test_pairs_of_one_key_spread_over_tasks(spark):
    rows = spark.range(0, 4096, 1, 1).selectExpr("id", "id DIV 4096 AS k", "id AS v")
    pairs = join.join(rows, rows, [("k", "=", "k"), ("v", "<", "v")])
    by_task = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 4096 * 4095 // 2 and len(by_task) > 1
    assert "Broadcast" not in plan(pairs) and "Coalesce" in plan(pairs)


def test_join_that_blocks_can_not_cut_stays_plain(spark):
    words = spark.createDataFrame([(1, "10"), (1, "9")], "k int, v string")
    numbers = spark.createDataFrame([(1, 9), (1, 10)], "k int, w int")
    got = join.join(words, numbers, [("k", "=", "k"), ("v", "<", "w")])
    assert "Generate" not in plan(got) and [(r["v"], r["w"]) for r in got.collect()] == [("9", 10)]
    outer = join.join(numbers, numbers, [("k", "=", "k"), ("w", "<", "w")], "left")
    assert sorted((r[1], r[3]) for r in outer.collect() if r[3] is not None) == [(9, 10)] and outer.count() == 2

"""Every registered query outside llm against its SQL, and what the plans must look like."""

import math

import duckdb
import pytest

from diglot import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PYTHON = {"decode_bytes", "stub_translate", "dup_runs", "html_blocks", "html_collapse", "html_tag_counts", "page_titles", "archive_round_trip", "package_spines", "repaired_contents"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (bool, str)) else float(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(names).collect()), key=repr)
    assert got
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == names
        at = [want.columns.index(n) for n in names]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - PYTHON))
def test_no_python_where_sql_will_do(spark, sf, name):
    text = plan(registry.queries()[name](spark, sf))
    assert "Python" not in text and "Arrow" not in text and "InPandas" not in text


def test_scans_read_what_they_need(spark, sf):
    text = plan(registry.queries()["spine_order"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in text
    assert "GreaterThan(p_size,10)" in text.replace(" ", "")
    counted = plan(registry.queries()["token_usage"](spark, sf))
    assert "role:string" in counted and "doc_id" not in counted


def test_counts_are_summed_before_they_move(spark, sf):
    text = plan(registry.queries()["blocks_to_translate"](spark, sf))
    assert text.count("HashAggregate") == 2 and text.count("Exchange hashpartitioning") == 1


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "n_lines", "n_eligible", "n_tokens", "n_letters"] and df.count() == 4


@pytest.mark.parametrize("name", ["zh_follow", "duplicate_keys", "pack_batches", "alike_neighbours", "derive_target", "batch_prompts", "first_n_blocks", "dup_runs"])
def test_lines_are_normalised_once(spark, sf, name):
    assert plan(registry.queries()[name](spark, sf)).count("\u2018\u2019\u201c\u201d") == 1


def test_what_windows_and_batches_move(spark, sf):
    assert "Join" not in plan(registry.queries()["pack_batches"](spark, sf))
    runs = plan(registry.queries()["dup_runs"](spark, sf))
    assert "InPandas" not in runs and runs.count("MapInArrow") == 1
    move = [x for x in plan(registry.queries()["zh_follow"](spark, sf)).split("\n") if "Window [" in x]
    assert len(move) == 1 and "lead(" in move[0] and "regexp" not in move[0]

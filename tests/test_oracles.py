"""Every registered query of the library against its DuckDB counterpart."""

import glob
import os
import re

import duckdb
import pytest

from loomspan import registry
from loomspan.functions.lexemes import stem
from loomspan.model import Bundle


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, sf, name):
    mine = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    """Executed, not only planned, and with rows."""
    found = registry.QUERIES[name](spark, sf)
    assert found.columns and found.count() > 0


def test_full_text_finds_the_stem(spark, sf):
    """The query's words are a stop word and a plural: blocks with a word of the same stem are found, and no others."""
    found = {r.content_block_id for r in registry.QUERIES["p12_full_text"](spark, sf).collect()}
    blocks = Bundle(spark, sf).blocks.select("content_block_id", "value").collect()
    assert found == {r.content_block_id for r in blocks if "thtion" in map(stem, re.findall(r"[a-z]+", r.value.lower()))} != set()


def test_names_are_registered_once():
    with pytest.raises(ValueError):
        registry.register("p12_full_text")(lambda b: None)

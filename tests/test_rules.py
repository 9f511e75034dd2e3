"""Rules over literal rows: every code of the completion rules, guards, and sanitized output."""

import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomspan.functions import textops
from loomspan.model import Bundle
from loomspan.operators import guards
from loomspan.plans import quality_checks, rules


@pytest.mark.parametrize("text, want", [
    ("see postgresql://u:p@h/db now", "see [REDACTED_DATABASE_URL] now"),
    ("t eyJabcdefghijklmnopqrstuv.abcdefghijkl.mnopqrstuvwx end", "t [REDACTED_JWT] end"),
    ("Password: hunter22, next", "Password=[REDACTED], next"),
    ("get http://127.0.0.1:80/x and http://localhost/y", "get http://127.0.0.1:80/x and http://localhost/y"),
    ("get http://localhost.example.org/y", "get [REDACTED_NONLOCAL_URL]"),
    ("", ""),
])
def test_sanitized(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(textops.sanitized(F.col("t"))).first()[0] == want


def test_every_completion_code_is_planted(spark):
    found = guards.completion_errors(rules.counted_runs(Bundle(spark, "/root/testdata/sf0.01")))
    codes = {r.e for r in found.select(F.explode("errors").alias("e")).distinct().collect()}
    assert codes == {"run_missing", *guards.COMPLETION_CODES}


def test_guards_name_the_first_error(spark):
    row = {"name": "n", "record_sha256": "a", "status": "open", "progress": 5}
    cases = [("quarantine", {}, None), ("quarantine", {"status": "released"}, None), ("quarantine", {"name": None}, "row_deleted"), ("checkpoint", {"record_sha256": "b"}, None),
             ("checkpoint", {"progress": 4}, "moved_backward"), ("dead_letter", {"record_sha256": "b", "progress": 4}, "content_immutable"), ("workspace", {"status": "x"}, "status_invalid")]
    rows = [(k, i, *row.values(), *{**row, **new}.values()) for i, (k, new, _) in enumerate(cases)]
    names = ", ".join(f"{side}_{c} {'long' if c == 'progress' else 'string'}" for side in ("old", "new") for c in row)
    found = {r.row_id: r.error for r in guards.guarded(spark.createDataFrame(rows, f"kind string, row_id long, {names}")).collect()}
    assert [found.get(i) for i in range(len(cases))] == [e for _, _, e in cases]


def test_every_repeated_statement_is_told_with_all_its_ids(spark):
    """Empty statements count; the hash covers each id of a text, in order, also where the text goes on in the next batch of rows."""
    values = ["", "One  two", "one two ", "", "alone", "", *["many"] * 700]
    rows = [(f"content_block_{i * 7919 % 1000:03}", v) for i, v in enumerate(values)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        blocks = SimpleNamespace(blocks=spark.createDataFrame(rows, "content_block_id string, value string"))
        found = {r.k: (r.n, r.ids) for r in quality_checks.duplicate_statements(blocks).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = {k: sorted(i for i, v in rows if " ".join(v.lower().split()) == k) for k in ("", "one two", "many")}
    assert found == {k: (len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) for k, ids in want.items()}

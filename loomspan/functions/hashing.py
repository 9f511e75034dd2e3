"""Content hashes and deterministic identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("string").cast("binary"), 256)


def hashed_id(kind: str, *parts: Column) -> Column:
    """kind_<32 hex> of the parts joined by colons."""
    return F.concat(F.lit(f"{kind}_"), F.substring(sha256(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 32))


def canonical_object(**fields: Column) -> Column:
    """A JSON object of string fields, keys sorted, without white space: the text that ids and record hashes are made of.

    Null fields are JSON null.  Strings are escaped as JSON strings.
    """
    def text(value: Column) -> Column:
        return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}":'), F.when(fields[k].isNull(), F.lit("null")).otherwise(text(fields[k]))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def deterministic_id(kind: str, workspace_id: Column, natural_key: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(sha256(canonical_object(natural_key=natural_key, workspace_id=workspace_id)), 1, 32))


def idempotency_key(kind: str, workspace_id: Column, natural_key: Column) -> Column:
    return sha256(canonical_object(kind=F.lit(kind), natural_key=natural_key, workspace_id=workspace_id))


def safe_reference(kind: str, value: Column) -> Column:
    """kind-<12 hex>: names a value without showing it."""
    return F.concat(F.lit(f"{kind}-"), F.substring(sha256(value), 1, 12))


def capture_reference(value: Column) -> Column:
    return F.concat(F.lit("capture-"), F.substring(sha256(value), 1, 24))


def hash_uuid(value: Column) -> Column:
    """A UUID-shaped id of a hash."""
    h = sha256(value)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def ordered_digest(value: str, order: str, separator: str = ",") -> Column:
    """The hash of a group's values, joined in order; a group is one run, conversation or version, never a whole table."""
    return F.expr(f"sha2(listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {order}), 256)")

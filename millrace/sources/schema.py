"""Schemas: aliases, naming, contracts, nested documents to parent and child tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Canonical columns by the first alias present, whatever its case; raises listing all that are missing."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in options if a.lower() in have), None) for name, options in aliases.items()}
    missing = sorted(n for n, c in found.items() if c is None)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(df.columns)}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def normalized_name(name: str) -> str:
    """Lower case, anything but letters and digits an underscore, no runs of them, none before a digit missing."""
    flat = re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.lower())).rstrip("_") or "_"
    return f"_{flat}" if flat[0].isdigit() else flat


def flattened(df: DataFrame, separator: str = "__") -> DataFrame:
    """Struct fields as columns named parent__child, at any depth; arrays stay."""
    columns, todo = [], [(F.col(f"`{f.name}`"), normalized_name(f.name), f.dataType) for f in df.schema]
    while todo:
        column, name, kind = todo.pop(0)
        if isinstance(kind, T.StructType):
            todo = [(column.getField(f.name), f"{name}{separator}{normalized_name(f.name)}", f.dataType) for f in kind] + todo
        else:
            columns.append(column.alias(name))
    return df.select(*columns)


def parent_and_children(df: DataFrame, table: str, load_id: str, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Nested documents as a parent table and a child table for each array at any depth, linked by generated ids.

    Ids are hashes of the key columns (and list index), so a repeated load gives the same ids; a child names
    its parent's id and that of the root it belongs to. A child of an array of arrays has one column, value.
    """
    own = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)))
    rooted = flattened(df).withColumn("_dlt_id", own).withColumn("_dlt_load_id", F.lit(load_id))
    return _with_children(rooted, table, F.col("_dlt_id"))


def _with_children(rows: DataFrame, table: str, root: Column) -> dict[str, DataFrame]:
    arrays = [f for f in rows.schema if isinstance(f.dataType, T.ArrayType)]
    out = {table: rows.drop(*(f.name for f in arrays))}
    for f in arrays:
        child = rows.select(F.col("_dlt_id").alias("_dlt_parent_id"), root.alias("_dlt_root_id"), F.posexplode(f.name).alias("_dlt_list_idx", "value"))
        child = child.withColumn("_dlt_list_idx", F.col("_dlt_list_idx").cast("long")).withColumn("_dlt_id", F.md5(F.concat_ws("\x1f", "_dlt_parent_id", F.lit(f.name), F.col("_dlt_list_idx").cast("string"))))
        if isinstance(f.dataType.elementType, T.StructType):
            child = flattened(child.select("*", F.col("value.*")).drop("value"))
        out |= _with_children(child, f"{table}__{f.name}", F.col("_dlt_root_id"))
    return out


def evolve(old: T.StructType, df: DataFrame, mode: str = "evolve") -> DataFrame:
    """``df`` brought to the schema ``old`` under a contract mode.

    Unknown columns: evolve adds them, freeze raises, discard_value drops the
    values, discard_row drops rows that have one. A value whose type differs:
    evolve keeps it in a variant column (name__v_type), freeze raises,
    discard_value makes it null, discard_row drops the row. Missing columns are null.
    """
    known = {f.name: f.dataType for f in old}
    new = [f for f in df.schema if f.name not in known]
    if mode == "freeze" and new:
        raise ValueError(f"new columns under a frozen contract: {', '.join(f.name for f in new)}")
    columns, keep = [], F.lit(True)
    for f in old:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        have = df.schema[f.name].dataType
        if have == f.dataType:
            columns.append(F.col(f.name))
            continue
        cast = F.col(f.name).try_cast(f.dataType)
        bad = F.col(f.name).isNotNull() & cast.isNull()
        if mode == "freeze":
            raise ValueError(f"column {f.name} is {have.simpleString()}, contract says {f.dataType.simpleString()}")
        if mode == "evolve":
            columns += [cast.alias(f.name), F.when(bad, F.col(f.name)).alias(f"{f.name}__v_{normalized_name(have.simpleString())}")]
        else:
            columns.append(cast.alias(f.name))
            keep = keep & ~bad if mode == "discard_row" else keep
    if mode == "discard_row":
        for f in new:
            keep = keep & F.col(f.name).isNull()
    elif mode == "evolve":
        columns += [F.col(f.name) for f in new]
    return df.filter(keep).select(*columns)


def lenient_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON texts as rows; records that do not parse are ignored, missing fields are null."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.select(F.from_json(column, marked, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select(*(F.col(f"r.`{f.name}`") for f in schema))


def code_map(seed: DataFrame, code: str, name: str, *, order: str) -> DataFrame:
    """``code`` and ``name`` in upper case without blanks around; rows without either drop out, of equal codes the last by ``order`` stays.

    A seed that leaves nothing raises.
    """
    tidy = lambda c: F.upper(F.trim(F.col(c)))
    filled = seed.select(tidy(code).alias(code), tidy(name).alias(name), F.col(order).alias("_order")).filter((F.col(code) != "") & (F.col(name) != ""))
    codes = filled.groupBy(code).agg(F.max_by(name, F.struct("_order", name)).alias(name))
    if codes.isEmpty():
        raise ValueError(f"no {code} with a {name}")
    return codes

"""Attribute-value rows into one typed row per entity.

Rows are first reduced to one value per cell by map-side aggregation, so an entity of any number of
rows leaves at most one row per attribute. Entities are then hash-bucketed; each bucket is read in
Arrow batches sorted by entity, entities are dictionary-encoded, values are scattered into one numpy
array per type by (entity, column) index, and Arrow batches come out. Memory is bounded by a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import attributes as A
from claimloom.functions import quantities as Q

TRUE = ("yes", "y", "true", "1", "ja", "oui", "si", "sí")
FALSE = ("no", "n", "false", "0", "nein", "non")
SQL_TYPES = {"number": "double", "text": "string", "label": "string", "flag": "boolean"}


def cells(rows: DataFrame, definitions: list[dict], number: Column | None = None) -> DataFrame:
    """One row per (entity, attribute) named by any row: ``entity, col, num, txt`` with the value backed by most rows.

    Both values are null where no row holds a usable one. Ties go to the value that arrived last, then
    to the larger one. ``number`` may give another reading of the numeric value (units, say).
    """
    keyed = rows.filter(F.col("product_id").isNotNull()).withColumn("_key", A.attribute_key(F.col("canonical_attribute")))
    keyed = keyed.filter(F.col("_key").isin(*[d["key"] for d in definitions]))
    index = {d["key"]: i for i, d in enumerate(definitions)}
    kind = A.by_key(F.col("_key"), {d["key"]: d["type"] for d in definitions}, "string")
    read = keyed.select(
        F.col("product_id").alias("entity"),
        A.by_key(F.col("_key"), index, "int").alias("col"),
        kind.alias("_kind"),
        "row_id",
        A.usable_text(F.col("value_string")).alias("_text"),
        (number if number is not None else Q.usable_number(F.col("value_numeric"), F.col("value_string"))).alias("_number"),
    )
    typed = read.select(
        "entity", "col", "row_id",
        F.when(F.col("_kind") == "number", F.col("_number")).alias("num"),
        F.when(F.col("_kind").isin("label", "flag"), F.lower("_text")).when(F.col("_kind") != "number", F.col("_text")).alias("txt"),
    )
    counted = typed.groupBy("entity", "col", "num", "txt").agg(F.count(F.lit(1)).alias("_n"), F.max("row_id").alias("_last"))
    usable = F.col("num").isNotNull() | F.col("txt").isNotNull()
    best = F.max(F.when(usable, F.struct("_n", "_last", "num", "txt"))).alias("_best")
    return counted.groupBy("entity", "col").agg(best).select("entity", "col", "_best.num", "_best.txt")


def _scatter(batches: Iterator[pa.RecordBatch], kinds: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cells sorted by entity in, wide rows out; the last entity of a batch waits for the next batch."""
    columns = {t: [i for i, k in enumerate(kinds) if SQL_TYPES[k] == t] for t in ("double", "string", "boolean")}
    place = {i: p for members in columns.values() for p, i in enumerate(members)}
    slot = np.array([place[i] for i in range(len(kinds))])
    of_type = np.array([("double", "string", "boolean").index(SQL_TYPES[k]) for k in kinds])

    def emit(table: pa.Table) -> pa.RecordBatch:
        encoded = table.column("entity").combine_chunks().dictionary_encode()
        entities, row = encoded.dictionary, encoded.indices.to_numpy()
        col = table.column("col").to_numpy()
        n = len(entities)
        number = table.column("num").to_numpy()
        text = table.column("txt").to_numpy(zero_copy_only=False)
        has_text = ~table.column("txt").is_null().to_numpy()
        wide_number = np.full((n, len(columns["double"])), np.nan)
        wide_text = np.full((n, len(columns["string"])), None, dtype=object)
        wide_flag = np.full((n, len(columns["boolean"])), -1, dtype=np.int8)
        empty = np.zeros((n, len(kinds)), dtype=bool)
        empty[row, col] = ~(~np.isnan(number) | has_text)
        at = of_type[col] == 0
        wide_number[row[at], slot[col[at]]] = number[at]
        at = of_type[col] == 1
        wide_text[row[at], slot[col[at]]] = text[at]
        at = (of_type[col] == 2) & has_text
        wide_flag[row[at], slot[col[at]]] = [1 if t in TRUE else 0 if t in FALSE else -1 for t in text[at]]
        out = [entities]
        for i, kind in enumerate(kinds):
            if SQL_TYPES[kind] == "double":
                v = wide_number[:, slot[i]]
                out.append(pa.array(v, mask=np.isnan(v)))
            elif SQL_TYPES[kind] == "string":
                out.append(pa.array(wide_text[:, slot[i]], type=pa.string()))
            else:
                v = wide_flag[:, slot[i]]
                out.append(pa.array(v == 1, mask=v < 0))
        at, which = np.nonzero(empty)
        offsets = np.concatenate([[0], np.cumsum(empty.sum(1))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(which.astype(np.int32))))
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema)], schema=schema)

    waiting: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        last = table.column("entity")[-1].as_py()
        entity = table.column("entity")
        start = table.num_rows - 1
        while start > 0 and entity[start - 1].as_py() == last:  # at most one row per attribute
            start -= 1
        waiting = table.slice(start)
        if start:
            yield emit(table.slice(0, start))
    if waiting is not None and waiting.num_rows:
        yield emit(waiting)


def widen(rows: DataFrame, defs: DataFrame, number: Column | None = None) -> DataFrame:
    """One row per product: ``product_id``, one typed column per attribute of ``defs``, ``empty_columns``.

    Attributes match in any spelling; attributes not in ``defs`` and rows without a product are left
    out. A product appears if any row names it with a known attribute. Numbers come as DOUBLE, texts
    and labels as STRING (labels in lower case), flags as BOOLEAN (null where the text is neither yes
    nor no). ``empty_columns`` holds the attributes that rows name but that got no usable value. An
    empty table gives an empty result with the same columns; definitions without any attribute of a known
    type give no rows of ``product_id, empty_columns``.
    """
    definitions = [d for d in A.read_definitions(defs) if d["type"] in SQL_TYPES]
    if not definitions:
        none = rows.filter(F.lit(False))
        return none.select(F.col("product_id").cast("string").alias("product_id"), F.array().cast("array<string>").alias("empty_columns"))
    kinds, names = [d["type"] for d in definitions], [d["attribute"] for d in definitions]
    fields = ["product_id string", *(f"`{n}` {SQL_TYPES[k]}" for n, k in zip(names, kinds)), "_empty array<int>"]
    arrow = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema(
        [("product_id", pa.string()), *((n, arrow[SQL_TYPES[k]]) for n, k in zip(names, kinds)), ("_empty", pa.list_(pa.int32()))]
    )
    bucketed = cells(rows, definitions, number).repartition("entity").sortWithinPartitions("entity")
    wide = bucketed.mapInArrow(lambda batches: _scatter(batches, kinds, schema), ", ".join(fields))
    listed = F.array(*[F.lit(n) for n in names])
    empty = F.transform("_empty", lambda i: F.element_at(listed, i + 1)).alias("empty_columns")
    return wide.select("product_id", *[F.col(f"`{n}`") for n in names], empty)


def empty_cells(wide: DataFrame) -> DataFrame:
    """The (product_id, attribute) cells that rows name but no usable value fills."""
    return wide.select("product_id", F.explode("empty_columns").alias("attribute"))

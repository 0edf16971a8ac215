"""Adjacent copies: the run fold per file, and the equal-text subset as gaps and islands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diglot.functions import plain
from diglot.functions import text as tx


def shape(text: Column) -> Column:
    """What `like` compares of every text, once for each row."""
    parts = dict(text=text, key=tx.duplicate_key(text), chinese=tx.chinese(text), han=tx.han(text))
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def like(x: Column, y: Column) -> Column:
    """Whether two shapes are of copies, or of an original and its translation.

    What only texts of two languages are compared by is worked out for those.
    """
    kx, ky = x["key"], y["key"]
    same = (x["text"] == y["text"]) | ((kx != "") & (kx == ky))
    short = F.least(F.length(kx), F.length(ky))
    equal = lambda f: F.coalesce(f(x["text"]) == f(y["text"]), F.lit(False))
    marks = equal(tx.citation) | equal(tx.figure)
    cores = tx.bound(tx.core(x["text"]), lambda core: (F.length(core) >= 8) & (core == tx.core(y["text"])))
    begins = (short >= 18) & (F.left(kx, F.lit(18)) == F.left(ky, F.lit(18)))
    fuzzy = begins | ((short >= 16) & (kx.contains(ky) | ky.contains(kx))) | marks | cores
    return (x["text"] != "") & (y["text"] != "") & (same | ((x["chinese"] != y["chinese"]) & fuzzy))


def better(kept: Column, new: Column) -> Column:
    """The text that stays of two shapes."""
    by_length = F.when(F.length(new["text"]) > F.length(kept["text"]), new["text"]).otherwise(kept["text"])
    return F.when(new["han"] > kept["han"] + 2, new["text"]).when(kept["han"] > new["han"] + 2, kept["text"]).otherwise(by_length)


def alike(a: str, b: str) -> Column:
    """Whether two text columns are copies, or an original and its translation."""
    return like(shape(F.col(a)), shape(F.col(b)))


def neighbours(blocks: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """blocks that have one after them in the file, with `alike` (whether the two are) and `better` (the text that stays)."""
    along = Window.partitionBy(file).orderBy(order)
    shaped = blocks.withColumn("x", shape(F.col(text)))
    return shaped.withColumn("y", F.lead("x").over(along)).where("y IS NOT NULL").withColumn("alike", like(F.col("x"), F.col("y"))).withColumn("better", better(F.col("x"), F.col("y"))).drop("x", "y")


def equal_runs(blocks: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """blocks with run (its number in the file) and place in the run, for runs of equal neighbours."""
    along = Window.partitionBy(file).orderBy(order)
    new = F.coalesce(F.lag(text).over(along) != F.col(text), F.lit(True))
    runs = blocks.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(file, "run").orderBy(order)))


def surplus(blocks: DataFrame, file: str, order: str, text: str, tag: str | None = None) -> DataFrame:
    """file, order of the blocks that the run fold drops. A file is one group; its blocks are what one document holds.

    Files come one after the other in sorted rows: a call and a frame for each of many small ones would take longer than the fold.
    """
    kind = {c: blocks.schema[c].dataType.simpleString() for c in (file, order)}

    def gone(rows: list[tuple]) -> Iterator[tuple]:
        texts = [plain.squeeze(t or "") for _, t, _ in rows]
        use = [k for k, t in enumerate(texts) if len(t) >= 2]
        return (rows[use[k]][0] for k in plain.surplus([texts[k] for k in use], [rows[k][2] in ("td", "th") for k in use]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            files, orders, texts, *tags = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for f, *row in zip(files, orders, texts, *(tags or [repeat(None, len(files))]), strict=True):
                if f != at:
                    out += [(at, o) for o in gone(rows)]
                    at, rows = f, []
                rows.append(row)
            fields = [batch.schema.field(0), batch.schema.field(1)]
            yield _batch(out, fields)
        if rows:
            yield _batch([(at, o) for o in gone(rows)], fields)

    some = blocks.select(file, order, text, *([tag] if tag else [])).repartition(file)
    return some.sortWithinPartitions(F.asc(file), F.asc_nulls_last(order)).mapInArrow(run, f"`{file}` {kind[file]}, `{order}` {kind[order]}")


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def removed_by_file(docs: DataFrame, html: str) -> DataFrame:
    """docs with copies collapsed in each document and how many blocks went."""
    from diglot.operators.html import collapse, rewrite

    return rewrite(docs, html, collapse, "removed")



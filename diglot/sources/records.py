"""Glossaries, reply caches and resume states kept as JSON."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diglot.functions import text as tx

SLACK = 1024


def _typed(c: Column, path: str, kind: str) -> Column:
    """A field of a variant if it has this type; from_json would turn numbers into strings."""
    v = F.try_variant_get(c, path, "variant")
    return F.when(F.schema_of_variant(v) == kind, F.try_variant_get(c, path, "string"))


def glossary_terms(raw: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, ord, source, target, aliases from JSON documents: a list of terms, or an object with `terms`.

    Terms need a source and a target; one alias may stand without a list; blank aliases and those equal
    to the source are dropped. What isn't JSON has no terms.
    """
    v = F.try_parse_json(F.col(column))
    listed = F.coalesce(F.try_variant_get(v, "$.terms", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    rows = raw.select(*keep, F.posexplode(listed).alias("ord", "term"))
    text = lambda p: F.trim(F.coalesce(F.try_variant_get("term", p, "string"), F.lit("")))
    many = F.filter(F.coalesce(F.try_variant_get("term", "$.aliases", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.schema_of_variant(a) == "STRING")
    alone = F.array(_typed(F.col("term"), "$.aliases", "STRING"))
    aliases = F.when(F.schema_of_variant(F.try_variant_get("term", "$.aliases", "variant")) == "STRING", alone).otherwise(F.transform(many, lambda a: F.try_variant_get(a, "$", "string")))
    found = rows.select(*keep, "ord", text("$.source").alias("source"), text("$.target").alias("target"), F.transform(aliases, lambda a: F.trim(a)).alias("aliases"))
    kept = found.where("source <> '' AND target <> ''")
    return kept.withColumn("aliases", F.filter("aliases", lambda a: (a != "") & (a != F.col("source"))))


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """The terms of a file; a missing file is created empty, one that can't be read is left alone."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "x", encoding="utf-8") as out:
            json.dump({"terms": []}, out, indent=2)
            out.write("\n")
    return glossary_terms(spark.read.text(path, wholetext=True))


def cache_entries(lines: DataFrame, column: str = "value", seq: str = "seq") -> DataFrame:
    """key, response, seq of a log's lines; lines that are broken or of other types are skipped."""
    v = F.try_parse_json(F.col(column))
    return lines.select(_typed(v, "$.key", "STRING").alias("key"), _typed(v, "$.response", "STRING").alias("response"), F.col(seq).alias("seq")).where("key IS NOT NULL AND response IS NOT NULL")


def latest(entries: DataFrame) -> DataFrame:
    """key, response: the last entry of each key."""
    return entries.groupBy("key").agg(F.max_by("response", "seq").alias("response"))


def needs_compaction(lines: DataFrame, column: str = "value", slack: int = SLACK) -> bool:
    """Whether more than `slack` lines are dead."""
    filled = lines.where(F.trim(column) != "").withColumn("seq", F.lit(0))
    return filled.count() - cache_entries(filled, column).select("key").distinct().count() > slack


def requests(table: DataFrame, model: str, prompt: str, source: str) -> DataFrame:
    """table with the key under which a reply is kept."""
    return table.withColumn("key", tx.cache_key(F.lit(model), F.col(prompt), F.col(source)))


def misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """The requests that the cache can't answer, one for each key."""
    return asked.join(cache, "key", "left_anti").dropDuplicates(["key"])


def log_replies(folder: str, entries: list[tuple[str, str]]) -> None:
    """Adds (key, response) pairs to the log from a task: a file that appears whole, under a name that no other has."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with where.open_output_stream(f"{path}/_{name}") as out:
        out.write("".join(json.dumps({"key": k, "response": r}) + "\n" for k, r in entries).encode())
    where.move(f"{path}/_{name}", f"{path}/{name}.jsonl")


def append_cache(replies: DataFrame, folder: str) -> None:
    """Adds non-empty replies to the log; each task's file appears whole or not at all."""
    kept = replies.where("response IS NOT NULL AND response <> ''")
    kept.select(F.to_json(F.struct("key", "response")).alias("value")).write.mode("append").text(folder)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a log (value) in the order in which their files came (seq)."""
    return spark.read.text(folder).withColumn("seq", F.struct(F.col("_metadata.file_modification_time"), F.monotonically_increasing_id()))


def open_cache(spark: SparkSession, folder: str, slack: int = SLACK) -> DataFrame:
    """key, response of a log, which is compacted first if it has more than `slack` dead lines; a missing one is empty."""
    where, path = fs.FileSystem.from_uri(folder)
    for _ in range(2):
        old = [x.path for x in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith((".jsonl", ".txt"))]
        if not old:
            return spark.createDataFrame([], "key string, response string")
        lines = log_lines(spark, folder)
        if not needs_compaction(lines, slack=slack):
            break
        # the new file is in place before the old ones go: a crash between leaves lines twice, which is no harm
        compact_cache(spark, folder, f"{folder}/_compact")
        for x in where.get_file_info(fs.FileSelector(f"{path}/_compact")):
            if x.path.endswith(".txt"):
                where.move(x.path, f"{path}/{uuid.uuid4().hex}.jsonl")
        for x in old:
            where.delete_file(x)
    return latest(cache_entries(lines))


def compact_cache(spark: SparkSession, folder: str, into: str) -> None:
    """Writes the latest entries of a log to another folder, one line a key."""
    latest(cache_entries(log_lines(spark, folder))).select(F.to_json(F.struct("key", "response")).alias("value")).write.mode("overwrite").text(into)


STATE = "base_sha1 string, src_sha1 string, done array<string>, attempts map<string,int>"


def states(raw: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Resume states of JSON documents; what isn't an object with a list of done files is left out."""
    return raw.select(*keep, F.from_json(column, STATE, {"mode": "PERMISSIVE"}).alias("s")).select(*keep, "s.*").where("base_sha1 IS NOT NULL AND done IS NOT NULL")


def valid_states(found: DataFrame, prints: DataFrame) -> DataFrame:
    """The states (with book) whose fingerprints are those of the book's base and source now: book, base, src."""
    match = (F.col("base_sha1") == F.col("base")) & (F.col("src_sha1").isNull() | (F.col("src_sha1") == F.col("src")))
    return found.join(prints, "book").where(match)


def of_this_source(found: DataFrame, prints: DataFrame) -> DataFrame:
    """Checkpoints that belong to the book's source; those without a source's fingerprint never do."""
    return found.join(prints, "book").where("src_sha1 = src")


def write_state(table: DataFrame, folder: str) -> None:
    table.select(F.to_json(F.struct(*table.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(folder)

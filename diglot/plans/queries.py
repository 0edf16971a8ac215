"""The queries over the driver's tables, each with the SQL that gives the same rows.

Blocks are the lines of documents. Translations are the stand-in translator's: a Chinese prefix and the
first 24 characters of the normalised source, for documents whose doc_id isn't divisible by 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diglot.functions import glossary as gl
from diglot.functions import paths, reply
from diglot.functions import text as tx
from diglot.functions.decode import decoded
from diglot.operators import batches as bt
from diglot.operators import dupes, jobs
from diglot.operators import html as ht
from diglot.operators import titles as tt
from diglot.session import table
from diglot.sources import epub, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- SQL pieces ----

S_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
S_LINES = "lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def s_norm(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), '‘’“” ​', '''''\"\" '), '{S_SPACE}', ' ', 'g'), ' ')"


def s_han(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"


def s_roman(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-Za-z\\x{{130}}\\x{{212a}}]', '', 'g'))"


def s_tokens(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, {s_han(x)} + (length({x}) - {s_han(x)} + 3) // 4) END"


def s_skip(n: str) -> str:
    return f"(length({n}) < 2 OR regexp_matches({n}, '^(http|www\\.|doi:)') OR {s_han(n)} >= 2 OR {s_roman(n)} < 3)"


S_BLOCKS = f"{S_LINES}, normed AS (SELECT *, {s_norm('line')} AS n FROM lines), blocks AS (SELECT *, {s_skip('n')} AS skipped FROM normed)"
S_STUB = f"""{S_BLOCKS}, body AS (
  SELECT doc_id, 4 * pos AS ord, n AS t FROM blocks WHERE NOT skipped
  UNION ALL SELECT doc_id, 4 * pos + 1, '译文：' || left(n, 24) FROM blocks WHERE NOT skipped AND doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 4 * pos + 2, '译文：' || left(n, 24) || '。' FROM blocks WHERE NOT skipped AND doc_id % 5 <> 0 AND doc_id % 3 = 1)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared inputs ----


def lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines normalised before they are rows of their own, so that each is normalised once, and whether they are skipped."""
    normal = F.transform(F.split("text", "\n", -1), tx.norm)
    found = table(spark, sf, "documents").select("doc_id", "lang", "source", F.posexplode(normal).alias("pos", "n"))
    return found.withColumn("skipped", tx.skipped_plain(F.col("n")))


def bilingual(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, ord, t: each block, its translation, and for some documents the translation again with a full stop."""
    b = blocks(spark, sf).where(~F.col("skipped"))
    stub = F.concat(F.lit("译文："), F.left("n", F.lit(24)))
    again = F.when(F.col("doc_id") % 3 == 1, F.concat(stub, F.lit("。")))
    rows = F.when(F.col("doc_id") % 5 == 0, F.array(F.col("n"))).otherwise(F.array(F.col("n"), stub, again))
    return b.select("doc_id", (4 * F.col("pos")).alias("base"), F.posexplode(rows).alias("k", "t")).where("t IS NOT NULL").select("doc_id", (F.col("base") + F.col("k")).alias("ord"), "t")


def terms(spark: SparkSession, aliases: bool = True) -> DataFrame:
    rows = [(i, s, f"词{i}", a if aliases else []) for i, (s, a) in enumerate(TERMS)]
    return spark.createDataFrame(rows, gl.TERM)


EDGE = "[A-Za-z0-9]"
TERMS: list[tuple[str, list[str]]] = [("the", []), ("was", ["were"]), ("inor", []), ("que", []), ("leur", []), ("der", ["dem"]), ("und", []), ("nicht", []), ("para", ["por"]), ("les", []), ("with", []), ("from", []), ("haan", ["heha"]), ("of the", []), ("de la", []), ("una", []), ("que de", []), ("thth", []), ("ser", []), ("mente", [])]
S_TERMS = "terms(ord, source, variant) AS (VALUES " + ", ".join(f"({i}, '{s}', '{v}')" for i, (s, a) in enumerate(TERMS) for v in [s, *a]) + ")"


# ---- text ----


@query(f"WITH {S_BLOCKS} SELECT lang, count(*) AS n_lines, count(*) FILTER (NOT skipped) AS n_eligible, sum(CASE WHEN skipped THEN 0 ELSE {s_tokens('n')} END)::BIGINT AS n_tokens, sum(CASE WHEN skipped THEN 0 ELSE {s_roman('n')} END)::BIGINT AS n_letters FROM blocks GROUP BY lang")
def blocks_to_translate(spark: SparkSession, sf: str) -> DataFrame:
    todo = lambda c: F.sum(F.when(F.col("skipped"), 0).otherwise(c)).cast("long")
    return blocks(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("skipped")).alias("n_eligible"), todo(tx.tokens("n")).alias("n_tokens"), todo(tx.roman("n")).alias("n_letters"))


@query(f"SELECT doc_id, {s_han('text')} AS cn, {s_roman('text')} AS en FROM documents")
def script_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.han("text").cast("long").alias("cn"), tx.roman("text").cast("long").alias("en"))


@query(f"SELECT 'd' || doc_id AS id, length({s_norm('text')}) AS n_chars, sha1({s_norm('text')}) AS digest FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, length({s_norm('text')}), sha1({s_norm('text')}) FROM conversations")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), tx.norm("text").alias("n"))
    talk = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), tx.norm("text").alias("n"))
    return docs.unionByName(talk).select("id", F.length("n").cast("long").alias("n_chars"), F.sha1("n").alias("digest"))


@query(f"WITH {S_BLOCKS} SELECT doc_id, pos, skipped FROM blocks")
def skip_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), "skipped")


@query(f"WITH {S_LINES} SELECT doc_id, pos, {s_tokens('line')} AS tokens FROM lines")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), tx.tokens("line").cast("long").alias("tokens"))


@query(f"SELECT doc_id, least(8000, greatest(800, (3 * ({s_tokens('text')})) // 2 + 30 * len(string_split(text, chr(10))) + 200)) AS budget FROM documents")
def reply_budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.reply_budget(tx.tokens("text"), F.size(F.split("text", "\n", -1))).cast("long").alias("budget"))


_S_KEY = """lower(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(translate({x}, ' ', ' '), '{w}', ' ', 'g'), ' '), '第\\s*(\\d+)\\s*章', '第\\1章', 'g'), '作者[：:]', '', 'g'), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}''"“”()《》·．。.,，、:：;；]', '', 'g'))"""


def s_key(x: str) -> str:
    return _S_KEY.format(x=x, w=S_SPACE)


def s_core(x: str) -> str:
    return s_key(f"regexp_replace(regexp_replace(trim(regexp_replace({x}, '{S_SPACE}', ' ', 'g'), ' '), '（[^）]*）', '', 'g'), '\\([^)]*\\)', '', 'g')")


@query(f"WITH {S_STUB} SELECT doc_id, ord, sha1({s_key('t')}) AS key, sha1({s_core('t')}) AS core, {s_han('t')} >= {s_roman('t')} AS chinese, nullif(regexp_extract(t, '^\\s*\\[(\\d+)\\]', 1), '') AS cite, CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END AS snippet FROM body")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return bilingual(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), F.sha1(tx.duplicate_key("t")).alias("key"), F.sha1(tx.core("t")).alias("core"), tx.chinese("t").alias("chinese"), tx.citation("t").alias("cite"), tx.snippet("t", 40).alias("snippet"))


@query(r"""SELECT page_id, replace(replace(replace(left(html, 400), '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS escaped,
  CASE WHEN trim(trim(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g'), ' '), '.') = '' THEN 'book' ELSE left(trim(trim(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g'), ' '), '.'), 120) END AS name,
  regexp_replace(url, '^.*\}', '') AS local FROM pages""")
def text_utilities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.attribute(F.left("html", F.lit(400))).alias("escaped"), tx.safe_name("url").alias("name"), tx.local_name("url").alias("local"))


@query(r"""SELECT page_id, sha1(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS escaped FROM pages""")
def escaped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages as attribute values."""
    return table(spark, sf, "pages").select("page_id", F.sha1(tx.attribute("html")).alias("escaped"))


@query("SELECT page_id, sha1(replace(html, '<meta charset=\"utf-8\">', '<meta charset=\"utf-8\">')) AS same, sha1(html) AS changed FROM pages")
def utf8_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """UTF-8 pages don't change; pages that declare another encoding become those that declare utf-8."""
    pages = table(spark, sf, "pages")
    legacy = F.replace("html", F.lit('charset="utf-8"'), F.lit('charset="gb2312"'))
    return pages.select("page_id", F.sha1(tx.declare_utf8("html")).alias("same"), F.sha1(tx.declare_utf8(legacy)).alias("changed"))


@query("SELECT doc_id, sha1(text) AS digest, 0::BIGINT AS bad FROM documents")
def decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts encoded four ways and decoded without being told how."""
    docs = table(spark, sf, "documents")
    marked = F.concat(F.lit('<?xml version="1.0" encoding="UTF-16"?>'), F.col("text"))
    raw = F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 4 == 1, F.encode("text", "UTF-16")).when(F.col("doc_id") % 4 == 2, F.encode(marked, "UTF-16LE")).otherwise(F.encode(marked, "UTF-16BE"))
    d = docs.select("doc_id", raw.alias("raw")).select("doc_id", decoded("raw").alias("d"))
    return d.select("doc_id", F.sha1(F.regexp_replace("d.text", "^<\\?xml[^>]*>", "")).alias("digest"), F.col("d.bad").cast("long").alias("bad"))


# ---- batches and prompts ----


@query(f"""WITH RECURSIVE {S_BLOCKS}, todo AS (SELECT doc_id, pos, {s_tokens('n')} AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM blocks WHERE NOT skipped),
  packed AS (SELECT doc_id, r, pos, cost AS used, 1 AS items, 0 AS batch FROM todo WHERE r = 1
    UNION ALL SELECT t.doc_id, t.r, t.pos, CASE WHEN p.items >= 12 OR p.used + t.cost > 1600 THEN t.cost ELSE p.used + t.cost END, CASE WHEN p.items >= 12 OR p.used + t.cost > 1600 THEN 1 ELSE p.items + 1 END, p.batch + CASE WHEN p.items >= 12 OR p.used + t.cost > 1600 THEN 1 ELSE 0 END FROM packed p JOIN todo t ON t.doc_id = p.doc_id AND t.r = p.r + 1)
  SELECT doc_id, pos, batch::BIGINT AS batch FROM packed""")
def pack_batches(spark: SparkSession, sf: str) -> DataFrame:
    todo = blocks(spark, sf).where(~F.col("skipped")).select("doc_id", F.col("pos").cast("long").alias("pos"), "n")
    return bt.places(todo, "doc_id", "pos", "n").select("doc_id", "pos", F.col("batch").cast("long").alias("batch"))


S_PROMPT = "'下列共 ' || count(*) || ' 段英文，请译为简体中文，格式如下：' || chr(10) || '1. 译文' || chr(10) || '2. 译文' || chr(10) || '每段一条，按编号输出，不加说明。' || chr(10) || chr(10)"


@query(f"WITH {S_BLOCKS}, few AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM blocks WHERE NOT skipped) SELECT doc_id, (r - 1) // 12 AS batch, count(*) AS items, sha1({S_PROMPT} || string_agg(((r - 1) % 12 + 1) || '. ' || n, chr(10) ORDER BY r)) AS digest FROM few GROUP BY doc_id, (r - 1) // 12")
def batch_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rank = Window.partitionBy("doc_id").orderBy("pos")
    some = blocks(spark, sf).where(~F.col("skipped")).withColumn("r", F.row_number().over(rank)).withColumn("batch", F.floor((F.col("r") - 1) / 12))
    grouped = some.groupBy("doc_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "n"))), lambda x: x["n"]).alias("items"))
    return grouped.select("doc_id", F.col("batch").cast("long").alias("batch"), F.size("items").cast("long").alias("items"), F.sha1(bt.prompt(F.lit(""), F.col("items"))).alias("digest"))


@query("""WITH pairs AS (SELECT conv_id, turn, text AS en, '译文：' || left(text, 24) AS zh FROM conversations),
  w AS (SELECT *, lag(en, 1) OVER o AS e1, lag(zh, 1) OVER o AS z1, lag(en, 2) OVER o AS e2, lag(zh, 2) OVER o AS z2 FROM pairs WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, sha1(CASE WHEN e1 IS NULL THEN '' WHEN e2 IS NULL THEN '【前文】仅供参考，请勿重译：' || chr(10) || '1. EN: ' || e1 || chr(10) || '   ZH: ' || z1 || chr(10) || chr(10)
  ELSE '【前文】仅供参考，请勿重译：' || chr(10) || '1. EN: ' || e2 || chr(10) || '   ZH: ' || z2 || chr(10) || '2. EN: ' || e1 || chr(10) || '   ZH: ' || z1 || chr(10) || chr(10) END) AS digest FROM w""")
def rolling_context(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("en"), F.concat(F.lit("译文："), F.left("text", F.lit(24))).alias("zh"))
    return bt.with_context(pairs, "conv_id", "turn", "en", "zh").select("conv_id", "turn", F.sha1("context_text").alias("digest"))


@query(f"WITH {S_BLOCKS}, few AS (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM blocks WHERE NOT skipped) SELECT doc_id, pos, n AS text FROM few WHERE r <= 3")
def first_n_blocks(spark: SparkSession, sf: str) -> DataFrame:
    todo = blocks(spark, sf).where(~F.col("skipped")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n").alias("text"))
    return jobs.first_blocks(todo, 3, ["doc_id"], ["pos"]).drop("place")


@query(f"WITH {S_BLOCKS} SELECT doc_id, pos, '译文：' || rtrim(left(n, 24)) AS translation FROM blocks WHERE NOT skipped")
def stub_translate(spark: SparkSession, sf: str) -> DataFrame:
    """The whole plan of batches, prompts, calls and replies with the stand-in translator."""
    from diglot.plans.client import Echo
    from diglot.plans.translate import translate

    todo = blocks(spark, sf).where(~F.col("skipped")).select(F.col("doc_id").cast("string").alias("file"), F.col("pos").cast("int").alias("n"), F.col("n").alias("text"), F.col("n").alias("visible"))
    done, _ = translate(todo, Echo(), tasks=8)
    return done.select(F.col("file").cast("long").alias("doc_id"), F.col("n").cast("long").alias("pos"), F.col("translation"))


# ---- neighbours ----


@query(f"WITH {S_STUB} SELECT doc_id, ord, coalesce({s_han('lead(t) OVER o')} >= 2 AND {s_han('lead(t) OVER o')} >= {s_roman('lead(t) OVER o')}, false) AS has_translation FROM body WINDOW o AS (PARTITION BY doc_id ORDER BY ord)")
def zh_follow(spark: SparkSession, sf: str) -> DataFrame:
    rows = bilingual(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("t").alias("text"), F.lit(0).alias("parent"), F.col("ord").alias("sib"), F.lit("p").alias("tag"))
    return rows.select("doc_id", "ord", ht.followed(rows, "doc_id").alias("has_translation"))


@query(f"""WITH {S_STUB}, c AS (SELECT *, {s_han('t')} AS cn, {s_roman('t')} AS en FROM body),
  f AS (SELECT *, coalesce(lead(cn) OVER o >= 2 AND lead(cn) OVER o >= lead(en) OVER o, false) AS follows FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY ord))
  SELECT doc_id, ord, t AS text FROM f WHERE NOT (follows AND ((cn = 0 AND en >= 8) OR (cn > 0 AND en >= 20 AND cn < 0.25 * (cn + en))))""")
def derive_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = bilingual(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("t").alias("text"), F.lit(0).alias("parent"), F.col("ord").alias("sib"), F.lit("p").alias("tag"))
    counted = rows.withColumn("source", tx.source_only("text"))
    return counted.withColumn("gone", F.col("source") & ht.followed(counted, "doc_id")).where(~F.col("gone")).select("doc_id", "ord", "text")


@query(f"""WITH {S_LINES}, l AS (SELECT *, coalesce(lag(line) OVER o <> line, true) AS fresh FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
  r AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l)
  SELECT doc_id, run::BIGINT AS run, count(*) AS n, min(pos) AS first_pos FROM r GROUP BY doc_id, run HAVING count(*) > 1""")
def exact_adjacent_dups(spark: SparkSession, sf: str) -> DataFrame:
    runs = dupes.equal_runs(lines(spark, sf), "doc_id", "pos", "line")
    return runs.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos")).where("n > 1")


@query(f"""WITH {S_STUB}, p AS (SELECT doc_id, ord, t, lead(t) OVER o AS u FROM body WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
  k AS (SELECT *, {s_key('t')} AS kt, {s_key('u')} AS ku, {s_core('t')} AS ct, {s_core('u')} AS cu, {s_han('t')} >= {s_roman('t')} AS zt, {s_han('u')} >= {s_roman('u')} AS zu FROM p WHERE u IS NOT NULL)
  SELECT doc_id, ord, (t <> '' AND u <> '' AND (t = u OR (kt <> '' AND kt = ku) OR (zt <> zu AND (coalesce(nullif(regexp_extract(t, '^\\s*\\[(\\d+)\\]', 1), '') = nullif(regexp_extract(u, '^\\s*\\[(\\d+)\\]', 1), ''), false)
    OR (length(ct) >= 8 AND ct = cu) OR (least(length(kt), length(ku)) >= 18 AND left(kt, 18) = left(ku, 18)) OR (least(length(kt), length(ku)) >= 16 AND (contains(kt, ku) OR contains(ku, kt))))))) AS alike,
    CASE WHEN {s_han('u')} > {s_han('t')} + 2 THEN u WHEN {s_han('t')} > {s_han('u')} + 2 THEN t WHEN length(u) > length(t) THEN u ELSE t END AS better FROM k""")
def alike_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.neighbours(bilingual(spark, sf), "doc_id", "ord", "t").select("doc_id", F.col("ord").cast("long").alias("ord"), "alike", "better")


@query()
def dup_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks that the run fold drops. A fold with fuzzy matching; tests hold it against plain Python."""
    return dupes.surplus(bilingual(spark, sf).withColumn("ord", F.col("ord").cast("long")), "doc_id", "ord", "t")


# ---- jobs ----


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def missing_docs(spark: SparkSession, sf: str) -> DataFrame:
    planned = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("dest"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("dest"), "quality").where("quality = 1")
    return planned.join(done.select("dest"), "dest", "left_anti").select(F.col("dest").alias("doc_id"), F.col("book").alias("source"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), b AS (SELECT *, regexp_replace(path, '^.*/', '') AS base FROM p)
  SELECT page_id, (path LIKE '%25.html' OR path LIKE '%7') AS chosen, base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_matches(base, '(?i)(references|bibliography|index|(end|foot)?notes|toc|nav|contents)\.(x?html?)$') AS short FROM b""")
def select_jobs_patterns(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    chosen = paths.matches(path, paths.names(F.lit(" 25.html, 7 ,")))
    return table(spark, sf, "pages").select("page_id", chosen.alias("chosen"), paths.basename(path).alias("base"), paths.dirname(path).alias("dir"), paths.is_short(path).alias("short"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS book, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages), m AS (SELECT DISTINCT book, path FROM p)
  SELECT m.book, count(*) AS files, count(t.path) AS done FROM m LEFT JOIN (SELECT DISTINCT book, path FROM p WHERE page_id % 3 = 0) t ON m.book = t.book AND m.path = t.path GROUP BY m.book""")
def progress_by_book(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("book"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    done = members.where("page_id % 3 = 0").select("book", "path", F.lit(1).alias("done")).distinct()
    return members.select("book", "path").distinct().join(done, ["book", "path"], "left").groupBy("book").agg(F.count(F.lit(1)).alias("files"), F.count("done").alias("done"))


@query("""WITH r AS (SELECT o_custkey AS book, o_orderkey AS dest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank, o_orderstatus <> 'O' AS present FROM orders)
  SELECT a.book, a.dest, a.rank, (SELECT arg_min(b.dest, b.rank) FROM r b WHERE b.book = a.book AND b.rank > a.rank AND b.present) AS successor FROM r a""")
def next_present(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("dest"), rank.cast("long").alias("rank"), (F.col("o_orderstatus") != "O").alias("present"))
    return jobs.next_present(wanted, ["book"]).drop("present")


@query("SELECT l.l_orderkey AS book, l.l_linenumber AS spine_ord, p.p_name AS href FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size > 10")
def spine_order(spark: SparkSession, sf: str) -> DataFrame:
    """A spine joined to its manifest; references that the manifest lacks drop out."""
    manifest = table(spark, sf, "part").where("p_size > 10").select("p_partkey", F.col("p_name").alias("href"))
    spine = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("spine_ord"), F.col("l_partkey").alias("p_partkey"))
    return spine.join(manifest, "p_partkey").select("book", "spine_ord", "href")


@query("""SELECT conv_id AS book, CASE role WHEN 'user' THEN 1 ELSE 2 END AS dest, (CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END + count(*) FILTER (length(text) < 200) > 0)::BOOLEAN AND (bool_or(length(text) >= 200) OR (CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 2 END + CASE WHEN bool_or(length(text) >= 200) THEN 0 ELSE 1 END) >= 3) AS done,
  CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 2 END + CASE WHEN bool_or(length(text) >= 200) THEN 0 ELSE 1 END AS attempts FROM conversations GROUP BY conv_id, CASE role WHEN 'user' THEN 1 ELSE 2 END""")
def futile_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts and done after a pass: odd conversations had two futile tries before."""
    talk = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.when(F.col("role") == "user", 1).otherwise(2).alias("dest"), "text")
    results = talk.groupBy("book", "dest").agg(F.bool_or(F.length("text") >= 200).alias("landed"))
    state = results.where("book % 2 = 1").select("book", "dest", F.lit(2).alias("attempts"), F.lit(False).alias("done"))
    return jobs.attempts(state, results)


# ---- titles ----

S_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"WITH t AS (SELECT page_id, {s_norm(S_TITLE)} AS title FROM pages) SELECT page_id, title, length(title) >= 2 AND {s_han('title')} = 0 AND {s_roman('title')} >= 2 AND NOT regexp_matches(title, '^http|\\.x?html$') AS is_title FROM t")
def title_predicate(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", tx.norm(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return t.select("page_id", "title", tx.is_title("title").alias("is_title"))


@query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a>', 1)) AS a, generate_subscripts(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a>', 1), 1) AS k FROM pages), n AS (SELECT page_id, k, {s_norm('a')} AS title FROM t),
  f AS (SELECT title, min(page_id * 1000000 + k) AS place FROM n WHERE length(title) >= 2 AND {s_han('title')} = 0 AND {s_roman('title')} >= 2 AND NOT regexp_matches(title, '^http|\\.x?html$') GROUP BY title),
  o AS (SELECT title, row_number() OVER (ORDER BY place) AS ord FROM f) SELECT title, ord, (ord - 1) // 40 AS batch FROM o""")
def distinct_titles(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select(F.lit("site").alias("book"), "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li><a [^>]*>([^<]*)</a>"), F.lit(1))).alias("k", "a")).withColumn("title", tx.norm("a")).where(tx.is_title("title"))
    one = tt.distinct(found, "book", ["page_id", "k"])
    return one.select("title", F.col("ord").cast("long").alias("ord"), bt.slices(F.col("ord")).cast("long").alias("batch"))


# ---- glossary ----

S_HIT = "regexp_matches(d.text, '(^|[^A-Za-z0-9])' || t.variant || '([^A-Za-z0-9]|$)')"


@query(f"WITH {S_TERMS} SELECT DISTINCT d.doc_id, t.ord::BIGINT AS ord FROM documents d JOIN terms t ON {S_HIT}")
def glossary_hits(spark: SparkSession, sf: str) -> DataFrame:
    return gl.appearing(table(spark, sf, "documents").select("doc_id", "text"), terms(spark), "doc_id").select("doc_id", F.col("ord").cast("long").alias("ord"))


_S_LINE = "CASE t.ord " + " ".join(f"WHEN {i} THEN '- {s}{('（' + ' / '.join(a) + '）') if a else ''} → 词{i}'" for i, (s, a) in enumerate(TERMS)) + " END"


@query(f"WITH {S_TERMS}, h AS (SELECT DISTINCT d.doc_id, t.ord, {_S_LINE} AS line FROM documents d JOIN terms t ON {S_HIT}) SELECT doc_id, '{gl.HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY ord) || chr(10) || '{gl.FOOT}' AS hint FROM h GROUP BY doc_id")
def glossary_hint(spark: SparkSession, sf: str) -> DataFrame:
    t = terms(spark)
    hits = gl.appearing(table(spark, sf, "documents").select("doc_id", "text"), t, "doc_id").join(t, "ord")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", gl.line(F.col("source"), F.col("target"), F.col("aliases")).alias("line")))), lambda x: x["line"])
    return hits.groupBy("doc_id").agg(ordered.alias("lines")).select("doc_id", gl.hint(F.col("lines")).alias("hint"))


@query("SELECT doc_id, pos, sha1(line) AS restored, true AS safe FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def glossary_protect_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Terms without aliases become placeholders and come back as themselves; no term is left while they are out."""
    some = [(i, s, s, [s], ["\\Q" + s + "\\E(?<!" + EDGE + "\\Q" + s + "\\E)(?!" + EDGE + ")"]) for i, (s, a) in enumerate(TERMS) if not a]
    given = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("target"), F.array(*map(F.lit, v)).alias("variants"), F.array(*map(F.lit, p)).alias("patterns")) for i, s, t, v, p in some])
    ordered = spark.range(1).select(gl.ordered(given).alias("terms"))  # sorted once, not for each line
    safe = lines(spark, sf).crossJoin(F.broadcast(ordered)).select("doc_id", F.col("pos").cast("long").alias("pos"), "terms", gl.protect(F.col("line"), F.col("terms")).alias("p"))
    left = F.exists("terms", lambda t: F.col("p.text").contains(F.get(t["variants"], F.lit(0))) & F.regexp_like(F.col("p.text"), F.get(t["patterns"], F.lit(0))))
    return safe.select("doc_id", "pos", F.sha1(gl.restore(F.col("p.text"), F.col("p.map"))).alias("restored"), (~left).alias("safe"))


# ---- replies, cache, usage ----


@query(f"""WITH {S_LINES}, l AS (SELECT doc_id, pos, trim(regexp_replace(line, '{S_SPACE}', ' ', 'g'), ' ') AS n FROM lines), c AS (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM l WHERE n <> '' AND NOT regexp_matches(n, '^[-+*•0-9_第]')),
  g AS (SELECT doc_id, ((r - 1) // 2)::BIGINT AS k, string_agg(n, ' ' ORDER BY r) AS t FROM c GROUP BY doc_id, (r - 1) // 2)
  SELECT doc_id, k + 1 AS item, trim(t, '"“”') AS text FROM g WHERE k < 20""")
def numbered_reply_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Replies whose items are two lines each in five spellings of the marker; numbers above 20 belong to item 20 and are cut off here."""
    clean = lines(spark, sf).select("doc_id", "pos", F.trim(F.regexp_replace("line", tx.SPACE, " ")).alias("n")).where("n <> ''").where(~F.col("n").rlike("^[-+*•0-9_第]"))
    rank = Window.partitionBy("doc_id").orderBy("pos")
    placed = clean.withColumn("r", F.row_number().over(rank)).where("r <= 40")
    k = F.floor((F.col("r") - 1) / 2).cast("int") + 1
    s = k.cast("string")
    mark = F.when(k % 5 == 0, F.concat(s, F.lit(". "))).when(k % 5 == 1, F.concat(F.lit("**"), s, F.lit(".** "))).when(k % 5 == 2, F.concat(F.lit("- "), s, F.lit(") "))).when(k % 5 == 3, F.concat(F.lit("第"), s, F.lit("段："))).otherwise(F.concat(s, F.lit("、")))
    raw = placed.withColumn("l", F.when(F.col("r") % 2 == 1, F.concat(mark, "n")).otherwise(F.col("n"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "l"))), lambda x: x["l"]), "\n").alias("raw"))
    return raw.select("doc_id", F.explode(reply.items("raw", F.lit(20))).alias("item", "text")).select("doc_id", F.col("item").cast("long").alias("item"), "text")


S_CACHE = f"SELECT sha1('m' || chr(10) || role || chr(10) || {s_norm('text')}) AS key, conv_id || '-' || turn AS response, conv_id * 1000 + turn AS seq FROM conversations"


def cache_log(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations")
    line = F.to_json(F.struct(tx.cache_key(F.lit("m"), F.col("role"), "text").alias("key"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response")))
    torn = F.when(F.col("turn") == 99, F.lit('{"key": 5, "resp')).otherwise(line)
    return talk.select(torn.alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "turn", "role", "text")


@query(f"SELECT key, arg_max(response, seq) AS response FROM ({S_CACHE}) GROUP BY key")
def cache_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return records.latest(records.cache_entries(cache_log(spark, sf)))


@query(f"SELECT DISTINCT sha1('m' || chr(10) || role || chr(10) || {s_norm('text')}) AS key FROM conversations WHERE sha1('m' || chr(10) || role || chr(10) || {s_norm('text')}) NOT IN (SELECT sha1('m' || chr(10) || role || chr(10) || {s_norm('text')}) FROM conversations WHERE turn < 2)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    log = cache_log(spark, sf)
    known = records.latest(records.cache_entries(log.where("turn < 2")))
    asked = log.select(tx.cache_key(F.lit("m"), F.col("role"), "text").alias("key"))
    return records.misses(asked, known).select("key")


@query("SELECT role, sum(length(text) // 4)::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, sum(length(text) // 4 + turn)::BIGINT AS total_tokens, count(*) FILTER (length(text) // 4 + turn > 0) AS calls FROM conversations GROUP BY role")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Counts from JSON payloads in two spellings; a missing total is the sum."""
    talk = table(spark, sf, "conversations").withColumn("i", F.floor(F.length("text") / 4).cast("long"))
    one = F.to_json(F.struct(F.col("i").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (F.col("i") + F.col("turn")).alias("total_tokens")))
    two = F.to_json(F.struct(F.col("i").alias("input_tokens"), F.col("turn").alias("output_tokens")))
    raw = talk.select("role", F.when(F.col("conv_id") % 2 == 0, one).otherwise(two).alias("u"))
    read = raw.select("role", tx.usage(F.col("u"), "prompt_tokens", "input_tokens").alias("i"), tx.usage(F.col("u"), "completion_tokens", "output_tokens").alias("o"), tx.usage(F.col("u"), "total_tokens").alias("t"))
    total = F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("i") + F.col("o"))
    return read.withColumn("t", total).groupBy("role").agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("t").alias("total_tokens"), F.count_if(F.col("t") > 0).alias("calls"))


# ---- archives ----


@query("SELECT l_orderkey AS book, l_linenumber::VARCHAR AS path, arg_max(l_shipdate::DATE::VARCHAR, l_suppkey * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS content, max(l_suppkey * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber")
def shadowed_members(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("string").alias("path"), (F.col("l_suppkey") * 100000 + F.unix_date(F.to_date("l_shipdate"))).alias("seq"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("content"))
    return epub.appended(log)


@query("SELECT coalesce(o_custkey, c_custkey) AS book, coalesce(o_orderpriority, 'new') AS path, coalesce(c_name, o_orderstatus) AS content FROM (SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY ALL) FULL JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def spliced_members(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("book"), F.col("o_orderpriority").alias("path")).agg(F.min("o_orderstatus").alias("content")).withColumn("ord", F.lit(0))
    new = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("book"), F.lit("1-URGENT").alias("path"), F.col("c_name").alias("content"))
    known = have.select("book", "path", F.lit(True).alias("there"))
    return epub.spliced(have, new).join(known, ["book", "path"], "left").select("book", F.when(F.col("there"), F.col("path")).otherwise("new").alias("path"), "content")


@query(r"""SELECT page_id::VARCHAR AS book, url AS path, 'characters' AS why FROM pages WHERE regexp_matches(url, '[:*?"<>|]')""")
def unsafe_names(spark: SparkSession, sf: str) -> DataFrame:
    return epub.unsafe_names(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("book"), F.col("url").alias("path")))


@query("""WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
  walk AS (SELECT node, 1 AS depth, node AS root FROM edges WHERE parent IS NULL UNION ALL SELECT e.node, w.depth + 1, w.root FROM walk w JOIN edges e ON e.parent = w.node)
  SELECT root, max(depth)::BIGINT AS depth, count(*) AS points FROM walk GROUP BY root""")
def toc_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and depth of each table of contents, here regions, nations and suppliers."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    root = lambda c: F.concat(F.lit("r"), F.col(c).cast("string")).alias("root")
    top = r.select(root("r_regionkey"), F.lit(1).alias("depth"))
    mid = n.join(r, n.n_regionkey == r.r_regionkey).select(root("r_regionkey"), F.lit(2).alias("depth"))
    low = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(root("r_regionkey"), F.lit(3).alias("depth"))
    return top.unionByName(mid).unionByName(low).groupBy("root").agg(F.max("depth").cast("long").alias("depth"), F.count(F.lit(1)).alias("points"))


# ---- HTML ----


@query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf blocks of all pages. Needs a tree; tests hold it against pinned pages."""
    return ht.blocks(table(spark, sf, "pages"), "page_id", "html").select("page_id", "node", "tag", "text", "visible", "has_translation", "eligible")


@query()
def html_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without adjacent copies."""
    return dupes.removed_by_file(table(spark, sf, "pages").select("page_id", "html"), "html")


@query()
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """English titles of all pages, once each, at their first place."""
    pages = table(spark, sf, "pages").select(F.lit("site").alias("book"), F.col("url").alias("path"), F.col("page_id").cast("int").alias("ord"), "html")
    return tt.collect(pages, "book", "path", "ord", "html")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages")
def html_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """li and h1 elements of the tree; these tags have no attributes in the pages, so their start tags can be counted in SQL."""
    found = ht.nodes(table(spark, sf, "pages"), "page_id", "html").where("tag IN ('li', 'h1')").groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("items"), F.count_if(F.col("tag") == "h1").alias("headings"))
    return table(spark, sf, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("headings", F.lit(0)).alias("headings"))


# ---- archives, packages and records built from the tables ----


@query("SELECT doc_id, coalesce(source, '') AS book, sha1(coalesce(text, '')) AS digest FROM documents")
def archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the members of a book for each source, written as archives and read again."""
    from diglot.storage import fresh_path

    docs = table(spark, sf, "documents")
    rows = docs.select(F.coalesce("source", F.lit("")).alias("book"), F.format_string("OEBPS/d%d.html", "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    folder = fresh_path(spark, "archives").removeprefix("file://")
    epub.save(rows, folder)
    back = epub.texts(epub.members(spark, folder))
    return back.select(F.regexp_extract("path", "d(\\d+)", 1).cast("long").alias("doc_id"), "book", F.sha1("text").alias("digest"))


@query("""SELECT p_partkey AS id, 'OEBPS/T' || p_size || '/c' || p_partkey || '.html' AS resolved, 'T' || p_size || '/c' || p_partkey || '.html' AS href,
  CASE p_partkey % 3 WHEN 0 THEN '../T' WHEN 1 THEN 'T' ELSE '../../OEBPS/T' END || p_size || '/c' || p_partkey || '.html' AS relative, 'OEBPS/content.opf' AS package, 'bt-OEBPS-T' || p_size || '-c' || p_partkey || '.html' AS item FROM part""")
def path_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with detours in normal form, resolved, made relative and made ids."""
    base = F.concat(F.lit("T"), F.col("p_size").cast("string"), F.lit("/c"), F.col("p_partkey").cast("string"), F.lit(".html"))
    dest = F.concat(F.lit("OEBPS/"), base)
    detour = F.concat(F.lit(" ./x/..//"), F.replace(base, F.lit("/"), F.lit("\\")), F.lit("#part"))
    package = F.when(F.col("p_partkey") % 3 == 0, "OEBPS/pkg/content.opf").when(F.col("p_partkey") % 3 == 1, "OEBPS/content.opf").otherwise("A/B/content.opf")
    # a small file has few row groups, and its folds would keep one core busy
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    return parts.select(F.col("p_partkey").alias("id"), paths.resolve(F.lit("OEBPS/content.opf"), detour).alias("resolved"), paths.href(detour).alias("href"), paths.relative(package, dest).alias("relative"), paths.likely_package(dest).alias("package"), paths.item_id(dest).alias("item"))


@query("SELECT l_orderkey AS book, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS place, 'Text/p' || l_partkey || '-' || l_suppkey || '.xhtml' AS href FROM lineitem")
def package_spines(spark: SparkSession, sf: str) -> DataFrame:
    """Package documents written from order lines and parsed: their documents in reading order."""
    from collections.abc import Iterator

    import pandas as pd

    from diglot.operators.xml import Package

    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("name")).alias("s")).groupBy("book").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["name"]).alias("names"))
    item = F.array_join(F.transform(F.array_sort("names"), lambda n: F.concat(F.lit("<opf:item href='./Text/../Text/"), n, F.lit(".xhtml#x' id='"), n, F.lit("'/>"))), "")
    ref = F.array_join(F.transform("names", lambda n: F.concat(F.lit("<opf:itemref idref='"), n, F.lit("'/>"))), "")
    text = F.concat(F.lit("<opf:package xmlns:opf='urn:x'><!-- <item/> --><opf:manifest>"), item, F.lit("</opf:manifest><opf:spine>"), ref, F.lit("<opf:itemref idref='gone'/></opf:spine></opf:package>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(b, i, h) for b, t in zip(f["book"], f["text"], strict=True) for i, h in enumerate(Package(t).reading_order())], columns=["book", "place", "href"])

    return rows.select("book", text.alias("text")).mapInPandas(run, "book long, place long, href string")


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
  SELECT n_name AS nation, coalesce(max(r), 0) + 1 AS points, CASE WHEN max(r) IS NULL THEN 1 ELSE 2 END::BIGINT AS depth, n_name || coalesce(' ' || string_agg(s_suppkey::VARCHAR, ' ' ORDER BY r), '') AS labels FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY n_name""")
def repaired_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Contents documents with bare labels and no numbers, written from nations and suppliers, repaired and read."""
    from collections.abc import Iterator

    import pandas as pd

    from diglot.operators import xml

    low = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    point = lambda label, inner: F.concat(F.lit("<navPoint><navLabel> "), label, F.lit(" </navLabel>"), inner, F.lit("</navPoint>"))
    inner = F.coalesce(F.array_join(F.transform("keys", lambda k: point(k.cast("string"), F.lit(""))), ""), F.lit(""))
    rows = table(spark, sf, "nation").join(low, "n_nationkey", "left").select(F.col("n_name").alias("nation"), F.concat(F.lit("<ncx><navMap>"), point(F.col("n_name"), inner), F.lit("</navMap></ncx>")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, text in zip(f["nation"], f["text"], strict=True):
                root = xml.tree(xml.repaired_ncx(text, name, ""))
                found = xml.named(root, "navPoint")
                depth = next(int(m.get("content")) for m in xml.named(root, "meta") if m.get("name") == "dtb:depth")
                numbers = [int(p.get("playOrder")) for p in found]
                labels = " ".join(xml.words(xml.kids(p, "navLabel")[0]) for p in found)
                out.append((name, max(numbers) if numbers == sorted(numbers) else -1, depth, labels))
            yield pd.DataFrame(out, columns=["nation", "points", "depth", "labels"])

    return rows.mapInPandas(run, "nation string, points long, depth long, labels string")


@query("SELECT p_partkey // 50 AS doc, p_partkey % 50 AS ord, p_name AS source, p_brand AS target, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type ELSE 'x' || p_size || '|y' END AS aliases FROM part WHERE p_size % 7 <> 0")
def glossary_json(spark: SparkSession, sf: str) -> DataFrame:
    """Glossaries written as JSON, as a list or an object, and parsed; terms without a target are dropped."""
    alias = F.when(F.col("p_size") % 3 == 0, "[]").when(F.col("p_size") % 3 == 1, F.to_json(F.struct(F.col("p_type").alias("v")))).otherwise(F.concat(F.lit('["x'), F.col("p_size").cast("string"), F.lit('"," ","y",7]')))
    plain_alias = F.when(F.col("p_size") % 3 == 1, F.regexp_extract(alias, '^\\{"v":(.*)\\}$', 1)).otherwise(alias)
    target = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_brand"))
    one = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("p_name").alias("source"), target.alias("target"))), "\\}$", ""), F.lit(',"aliases":'), plain_alias, F.lit("}"))
    doc = F.floor(F.col("p_partkey") / 50)
    listed = table(spark, sf, "part").groupBy(doc.alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("j")))), lambda x: x["j"]).alias("js"))
    text = F.concat(F.lit("["), F.array_join("js", ","), F.lit("]"))
    raw = listed.select("doc", F.when(F.col("doc") % 2 == 0, text).otherwise(F.concat(F.lit('{"terms":'), text, F.lit("}"))).alias("value"))
    return records.glossary_terms(raw, keep=["doc"]).select("doc", F.col("ord").cast("long").alias("ord"), "source", "target", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT o_orderkey AS book, c_custkey AS file, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 GROUP BY ALL")
def resume_states(spark: SparkSession, sf: str) -> DataFrame:
    """Resume states in JSON that match their base and, where they name it, their source; stale and broken ones are left out."""
    o = table(spark, sf, "orders")
    now = o.select(F.col("o_orderkey").alias("book"), F.sha1(F.col("o_orderkey").cast("string")).alias("base"), F.sha1(F.col("o_orderpriority")).alias("src"))
    base = F.when(F.col("o_orderkey") % 3 == 0, "stale").otherwise(F.sha1(F.col("o_orderkey").cast("string")))
    src = F.when(F.col("o_orderkey") % 4 == 0, F.sha1("o_orderpriority"))
    state = F.to_json(F.struct(base.alias("base_sha1"), src.alias("src_sha1"), F.array(F.col("o_custkey").cast("string")).alias("done")))
    raw = o.select(F.col("o_orderkey").alias("book"), F.when(F.col("o_orderkey") % 2 == 0, state).otherwise(F.left(state, F.lit(9))).alias("value"))
    valid = records.valid_states(records.states(raw, keep=["book"]), now)
    return valid.select("book", F.explode(F.transform("done", lambda x: x.cast("long"))).alias("file")).groupBy("book", "file").agg(F.count(F.lit(1)).alias("n"))


S_MEMBERS = r"""p AS (SELECT DISTINCT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS book, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages), s AS (SELECT book, path, min(page_id) AS ord FROM p WHERE path <> '' GROUP BY book, path), b AS (SELECT *, regexp_replace(path, '^.*/', '') AS base, count(*) OVER (PARTITION BY book, regexp_replace(path, '^.*/', '')) AS n FROM s)"""


@query(f"WITH {S_MEMBERS} SELECT book, path, CASE WHEN ord % 3 = 0 THEN path WHEN ord % 3 = 1 AND n = 1 THEN 'T/' || base END AS dest FROM b WHERE base <> ''")
def job_destinations(spark: SparkSession, sf: str) -> DataFrame:
    """Where translations of pages are: a third under the same path, a third in another folder if the name is unique, the rest nowhere."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("book"), F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("path")).where("path <> ''")
    source = p.groupBy("book", "path").agg(F.min("page_id").alias("ord")).where(paths.basename("path") != "")
    unique = Window.partitionBy("book", paths.basename("path"))
    moved = source.withColumn("n", F.count(F.lit(1)).over(unique)).where("ord % 3 = 1 AND n = 1").select("book", F.concat(F.lit("T/"), paths.basename("path")).alias("path"), "ord")
    target = source.where("ord % 3 = 0").select("book", "path", "ord").unionByName(moved)
    return jobs.destinations(source, target).select("book", "path", "dest")

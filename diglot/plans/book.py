"""Books from end to end: members -> jobs -> translations -> titles -> copies -> contents -> archives."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diglot.functions import paths
from diglot.functions import text as tx
from diglot.operators import html as ht
from diglot.operators import jobs, titles, xml
from diglot.plans import translate as tr
from diglot.plans.client import Translator
from diglot.sources import epub, records
from diglot.storage import exists, materialise

LEAST_BYTES = 1000
ENTRY = "book string, path string, ord int"


def counted(texts: DataFrame) -> DataFrame:
    """HTML members with todo (blocks to translate) and chinese (Chinese blocks)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            roots = [ht.parse(t) for t in f["text"]]
            chinese = [sum(1 for x in ht.leaves(r) if tx_han(x) >= 2) for r in roots]
            yield f[["book", "path", "ord"]].assign(todo=[len(ht.eligible(r)) for r in roots], chinese=chinese)

    def tx_han(x: ht.Node) -> int:
        return ht.plain.counts(ht.plain.norm(x.text()))[0]

    return texts.where(paths.is_html("path")).select("book", "path", "ord", "text").mapInPandas(run, f"{ENTRY}, todo int, chinese int")


def spine(texts: DataFrame) -> DataFrame:
    """book, path, ord, package: the documents of each book in reading order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(frame["path"], frame["text"], strict=True))
        package, _ = xml.package_path(list(by), by.get("META-INF/container.xml"))
        order = [xml.resolve(package, h) for h in xml.Package(by[package]).reading_order()] if package else []
        return pd.DataFrame([(frame["book"].iloc[0], p, i, package) for i, p in enumerate(order)], columns=["book", "path", "ord", "package"])

    small = texts.where(F.lower("path").endswith(".opf") | (F.col("path") == "META-INF/container.xml")).select("book", "path", "text")
    return small.groupBy("book").applyInPandas(run, f"{ENTRY}, package string")


def blocks_of(texts: DataFrame, planned: DataFrame) -> DataFrame:
    """book, job (the file's place in the source), file, name, n, text, visible: the blocks to translate of the planned documents."""
    schema = "book string, job int, file string, name string, n int, text string, visible string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (b, o, b + "\x02" + d, p, n, ht.plain.norm(x.text()), x.visible())
                for b, o, p, d, t in zip(f["book"], f["ord"], f["path"], f["dest"], f["text"], strict=True)
                for n, x in enumerate(ht.eligible(ht.parse(t)))
            ]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return texts.drop("ord").join(planned.select("book", "path", "dest", "ord"), ["book", "path"]).select("book", "ord", "path", "dest", "text").mapInPandas(run, schema)


def inserted(texts: DataFrame, planned: DataFrame, done: DataFrame) -> DataFrame:
    """book, path (the destination), content, inserted: source documents with their translations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [ht.insert(t, dict(zip(n or [], v or [], strict=True))) for t, n, v in zip(f["text"], ([*x] if x is not None else [] for x in f["ns"]), ([*x] if x is not None else [] for x in f["values"]), strict=True)]
            yield f[["book", "path"]].assign(text=[m[0] for m in made], inserted=[m[1] for m in made])

    per = tr.accepted(done).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "translation"))).alias("z")).select("file", "z.n", "z.translation").toDF("file", "ns", "values")
    keyed = texts.join(planned.select("book", "path", "dest"), ["book", "path"]).withColumn("file", F.concat_ws("\x02", "book", "dest"))
    made = keyed.join(per, "file", "left").select("book", F.col("dest").alias("path"), "text", "ns", "values").mapInPandas(run, "book string, path string, text string, inserted int")
    return made.select("book", "path", F.encode(tx.declare_utf8("text"), "UTF-8").alias("content"), "inserted")


def packages(texts: DataFrame, order: DataFrame) -> DataFrame:
    """book, path, content: package documents with entries for all destinations (order: book, dest, rank)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(frame["path"], frame["text"], strict=True))
        package, _ = xml.package_path(list(by), by.get("META-INF/container.xml"))
        if not package:
            return pd.DataFrame(columns=["book", "path", "text"])
        dests = [*frame["dests"].iloc[0]]
        new, _ = xml.with_documents(by[package], dests, package, dests)
        return pd.DataFrame([(frame["book"].iloc[0], package, new)], columns=["book", "path", "text"])

    dests = order.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dest"))), lambda x: x["dest"]).alias("dests"))
    small = texts.where(F.lower("path").endswith(".opf") | (F.col("path") == "META-INF/container.xml")).select("book", "path", "text").join(dests, "book")
    return small.groupBy("book").applyInPandas(run, "book string, path string, text string").select("book", "path", F.encode("text", "UTF-8").alias("content"))


def contents(texts: DataFrame) -> DataFrame:
    """book, path, content, navpoints: repaired tables of contents, nav pages and packages of each book that has an NCX."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        book, by = frame["book"].iloc[0], dict(zip(frame["path"], frame["text"], strict=True))
        package, _ = xml.package_path([m for m in by if m.lower().endswith(".opf")] + ["META-INF/container.xml"], by.get("META-INF/container.xml"))
        package = package if package in by and package != "META-INF/container.xml" else None
        if package:
            about = xml.Package(by[package])
            ncx = xml.resolve(package, about.ncx() or "") or None
            title, author = about.title, about.creator
        else:
            ncx, title, author = next(iter(sorted(p for p in by if p.lower().endswith(".ncx"))), None), "", ""
        rows = []
        if ncx in by:
            fixed = xml.repaired_ncx(by[ncx], title, author)
            page = posixpath.join(posixpath.dirname(ncx), "nav.xhtml")
            many = len(xml.named(xml.tree(fixed), "navPoint"))
            rows = [(book, ncx, fixed, many), (book, page, xml.nav_page(fixed, title), many)]
            if package:
                rows.append((book, package, xml.with_nav(by[package], posixpath.relpath(page, posixpath.dirname(package) or ".")), many))
        return pd.DataFrame(rows, columns=["book", "path", "text", "navpoints"])

    small = texts.where(F.lower("path").rlike(r"\.(opf|ncx)$") | (F.col("path") == "META-INF/container.xml")).select("book", "path", "text")
    made = small.groupBy("book").applyInPandas(run, "book string, path string, text string, navpoints int")
    return made.select("book", "path", F.encode("text", "UTF-8").alias("content"), "navpoints")


def changed(texts: DataFrame, change, count: str) -> DataFrame:
    """book, path, content of the HTML members that `change` (html -> html, how many) changes."""
    made = ht.rewrite(texts.where(paths.is_html("path")).select("book", "path", "text"), "text", change, count)
    return made.where(F.col(count) > 0).select("book", "path", F.encode(tx.declare_utf8("text"), "UTF-8").alias("content"), count)


def step(members: DataFrame, updates: DataFrame, name: str) -> DataFrame:
    return materialise(epub.spliced(members, updates.select("book", "path", "content")), name)


@dataclass
class Calls:
    """How a run calls: the translator, the glossary, tasks at once, and the folder that keeps the replies."""

    translator: Translator
    terms: DataFrame | None = None
    tasks: int = 4
    log: str | None = None
    context: int = 0
    replies: list[DataFrame] = field(default_factory=list)

    def cache(self, spark: SparkSession) -> DataFrame | None:
        return records.open_cache(spark, self.log) if self.log else None

    def translate(self, blocks: DataFrame, strict: bool = True) -> DataFrame:
        done, fresh = tr.translate(blocks, self.translator, self.terms, self.cache(blocks.sparkSession), self.tasks, self.log, strict)
        self.replies.append(fresh)
        return done

    def usage(self) -> tuple[int, int, int, int]:
        """Input, output and total tokens and calls of the run so far, from the written replies."""
        sums = [r.agg(*[F.sum(c) for c in ("input", "output", "total", "calls")]).first() for r in self.replies]
        return tuple(sum(s[k] or 0 for s in sums) for k in range(4))


def with_titles(members: DataFrame, calls: Calls, map_path: str | None = None, log_path: str | None = None) -> DataFrame:
    """members with English titles translated in one pass of calls, book by book.

    The mapping (book, title, translation) and the number of titles replaced in each member may be kept as JSON.
    """
    texts = epub.texts(members)
    pages = texts.where(F.lower("path").rlike(r"\.(xhtml|html?|ncx|xml)$"))
    found = materialise(titles.collect(pages, "book", "path", "ord", "text"), "titles")
    done = calls.translate(tr.title_requests(found), strict=False)
    mapping = materialise(done.where("translation <> text").select(F.col("file").alias("book"), F.col("text").alias("title"), "translation"), "title-map")
    if map_path:
        mapping.write.mode("append").json(map_path)
    fixed = materialise(titles.applied(pages.select("book", "path", "text"), "book", "path", "text", mapping).where("replaced > 0"), "titled")
    if log_path:
        fixed.select("book", "path", "replaced").write.mode("append").json(log_path)
    return step(members, fixed.select("book", "path", F.encode(tx.declare_utf8("text"), "UTF-8").alias("content")), "with-titles")


def finished(members: DataFrame, calls: Calls, log_path: str | None = None) -> DataFrame:
    """Titles, copies and contents, in this order."""
    members = with_titles(members, calls, log_path=log_path)
    members = step(members, changed(epub.texts(members), ht.collapse, "removed"), "deduped")
    return step(members, contents(epub.texts(members)), "contents")


def book_prints(members: DataFrame) -> DataFrame:
    """book, sha1: a fingerprint of each book's members, the same in whatever order they are stored."""
    per = epub.fingerprints(members).groupBy("book").agg(F.array_sort(F.collect_list(F.concat_ws("\x01", "path", "sha1"))).alias("all"))
    return per.select("book", F.sha1(F.array_join("all", "\x02")).alias("sha1"))


STATE_ROW = "book string, base_sha1 string, src_sha1 string, done array<string>, attempts map<string,int>"


def load_state(spark: SparkSession, work: str) -> DataFrame | None:
    """The states of all books of a work folder, or None: the first run."""
    if not exists(f"{work}/state"):
        return None
    raw = spark.read.text(f"{work}/state").withColumn("book", F.get_json_object("value", "$.book"))
    return records.states(raw, keep=["book"]).where("book IS NOT NULL")


def resumable(spark: SparkSession, work: str, src: DataFrame, target: str | None) -> tuple[DataFrame | None, DataFrame | None]:
    """The members to go on from and the states (book, done, attempts) that hold for them.

    A checkpoint counts if its state is bound to this source; its done list, if it is bound to the base too.
    """
    found = load_state(spark, work)
    prints = book_prints(src).select("book", F.col("sha1").alias("src"))
    base = None
    if target is not None:
        base = materialise(epub.members(spark, target), "target")
    elif found is not None and exists(f"{work}/resumed"):
        known = records.of_this_source(found, prints).select("book")
        base = materialise(epub.members(spark, f"{work}/resumed").join(known, "book", "left_semi"), "target")
        base = None if base.isEmpty() else base
    if base is None or found is None:
        return base, None
    both = prints.join(book_prints(base).select("book", F.col("sha1").alias("base")), "book")
    return base, materialise(records.valid_states(found, both).select("book", "done", "attempts"), "valid-states")


def save_progress(members: DataFrame, src: DataFrame, chosen: DataFrame, made: DataFrame, before: DataFrame | None, work: str) -> None:
    """The books as they are now, then the state that is bound to them: a crash between repeats the files, and loses none.

    A file is done when Chinese landed in it, or after three futile tries.
    """
    spark = members.sparkSession
    epub.save(members, f"{work}/resumed")
    saved = epub.members(spark, f"{work}/resumed")
    landed = chosen.select("book", "dest").join(made.select("book", F.col("path").alias("dest"), "inserted"), ["book", "dest"], "left")
    results = landed.select("book", "dest", (F.coalesce("inserted", F.lit(0)) > 0).alias("landed"))
    known = spark.createDataFrame([], "book string, dest string, attempts int, done boolean")
    if before is not None:
        listed = before.select("book", F.explode("done").alias("dest")).select("book", "dest", F.lit(0).alias("attempts"), F.lit(True).alias("done"))
        tried = before.select("book", F.explode("attempts").alias("dest", "attempts")).select("book", "dest", "attempts", F.lit(False).alias("done"))
        known = known.unionByName(listed).unionByName(tried).groupBy("book", "dest").agg(F.max("attempts").alias("attempts"), F.max("done").alias("done"))
    after = jobs.attempts(known, results)
    open_ = F.when(~F.col("done") & (F.col("attempts") > 0), F.struct("dest", "attempts"))
    per = after.groupBy("book").agg(F.array_sort(F.collect_list(F.when(F.col("done"), F.col("dest")))).alias("done"), F.map_from_entries(F.collect_list(open_)).alias("attempts"))
    prints = book_prints(saved).select("book", F.col("sha1").alias("base_sha1")).join(book_prints(src).select("book", F.col("sha1").alias("src_sha1")), "book")
    state = materialise(prints.join(per, "book", "left").select("book", "base_sha1", "src_sha1", F.coalesce("done", F.array().cast("array<string>")).alias("done"), "attempts"), "state")
    records.write_state(state, f"{work}/state")


def translated(
    spark: SparkSession, source: str, calls: Calls, target: str | None = None, only: str = "", again: str = "", most_blocks: int | None = None, work: str | None = None
) -> DataFrame:
    """Members of the bilingual books of a source (a book, or a folder).

    With a `work` folder a run goes on where the last one ended: finished files aren't asked for again, nor are
    prompts that were answered. A test of the first blocks leaves no state.
    """
    src = materialise(epub.members(spark, source), "source")
    base, state = resumable(spark, work, src, target) if work and most_blocks is None else (None if target is None else materialise(epub.members(spark, target), "target"), None)
    # books without a checkpoint begin from the source
    have = src if base is None else base.unionByName(src.join(base.select("book").distinct(), "book", "left_anti"))
    texts, have_texts = epub.texts(src), epub.texts(have)
    planned = jobs.jobs(counted(texts), have.where(paths.is_html("path")))
    open_ = jobs.selected(planned, counted(have_texts), paths.names(F.lit(only)), paths.names(F.lit(again)))
    if state is not None:
        open_ = jobs.unfinished(open_, state, paths.names(F.lit(again)))
    chosen = materialise(open_, "jobs")
    blocks = blocks_of(texts, chosen)
    if most_blocks is not None:
        blocks = jobs.first_blocks(blocks, most_blocks, ["book"], ["job", "n"])
    blocks = materialise(blocks, "blocks")
    if calls.context:
        ordered = materialise(tr.translate_in_order(blocks, calls.translator, calls.terms, calls.context), "translations")
        failed, done = ordered.where("error IS NOT NULL"), ordered
    else:
        failed, done = None, materialise(calls.translate(blocks), "translations")
    made = materialise(inserted(texts, chosen, done), "inserted")
    if failed is not None:
        # files with a failed call are as they were; the others are kept before the error is raised
        ill = failed.select(F.col("file")).distinct()
        made = made.join(ill, F.concat_ws("\x02", "book", "path") == F.col("file"), "left_anti")
    order = jobs.order_of(src.where(paths.is_html("path")), spine(texts), have.where(paths.is_html("path")), chosen)
    new = step(have, made, "inserted-members")
    touched = order.join(chosen.select("book", "dest"), ["book", "dest"], "left_semi")
    out = step(new, packages(epub.texts(new), order if base is None else touched), "packages")
    if work and most_blocks is None:
        tried = chosen if failed is None else chosen.join(ill, F.concat_ws("\x02", "book", "dest") == F.col("file"), "left_anti")
        save_progress(out, src, tried, made, state, work)
    if failed is not None:
        tr.failures(failed)
    return out


def run(
    spark: SparkSession, source: str, out: str, translator: Translator, terms: DataFrame | None = None, target: str | None = None, bilingual_only: bool = False, work: str | None = None, tasks: int | str = 4, context: int = 0, **options
) -> dict[str, DataFrame]:
    """Writes the bilingual and the Chinese books of a source to folders under out; returns their members, and `usage`."""
    calls = Calls(translator, terms, jobs.workers(tasks), f"{work}/replies" if work else None, context)
    log = f"{work}/titles" if work else None
    both = finished(translated(spark, source, calls, target, work=work, **options), calls, log)
    results = {"bilingual": both}
    if not bilingual_only:
        alone = step(both, changed(epub.texts(both), ht.without_source, "removed"), "target-only")
        alone = finished(alone, calls, log)
        results["chinese"] = alone.withColumn("book", epub.target_name(F.col("book")))
    for name, table in results.items():
        small = table.groupBy("book").agg(F.sum(F.length("content")).alias("n")).where(F.col("n") < LEAST_BYTES)
        if not small.isEmpty():
            raise RuntimeError(f"books under {LEAST_BYTES} bytes: {[r.book for r in small.take(5)]}")
        epub.save(table, f"{out}/{name}")
    results["usage"] = spark.createDataFrame([calls.usage()], "input long, output long, total long, calls long")
    return results

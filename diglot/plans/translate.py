"""Translating blocks: batches, prompts, cached calls, replies, fallbacks.

The calls are the only step that leaves Spark. Each stage of calls is one mapInPandas over requests
that the cache can't answer, in a fixed number of tasks, and is written before anything reads it:
a lost executor repeats the calls of its own unfinished task and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diglot.functions import glossary as gl
from diglot.functions import plain, reply
from diglot.functions import text as tx
from diglot.operators import batches as bt
from diglot.plans.client import CallFailed, Translator, transient
from diglot.sources import records
from diglot.storage import materialise


REPLIES = "key string, response string, error string, cut boolean, admitted boolean, input long, output long, total long, calls long"
#: Replies of a task that go into one file of the log; a crash loses this many at most.
LOGGED = 8


def call(requests: DataFrame, translator: Translator, tasks: int = 4, log: str | None = None) -> DataFrame:
    """REPLIES to requests (key, prompt, max_tokens, expect: numbered items, or 0).

    A failed call is a row with an error, not a lost job; after one that would fail again (a refused key,
    say) a task asks no more. A reply is admitted to the cache unless it is empty, was cut, or has none of the
    items expected. With a `log` folder, admitted replies are written as they come, whole files at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped, held = None, []
        for frame in frames:
            rows = []
            for key, prompt, most, expect in zip(frame["key"], frame["prompt"], frame["max_tokens"], frame["expect"], strict=True):
                if stopped:
                    rows.append((key, None, stopped, False, False, 0, 0, 0, 0))
                    continue
                try:
                    reply = translator.chat(prompt, int(most))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, None, repr(e), False, False, 0, 0, 0, 0))
                    stopped = None if transient(e) else f"not asked after {e!r}"
                    continue
                cut = getattr(reply, "cut", False)
                good = bool(reply) and not cut and (not expect or bool(plain.reply_items(reply, int(expect))))
                rows.append((key, str(reply), None, cut, good, *getattr(reply, "counts", (0, 0, 0, 0))))
                if good and log:
                    held.append((key, str(reply)))
                    if len(held) == LOGGED:
                        records.log_replies(log, held)
                        held = []
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in REPLIES.split(", ")])
        if held:
            records.log_replies(log, held)

    return requests.select("key", "prompt", "max_tokens", "expect").repartition(tasks, "key").mapInPandas(run, REPLIES)


def failures(replies: DataFrame) -> None:
    """Raises the first error of a written stage of calls, so that a run with failed calls doesn't end as if it were done."""
    first = replies.where("error IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("error").startswith("not asked").alias("later"), "error")).alias("e")).first()
    if first.n:
        raise CallFailed(f"{first.n} calls failed: {first.e.error}")


def answered(asked: DataFrame, cache: DataFrame | None, translator: Translator, tasks: int, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """asked with response and error, and the replies that are new. Raises if a call failed, after the others are written."""
    keyed = records.requests(asked, translator.model, "prompt", "source")
    todo = keyed.dropDuplicates(["key"]) if cache is None else records.misses(keyed, cache)
    fresh = materialise(call(todo, translator, tasks, log), "replies")
    failures(fresh)
    known = fresh.select("key", "response")
    if cache is not None:
        known = known.unionByName(cache.select("key", "response"))
    return keyed.join(known, "key", "left"), fresh


def batch_requests(blocks: DataFrame, terms: DataFrame | None) -> DataFrame:
    """file, batch, items (array of n, text, protected, map), terms, prefix, prompt, source, max_tokens. blocks: file, n, text, visible, batch."""
    keyed = blocks.withColumn("b", F.concat_ws("\x01", "file", "batch"))
    grouped = keyed.groupBy("file", "batch", "b").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("items"))
    none = F.array().cast("array<struct<longest:int,ord:int,target:string,variants:array<string>,patterns:array<string>,line:string>>")
    if terms is None:
        with_terms = grouped.withColumn("terms", none)
    else:
        comp = gl.compiled(terms).withColumn("line", gl.line(F.col("source"), F.col("target"), F.col("aliases")))
        hits = gl.appearing(keyed.select("b", F.coalesce("visible", "text").alias("text")), terms, "b").join(comp, "ord")
        per = hits.groupBy("b").agg(F.sort_array(F.collect_list(F.struct((-F.col("longest")).alias("longest"), "ord", "target", "variants", "patterns", "line"))).alias("terms"))
        with_terms = grouped.join(per, "b", "left").withColumn("terms", F.coalesce("terms", none))
    lines = F.transform(F.array_sort(F.transform("terms", lambda t: F.struct(t["ord"].alias("ord"), t["line"].alias("line")))), lambda x: x["line"])
    hint = gl.hint(lines)
    ready = with_terms.withColumn("prefix", F.when(hint == "", "").otherwise(F.concat(hint, F.lit("\n\n"))))
    ready = ready.withColumn("safe", F.transform("items", lambda x: gl.protect(x["text"], F.col("terms"))))
    joined = F.array_join(F.transform("items", lambda x: x["text"]), "\n")
    return ready.select("file", "batch", "items", "safe", "terms", "prefix", bt.prompt(F.col("prefix"), F.transform("safe", lambda s: s["text"])).alias("prompt"), joined.alias("source"), tx.reply_budget(tx.tokens(joined), F.size("items")).alias("max_tokens"), F.size("items").alias("expect"))


def translate(blocks: DataFrame, translator: Translator, terms: DataFrame | None = None, cache: DataFrame | None = None, tasks: int = 4, log: str | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """file, n, text, translation for each block (file, name, n, text, visible), and the new REPLIES.

    Blocks that have a batch number keep it. Failed calls raise when their stage is written; with a `log` folder
    (see `call`) the replies that came can be used again.

    A batch whose reply has no item is asked for once more with a strict format, if `strict`; an item that is still
    missing is asked for alone; one that can't be had is its own source.
    """
    packed = blocks if "batch" in blocks.columns else bt.pack(blocks, "file", "n", "text", "name" if "name" in blocks.columns else None)
    wanted = materialise(batch_requests(packed, terms), "batches")
    count = F.size("items")
    first, fresh = answered(wanted, cache, translator, tasks, log)
    first = first.withColumn("found", reply.items("response", count, reply.unwrapped))
    silent = first.where((F.size("found") <= 0) & (count > 1) & F.lit(strict)).drop("key", "response", "found").withColumn("prompt", F.concat(F.lit(bt.REMINDER), F.col("prompt")))
    second, fresh_2 = answered(silent, cache, translator, tasks, log)
    strict = second.select("file", "batch", reply.items("response", count, reply.unwrapped).alias("strict"))
    best = first.join(strict, ["file", "batch"], "left").withColumn("found", F.when(F.size("strict") > 0, F.col("strict")).otherwise(F.col("found")))
    each = best.select("file", "prefix", "terms", "found", F.posexplode(F.arrays_zip("items", "safe")).alias("i", "z")).select("file", F.col("z.items.n").alias("n"), F.col("z.items.text").alias("text"), "prefix", "terms", F.col("z.safe.text").alias("protected"), F.col("z.safe.map").alias("map"), F.try_element_at("found", F.col("i") + 1).alias("raw"))
    each = materialise(each, "items")
    alone = each.where("raw IS NULL OR raw = ''").select("file", "n", bt.single_prompt(F.col("prefix"), F.col("protected")).alias("prompt"), F.col("text").alias("source"), F.greatest(F.lit(1000), 3 * F.length("text")).alias("max_tokens"), F.lit(0).alias("expect"))
    third, fresh_3 = answered(alone, cache, translator, tasks, log)
    single = third.select("file", "n", reply.single("response").alias("single"))
    raw = F.coalesce(F.when(F.col("raw") != "", F.col("raw")), F.when(F.col("single") != "", F.col("single")))
    done = each.join(single, ["file", "n"], "left").select("file", "n", "text", F.coalesce(gl.restore(raw, F.col("map"), F.col("terms")), F.col("text")).alias("translation"))
    return done, fresh.unionByName(fresh_2).unionByName(fresh_3)


def translate_in_order(blocks: DataFrame, translator: Translator, terms: DataFrame | None = None, most: int = bt.CONTEXT) -> DataFrame:
    """As `translate`, but each batch is given the last accepted pairs of its file, so a file is one task.

    Replies that are English never become context. The glossary is gathered: it is a list that a person wrote. A file
    ends at its first failed call, whose error is in the row of the batch (column error); see `failures`.
    """
    import re

    comp = [] if terms is None else sorted(([r.longest, r.ord, r.target, r.variants, r.patterns, gl_line(r)] for r in gl.compiled(terms).toLocalIterator()), key=lambda c: (-c[0], c[1]))
    known = [(ordinal, target, variants, [re.compile(java_pattern(v)) for v in variants], line) for _, ordinal, target, variants, _, line in comp]
    packed = bt.pack(blocks, "file", "n", "text", "name" if "name" in blocks.columns else None)
    kind = {c: packed.schema[c].dataType.simpleString() for c in ("file", "n")}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        context: list[tuple[str, str]] = []
        rows = []
        for _, batch in frame.sort_values("n").groupby("batch", sort=True):
            texts, visible = batch["text"].tolist(), batch["visible"].fillna("").tolist()
            here = [t for t in known if any(p.search(v) for p in t[3] for v in visible)]
            safe, maps = zip(*(protect_plain(t, here) for t in texts), strict=True)
            hint = "\n".join([gl.HEAD, *(t[4] for t in sorted(here)), gl.FOOT]) + "\n\n" if here else ""
            before = context_plain(context)
            try:
                items = translator_items(translator, hint + before, list(safe))
            except Exception as e:  # noqa: BLE001
                rows.append((frame["file"].iloc[0], batch["n"].iloc[0], texts[0], texts[0], repr(e)))
                break
            for n, text, one, marks in zip(batch["n"], texts, items, maps, strict=True):
                new = restore_plain(one, marks, here) if one else text
                rows.append((frame["file"].iloc[0], n, text, new, None))
                if new != text and plain.counts(new)[0] >= 2:
                    context = [*context, (text, new)][-most:]
        return pd.DataFrame(rows, columns=["file", "n", "text", "translation", "error"])

    schema = f"file {kind['file']}, n {kind['n']}, text string, translation string, error string"
    return packed.select("file", "n", "text", "visible", "batch").groupBy("file").applyInPandas(run, schema)


def gl_line(r) -> str:
    return f"- {r.source}{'（' + ' / '.join(r.aliases) + '）' if r.aliases else ''} → {r.target}"


def java_pattern(v: str) -> str:
    """The pattern of a spelling for Python's re."""
    import re

    edge = "[A-Za-z0-9]"
    bounded = re.match(edge, v[0]) and re.match(edge, v[-1])
    return f"(?<!{edge}){re.escape(v)}(?!{edge})" if bounded else re.escape(v)


Pairs = list[tuple[str, str]]


def protect_plain(text: str, known: list) -> tuple[str, Pairs]:
    marks: Pairs = []
    for _, target, _, patterns, _ in known:
        hit = next((p for p in patterns if p.search(text)), None)
        if hit:
            mark = f"@@BT{len(marks)}@@"
            text = hit.sub(mark, text)
            marks.append((mark, target))
    return text, marks


def restore_plain(text: str, marks: list[tuple[str, str]], known: list) -> str:
    for mark, target in marks:
        text = text.replace(mark, target)
    for _, target, variants, patterns, _ in known:
        for v, p in zip(variants, patterns, strict=True):
            if v != target:
                text = p.sub(lambda _, t=target: t, text)
    return text


def context_plain(pairs: Pairs) -> str:
    lines = [f"{i}. EN: {en}\n   ZH: {zh}" for i, (en, zh) in enumerate(pairs, 1)]
    return "\n".join([bt.CONTEXT_HEAD, *lines, "", ""]) if pairs else ""


def translator_items(translator: Translator, prefix: str, items: list[str]) -> list[str]:
    """The replies to a batch: parsed, asked for again in a strict format, or alone; '' where there is none."""
    ask = bt.ASK.format(len(items)) + "\n".join(f"{i + 1}. {t}" for i, t in enumerate(items))
    most = max(800, min(8000, 3 * sum(map(len, items)) // 8 + 30 * len(items) + 200))

    def parsed(prompt: str) -> dict[int, str]:
        return plain.reply_items(translator.chat(prompt, most), len(items), plain.unwrapped)

    found = parsed(prefix + ask)
    if not found and len(items) > 1:
        found = parsed(bt.REMINDER + prefix + ask)
    out = []
    for i, t in enumerate(items, 1):
        one = found.get(i, "")
        if not one:
            one = plain.unwrapped(plain.squeeze(translator.chat(prefix + bt.ASK_ONE + t, max(1000, 3 * len(t)))))
        out.append(one)
    return out


def accepted(done: DataFrame) -> DataFrame:
    """The translations to insert: not empty, not the source, two CJK characters at least."""
    return done.where((F.col("translation") != "") & (tx.norm("translation") != tx.norm("text")) & (tx.han("translation") >= 2))


def title_requests(titles: DataFrame, size: int = 40) -> DataFrame:
    """titles (book, title, ord: 1, 2 ... in each book) as blocks; a batch is a fixed slice of a book's titles."""
    return titles.select(F.col("book").alias("file"), (F.col("ord") - 1).cast("int").alias("n"), F.col("title").alias("text"), F.col("title").alias("visible"), bt.slices(F.col("ord"), size).alias("batch"))

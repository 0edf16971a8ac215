"""Which files still need work: joins of source and target members, by book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diglot.functions import paths

MOST_FUTILE, MOST_WORKERS = 3, 4


def destinations(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (book, path, ord) with dest, the target member that holds its translation, or null.

    The same path; else, for a file name that is unique in the source, the target member of that name
    with the longest common suffix. A member serves the first source file that asks for it.
    """
    base = Window.partitionBy("book", "base")
    src = source.withColumn("base", paths.basename("path")).withColumn("alone", F.count(F.lit(1)).over(base) == 1)
    members = target.select("book", F.col("path").alias("to"), F.col("ord").alias("to_ord"))
    exact = members.select("book", F.col("to").alias("path"), F.lit(True).alias("exact"))
    named = members.withColumn("base", paths.basename("to"))
    rank = Window.partitionBy("book", "path").orderBy(F.desc("suffix"), "to_ord")
    alike = src.where("alone").select("book", "path", "base").join(named, ["book", "base"]).withColumn("suffix", paths.common_suffix(F.col("path"), F.col("to"))).withColumn("r", F.row_number().over(rank)).where("r = 1").select("book", "path", "to")
    guessed = src.join(exact, ["book", "path"], "left").join(alike, ["book", "path"], "left").withColumn("dest", F.when(F.col("exact"), F.col("path")).otherwise(F.col("to")))
    claim = Window.partitionBy("book", "dest").orderBy("ord")
    return guessed.withColumn("dest", F.when(F.row_number().over(claim) == 1, F.col("dest"))).select(*source.columns, "base", "dest")


def jobs(source: DataFrame, target: DataFrame) -> DataFrame:
    """book, base, path, dest, ord for each source file with blocks to translate (source has `todo`, their number).

    A file without a destination gets its name in the directory of the first target member, or its
    path with underscores where that is taken.
    """
    found = destinations(source.where("todo > 0"), target)
    first = target.groupBy("book").agg(F.min_by("path", "ord").alias("first"))
    prefix = F.when(F.col("first").isNull(), "EPUB/Text/").when(paths.dirname("first") == "", "").otherwise(F.concat(paths.dirname("first"), F.lit("/")))
    taken = target.select("book", F.col("path").alias("fresh"), F.lit(True).alias("taken"))
    fresh = found.join(first, "book", "left").withColumn("prefix", prefix).withColumn("fresh", F.when(F.col("dest").isNull(), F.concat("prefix", "base")))
    again = Window.partitionBy("book", "fresh").orderBy("ord")
    placed = fresh.join(taken, ["book", "fresh"], "left").withColumn("again", F.row_number().over(again) > 1)
    other = F.concat("prefix", F.translate("path", "/", "_"))
    dest = F.coalesce("dest", F.when(F.coalesce("taken", F.lit(False)) | F.col("again"), other).otherwise(F.col("fresh")))
    return placed.select("book", "base", "path", dest.alias("dest"), "ord")


def missing(planned: DataFrame, target: DataFrame) -> DataFrame:
    """The jobs whose destination is absent or has no Chinese block (target has `chinese`, their number)."""
    done = target.where("chinese > 0").select("book", F.col("path").alias("dest"))
    return planned.join(done, ["book", "dest"], "left_anti")


def selected(planned: DataFrame, target: DataFrame, only: Column, again: Column) -> DataFrame:
    """Missing jobs and those that `again` names, within those that `only` names if it names any."""
    wanted = (F.size(only) == 0) | paths.matches("path", only)
    open_ = missing(planned, target).select("book", "dest", F.lit(True).alias("open"))
    return planned.where(wanted).join(open_, ["book", "dest"], "left").where(F.coalesce("open", F.lit(False)) | paths.matches("path", again)).drop("open")


def unfinished(planned: DataFrame, state: DataFrame, again: Column) -> DataFrame:
    """planned without the files that a state (book, done) lists, except those asked for again."""
    done = state.select("book", F.explode("done").alias("dest"))
    redo = paths.matches("path", again)
    return planned.where(redo).unionByName(planned.where(~redo).join(done, ["book", "dest"], "left_anti"))


def order_of(source: DataFrame, spine: DataFrame, target: DataFrame, open_: DataFrame) -> DataFrame:
    """book, dest, rank: destinations in the source's reading order, then its archive order, then what is missing."""
    known = destinations(source, target).where("dest IS NOT NULL").select("book", "path", "dest", "ord")
    both = known.join(open_.select("book", "path", F.col("dest").alias("new")), ["book", "path"], "full").select("book", "path", F.coalesce("new", "dest").alias("dest"), F.coalesce("ord", F.lit(1 << 30)).alias("ord"))
    by_spine = both.join(spine.select("book", "path", F.col("ord").alias("spine_ord")), ["book", "path"], "left")
    first = by_spine.groupBy("book", "dest").agg(F.min(F.struct(F.col("spine_ord").isNull().alias("late"), F.coalesce("spine_ord", "ord").alias("at"))).alias("k"))
    return first.select("book", "dest", F.row_number().over(Window.partitionBy("book").orderBy("k", "dest")).alias("rank"))


def first_blocks(blocks: DataFrame, most: int, per: list[str], order: list[str]) -> DataFrame:
    """The first `most` blocks of each group (of all, for no group), in order."""
    rank = Window.partitionBy(*per).orderBy(*order)
    return blocks.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most) if per else blocks.orderBy(*order).limit(most)


def attempts(state: DataFrame, results: DataFrame) -> DataFrame:
    """State (book, dest, attempts, done) after results (book, dest, landed): done when Chinese landed, or after three tries."""
    both = state.join(results, ["book", "dest"], "full")
    tries = F.coalesce("attempts", F.lit(0)) + F.when(F.col("landed").isNotNull() & ~F.col("landed"), 1).otherwise(0)
    done = F.coalesce("done", F.lit(False)) | F.coalesce("landed", F.lit(False)) | (tries >= MOST_FUTILE)
    return both.select("book", "dest", tries.cast("int").alias("attempts"), done.alias("done"))


def workers(value: str | int | None) -> int:
    """A number of parallel calls from 1 to 4; what isn't a number is 1."""
    try:
        return min(MOST_WORKERS, max(1, int(str(value).strip())))
    except ValueError:
        return 1


def next_present(wanted: DataFrame, per: list[str]) -> DataFrame:
    """wanted (rank, dest, present) with `successor`, the nearest later destination that is there."""
    later = Window.partitionBy(*per).orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    return wanted.withColumn("successor", F.first(F.when(F.col("present"), F.col("dest")), ignorenulls=True).over(later))

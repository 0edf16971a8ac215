"""Archive paths as Column expressions: normal forms are folds over path segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diglot.functions.text import bound, column

SHORT = r"(?i)(references|bibliography|index|(end|foot)?notes|toc|nav|contents)\.(x?html?)$"
HTML = r"(?i)\.(xhtml|html|htm)$"


def slashes(c: Column | str) -> Column:
    return F.translate(column(c), "\\", "/")


def basename(c: Column | str) -> Column:
    return F.substring_index(slashes(c), "/", -1)


def dirname(c: Column | str) -> Column:
    """The directory of a path, '' if it has none."""
    return F.regexp_extract(slashes(c), "^(.*)/[^/]*$", 1)


def _fold(parts: Column) -> Column:
    """Segments without '.', and with '..' applied where a segment stands before it."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        stays = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == "..")
        more = F.concat(acc, F.array(x))
        return F.when((x == ".") | (x == ""), acc).when(x != "..", more).when(stays, more).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))

    return F.aggregate(parts, empty, step)


def normal(c: Column | str) -> Column:
    """A POSIX path in normal form; an empty path stays empty, '.' is kept for the current directory.

    Paths whose segments are all names are so already.
    """

    def of(c: Column) -> Column:
        rooted = c.startswith("/")

        def joined(kept: Column) -> Column:
            kept = F.when(rooted, F.filter(kept, lambda x: x != "..")).otherwise(kept)
            return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))

        names = ~c.rlike("(?:^|/)[.]{0,2}(?:/|$)")
        return F.when((c == "") | names, c).otherwise(bound(bound(_fold(F.split(c, "/")), joined), lambda j: F.when(j == "", ".").otherwise(j)))

    return bound(slashes(c), of)


def href(c: Column | str) -> Column:
    """A package reference without its fragment, in normal form."""
    return normal(F.trim(F.substring_index(slashes(F.coalesce(column(c), F.lit(""))), "#", 1)))


def resolve(package: Column | str, ref: Column | str) -> Column:
    """The archive path of a reference in a package document."""
    full = lambda r: bound(dirname(package), lambda base: F.when(base == "", r).otherwise(normal(F.concat(base, F.lit("/"), r))))
    return bound(href(ref), lambda r: F.when(r == "", "").when(r.startswith("/"), F.ltrim(r, F.lit("/"))).otherwise(full(r)))


def relative(package: Column | str, dest: Column | str) -> Column:
    """The reference to an archive path from a package document."""
    base = F.filter(F.split(dirname(package), "/"), lambda x: x != "")
    to = F.filter(F.split(normal(slashes(dest)), "/"), lambda x: x != "")

    def of(x: Column) -> Column:
        base, to = x["base"], x["to"]
        apart = F.array_position(F.zip_with(base, to, lambda a, b: a.eqNullSafe(b)), F.lit(False))

        def joined(same: Column) -> Column:
            ups = F.array_repeat(F.lit(".."), F.size(base) - same)
            return F.array_join(F.concat(ups, F.slice(to, same + 1, F.greatest(F.size(to) - same, F.lit(0)))), "/")

        return bound(bound(apart, lambda k: F.when(k == 0, F.size(base)).otherwise(k - 1)).cast("int"), joined)

    return bound(F.struct(base.alias("base"), to.alias("to")), of)


def likely_package(first: Column | str) -> Column:
    """Where the package document of a book with this first destination is likely to be."""
    c = F.coalesce(slashes(first), F.lit(""))
    return F.when(c.startswith("EPUB/"), "EPUB/content.opf").when(c.startswith("OEBPS/"), "OEBPS/content.opf").otherwise("content.opf")


def names(c: Column | str) -> Column:
    """The names in a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(column(c), F.lit("")), ","), lambda x: F.trim(slashes(x))), lambda x: x != "")


def matches(path: Column | str, patterns: Column) -> Column:
    """Whether a path is one of the patterns, ends with one, or has the file name of one."""
    path = slashes(path)
    return F.exists(patterns, lambda p: path.endswith(p) | (basename(p) == basename(path)))


def is_short(c: Column | str) -> Column:
    """Whether a file's name says that its blocks are short (notes, indexes, contents)."""
    return basename(c).rlike(SHORT)


def is_html(c: Column | str) -> Column:
    return column(c).rlike(HTML)


def item_id(dest: Column | str) -> Column:
    """The manifest id that a new document asks for."""
    return F.concat(F.lit("bt-"), F.regexp_replace(slashes(dest), "[^\\w.-]", "-"))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(places, lambda i: F.right(a, i) == F.right(b, i)))

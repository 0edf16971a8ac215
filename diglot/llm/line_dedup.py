"""Line dedup: equal and one-edit lines across all documents, by deletion neighbourhoods.

Lines are trimmed and lower-cased. With `every`, all lines with a word take part: a line goes if an earlier
line, in the order of (doc_id, line number), is equal to it or, where both have `least_chars` characters or
more, differs by one inserted, deleted or substituted character. So the earliest of each group stays.
Without `every`, lines under `least_chars` always stay. With `least_words`, a line also goes if it differs from
an earlier one by one inserted, deleted or substituted word, where both have that many words or more: a long
line may differ by many characters. Lines that differ by two words or more stay.

Everything is a DataFrame operation on the JVM:

1. Equal lines are reduced to one row with the earliest place, summed before the shuffle.
2. Two texts one edit apart share their first or their last half: two half keys a text, with the
   length, leave those with a possible partner. Only their texts go on: a bit filter of fixed size (8 MB)
   keeps the others out of the shuffle.
3. Those emit coarse deletions, the text without one block of its characters, with the block's place.
   Only (text, block) pairs whose key another text shares go on: an edit must lie in that block.
4. Within these blocks each character's deletion is a variant. Its key is a hash of the block's place
   and content without the character, and of the texts before and after. Variants with an equal key and
   an equal place differ in that character only; a text equal to a variant is one insertion away. So
   minima by key give each text the earliest within one edit: no pairs are formed, a group of any
   size is one row per text.
5. The edit distance of each text and the earliest found is verified. If keys that are equal by chance led to
   it, all that the text's variants meet are verified.

The word step is the same on words: each word becomes one character, by a hash of 20 bits, so that a word's edit
is one character's. Such pairs are verified on their words.

Defined cases: null or empty texts have no lines; a null doc_id comes first; rows that share a doc_id
are one sequence of documents in an undefined but single order (their lines get the same place, and an
equal line in the same place is kept); the same line twice in a document goes the second time. Very
long lines emit keys only for their blocks that have partners. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diglot.storage import materialise

LEAST_CHARS = 32
BLOCKS = 8
BITS, MAP = 1 << 26, 32768


def _place() -> Column:
    return F.struct("doc_id", "line")


def _h(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS, every: bool = False) -> DataFrame:
    """doc_id, line (number from 0), norm and key of the lines that take part."""
    # most lines begin with a word, which is told without a search
    takes_part = (F.col("raw") >= "!") | F.col("raw").rlike(r"[^\x20\x09-\x0D]") if every else F.length("norm") >= least_chars
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line", "raw"))
    norm = parts.select("doc_id", "line", "raw", F.lower(F.trim("raw")).alias("norm")).where(takes_part)
    return norm.select("doc_id", "line", "norm", _h(F.col("norm")).alias("key"), F.hash("norm").alias("check"))


def _scale(n: Column) -> Column:
    """The block size of a length: a power of two, about an eighth of it, 8 at least."""
    return F.greatest(F.lit(8), F.pow(F.lit(2.0), F.ceil(F.log2(n / F.lit(float(BLOCKS))))).cast("int"))


def _lengths(n: Column) -> Column:
    return F.array(n, n + 1)


def half_keys(norm: Column, n: Column) -> Column:
    """Hashes of the first and the last half, with the length of the longer of two texts one edit apart.

    A text of n characters is the longer one or as long (m = n), or the shorter one (m = n + 1).
    """
    keys = []
    for m in (n, n + 1):
        half = F.greatest(F.floor((m - 1) / 2).cast("int"), F.lit(1))
        keys += [_h(F.lit(0), m, F.left(norm, half)), _h(F.lit(1), m, F.right(norm, half))]
    return F.array(*keys)


def words_of(norm: Column) -> Column:
    # few texts have other white space than single spaces
    cut = F.lit(False)
    for c in "\t\n\x0b\f\r":
        cut = cut | F.contains(norm, F.lit(c))
    cut = cut | F.contains(norm, F.lit("  ")) | F.startswith(norm, F.lit(" ")) | F.endswith(norm, F.lit(" ")) | (norm == "")
    return F.when(cut, F.array_remove(F.split(F.translate(norm, "\t\n\x0b\f\r", " " * 5), " ", -1), "")).otherwise(F.split(norm, " ", -1))


def word_halves(words: Column) -> Column:
    """As half_keys, of words."""
    n = F.size(words)
    keys = []
    for m in (n, n + 1):
        half = F.greatest(F.floor((m - 1) / 2).cast("int"), F.lit(1))
        keys += [_h(F.lit(2), m, F.slice(words, 1, half)), _h(F.lit(3), m, F.slice(words, n - half + 1, half))]
    return F.array(*keys)


def coded(words: Column) -> Column:
    """A text with one character of U+10000 to U+10FFFF a word."""
    code = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(_h(w), F.lit(1 << 20)) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def a_word_apart(a: Column, b: Column) -> Column:
    """Whether two arrays of words are equal but for one inserted, deleted or substituted word, or equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    longer, shorter = (F.size(a) >= F.size(b)).cast("int"), (F.size(a) <= F.size(b)).cast("int")
    rest = F.slice(a, F.greatest(at + longer, F.lit(1)), F.size(a)) == F.slice(b, F.greatest(at + shorter, F.lit(1)), F.size(b))
    return (at == 0) | rest


def in_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that is true for all of keys.key and few others: 2**26 bits, a scalar subquery of 8 MB."""
    place = keys.select((F.pmod("key", F.lit(BITS)) + 1).alias("p"))
    maps = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    # as numbers, which are read where they are: of an array of binaries each test would copy a whole map
    eight = F.transform(F.sequence(F.lit(0), F.lit(MAP // 64 - 1)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = maps.select("b", eight.alias("numbers"))
    every = keys.sparkSession.range(1, BITS // MAP + 1, 1, 1).join(F.broadcast(maps), F.col("id") == F.col("b"), "left")
    numbers = F.coalesce("numbers", F.array_repeat(F.lit(0).cast("long"), MAP // 64))
    whole = every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", numbers.alias("numbers")))), lambda x: x["numbers"]))).scalar()

    def test(key: Column) -> Column:
        p = F.pmod(key, F.lit(BITS)).cast("int")
        # the first byte of a number is its highest
        bit = p.bitwiseXOR(F.lit(56)).bitwiseAND(F.lit(63))
        return F.coalesce(F.getbit(F.get(whole, F.shiftright(p, 6)), bit) == 1, F.lit(False))

    return test


def possible(lines: DataFrame, idents: DataFrame) -> DataFrame:
    """id, place, norm, text of the distinct lines that share a half key with another: all that can be one edit apart.

    id is (key, check, kind): kind 0 has the line itself as norm, kind 1 its words as characters, and the line as text. A bit
    filter keeps the texts of other lines out of the shuffle.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("keys")) for k, c in enumerate(("halves", "word_halves"))])
    halves = idents.select("key", F.explode(kinds).alias("k")).select("key", "k.kind", F.explode("k.keys").alias("half"))
    same = Window.partitionBy("half")
    shared = halves.select("key", "kind", F.min("key").over(same).alias("a"), F.max("key").over(same).alias("b")).where("a <> b")
    wanted = shared.groupBy("key").agg(F.max(F.col("kind") == 0).alias("chars"), F.max(F.col("kind") == 1).alias("words"))
    some = materialise(wanted, "line-keys")
    # the filter uses the key three times: taken from an array it isn't hashed anew, with the line trimmed and lower-cased, for each
    keyed = lines.select("*", F.explode(F.array("key")).alias("once"))
    texts = keyed.where(in_filter(some)(F.col("once"))).drop("once").join(some, "key")
    first = texts.groupBy("key", "check").agg(F.min(F.struct(_place().alias("place"), "norm")).alias("s"), F.first("chars").alias("chars"), F.first("words").alias("words"))
    plain = F.when(F.col("chars"), F.struct(F.lit(0).alias("kind"), F.col("s.norm").alias("norm"), F.lit(None).cast("string").alias("text")))
    by_word = F.when(F.col("words"), F.struct(F.lit(1).alias("kind"), coded(words_of(F.col("s.norm"))).alias("norm"), F.col("s.norm").alias("text")))
    each = first.select("key", "check", "s.place", F.explode(F.filter(F.array(plain, by_word), lambda x: x.isNotNull())).alias("x"))
    return materialise(each.select(F.struct("key", "check", "x.kind").alias("id"), "place", "x.norm", "x.text"), "line-halves")


def earliest_near(near: DataFrame) -> DataFrame:
    """id (key, check), near (the earliest place within one edit, if before the text's own) for the texts of `possible`.

    The distance to the text found is verified: of characters or of words, by the kind of the id.
    """
    n = F.length("norm")
    # coarse deletions: m is the longer length of the pair; a text of m - 1 characters lacks one in the block
    at = near.select("id", "norm", n.alias("n")).select("id", "norm", "n", F.explode(_lengths(F.col("n"))).alias("m"))
    sized = at.withColumn("size", _scale(F.col("m")))
    block = sized.select("id", "norm", "n", "m", "size", F.explode(F.expr("sequence(0, (m - 1) div size)")).alias("q"))
    placed = block.select("id", "m", "n", "size", "q", _h(F.expr("left(norm, q * size)")).alias("before"), _h(F.expr("right(norm, greatest(m - (q + 1) * size, 0))")).alias("after"), F.expr("substring(norm, q * size + 1, least(size, m - q * size) - (m - n))").alias("inside"))
    keyed = placed.withColumn("coarse", _h(F.col("m"), F.col("q"), F.col("before"), F.col("after")))
    common = keyed.groupBy("coarse").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("coarse")
    blocks = materialise(keyed.join(common, "coarse", "left_semi").join(near.select("id", "place"), "id"), "line-blocks")

    # fine deletions: every character of the block for a text of m characters, the block as it is for one of m - 1
    full = blocks.where("n = m").select("id", "place", "coarse", "inside", F.explode(F.expr("sequence(1, length(inside))")).alias("i"))
    removed = full.select("id", "place", "i", _h(F.col("coarse"), F.expr("concat(left(inside, i - 1), substring(inside, i + 1))")).alias("variant"))
    short = blocks.where("n = m - 1").select("id", "place", F.lit(0).alias("i"), _h(F.col("coarse"), F.col("inside")).alias("variant"))
    variants = materialise(removed.unionByName(short), "line-variants")
    groups = variants.groupBy("variant", "i").agg(F.min("place").alias("first"))
    own = groups.groupBy("variant").agg(F.min(F.when(F.col("i") == 0, F.col("first"))).alias("short_first"), F.min(F.when(F.col("i") > 0, F.col("first"))).alias("full_first"))
    found = variants.join(groups, ["variant", "i"]).join(own, "variant").select("id", "place", F.when(F.col("i") > 0, F.least("first", F.coalesce("short_first", "first"))).otherwise(F.col("full_first")).alias("near"))
    first = found.where("near < place").groupBy("id").agg(F.min("near").alias("near"))
    # both texts of a pair are among those with a possible partner
    other = near.select(F.col("place").alias("near"), F.col("id.kind").alias("kind"), F.col("norm").alias("near_norm"), F.col("text").alias("near_text"))

    def verified(pairs: DataFrame) -> DataFrame:
        checked = pairs.join(near.select("id", F.col("id.kind").alias("kind"), "norm", "text"), "id").join(other, ["near", "kind"])
        good = F.when(F.col("kind") == 0, F.levenshtein("norm", "near_norm", 1) >= 0).otherwise(a_word_apart(words_of(F.col("text")), words_of(F.col("near_text"))))
        return materialise(checked.select("id", "near", good.alias("good")), "line-near")

    tried = verified(first)
    good = tried.where("good")
    missed = tried.groupBy("id").agg(F.max("good").alias("good")).where(~F.col("good")).select("id")
    if not missed.isEmpty():
        a, b = variants.join(missed, "id").alias("a"), variants.alias("b")
        meet = (F.col("a.variant") == F.col("b.variant")) & ((F.col("a.i") == F.col("b.i")) | (F.least("a.i", "b.i") == 0)) & (F.col("b.place") < F.col("a.place"))
        good = good.unionByName(verified(a.join(b, meet).select("a.id", F.col("b.place").alias("near")).distinct()).where("good"))
    return good.groupBy(F.struct("id.key", "id.check").alias("id")).agg(F.min("near").alias("near"))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, every: bool = False, least_words: int | None = None) -> DataFrame:
    """doc_id, line and the earlier (of_doc_id, of_line) for each line that goes. Texts move only for lines with a possible partner."""
    lines = lines_of(docs, least_chars, every)
    ident = F.struct("key", "check")
    # columns of their own: inlined, the words would be cut and the characters counted again for each of their uses
    rows = lines.select("key", "check", _place().alias("place"), "norm", F.length("norm").alias("n"), words_of(F.col("norm")).alias("words"))
    by_word = F.lit(None).cast("array<long>") if least_words is None else F.when(F.size("words") >= least_words, word_halves(F.col("words")))
    rows = rows.select("key", "check", "place", F.when(F.col("n") >= least_chars, half_keys(F.col("norm"), F.col("n"))).alias("halves"), by_word.alias("word_halves"))
    texts = materialise(rows.groupBy("key", "check").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("halves", "word_halves")]), "line-ids")
    near = earliest_near(possible(lines, texts))
    firsts = texts.select(ident.alias("id"), "place", "n").join(near, "id", "left").where("n > 1 OR near IS NOT NULL").select("id", F.coalesce("near", "place").alias("first"))
    places = lines.select("doc_id", "line", ident.alias("id"))
    gone = places.join(firsts, "id").where(~F.struct("doc_id", "line").eqNullSafe(F.col("first")))
    return gone.select("doc_id", "line", F.col("first.doc_id").alias("of_doc_id"), F.col("first.line").alias("of_line"))


def by_document(docs: DataFrame, least_chars: int = LEAST_CHARS, every: bool = False, least_words: int | None = None) -> DataFrame:
    """For every document its lines, those removed and the documents that keep them: doc_id, n_lines, n_removed, removed_lines, of_doc_ids."""
    gone = repeated_lines(docs, least_chars, every, least_words).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"), F.array_sort(F.collect_set("of_doc_id")).alias("of_doc_ids"))
    total = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n")).groupBy("doc_id").agg(F.max("n").cast("long").alias("n_lines"))
    joined = total.join(gone.withColumnRenamed("doc_id", "gone_id"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    empty = F.array().cast("array<int>"), F.array().cast("array<long>")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", empty[0]).alias("removed_lines"), F.coalesce("of_doc_ids", empty[1]).alias("of_doc_ids"))


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, every: bool = False, least_words: int | None = None) -> DataFrame:
    """docs with repeated lines cut from their texts, with the columns of docs (n_chars follows the text where there is one).

    A document that loses all its lines with a word is a copy, and goes.
    """
    taken = {c.lower() for c in docs.columns}
    gone_id, cut, left = (next(n for n in (base + "_" * i for i in range(99)) if n not in taken) for base in ("gone_id", "cut_lines", "left_text"))
    gone = materialise(repeated_lines(docs, least_chars, every, least_words).groupBy("doc_id").agg(F.collect_set("line").alias(cut)).withColumnRenamed("doc_id", gone_id), "cut-lines")
    # documents that surely lose nothing aren't shuffled
    some = in_filter(gone.select(_h(gone[gone_id]).alias("key")))(_h(docs["doc_id"].cast("long")))
    whole, docs = docs.where(~some), docs.where(some)
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[gone_id]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(F.col(cut), i)), "\n")
    changed = joined.withColumn(left, F.when(F.col(cut).isNull(), docs["text"]).otherwise(kept))
    kept_rows = changed.where(F.col(cut).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    out = {"text": F.col(left)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(cut).isNull(), docs["n_chars"]).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(kept_rows.select(*[out.get(c, docs[c]).alias(c) for c in docs.columns]))

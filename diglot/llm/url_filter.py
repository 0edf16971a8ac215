"""URL filters: a tree of path templates for each host, judged by its labelled purity.

Rules decide where they fit (the longest wins); what they decide labels the rest. Paths are cut into
segments, and numbers, hexadecimal and long segments become wildcards at once. Then the tree is
walked level by level, as deep as paths share a beginning. Below each node, segments that are rare among many,
and branches that are followed by what their siblings (without the branch itself) are followed by, become one
wildcard, unless their labelled share differs from the siblings' by a two-proportion test (|z| > 1.96 with five
labels or more). What follows is compared by total variation, at most 0.1 + 1 / sqrt(n) and at most a half; the
next segment counts as itself if it follows two of the siblings or more, else as some word. A template's share
of block labels is smoothed towards its host's, and the host's towards the share of all labels; a share above
`most_blocked` rejects.

All steps are DataFrame operations. Urls are counted by host and segments before the first shuffle, so
a host with a third of all pages is a few rows.

Defined cases: a null url, or one without `://`, has an empty host and path and is judged as a page
of the host ''; a very long url is as deep as it has segments, and is left alone below the last node that it
shares; rules of the same length that both fit go by their text, the later one wins; repeated rows are judged
one by one; other columns, whatever their names, aren't read; without labels nothing is rejected; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diglot.storage import materialise

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, with numbers, hexadecimal and long ones as wildcards."""

    def shape(x: Column) -> Column:
        return F.when(x.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), "{n}").when(x.rlike(r"^[0-9a-fA-F-]{8,}$"), "{x}").when(F.length(x) > 32, "{s}").otherwise(x)

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), shape)


def _branches(tree: DataFrame, d: int) -> DataFrame:
    """host, prefix, seg, kind (what follows), shapes, n, allowed, blocked: the branches at depth d of a tree of shapes."""
    sums = [F.sum(c).alias(c) for c in ("shapes", "n", "allowed", "blocked")]
    here = tree.where(F.get("segs", F.lit(d)).isNotNull())
    after = F.coalesce(F.get("segs", F.lit(d + 1)), F.lit("{end}"))
    each = here.select("host", "prefix", F.get("segs", F.lit(d)).alias("seg"), after.alias("next"), F.lit(1).alias("shapes"), "n", "allowed", "blocked").groupBy("host", "prefix", "seg", "next").agg(*sums)
    known = each.groupBy("host", "prefix", "next").agg((F.count(F.lit(1)) > 1).alias("common"))
    kind = F.when(F.col("next").startswith("{") | F.col("common"), F.col("next")).otherwise("{w}")
    return each.join(known, ["host", "prefix", "next"]).withColumn("kind", kind).groupBy("host", "prefix", "seg", "kind").agg(*sums)


def _tokens(each: DataFrame) -> DataFrame:
    """host, prefix, seg, token: a branch's own name, or * where it is merged."""
    c = F.col
    own = each.groupBy("host", "prefix", "seg").agg(*[F.sum(x).alias(f"own_{x}") for x in ("n", "allowed", "blocked")])
    pool = own.groupBy("host", "prefix").agg(*[F.sum(f"own_{x}").alias(f"all_{x}") for x in ("n", "allowed", "blocked")], F.count(F.lit(1)).alias("branches"))
    kinds = each.groupBy("host", "prefix", "kind").agg(F.sum("n").alias("kind_n"))
    both = each.select("host", "prefix", "seg", "kind", "n").join(kinds, ["host", "prefix", "kind"]).join(own, ["host", "prefix", "seg"]).join(pool, ["host", "prefix"])
    p, q = c("n") / c("own_n"), (c("kind_n") - c("n")) / F.nullif(c("all_n") - c("own_n"), F.lit(0))
    measures = ["own_n", "own_allowed", "own_blocked", "all_n", "all_allowed", "all_blocked", "branches"]
    # what follows the siblings and not the branch counts with its whole share
    held = both.groupBy("host", "prefix", "seg", *measures).agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("apart"))
    labels, every = c("own_allowed") + c("own_blocked"), c("all_allowed") + c("all_blocked")
    others = every - labels
    share = c("all_blocked") / F.greatest(every, F.lit(1))
    gap = F.abs(c("own_blocked") / F.greatest(labels, F.lit(1)) - (c("all_blocked") - c("own_blocked")) / F.greatest(others, F.lit(1)))
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest(labels, F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    differs = (labels >= 5) & (others >= 5) & (gap > 1.96 * spread) & (gap > 0)
    rare = (c("branches") >= 8) & (c("own_n") < 0.02 * c("all_n"))
    alike = F.coalesce(c("apart") <= F.least(F.lit(0.5), 0.1 + 1 / F.sqrt(c("own_n").cast("double"))), F.lit(False))
    token = F.when(c("seg").startswith("{"), c("seg")).when(~differs & (rare | alike), "*").otherwise(c("seg"))
    return held.select(c("host").alias("t_host"), c("prefix").alias("t_prefix"), c("seg").alias("t_seg"), token.alias("token"))


def walked(tree: DataFrame) -> DataFrame:
    """tree (host, segs, n, allowed, blocked) with the whole template of each shape (prefix).

    A level is written once. The walk ends when no node has two shapes below it; what is left of a path is as it is.
    """
    tree = tree.withColumn("prefix", F.lit(""))
    d = 0
    while True:
        each = materialise(_branches(tree, d), "url-branches")
        if each.groupBy("host", "prefix").agg(F.sum("shapes").alias("shapes")).where("shapes > 1").isEmpty():
            left = F.slice("segs", d + 1, F.greatest(F.size("segs") - d, F.lit(0)))
            return tree.withColumn("prefix", F.when(F.size(left) > 0, F.concat_ws("/", "prefix", left)).otherwise(F.col("prefix")))
        seg = F.get("segs", F.lit(d))
        chosen = _tokens(each)
        found = tree.join(chosen, (tree.host == F.col("t_host")) & (tree.prefix == F.col("t_prefix")) & (seg == F.col("t_seg")), "left")
        longer = F.when(F.col("token").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "token"))
        tree = materialise(found.select("host", "segs", "n", "allowed", "blocked", longer.alias("prefix")), "url-tree")
        d += 1


def templates(parsed: DataFrame, strength: float = 4.0) -> DataFrame:
    """host, segs, template and block_share (smoothed) for each host and shape of path. parsed: host, segs, label."""
    one = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    counted = parsed.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), one("allow").alias("allowed"), one("block").alias("blocked"))
    tree = walked(materialise(counted, "url-tree"))
    total = tree.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    labels = (total.a or 0) + (total.b or 0)
    overall = (total.b or 0) / labels if labels else 0.0
    by_host = tree.groupBy("host").agg(((F.sum("blocked") + strength * overall) / (F.sum("allowed") + F.sum("blocked") + strength)).alias("host_share"))
    by_template = tree.groupBy("host", "prefix").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).join(by_host, "host")
    share = by_template.select("host", "prefix", ((F.col("b") + strength * F.col("host_share")) / (F.col("a") + F.col("b") + strength)).alias("block_share"))
    return tree.join(share, ["host", "prefix"]).select("host", "segs", F.col("prefix").alias("template"), "block_share")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, most_blocked: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template and block_share for every page."""
    host, path = parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, label = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    labelled = parsed.select("page_id", "host", "path", rule.alias("rule"), label.alias("label"), segments(F.col("path")).alias("segs"))
    found = templates(labelled.select("host", "segs", "label"))
    joined = labelled.join(found.withColumnRenamed("host", "t_host").withColumnRenamed("segs", "t_segs"), (F.col("host") == F.col("t_host")) & (F.col("segs") == F.col("t_segs")), "left")
    own = F.when(F.col("block_share") > most_blocked, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "template", "block_share")

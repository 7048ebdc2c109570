"""URL filters: explicit host and path rules, and a tree of path templates per host that is rejected by labelled purity.

Segments that are plainly variable (numbers, hexadecimal ids) become typed wildcards at once. The tree is then walked level by level.
Under each node, branches that have support and whose share of bad pages differs significantly from that of their siblings together
stay apart from the others, which merge into one wildcard. Those apart are laid out by their share; neighbours that don't differ
significantly merge into one group, so several wildcards may stand beside each other. A path whose node holds no other typed path is
finished, as nothing is left to merge with; so the levels are those down to which paths branch. A template is rejected when its
smoothed share of bad labelled pages reaches a bar; without any label it is allowed.

All steps are aggregations over (host, typed path), so a host of any size is summed map-side first; no host meets in one task, and of
a node's branches no more than BINS rows come together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages below which a branch isn't kept apart from its siblings.
SUPPORT = 30
#: Standard errors by which a branch's share of bad pages must differ from its siblings' to stay apart.
APART = 3.0
#: Pseudo-counts at the overall share of bad pages, and the smoothed share from which a template is rejected.
PRIOR, BAR = 5.0, 0.5
#: Parts into which shares, on a scale on which their errors are alike, are laid out before neighbours merge.
BINS = 16

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def typed(segment: Column) -> Column:
    """A segment with its plainly variable part replaced by a typed wildcard; a file ending stays."""
    kept = F.regexp_replace(segment, r"^\d+(?=$|\.[a-z]{1,5}$)", "{n}")
    return F.regexp_replace(kept, r"^(?=[0-9a-f]*\d)[0-9a-f-]{8,}(?=$|\.[a-z]{1,5}$)", "{x}")


def segments(path: Column) -> Column:
    """Typed segments of a path."""
    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/", -1), typed)


def _share(bad: Column, labelled: Column, overall: float) -> Column:
    return (bad + PRIOR * overall) / (labelled + PRIOR)


def _differ(b1: Column, l1: Column, b2: Column, l2: Column, overall: float) -> Column:
    """Whether two shares of bad pages differ by more than APART standard errors."""
    pooled = (b1 + b2 + 2 * PRIOR * overall) / (l1 + l2 + 2 * PRIOR)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (l1 + PRIOR) + 1 / (l2 + PRIOR)))
    return F.abs(_share(b1, l1, overall) - _share(b2, l2, overall)) > APART * error


def _groups(bins: Column, overall: float) -> Column:
    """Of a node's bins (bin, n: branches, labelled, bad) in order, the number of the group of each: a bin that doesn't differ from the group before joins it."""
    kind = "array<struct<bin:int,number:int,n:bigint,labelled:bigint,bad:bigint>>"

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        apart = F.when(F.size(acc) == 0, True).otherwise(_differ(x["bad"], x["labelled"], last["bad"], last["labelled"], overall))
        number = F.when(F.size(acc) == 0, 1).otherwise(last["number"] + apart.cast("int"))
        before = lambda c: F.when(apart, F.lit(0).cast("bigint")).otherwise(last[c])
        return F.concat(acc, F.array(F.struct(x["bin"].alias("bin"), number.alias("number"), *[(x[c] + before(c)).alias(c) for c in ("n", "labelled", "bad")])).cast(kind))

    return F.aggregate(bins, F.array().cast(kind), join)


def templates(pages: DataFrame) -> DataFrame:
    """From rows (host, path, bad: 1, 0 or null if unlabelled): (host, typed, n, template, labelled, bad, rejected) for each typed path."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    rows = pages.select("host", segments(F.col("path")).alias("segs"), "bad")
    base = rows.groupBy("host", F.array_join("segs", "/").alias("typed")).agg(F.first("segs").alias("segs"), F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = scratch.save(base.withColumn("template", F.lit("")), "base")
    totals = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.count("*").alias("k")).first()
    n_labelled, n_bad, n_typed = totals["l"] or 0, totals["b"] or 0, totals["k"]
    share = (n_bad + 1) / (n_labelled + 2)
    done, level = [], 0
    while not tree.isEmpty():
        seg = F.get("segs", F.lit(level))
        here = tree.withColumn("seg", seg)
        child = here.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("cn"), F.sum("labelled").alias("cl"), F.sum("bad").alias("cb"), F.count("*").alias("k"))
        child = scratch.save(child, f"child{level}")
        node = child.groupBy("host", "template").agg(F.sum("cl").alias("nl"), F.sum("cb").alias("nb"), F.count("*").alias("fan"), F.sum("k").alias("paths"))
        both = look_up(child, node, ["host", "template"], "fan", n_typed, F.col("seg"), "inner")
        apart = (F.col("cn") >= SUPPORT) & (F.col("nl") > F.col("cl")) & _differ(F.col("cb"), F.col("cl"), F.col("nb") - F.col("cb"), F.col("nl") - F.col("cl"), share)
        angle = 2 * F.asin(F.sqrt(_share(F.col("cb"), F.col("cl"), share)))
        both = both.withColumn("bin", F.when(apart, F.least(F.floor(angle / math.pi * BINS), F.lit(BINS - 1)).cast("int")))
        both = scratch.save(both, f"both{level}")
        # Of the branches apart no more than BINS rows of a node come together.
        bins = both.where("bin is not null").groupBy("host", "template", "bin").agg(F.count("*").alias("n"), F.sum("cl").alias("labelled"), F.sum("cb").alias("bad"))
        bins = bins.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "labelled", "bad"))).alias("b"), F.sum("n").alias("w"))
        groups = bins.select("host", "template", "w", _groups(F.col("b"), share).alias("g"))
        grouped = look_up(both, groups, ["host", "template"], "w", n_typed, F.col("seg"))
        own = F.get(F.filter("g", lambda x: x["bin"] == F.col("bin")), F.lit(0))["number"]
        size = F.array_max(F.transform(F.filter("g", lambda x: x["number"] == own), lambda x: x["n"]))
        alone = F.col("cl") == F.col("nl")  # no labelled sibling speaks for or against it
        step = F.when((size == 1) | (alone & F.col("seg").contains("{")), F.col("seg")).when(own.isNotNull(), F.concat(F.lit("*"), own.cast("string"))).otherwise("*")
        decided = grouped.select("host", "template", "seg", "k", step.alias("step"), "paths")
        grown = look_up(here, decided, ["host", "template", "seg"], "k", n_typed, F.col("typed"))
        # Alone in its node: the rest of the path has nothing to merge with.
        rest = F.transform(F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(0))), lambda x: F.when(x.contains("{"), x).otherwise("*"))
        last = (F.col("paths") == 1) | (F.size("segs") <= level + 1)
        whole = F.when(F.col("paths") == 1, F.array_join(F.concat(F.array("template"), rest), "/")).otherwise(F.concat("template", F.lit("/"), "step"))
        grown = grown.withColumn("template", whole).withColumn("last", last).drop("seg", "step", "paths")
        new = scratch.save(grown, f"tree{level}")
        done.append(new.where("last").drop("last"))
        scratch.drop(child, both, free=False)
        tree, level = new.where("not last").drop("last"), level + 1
    every = tree
    for part in done:
        every = every.unionByName(part)
    every = scratch.save(every, "templates")
    leaf = every.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"), F.count("*").alias("k"))
    purity = _share(F.col("tb"), F.col("tl"), share)
    leaf = leaf.select("host", "template", "k", F.col("tl").alias("template_labelled"), purity.alias("purity"), ((F.col("tl") > 0) & (purity >= BAR)).alias("rejected"))
    return look_up(every, leaf, ["host", "template"], "k", n_typed, F.col("typed")).drop("segs")


def judge(pages: DataFrame, bad: Column, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    ``bad`` is 1 for bad pages, 0 for good ones and null where nothing is known. A rule decides where one fits; elsewhere the
    template does. Null urls have empty host and path. Null and repeated ids of any type stay, row by row; other columns are ignored; an empty table gives
    no rows. Urls and paths of any length are one row.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), bad.cast("int").alias("bad"))
    found = Scratch(pages.sparkSession, "url-templates")
    known = found.save(templates(own), "templates")
    keyed = own.withColumn("typed", F.array_join(segments(F.col("path")), "/"))
    n = own.count()
    out = look_up(keyed, known.select("host", "typed", "n", "template", "purity", "rejected"), ["host", "typed"], "n", n, F.coalesce(F.col("page_id"), F.lit(0)))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")


def bad_by_document(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``_bad`` (a column of this name is replaced) from the label of the document that a page was rendered from, whose id
    ends the page's path: 1 if it is of low quality or toxic, 0 if neither, null if unlabelled or if no number ends the path."""
    path = host_and_path(F.col(url).cast("string"))[1]
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("marked"))
    keyed = pages.select(F.struct("*").alias("row"), F.regexp_extract(path, r"(\d+)(?:\.[a-z]+)?/?$", 1).try_cast("bigint").alias("doc"))
    count = keyed.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n"))
    out = look_up(keyed, marked.join(count, "doc"), ["doc"], "n", pages.count(), F.to_json("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in pages.columns if c != "_bad"], F.col("marked").alias("_bad"))

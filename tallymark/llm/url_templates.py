"""URL filters: fixed rules first, then a tree of path templates for each host.

Paths are reduced to shapes (runs of digits become {n}) and counted with their labels, so that the tree grows over distinct
shapes and not over pages. Level by level a segment is a variable one and becomes the wildcard * unless it has LEAST_PAGES pages,
however small a part of the parent's, and its share of bad labels differs from the parent's by a two-sided test. The branches
that differ are merged where they are alike: shares of bad labels on a scale on which they vary alike everywhere (the arcsine's)
fall into classes, and all segments of a class grow on as one branch, *1 to *9, so that any two of them are pooled in one
aggregation however many siblings there are. A template is blocked if its share of bad labels, smoothed towards the host's and
that towards all, is high. Everything is in DataFrame functions.

A page's label comes from its own visible text: bad if the base rules of text quality fail (fewer than 50 words, or repeated
windows over half of them). Pages without html have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import group_join, table, written
from tallymark.llm.quality_mcd import base_failed, base_statistics

#: (verdict, host, path) of the fixed rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LEAST_PAGES = 5  # for a segment of its own
DIFFERENT = 1.96  # standard errors
WEIGHT = 20.0  # labels that a prior counts for
BAD_SHARE = 0.5
CLASSES = 9  # of alike branches
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;|&#\d+;"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://; both empty without one or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grown(shapes: DataFrame) -> DataFrame:
    """shapes(host, shape, n, labelled, bad) to (host, shape, template, n, labelled, bad).

    Depth has no limit: a level is grown while a node has LEAST_PAGES pages and two shapes; the segments beyond are wildcards.
    """
    counts = ["n", "labelled", "bad"]
    now = written(shapes.select("*", F.filter(F.split("shape", "/"), lambda s: s != "").alias("parts"), F.lit("").alias("template"), F.lit(True).alias("live")), "tree")
    k = 0
    while True:
        part = F.get("parts", F.lit(k))
        held = now.filter(F.col("live") & part.isNotNull())
        parent = held.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in counts], F.count("*").alias("shapes"))
        parent = written(parent.filter((F.col("all_n") >= LEAST_PAGES) & (F.col("shapes") > 1)), "parents")
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("parts") - k))
        if parent.isEmpty():
            return now.select("host", "shape", F.when(F.col("live"), rest).otherwise(F.col("template")).alias("template"), *counts)
        child = held.groupBy("host", "template", part.alias("part")).agg(*[F.sum(c).alias(c) for c in counts]).filter(F.col("n") >= LEAST_PAGES)
        child = group_join(child, parent, ["host", "template"], ["part"]).filter("shapes is not null")
        rate = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        error = F.sqrt(rate * (1 - rate) / F.greatest("labelled", F.lit(1)))
        differs = (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - rate) > DIFFERENT * error)
        own = (F.col("bad") + 0.5) / (F.col("labelled") + 1)
        alike = F.least(F.floor(F.asin(F.sqrt(own)) / F.lit(1.5707963267948966) * CLASSES) + 1, F.lit(CLASSES)).cast("string")
        kept = child.filter(differs).select("host", "template", "part", F.concat(F.lit("*"), alike).alias("branch"))
        # A class with one segment keeps the segment's name.
        single = kept.groupBy("host", "template", "branch").agg(F.count("*").alias("size"), F.min("part").alias("only"))
        named = single.select("host", "template", "branch", F.when(F.col("size") == 1, F.col("only")).otherwise(F.col("branch")).alias("name"))
        kept = written(kept.join(named, ["host", "template", "branch"]).select("host", "template", "part", "name"), "branches")
        at = now.withColumn("part", part)
        at = group_join(at, parent.select("host", "template", F.lit(True).alias("grows")), ["host", "template"], ["shape"])
        at = group_join(at, kept, ["host", "template", "part"], ["shape"])
        growing = F.col("live") & F.coalesce("grows", F.lit(False)) & F.col("part").isNotNull()
        template = F.when(growing, F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))).when(F.col("live") & F.col("part").isNotNull(), rest).otherwise(F.col("template"))
        now = written(at.select("host", "shape", *counts, "parts", template.alias("template"), growing.alias("live")), "tree")
        k += 1


def page_labels(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with bad: does the visible text fail the base rules of text quality; null without html."""
    clash = [c for c in pages.columns if c != "bad"]
    rows = pages.select(*[F.col(f"`{c}`") for c in clash], F.regexp_replace(F.col(html_col).cast("string"), MARKUP, " ").alias("__seen"))
    found = base_statistics(rows, clash[0], "__seen", tuple(clash[1:]))
    return found.select(*[F.col(f"`{c}`") for c in clash], F.when(F.col(html_col).isNotNull(), base_failed()).alias("bad"))


def with_labels(pages: DataFrame, labels: DataFrame, id_col: str = "page_id") -> DataFrame:
    """pages with bad from labels(id, bad); null ids or flags are not used, of repeated ids any bad one counts."""
    told = labels.select(F.col("id").alias(id_col), F.col("bad").cast("int").alias("bad")).filter(F.col(id_col).isNotNull() & F.col("bad").isNotNull()).groupBy(id_col).agg((F.max("bad") > 0).alias("bad"))
    return pages.drop("bad").join(told, id_col, "left")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """(id, host, path, rule, verdict, template, bad_share) of each row of pages(id, url, bad Boolean or null).

    Null urls and urls without :// have empty host and path, and are one template. Very long urls have long templates and no
    other limit. Repeated rows and null ids: each row for itself, and each counts. Of rules alike in length that fit, the later
    one. Where no label is there nothing but a rule blocks. Other columns are not carried. An empty table gives an empty one.
    """
    host, path = address(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(bad_col).cast("int").alias("bad")).select("id", host.alias("host"), path.alias("path"), "bad")
    rows = written(rows.select("*", F.regexp_replace("path", "[0-9]+", "{n}").alias("shape")), "addresses")
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = written(grown(shapes), "templates")
    every = tree.agg(((F.sum("bad") + 0.1) / (F.sum("labelled") + 1)).alias("rate")).first()["rate"]
    overall = F.lit(every if every is not None else 0.0)
    of_template = written(tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")), "shares")
    of_host = of_template.groupBy("host").agg(((F.sum("b") + WEIGHT * overall) / (F.sum("l") + WEIGHT)).alias("prior"))
    of_template = group_join(of_template, of_host, ["host"], ["template"])
    of_template = written(of_template.select("host", "template", ((F.col("b") + WEIGHT * F.col("prior")) / (F.col("l") + WEIGHT)).alias("bad_share")), "shares")
    of_shape = group_join(tree.select("host", "shape", "template"), of_template, ["host", "template"], ["shape"]).select("host", "shape", "template", "bad_share")
    found = rows.join(of_shape, ["host", "shape"], "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") >= BAD_SHARE, "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", F.round("bad_share", 6).alias("bad_share"))


def op1_url_templates(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judged(page_labels(pages))

"""URL filter by a path-template tree per host, in DataFrame functions only.

Paths are cut into segments. A segment of digits, hex digits or dates is variable from its
form; a segment is variable by statistics where its place in the tree (host and template so far) has many
different children none of which is common. Variable segments become wildcards, level by level, over
distinct (host, path) counts, so a host with a third of all pages is a table of its templates. Sibling branches
that agree on everything but one segment are merged if both have labels and those of the branch do not differ from
those of its siblings by more than chance. A template is rejected if its smoothed share of blocked labels is above a
threshold; one without labels is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import UPPER, LOWER, table
from panelweave.session import stage

MANY_CHILDREN, COMMON = 12, 0.05
PRIOR, THRESHOLD, CHANCE = 2.0, 0.5, 2.0
# fixed values: the asked rules as (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, NULL if none fits. The list is a parameter and goes into the plan."""
    fitting = F.array_compact(F.array(*[
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]))
    return F.get(F.array_sort(fitting), F.lit(0))


def _by_form(segment: Column) -> Column:
    """Segments that are variable from their form; an ending like .html stays."""
    s = F.regexp_replace(segment, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?=\.|$)", "{date}")
    s = F.regexp_replace(s, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=\.|$)", "{hex}")
    return F.regexp_replace(s, r"^[0-9]+(?=\.|$)", "{n}")


def _purity(blocked: Column, allowed: Column, prior: Column) -> Column:
    return (blocked + PRIOR * prior) / (blocked + allowed + PRIOR)


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, path, template: array): ``paths`` has host, path, n, distinct by (host, path).

    Level by level from the host on, whatever the depth. Below a place with fewer than ``MANY_CHILDREN`` forms no segment can be variable by
    statistics, so its rows keep the rest of their segments and leave; one very deep path takes no rounds of its own.
    """
    segments = F.transform(F.slice(F.split(F.col("path"), "/", -1), 2, 1 << 30), _by_form)
    rows = paths.select("host", "path", "n", segments.alias("seg"))
    # one row per (host, form) from here on
    forms = stage(rows.groupBy("host", "seg").agg(F.sum("n").alias("n")), "forms")
    open_ = forms.withColumn("template", F.array().cast("array<string>"))
    done, level = [open_.filter(F.size("seg") == 0)], 0
    open_ = open_.filter(F.size("seg") > 0)
    while not open_.isEmpty():
        here = F.get(F.col("seg"), F.lit(level))
        children = open_.groupBy(F.col("host").alias("ph"), F.col("template").alias("parent"), here.alias("child")).agg(F.sum("n").alias("pn"), F.count(F.lit(1)).alias("forms"))
        marks = children.groupBy("ph", "parent").agg(F.sum("pn").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum("forms").alias("forms"))
        known = children.drop("forms").join(marks, ["ph", "parent"]).select(
            "ph", "parent", "child", (F.col("forms") < MANY_CHILDREN).alias("few"),
            ((F.col("kinds") >= MANY_CHILDREN) & (F.col("pn") <= COMMON * F.col("all"))).alias("variable"))
        joined = open_.join(known, (F.col("host") == F.col("ph")) & (F.col("template") == F.col("parent")) & (here == F.col("child")))
        one = F.concat("template", F.array(F.when(F.col("variable"), F.lit("*")).otherwise(here)))
        rest = F.concat("template", F.slice("seg", level + 1, 1 << 30))
        over = F.col("few") | (F.size("seg") <= level + 1)
        moved = stage(joined.select("host", "seg", "n", F.when(F.col("few"), rest).otherwise(one).alias("template"), over.alias("over")), "level")
        done.append(moved.filter("over").drop("over"))
        open_, level = moved.filter("NOT over").drop("over"), level + 1
    named = reduce(lambda a, b: a.unionByName(b), done).select(F.col("host").alias("th"), F.col("seg").alias("ts"), "template")
    return rows.join(named, (F.col("host") == F.col("th")) & (F.col("seg") == F.col("ts"))).select("host", "path", "n", "template")


def template_verdicts(tree: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, template, branch, purity): ``labelled`` has host, path, blocked, allowed counts.

    branch is the template with the merged segment as ``+``, or the template itself. A template with labels is merged with siblings if they have
    labels too and the test finds no difference. Purity comes from the template's own labels, smoothed by the merged branch's, and those by one
    half; hosts and the table as a whole are no evidence. A template without labels has purity 0.5, which is not above ``THRESHOLD``.
    """
    cells = tree.join(labelled, ["host", "path"], "left").groupBy("host", "template").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("allowed")
    )
    cells = stage(cells, "cells")
    seen, all_ = F.col("blocked") + F.col("allowed"), F.col("bb") + F.col("ba")
    places = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("template") - 1)), lambda i: F.struct(
        i.alias("i"), F.transform("template", lambda s, j: F.when(j == i, F.lit("+")).otherwise(s)).alias("branch"))))
    siblings = cells.filter((F.size("template") > 0) & (seen > 0)).select("host", "template", "blocked", "allowed", places.alias("b")).select("host", "template", "blocked", "allowed", "b.*")
    branches = siblings.groupBy("host", "branch").agg(F.sum("blocked").alias("bb"), F.sum("allowed").alias("ba"))
    share = F.try_divide(F.col("bb"), all_)
    spread = F.sqrt(F.try_divide((F.col("bb") + 1) * (F.col("ba") + 1), (all_ + 2) * (all_ + 2) * seen))
    similar = F.abs(F.col("blocked") / seen - share) <= CHANCE * spread
    merged = siblings.join(branches, ["host", "branch"]).filter((all_ > seen) & similar).groupBy("host", "template").agg(
        F.min(F.struct((-all_).alias("o"), "i", "branch", "bb", "ba")).alias("m")
    )
    whole = cells.join(merged, ["host", "template"], "left")
    p_branch = F.when(F.col("m").isNull(), F.lit(0.5)).otherwise(_purity(F.col("m.bb"), F.col("m.ba"), F.lit(0.5)))
    return whole.select("host", "template", F.coalesce("m.branch", "template").alias("branch"), _purity(F.col("blocked"), F.col("allowed"), p_branch).alias("purity"))


def judge_urls(pages: DataFrame, page_id: str, url: str, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per input row.

    The rules' verdicts label the urls they fit; all others get the verdict of their template, which is
    to allow if no url of it is labelled. NULL urls and urls without ``://`` have
    empty host and path and share one template. Equal urls share everything. An empty table gives no rows.
    """
    u = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), host_of(u).alias("host"), path_of(u).alias("path"))
    paths = stage(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("r", ruling(F.col("host"), F.col("path"), rules)), "paths")
    labelled = paths.filter("r IS NOT NULL").select(
        "host", "path", F.when(F.col("r.verdict") == "block", F.col("n")).otherwise(0).alias("blocked"), F.when(F.col("r.verdict") == "allow", F.col("n")).otherwise(0).alias("allowed"))
    tree = stage(template_tree(paths), "tree")
    judged = tree.join(template_verdicts(tree, labelled), ["host", "template"]).select("host", "path", "template", "branch", "purity")
    own = paths.join(judged, ["host", "path"]).select(
        F.col("host").alias("h"), F.col("path").alias("p"), F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("purity") > THRESHOLD, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
    return rows.join(own, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))).select(F.col("id").alias(page_id), "host", "path", "rule", "verdict", "template", "purity")


def op6_url_templates(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url").select("page_id", "host", "path", "rule", "verdict", "template")

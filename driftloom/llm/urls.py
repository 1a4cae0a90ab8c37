"""URL filters: host and path rules, and a tree of path templates judged by labelled purity, in DataFrame functions alone."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import beside, stored

#: The contract's rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Settings:
    """A node's children are variable if there are at least ``least`` of them and ``variety`` as many as the pages that pass
    through it; ``z`` is the bound for branches to count as similar; ``weight`` is that of a prior in a purity, and ``bar``
    the purity of blocked pages at which a template is rejected."""

    least: int = 8
    variety: float = 0.3
    z: float = 1.96
    weight: float = 4.0
    bar: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one. Rules are a short list in the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, settings: Settings | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and template and purity (share of blocked pages, smoothed) of the page's path.

    Pages that a rule fits are the labelled ones. Per host, paths are a tree of segments, built from the top, down to the
    deepest path: a node's children become one wildcard ``*`` where they are many for the pages that pass through it, and
    labelled children whose blocked share doesn't differ significantly from that of their siblings are merged to one, ``+``.
    A template's purity is its blocked share, smoothed to that of the same template on all hosts, and that to the share of
    all labelled pages; from ``bar`` on, pages without a rule are blocked. Pages are counted by host and path first, so
    that no host's pages meet in one task. Null url, or one without ``://``: host and path empty. Repeated rows and ids
    each give a row; other columns are ignored; no rows give none.
    """
    settings = settings or Settings()
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = stored(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said")), "pages")
    shapes = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("bad"), F.count("said").alias("known"))
    shapes = stored(shapes.withColumn("segments", _segments(F.col("path"))).withColumn("template", F.lit("")), "shapes")
    most = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    done = []
    for level in range(most):
        done.append(shapes.where(F.size("segments") <= level))
        inside = shapes.where(F.size("segments") > level).withColumn("s", F.col("segments")[level])
        child = stored(inside.groupBy("host", "template", "s").agg(F.count("*").alias("shapes"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("known").alias("known")), "children")
        node = stored(child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known")), "nodes")
        both = beside(child, node.withColumn("size", F.col("kids")), ["host", "template"], "size")
        variable = (F.col("kids") >= settings.least) & (F.col("kids") >= settings.variety * F.col("all_n"))
        # two-proportion test of a child against its siblings
        others_known, others_bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.col("all_known")
        error = F.sqrt(share * (1 - share) * (1 / F.col("known") + 1 / others_known))
        near = (F.col("known") > 0) & (others_known > 0) & (F.abs(F.col("bad") / F.col("known") - others_bad / others_known) <= settings.z * error)
        step = F.when(variable, "*").when(F.coalesce(near, F.lit(False)), "+").otherwise(F.col("s"))
        names = stored(both.select("host", "template", "s", "shapes", step.alias("step")), "steps")
        inside = beside(inside, names, ["host", "template", "s"], "shapes")
        shapes = stored(inside.withColumn("template", F.concat_ws("/", "template", "step")).select(*shapes.columns), "shapes")
    for part in done:
        shapes = shapes.unionByName(part)
    shapes = stored(shapes.drop("segments"), "shapes")
    total = shapes.agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).first()
    prior = ((total["bad"] or 0) + 1.0) / ((total["known"] or 0) + 2.0)
    k = settings.weight
    own = stored(shapes.groupBy("host", "template").agg(F.count("*").alias("size"), F.sum("bad").alias("bad"), F.sum("known").alias("known")), "own")
    every = stored(own.groupBy("template").agg(F.count("*").alias("hosts"), ((F.sum("bad") + k * prior) / (F.sum("known") + k)).alias("wide")), "wide")
    purity = beside(own, every, ["template"], "hosts")
    purity = stored(purity.select("host", "template", "size", ((F.col("bad") + k * F.col("wide")) / (F.col("known") + k)).alias("purity")), "purity")
    found = stored(beside(shapes.select("host", "path", "n", "template"), purity, ["host", "template"], "size"), "templates")
    judged = beside(rows, found, ["host", "path"], "n")
    verdict = F.coalesce("said", F.when(F.col("purity") >= settings.bar, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")

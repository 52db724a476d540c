"""URL filter: list rules first, then a path-template tree learned per host.

Each URL is a path in its host's tree, one segment a level. Segments with digits
are generalised to typed wildcards while they are read; on every level the segments
that are rare under a node with many children, or that have no labels of their own,
become one wildcard, and of the other branches, ordered by their labelled share of
blocks, each is merged with the one before it unless their shares differ by more than
``Z`` standard errors. A template (a leaf) is rejected if the smoothed purity of its labels,
``(blocked + ALPHA * prior) / (labelled + ALPHA)``, exceeds ``REJECT``. The labels
are the verdicts of the rules where one fits. Levels are built over all hosts at
once from counts per template, so a host of any size is never one task's group.
A node with one shape, or without labels, branches no further: what is left of its
templates follows from the shapes themselves, and they leave the loop. So there are as
many passes as levels on which labelled shapes still part, not as segments in a path.

Defined results: a null URL or one without ``://`` has empty host and path and no
rule; repeated rows are judged alike; templates without labels get the prior, so
they are allowed unless most labels are blocks; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialise, table

#: Fixed values of the contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MANY, RARE = 32, 0.02
ALPHA, REJECT, Z = 4.0, 0.5, 2.0
PARTS = 16  # levels held apart before they are written together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict (null without)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def shape(path: str = "path") -> Column:
    """The segments of a path, runs of digits and hexadecimal ids made wildcards."""
    hexed = F.regexp_replace(F.col(path), r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{x}")
    return F.split(F.regexp_replace(hexed, r"[0-9]+", "{n}"), "/", -1)


def _settled(rows: DataFrame, level: int) -> DataFrame:
    """Rows with the ``shapes`` and ``labelled`` of their node on a ``level``; ``open`` where the
    node can still branch. Elsewhere the prefix is completed: a labelled shape alone in
    its node keeps its segments, shapes without labels get wildcards."""
    left = F.greatest(F.size("shape") - level, F.lit(0))
    own = F.slice("shape", level + 1, left)
    rest = F.when(F.col("labelled") > 0, own).otherwise(F.array_repeat(F.lit("*"), left))
    is_open = (F.col("shapes") > 1) & (F.col("labelled") > 0) & (left > 0)
    whole = F.array_join(F.concat(F.array("prefix"), rest), "/")
    return rows.withColumn("open", is_open).withColumn("prefix", F.when(is_open, F.col("prefix")).otherwise(whole)).drop("shapes", "labelled")


def template_tree(urls: DataFrame) -> DataFrame:
    """host, shape, template, purity from rows (host, shape, verdict): one per host and shape."""
    blocked, allowed = (F.sum((F.col("verdict") == v).cast("long")) for v in ("block", "allow"))
    paths = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.coalesce(blocked, F.lit(0)).alias("blocked"), F.coalesce(allowed, F.lit(0)).alias("allowed"))
    paths = materialise(paths.withColumn("prefix", F.lit("")), "url-shapes")
    total = paths.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).first()
    prior = ((total["b"] or 0) + 1) / ((total["b"] or 0) + (total["a"] or 0) + 2)
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    labelled = F.col("blocked") + F.col("allowed")
    hosts = paths.groupBy("host").agg(F.count(F.lit(1)).alias("shapes"), F.sum(labelled).alias("labelled"))
    levels = [materialise(_settled(paths.join(hosts, "host"), 0), "url-level")]
    discard(paths)
    done, level = [], 0
    while True:
        done.append(levels[-1].where("NOT open"))
        if len(done) == PARTS:  # the plan of the union stays short, however deep the tree
            joined = materialise(_union(done), "url-done")
            discard(*levels[:-1])
            levels, done = [joined, levels[-1]], [joined]
        paths = levels[-1].where("open")
        if paths.isEmpty():
            break
        seg = F.get("shape", F.lit(level))
        child = paths.where(seg.isNotNull()).groupBy("host", "prefix", seg.alias("seg")).agg(F.count(F.lit(1)).alias("shapes"), *sums)
        node = child.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("node_n"))
        both = child.join(node, ["host", "prefix"])
        rare = (F.col("children") > MANY) & (F.col("n") < RARE * F.col("node_n"))
        share = F.col("blocked") / F.greatest(labelled, F.lit(1))
        error = (share * (1 - share) + 0.25 / (labelled + 1)) / F.greatest(labelled, F.lit(1))
        both = both.select("host", "prefix", "seg", "shapes", labelled.alias("labelled"), (rare | (labelled == 0)).alias("wild"), share.alias("share"), error.alias("error"))
        # a node keeps at most max(MANY, 1 / RARE) branches, so these windows are small
        by_share = Window.partitionBy("host", "prefix").orderBy("share", "seg")
        apart = F.col("share") - F.lag("share").over(by_share) > Z * F.sqrt(F.col("error") + F.lag("error").over(by_share))
        kept = both.where(~F.col("wild")).withColumn("first", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("branch", F.sum("first").over(by_share))
        size = F.count(F.lit(1)).over(Window.partitionBy("host", "prefix", "branch"))
        name = F.when(size > 1, F.concat(F.lit("~"), F.col("branch").cast("string"))).otherwise(F.col("seg"))
        columns = ["host", "prefix", "seg", "shapes", "labelled"]
        named = kept.select(*columns, name.alias("name")).unionByName(both.where("wild").select(*columns, F.lit("*").alias("name")))
        below = named.groupBy("host", "prefix", "name").agg(F.sum("shapes").alias("shapes"), F.sum("labelled").alias("labelled"))
        named = named.drop("shapes", "labelled").join(below, ["host", "prefix", "name"])
        after = paths.withColumn("seg", seg).join(named, ["host", "prefix", "seg"])
        after = after.withColumn("prefix", F.concat_ws("/", "prefix", "name")).drop("seg", "name", "open")
        level += 1
        levels.append(materialise(_settled(after, level).select("host", "shape", "n", "blocked", "allowed", "prefix", "open"), "url-level"))
    paths = materialise(_union(done), "url-paths")
    discard(*levels)
    leaf = paths.groupBy("host", "prefix").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    leaf = leaf.withColumn("purity", (F.col("b") + ALPHA * prior) / (F.col("b") + F.col("a") + ALPHA))
    return paths.join(leaf, ["host", "prefix"]).select("host", "shape", F.concat("host", "prefix").alias("template"), "purity")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, id_: str = "page_id", url: str = "url") -> DataFrame:
    """host, path, rule, verdict, template and purity of every URL."""
    host, path = parsed(url)
    rows = pages.select(F.col(id_), host.alias("host"), path.alias("path"))
    rule, verdict = ruled()
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "shape": shape()})
    tree = template_tree(rows.select("host", "shape", "verdict"))
    tree = tree.select(F.col("host").alias("__h"), F.col("shape").alias("__s"), "template", "purity")
    found = rows.join(tree, (F.col("host") == F.col("__h")) & (F.col("shape") == F.col("__s")), "left")
    own = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return found.select(id_, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

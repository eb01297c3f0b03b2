"""URL filters: host and path rules, and behind them a path-template tree learned from labelled pages.

Per host, paths form a tree of segments, the last of which is END. All steps work on the different paths of a host with their counts of
pages, labelled pages and bad ones, one level of the tree at a time.

* Variable segments become wildcards: numbers, hexadecimal names and dates by their form. Of a node with more than `most_children`
  different children, those become one wildcard that have less than `share` of its pages each, unless their labelled pages
  differ significantly from those of all such children together (a normal test with continuity correction, from five labels on).
* Branches that are statistically similar are merged: the labelled siblings of a node stand in order of their share of bad pages,
  and neighbours that two proportions' test does not tell apart are one class with joint counts. Inner branches likewise.
* Purity is smoothed along a chain, each link counting as two labels for the next: the parent's purity (a half above
  the host's root), the same template on all hosts, the same on the host's site (the last two parts of its name), and the class. So a
  template without labels takes those of other hosts, or else its parent's. It is rejected if its purity is at least `purity`.

Nothing depends on absolute sizes but the number of children below which all stay as they are. A host with a third of all pages costs no
more than others: its pages are counted before any shuffle, and joins split what is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import durable

#: The last segment of each path.
END = "$"
#: Labels that each link of the smoothing chain counts as.
PRIOR = 2.0
#: Labels from which a rare child may stand for itself.
LEAST = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path) as the query fixes them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as (verdict, rule), null without one. Rules of equal length: the first in order."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((F.col(host) == own) | F.endswith(F.col(host), F.lit("." + own))) & F.startswith(F.col(path), F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def segments(path: str, depth: int) -> Column:
    """The segments of a path, variable ones by form as wildcards, and END; what lies deeper than `depth` is one segment."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]{1,5})?$"), F.regexp_replace(s, r"^[0-9]+", "{n}")).when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{h}")).when(s.rlike(r"^[0-9]{1,4}([-_.][0-9]{1,4})+$"), F.lit("{d}")).otherwise(s)
    shown = F.transform(F.slice(parts, 1, depth), kind)
    shown = F.when(F.size(parts) > depth, F.concat(shown, F.array(F.lit("{more}")))).otherwise(shown)
    return F.concat(shown, F.array(F.lit(END)))


def templates(paths: DataFrame, share: float = 0.02, most_children: int = 24, z: float = 1.96) -> DataFrame:
    """paths (host, segs, pages, n, bad), each host and segs once, with `parts`: segs with variable ones as wildcards."""
    out = durable(paths.withColumn("parts", F.array().cast("array<string>")))
    levels = out.agg(F.max(F.size("segs"))).first()[0] or 0
    node = ["host", "parts"]
    for level in range(levels):
        here = F.get("segs", F.lit(level))
        kids = out.where(here.isNotNull()).groupBy(*node, here.alias("kid")).agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        whole = kids.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("pages").alias("of"))
        kids = kids.join(whole.where(F.col("kids") > most_children), node).withColumn("rare", (F.col("pages") < share * F.col("of")) & ~F.startswith("kid", F.lit("{")) & (F.col("kid") != END))
        pool = kids.where("rare").groupBy(*node).agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("joint"))
        kids = kids.where("rare").join(pool, node)
        apart = F.abs(F.col("bad") - F.col("n") * F.col("joint")) > z * F.sqrt(F.col("n") * F.col("joint") * (1 - F.col("joint"))) + 0.5
        gone = kids.where(~((F.col("n") >= LEAST) & apart)).select(*node, "kid", F.lit(True).alias("gone"))
        out = out.withColumn("kid", here).join(gone, [*node, "kid"], "left")
        shown = F.when(F.col("gone"), F.lit("*")).otherwise(F.col("kid"))
        out = out.withColumn("parts", F.when(F.col("kid").isNotNull(), F.concat("parts", F.array(shown))).otherwise(F.col("parts"))).drop("kid", "gone")
        out = durable(out)
    return out


def classes(nodes: DataFrame, z: float = 1.96) -> DataFrame:
    """nodes (host, parent, node, n, bad) with class_n, class_bad: the counts of the similar siblings together."""
    family = Window.partitionBy("host", "parent").orderBy("share", "node")
    out = nodes.where("n > 0").withColumn("share", F.col("bad") / F.col("n"))
    out = out.withColumn("n0", F.lag("n").over(family)).withColumn("bad0", F.lag("bad").over(family))
    joint = (F.col("bad") + F.col("bad0")) / (F.col("n") + F.col("n0"))
    far = F.col("share") - F.col("bad0") / F.col("n0") > z * F.sqrt(joint * (1 - joint) * (1 / F.col("n") + 1 / F.col("n0"))) + 1e-12
    out = out.withColumn("class", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(family))
    merged = Window.partitionBy("host", "parent", "class")
    out = out.select("host", "parent", "node", "n", "bad", F.sum("n").over(merged).alias("class_n"), F.sum("bad").over(merged).alias("class_bad"))
    return out.unionByName(nodes.where("n = 0").select("host", "parent", "node", "n", "bad", F.lit(0).cast("long").alias("class_n"), F.lit(0).cast("long").alias("class_bad")))


def _toward(prior: Column | str, bad: Column | str, n: Column | str) -> Column:
    prior, bad, n = (F.col(x) if isinstance(x, str) else x for x in (prior, bad, n))
    return (F.coalesce(bad, F.lit(0)) + PRIOR * prior) / (F.coalesce(n, F.lit(0)) + PRIOR)


def template_verdicts(leaves: DataFrame, purity: float = 0.8, z: float = 1.96) -> DataFrame:
    """(host, node, class_n, class_bad, score, reject) of each template, from leaves (host, parts, n, bad)."""
    leaves = durable(leaves.groupBy("host", "parts").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    levels = leaves.agg(F.max(F.size("parts"))).first()[0] or 0
    name = lambda k: F.concat_ws("/", F.slice("parts", 1, k)) if k else F.lit("")
    above = leaves.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select("host", F.lit("").alias("parent"), _toward(F.lit(0.5), "bad", "n").alias("prior"))
    out = None
    site = F.substring_index("host", ".", -2)
    for level in range(1, levels + 1):
        nodes = leaves.where(F.size("parts") >= level).groupBy("host", name(level - 1).alias("parent"), name(level).alias("node")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        nodes = durable(classes(nodes, z)).withColumn("site", site)
        labelled = nodes.where("n > 0")
        every = labelled.groupBy("node").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
        near = labelled.groupBy("site", "node").agg(F.sum("n").alias("site_n"), F.sum("bad").alias("site_bad"))
        scored = nodes.join(above, ["host", "parent"]).join(every, "node", "left").join(near, ["site", "node"], "left")
        on_all = _toward("prior", "all_bad", "all_n")
        score = _toward(_toward(on_all, "site_bad", "site_n"), "class_bad", "class_n")
        scored = durable(scored.select("host", "node", "class_n", "class_bad", score.alias("score")))
        above = scored.select("host", F.col("node").alias("parent"), F.col("score").alias("prior"))
        ends = scored.where((F.col("node") == END) | F.endswith("node", F.lit("/" + END)))
        out = ends if out is None else out.unionByName(ends)
    if out is None:
        out = leaves.select("host", F.lit("").alias("node"), "n", "bad", F.lit(0.5).alias("score")).toDF("host", "node", "class_n", "class_bad", "score")
    return out.withColumn("reject", F.col("score") >= purity)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", depth: int = 16, share: float = 0.02, most_children: int = 24, purity: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template.

    labels (page_id, bad 0/1) are the labelled pages; without them, the pages that a rule judges serve as labelled. A rule's
    verdict stands; other pages get their template's. Null urls and those without :// have empty host and path, and
    their template is judged like others. Repeated rows and null ids each get a row; of several labels of an id the highest counts,
    null labels and labels of null ids do not. Without any label nothing is rejected. An empty table gives an empty
    result; other columns are ignored, whatever their names. Segments beyond `depth` are one.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    base = base.withColumn("r", rule_of("host", "path", rules)).withColumn("segs", segments("path", depth))
    if labels is None:
        labelled = base.withColumn("label", (F.col("r.verdict") == "block").cast("int"))
    else:
        known = labels.select(F.col(id_col).cast("long").alias("page_id"), F.col("bad").cast("int").alias("label")).groupBy("page_id").agg(F.max("label").alias("label"))
        labelled = base.join(known, "page_id", "left")
    paths = labelled.groupBy("host", "segs").agg(F.count("*").alias("pages"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    tree = templates(paths, share, most_children)
    verdicts = template_verdicts(tree, purity).select("host", "node", "reject")
    found = durable(tree.withColumn("node", F.concat_ws("/", "parts")).join(verdicts, ["host", "node"]).select("host", "segs", "node", "reject"))
    out = base.join(F.broadcast(found) if found.count() <= broadcast_rows else found, ["host", "segs"])
    method = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    shown = F.regexp_replace(F.concat(F.lit("/"), "node"), r"/?\$$", "")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"), shown.alias("template"))

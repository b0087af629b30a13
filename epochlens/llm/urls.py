"""URL filters: rules by host and path, and per host a tree of path templates judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from epochlens.llm.common import cut

#: A child has evidence of its own with as many pages as the root of its node's, or as many labels as the root of the
#: node's, and FEW at least; or, however few its pages are beside theirs, with FEW labels whose share is APART_Z standard
#: errors from that of its siblings. Where FEW children or more have none, the node is variable there: they are a wildcard.
#: A node of fewer than FEW pages is not divided.
FEW, APART_Z = 5, 3.0
#: A branch whose label share or leaf share is so many standard errors from that of the others stands apart.
ALIKE_Z = 1.64
#: Weight of the host's share in a template's, and of the overall share in the host's.
PRIOR_WEIGHT = 5.0
#: Names of so many merged branches are spelled out; of more, the first, their number and a digest.
SPELLED = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) rule that fits host or a domain above it and begins the path, as a struct."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chain = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def typed_path(path: Column) -> Column:
    """The path with segments that are plainly variable written by their type: ids, numbers, digests."""
    p = F.regexp_replace(path, r"(?i)(?<=/)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?=[/.]|$)", "<uuid>")
    p = F.regexp_replace(p, r"(?<=/)[0-9]+(?=[/.]|$)", "<n>")
    p = F.regexp_replace(p, r"(?i)(?<=/)[0-9a-f]{16,}(?=[/.]|$)", "<hex>")
    return F.regexp_replace(p, r"[0-9]+", "#")


def z_score(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Standard errors between two shares a/n and b/m, each with half a case of either kind added; positive if the first is larger."""
    p, q = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
    return (p - q) / F.sqrt(p * (1 - p) / (n + 1) + q * (1 - q) / (m + 1))


def side(a: str, n: str, of: WindowSpec) -> Column:
    """1, -1 or 0: the share a/n of a row is significantly above, below or like that of the other rows of its window."""
    z = z_score(F.col(a), F.col(n), F.sum(a).over(of) - F.col(a), F.sum(n).over(of) - F.col(n))
    return F.when(z >= ALIKE_Z, 1).when(z <= -ALIKE_Z, -1).otherwise(0)


def branch_names(children: DataFrame) -> DataFrame:
    """(host, template, seg, name) for the children (host, template, seg, n, bad, labelled, ends) of nodes.

    Children without evidence of their own are a wildcard where they are FEW or more; the others of such a node keep
    their names. In other nodes children merge with those that stand on the same side: each is tested against all
    its siblings together, by label share and by how often a path ends there, and then against all on its side; it
    stands alone where it differs from these too.
    """
    node = ["host", "template"]
    of = W.partitionBy(*node)
    apart = F.abs(z_score(F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled"))) >= APART_Z
    own = (F.col("n") >= F.greatest(F.sqrt("all"), F.lit(FEW))) | (F.col("labelled") >= F.greatest(F.sqrt("all_labelled"), F.lit(FEW))) | (F.col("labelled") >= FEW) & apart
    total = children.groupBy(*node).agg(F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    c = cut(children.join(total, node).withColumn("own", own), "url-children")
    sparse = c.groupBy(*node).agg(F.count_if(~F.col("own")).alias("sparse"))
    c = c.join(sparse, node)
    wild = c.where(F.col("sparse") >= FEW).select(*node, "seg", F.when(F.col("own"), F.col("seg")).otherwise("*").alias("name"))
    few = c.where(F.col("sparse") < FEW).withColumn("s1", side("bad", "labelled", of)).withColumn("s2", side("ends", "n", of))
    same = W.partitionBy(*node, "s1", "s2")
    alone = (side("bad", "labelled", same) != 0) | (side("ends", "n", same) != 0)
    few = few.withColumn("alone", F.when((F.count("*").over(same) > 1) & alone, F.col("seg")).otherwise(""))
    parts = few.groupBy(*node, "s1", "s2", "alone").agg(F.array_sort(F.collect_set("seg")).alias("segs"))
    spelled = F.array_join("segs", "|")
    short = F.concat(F.col("segs")[0], F.lit("|+"), F.size("segs") - 1, F.lit(":"), F.substring(F.md5(spelled), 1, 8))
    parts = parts.select(*node, F.when(F.size("segs") <= SPELLED, spelled).otherwise(short).alias("name"), F.explode("segs").alias("seg"))
    return wild.union(parts.select(*node, "seg", "name"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, typed, template) for distinct (host, typed) with counts n, bad and labelled.

    Below each prefix, what all its paths begin with is taken at once; then the next segments become branches, see
    branch_names(). A prefix with one path is done, and one of fewer than FEW pages ends in "**". So there are as
    many rounds as paths divide below each other, however long they are. Rounds are written, so a lost
    executor repeats one at most.
    """
    node = ["host", "template"]
    rows = paths.withColumn("rest", F.split(F.regexp_replace("typed", "^/", ""), "/")).withColumn("template", F.lit("")).withColumn("done", F.lit(False))
    rows = cut(rows, "url-paths")
    while rows.where("not done").limit(1).count():
        live = rows.where("not done")
        nodes = live.groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("n").alias("pages"))
        # in order, the first and the last path share what all share
        apart = F.array_position(F.transform(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), lambda x: x.cast("int")), 0)
        shared = F.when(apart == 0, F.size("lo")).otherwise(apart - 1).cast("int")
        nodes = nodes.select(*node, "pages", (F.col("lo") != F.col("hi")).alias("divides"), shared.alias("shared"))
        live = live.join(nodes, node).withColumn("prefix", F.concat("template", F.concat_ws("", F.transform(F.slice("rest", F.lit(1), F.col("shared")), lambda x: F.concat(F.lit("/"), x)))))
        live = live.withColumn("tail", F.slice("rest", F.col("shared") + 1, F.lit(1_000_000)))
        ended = F.size("tail") == 0
        few = F.col("divides") & (F.col("pages") < FEW) & ~ended
        live = live.select("host", "typed", "n", "bad", "labelled", F.col("tail").alias("rest"), F.when(few, F.concat("prefix", F.lit("/**"))).otherwise(F.col("prefix")).alias("template"), (ended | few).alias("done"))
        live = cut(live, "url-nodes")
        going = live.where("not done").withColumn("seg", F.col("rest")[0])
        ends = F.when(F.size("rest") == 1, F.col("n")).otherwise(0)
        children = going.groupBy(*node, "seg").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.sum(ends).alias("ends"))
        names = branch_names(children)
        tail = F.slice("rest", F.lit(2), F.lit(1_000_000))
        going = going.join(names, [*node, "seg"]).select("host", "typed", "n", "bad", "labelled", tail.alias("rest"), F.concat("template", F.lit("/"), "name").alias("template"), (F.size("rest") == 1).alias("done"))
        columns = ["host", "typed", "n", "bad", "labelled", "rest", "template", "done"]
        rows = cut(rows.where("done").select(*columns).union(live.where("done").select(*columns)).union(going.select(*columns)), "url-paths")
    return rows.select("host", "typed", "template", "n", "bad", "labelled")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], reject_z: float = 3.0, reject_lift: float = 2.0, reject_share: float = 0.5, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, host, path, rule, verdict, template, bad_share) of every row of pages.

    Rules come first; the longest that fits wins. Elsewhere the url's template decides: its share of labelled
    pages with label 0, smoothed towards its host's share and that towards the overall share, blocks where it is
    reject_share at least, reject_z standard errors above the overall share and reject_lift times as high. A page's label is the one of
    the same id; ids with several labels count by their mean.

    Counts are taken a (host, typed path), so a host with a third of all pages is summed before any shuffle.
    Null urls and ones without "://" have an empty host and path and share a template. Very long urls are judged whole; columns
    of pages beside id and url, whatever their names, take no part. Rows that repeat an id are judged each; without labels nothing is blocked by a template. An empty table gives an empty result.
    """
    host, path = url_parts(pages[url_col].cast("string"))
    p = pages.select(pages[id_col].alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("typed", typed_path(F.col("path")))
    y = labels.select(labels[label_id].alias("l_id"), labels[label_col].alias("label")).where("l_id is not null and label is not null").groupBy("l_id").agg((1 - F.avg("label")).alias("bad"))
    seen = p.join(y, F.col("id") == F.col("l_id"), "left").groupBy("host", "typed").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count("bad").alias("labelled"))
    tree = cut(templates(seen), "url-tree")
    total = tree.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n")).first()
    overall = (total["b"] or 0.0) / total["n"] if total["n"] else 0.0
    hosts = tree.groupBy("host").agg(((F.sum("bad") + PRIOR_WEIGHT * overall) / (F.sum("labelled") + PRIOR_WEIGHT)).alias("host_share"))
    judged = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).join(hosts, "host")
    judged = judged.select("host", "template", "labelled", ((F.col("bad") + PRIOR_WEIGHT * F.col("host_share")) / (F.col("labelled") + PRIOR_WEIGHT)).alias("bad_share"))
    by_path = cut(tree.select("host", "typed", "template").join(judged, ["host", "template"]), "url-verdicts")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    spread = F.sqrt(F.lit(overall * (1 - overall)) / (F.col("labelled") + PRIOR_WEIGHT))
    impure = (F.col("bad_share") >= max(overall * reject_lift, reject_share)) & (F.col("bad_share") - overall >= spread * reject_z) & F.lit(overall > 0)
    out = p.join(by_path, ["host", "typed"]).withColumn("r", rule)
    return out.select("id", "host", "path", "r.rule", F.coalesce("r.verdict", F.when(impure, "block").otherwise("allow")).alias("verdict"), "template", "bad_share")

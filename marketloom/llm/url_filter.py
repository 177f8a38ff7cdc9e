"""URL verdicts: longest matching rule, else trust and distrust over the link graph.

Hosts whose pages a rule allows are trusted seeds, hosts whose pages a rule
blocks are distrusted seeds, each by the share of its pages.  Trust flows along
links (personalised PageRank), distrust flows against them, because who links
to bad hosts is suspect.  Pages are first summed to weighted host edges, so the
iterations run on hosts, and each is one join and one aggregation.  A host is
blocked when its distrust exceeds its trust and ``threshold`` of what a fully
blocked host without links would have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], value: int) -> Column:
    """Of the longest rule (verdict, host, path) that fits: the verdict (0) or the rule's text (1)."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit((verdict, h + p)[value])).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, n): links between different hosts in the pages' HTML, those without a scheme (//host/) too.

    Links within a host (relative ones) carry nothing between hosts.
    """
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("url"))
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))
    links = links.select("src", host_of(url).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(host, score): personalised PageRank over edges (src, dst, share) from seeds (host, seed)."""
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("own"))
    score = start.select("host", F.col("own").alias("score"))
    for _ in range(rounds):
        flow = edges.join(score.select(F.col("host").alias("src"), "score"), "src")
        flow = flow.select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = written(flow.union(start.select("host", F.col("own").alias("score"))).groupBy("host").agg(F.sum("score").alias("score")))
    return score


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    rounds: int = 12,
    threshold: float = 0.5,
) -> DataFrame:
    """Per page: id_col, host, path, rule (its text or null), verdict, trust, distrust.

    A rule's verdict holds; other pages take their host's.  Of rules that fit
    equally long, the one later in the order of host and path holds.  Null urls
    and urls without ``://`` have empty host and path, and an empty host is
    allowed.  Null pages have no links; long ones are read whole.  Repeated rows
    are judged alike, and count as often for their host; an empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 1)).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, 0))
    hosts = judged.groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("good"), F.avg(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("bad"))
    hosts = written(hosts.where("host <> ''"))
    edges = written(host_edges(pages, host, F.col(html_col)))
    trust = hosts.select("host", F.col("good").alias("seed"))
    distrust = hosts.select("host", F.col("bad").alias("seed"))
    if edges.isEmpty():  # nothing flows: the scores are the seeds' own
        trust, distrust = (s.select("host", (F.col("seed") * (1 - damping)).alias("score")) for s in (trust, distrust))
    else:
        out = written(edges.groupBy("src").agg(F.sum("n").alias("total")))
        inn = written(edges.groupBy("dst").agg(F.sum("n").alias("total")))
        ahead = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
        back = written(edges.join(inn, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("share")))
        trust, distrust = propagated(ahead, trust, damping, rounds), propagated(back, distrust, damping, rounds)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    scores = written(scores.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - damping))
    method = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    out = judged.join(scores, "host", "left").withColumn("verdict", F.coalesce("ruled", method))
    return out.select(id_col, "host", "path", "rule", "verdict", "trust", "distrust")

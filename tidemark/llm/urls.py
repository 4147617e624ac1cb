"""URL filters: host and path rules first, then trust and distrust that flow over the link graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import ascii_lower, cut, let, table

#: Part of a host's score that goes on over its links, and the score yet to be handed out at which propagation ends.
DAMPING, REST = 0.85, 1e-6
#: Up to so many hosts are broadcast to the pages; more are joined by shuffles, where Spark splits a hot host's rows.
BROADCAST_HOSTS = 100_000
#: A host without a rule's verdict is blocked if its distrust exceeds this many times its trust.
RATIO = 1.0


def url_parts(url: Column) -> Column:
    """struct(host, path) of a url: the host after the first :// up to / ? # or the end, A-Z lower-cased; the path from there up to ? #
    or the end. Both are empty without :// and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.struct(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


def domains(host: Column) -> Column:
    """The host and every domain above it, as an array."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def rule_table(spark, rules) -> DataFrame:
    """(rule, rule_host, rule_path, decision) of pairs (allow or block, host/path)."""
    return spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], d) for d, r in rules], "rule string, rule_host string, rule_path string, decision string")


def _by_host(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else hosts


def judge_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with host and path) plus rule and decision of the longest rule that fits, null where none does.

    Rules meet distinct hosts, through the domains above them; a page then tests the few rules of its host. The page side is only
    joined by host."""
    fits = urls.select("host").distinct().select("host", F.explode(domains(F.col("host"))).alias("rule_host")).join(rules, "rule_host")
    longest = F.struct(F.length("rule").alias("n"), "rule", "rule_path", "decision")
    by_host = fits.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list(longest), asc=False).alias("_rules"))
    joined = urls.join(_by_host(cut(by_host)), F.col("host") == F.col("_host"), "left")
    best = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r.rule_path)), 0)
    return joined.withColumns({"rule": best.rule, "decision": best.decision}).drop("_host", "_rules")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host's pages to another host, counted. Links within a host carry nothing over."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""), 1)
    targets = F.transform(found, lambda u: url_parts(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("http:"), u)).otherwise(u)).host)
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked) and links (src, dst, n).

    Trust is the PageRank personalised to the trusted seeds; distrust the same over reversed links from the blocked ones: who links
    to a blocked host is suspect. Both run in one loop: the score under way, spread over the links in each step and damped, is added up
    until all later steps together can bring less than REST. Damping alone ends the loop: of a score of 2 at the start, 89 steps leave that little
    on any graph. Mass at a host without links ends there. A hub's scores are summed map-side; steps are cut in the shared
    folder, and only a sum comes to the driver."""
    spark = seeds.sparkSession
    total = seeds.agg(F.coalesce(F.sum("trusted"), F.lit(0)).alias("t"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    start = seeds.select("host", F.inline(F.array(F.struct(F.lit("t").alias("kind"), (F.col("trusted") / F.lit(float(max(total.t, 1)))).alias("x")), F.struct(F.lit("b").alias("kind"), (F.col("blocked") / F.lit(float(max(total.b, 1)))).alias("x")))))
    now = cut(start.where(F.col("x") > 0).select("kind", "host", (F.col("x") * (1 - DAMPING)).alias("x")))
    both = links.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("to"), "n").unionByName(links.select(F.lit("b").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    ways = cut(both.join(out, ["kind", "a"]).select("kind", F.col("a").alias("host"), "to", (F.col("n") / F.col("all") * DAMPING).alias("w")))
    scores = now
    if not ways.isEmpty():
        while True:
            now = cut(now.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("x") * F.col("w")).alias("x")))
            scores = scores.unionByName(now)
            left = now.agg(F.sum("x")).first()[0] or 0.0
            if left * DAMPING < REST * (1 - DAMPING):
                break
    return scores.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("x"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "b", F.col("x"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of pages (page_id, url, html).

    Seeds are the pages that rules allow or block, counted by host. Where no rule fits, the host's scores decide; a host that nothing
    reaches is allowed, as are pages without a host. Null html has no links. Rows come out as often as they are there; the text of pages
    is never shuffled."""
    parts = url_parts(F.col("url"))
    located = pages.select("page_id", "html", parts.alias("_u")).select("page_id", "html", "_u.host", "_u.path")
    judged = cut(judge_by_rules(located.select("page_id", "host", "path"), rule_table(pages.sparkSession, rules)))
    seeds = judged.where(F.col("decision").isNotNull()).groupBy("host").agg(F.count_if(F.col("decision") == "allow").alias("trusted"), F.count_if(F.col("decision") == "block").alias("blocked"))
    scores = propagate(seeds, cut(host_links(located)))
    joined = judged.join(_by_host(cut(scores.withColumnRenamed("host", "_host"))), F.col("host") == F.col("_host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > trust * RATIO, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("decision", method).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust"))


#: The rules of op2.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    """A row a page, those of a null url, host or html included; other columns are left out."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)

import collections
import re

import numpy as np
import pandas as pd

from tidemark.llm import urls

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def locate(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fit = [(len(r), r, d) for d, r in rules for h, p in [(r.split("/")[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(pages, rules):
    out, seeds, links = {}, {"t": collections.Counter(), "b": collections.Counter()}, collections.Counter()
    for i, url, html in pages:
        host, path = locate(url)
        rule, d = rule_of(host, path, rules)
        out[i] = [host, path, rule, d]
        if d:
            seeds["t" if d == "allow" else "b"][host] += 1
        for to in re.findall(r"""href="((?:https?:)?//[^"]*)""", html or ""):
            to = locate(to if not to.startswith("//") else "http:" + to)[0]
            if host and to and to != host:
                links[host, to] += 1
    score = {}
    for k in "tb":
        ways = collections.defaultdict(dict)
        for (a, b), n in links.items():
            a, b = (a, b) if k == "t" else (b, a)
            ways[a][b] = n
        total = sum(seeds[k].values()) or 1
        now = {h: 0.15 * n / total for h, n in seeds[k].items()}
        score[k] = collections.Counter(now)
        while sum(now.values()) > 1e-12:
            new = collections.Counter()
            for a, x in now.items():
                for b, n in ways[a].items():
                    new[b] += x * 0.85 * n / sum(ways[a].values())
            now = new
            score[k].update(now)
    return {i: (h, p, r, d or ("block" if score["b"][h] > score["t"][h] + 1e-7 else "allow")) for i, (h, p, r, d) in out.items()}, score


def agree(spark, folder):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    want, score = brute(pages, RULES)
    got = urls.op2_url_filters(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]
        assert abs(r.trust - score["t"][r.host]) < 1e-6 and abs(r.distrust - score["b"][r.host]) < 1e-6
    return got


def test_given(spark, sf, monkeypatch):
    agree(spark, sf)
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", 3)
    agree(spark, sf)


def test_links_and_odd_urls(spark, tmp_path):
    def link(*hosts):
        return "".join(f'<a href="http://{h}/x">' for h in hosts)

    rows = [
        (1, "http://good.com/a", link("friend.org", "friend.org", "other.org")), (2, "https://bad.net/es/1", None), (3, "http://farm.org/", link("bad.net")),
        (4, "http://FRIEND.org", '<a HREF="//third.org/q">'.replace("HREF", "href")), (5, "http://third.org/?q#x", link("lone.org")), (6, None, "x"), (7, "no host", link("bad.net")),
        (8, "ftp://www.EXAMPLE.com/en/?x", ""), (9, "http://example.com/en/a", ""), (10, "http://a.example.com/en", ""), (11, "http://lone.org", "<a href='/self'>"),
        (12, "http://example.com", ""), (13, "http://bad.net/fr/", link("farm.org", "bad.net")), (14, "://", ""), (15, "http://x.com?a/b", ""), (16, "a://b://c/d", ""),
    ]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in agree(spark, str(tmp_path))}
    assert got[3].verdict == "block" and got[4].verdict == "allow" and got[4].trust > 0 and got[5].trust > 0
    assert got[8].verdict == "allow" and got[9].verdict == "block" and got[12].rule is None


def test_repeats_and_empty(spark, tmp_path):
    schema = "page_id bigint, url string, html string, host int"
    spark.createDataFrame([(1, "http://a.com/", None, 3)] * 3 + [(None, None, None, None)], schema).write.parquet(f"{tmp_path}/a/pages.parquet")
    assert urls.op2_url_filters(spark, f"{tmp_path}/a").count() == 4
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert urls.op2_url_filters(spark, f"{tmp_path}/b").count() == 0


def test_cycle_is_within_1e_6_of_the_solution(spark):
    seeds = spark.createDataFrame([("a", 3, 1), ("c", 1, 0)], "host string, trusted bigint, blocked bigint")
    links = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("b", "c", 3), ("c", "a", 1)], "src string, dst string, n bigint")
    got = {r.host: r for r in urls.propagate(seeds, links).collect()}
    n = np.array([[0, 2, 0], [1, 0, 3], [1, 0, 0]], float)  # links from row to column
    for flow, start, name in (((n / n.sum(1, keepdims=True)).T, [0.75, 0, 0.25], "trust"), (n / n.sum(0), [1, 0, 0], "distrust")):
        exact = 0.15 * np.linalg.solve(np.eye(3) - 0.85 * flow, start)
        for k, h in enumerate("abc"):
            assert abs(got[h][name] - exact[k]) < 1e-6, (name, h)


def test_many_hosts_with_a_hub_and_a_long_cycle(spark):
    """10^5 hosts: a third of them link to one hub and the hub to many, the rest form a cycle; against NumPy."""
    n = 100_000
    k = np.arange(n)
    a = np.concatenate((k[1 : n // 3], np.zeros(2000, int), k[n // 3 :]))
    b = np.concatenate((np.zeros(n // 3 - 1, int), k[1:2001], np.append(k[n // 3 + 1 :], n // 3)))
    w = a % 3 + 1
    links = spark.createDataFrame(pd.DataFrame({"src": a, "dst": b, "n": w})).selectExpr("concat('h', src) AS src", "concat('h', dst) AS dst", "n")
    seeds = spark.createDataFrame([("h0", 5, 0), (f"h{n // 3}", 5, 0), ("h7", 0, 4), (f"h{n - 1}", 0, 4)], "host string, trusted bigint, blocked bigint")
    got = urls.propagate(seeds, links).toPandas().set_index("host")
    for name, src, dst, at in (("trust", a, b, (0, n // 3)), ("distrust", b, a, (7, n - 1))):
        out = np.bincount(src, w, n)
        now = np.zeros(n)
        now[list(at)] = 0.15 / 2
        total = now.copy()
        while now.sum() > 1e-12:
            now = np.bincount(dst, now[src] * 0.85 * w / out[src], n)
            total += now
        mine = got[name].reindex([f"h{i}" for i in range(n)]).fillna(0).to_numpy()
        assert np.abs(mine - total).sum() < 1e-6


def test_many_pages_of_one_host(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("id AS page_id", "IF(id % 3 = 0, concat('http://hot.com/', id), concat('http://h', id % 500, '.net/fr/', id)) AS url", "CAST(NULL AS STRING) AS html")
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op2_url_filters(spark, str(tmp_path)).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"allow": 10_000, "block": 20_000}

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, urls

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/", "http://example.com", "http://x.net/es/a", "ftp://net/fr/", "http://notnet/fr/",
    "http://a.b.NET/de", "http://www.example.com/en", "x://y://z/p", "http://h?q/en/", "http://h#f", "http://spam-farm.example.org/de/1", "http://m.ads-track.example.net/en/2", "http://K.example.org/",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    listed = any(host == d or host.endswith("." + d) for d in queries.BLOCKED_DOMAINS)
    return host, path, best and best.name, best.verdict if best else "block" if listed else "allow"


def test_filter(spark):
    pages = spark.createDataFrame([(k, u, 1, None) for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host int, verdict string")
    got = urls.filter_urls(pages, queries.URL_RULES, queries.BLOCKED_DOMAINS)
    rows = got.collect()
    assert len(rows) == 2 * len(URLS) and all((r.host, r.path, r.rule, r.verdict) == expected(r.url) for r in rows)
    assert urls.filter_urls(pages.limit(0), queries.URL_RULES, queries.BLOCKED_DOMAINS).count() == 0


@pytest.mark.parametrize(("n", "every"), [(3000, 7), (3000, 2), (10, 1), (10, 11), (1, 1)])
def test_cascade_is_exact_over_its_universe(spark, n, every):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % every == 0).alias("listed"))
    keys = keys.unionByName(keys.limit(5)).unionByName(spark.sql("select cast(null as string) key, true listed"))
    c = urls.BloomCascade(keys)
    known = keys.where("key is not null")
    assert known.where(c.listed(F.col("key")) != F.col("listed")).count() == 0
    assert keys.where("key is null").select(c.listed(F.col("key"))).first()[0] is False
    assert every > 1 or len(c.levels) == 1


def test_cascade_bounds(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"), (F.col("id") < 1000).alias("listed"))
    with pytest.raises(urls.BloomCascade.TooLarge):
        urls.BloomCascade(keys, max_bits=1024)
    assert urls.listed_keys(keys.select(F.col("key").alias("h")), "h", keys.where("listed").select("key")).count() == 1000
    assert urls.BloomCascade(keys.limit(0)).levels == []

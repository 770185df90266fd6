"""Lists of domains as tables, and lists beyond the bitmaps' bound."""

from __future__ import annotations

import pytest

from lodestone.llm import queries, urls

from .test_urls import URLS, expected


@pytest.mark.parametrize("max_bits", [1 << 26, 0])
def test_table_of_domains_with_and_without_a_cascade(spark, max_bits):
    pages = spark.createDataFrame([(k, u, 1, None) for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host int, listed_host string")
    domains = spark.createDataFrame([(d,) for d in (*queries.BLOCKED_DOMAINS, *queries.BLOCKED_DOMAINS, None)], "domain string")
    got = urls.filter_urls(pages, queries.URL_RULES, domains, max_bits)
    assert got.columns == ["page_id", "url", "listed_host", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 2 * len(URLS) and all((r.host, r.path, r.rule, r.verdict) == expected(r.url) for r in rows)
    assert {r.verdict for r in urls.filter_urls(pages, [], domains.limit(0), max_bits).collect()} == {"allow"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (max_bits == 0) and ("Subquery" in plan) == (max_bits > 0)


def test_hosts_under_domains(spark):
    hosts = ["a.b.c", "b.c", "c", "xb.c", "b.c.d", "", "a..b", "b.c.", "." * 200]
    domains = ["b.c", "b", "a..b"]
    got = urls.hosts_under(spark.createDataFrame([(h,) for h in [*hosts, *hosts, None]], "key string"), spark.createDataFrame([(d,) for d in domains], "domain string"))
    assert sorted(r.key for r in got.collect()) == sorted(h for h in hosts if any(h == d or h.endswith("." + d) for d in domains))

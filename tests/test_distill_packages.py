"""Distilled documents over the whole table."""

from __future__ import annotations

import re

from lodestone.plans import catalogue


def test_every_file_is_in_one_document(spark, sf):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    rows = catalogue.QUERIES["q_distill_packages"](spark, sf).collect()
    found = [(r.package, int(x)) for r in rows for x in re.findall(r'<file path="m(\d+)\.py">', r.document)]
    assert max(ids) >= 50 and sorted(x for _, x in found) == ids and all(p == x // 100 for p, x in found)

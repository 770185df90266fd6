"""Snapshots compared, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestone.operators import snapshots
from lodestone.plans import catalogue_code

SCHEMA = "file string, content string"


def brute(before, after, similar):
    b, a = ({f: c or "" for f, c in x if f is not None} for x in (before, after))
    out = [("modified", f, None, None) for f in b if f in a and a[f] != b[f]]
    old, new = sorted(f for f in b if f not in a), sorted(f for f in a if f not in b)
    for f in list(old):
        twin = next((x for x in new if a[x] == b[f]), None)
        if twin is not None:
            out.append(("renamed", twin, f, 100))
            old.remove(f), new.remove(twin)
    pairs = []
    for f in old if similar else []:
        for g in new:
            x, y = Counter(b[f].split("\n")), Counter(a[g].split("\n"))
            common, longer = sum((x & y).values()), max(sum(x.values()), sum(y.values()))
            if 100 * common >= similar * longer:
                pairs.append((-common / longer, f, g, 100 * common // longer))
    for _, f, g, s in sorted(pairs):
        if f in old and g in new:
            out.append(("renamed", g, f, s))
            old.remove(f), new.remove(g)
    return out + [("deleted", f, None, None) for f in old] + [("added", f, None, None) for f in new]


def same(spark, before, after, similar):
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (before, after)]
    got = snapshots.compare(*frames, similar=similar).collect()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(brute(before, after, similar), key=key)


def text(rng, n):
    return "\n".join(rng.choice(("{", "}", "", f"line {rng.randint(1, 60)}")) for _ in range(n))


@pytest.mark.parametrize(("seed", "similar"), [(1, 50), (2, 80), (3, None), (4, 20), (5, 100)])
def test_random_snapshots(spark, seed, similar):
    rng = random.Random(seed)
    before = [(f"f{k:02}", text(rng, rng.randint(1, 12))) for k in range(40)] + [("null", None), ("empty", ""), (None, "x")]
    after = []
    for f, c in before:
        lines, turn = (c or "").split("\n"), rng.randrange(5)
        if turn == 1:
            c = "\n".join([*lines, "more"])
        elif turn == 3:
            f = f"moved/{f}"
        elif turn == 4:
            f, c = f"edited/{f}", "\n".join([*lines[1:], *(rng.sample(lines, 1))])
        if turn != 2:
            after.append((f, c))
    same(spark, before, [*after, ("new", text(rng, 5)), ("copy", before[0][1])], similar)


def test_copies_and_nothing(spark):
    many = [(f"a{k}", "same\ntext") for k in range(30)]
    same(spark, many, [(f"b{k:02}", "same\ntext") for k in range(20)], 50)
    same(spark, [], many, 50), same(spark, many, [], 50), same(spark, [], [], 50), same(spark, many, many, 50)


def test_equal_paths_in_one_snapshot(spark):
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], SCHEMA)
    assert snapshots.compare(twice, twice).collect() == []
    with pytest.raises(ValueError, match="percentage"):
        snapshots.compare(twice, twice, 0)


def test_query(spark, sf):
    before, after = ([tuple(r) for r in x.collect()] for x in catalogue_code.two_snapshots(spark, sf))
    got = catalogue_code.q_snapshot_renames(spark, sf).collect()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(brute(before, after, 50), key=key)


def test_equally_like_families_are_paired_at_once(spark, monkeypatch):
    """Copies with a line more each, one family beside another and some files in between."""
    texts = ["\n".join(f"{k} line {n}" for n in range(9)) for k in range(3)]
    before = [(f"old{k:02}", texts[k % 3]) for k in range(45)] + [("odd", texts[0] + "\nodd\nodder")]
    after = [(f"new{k:02}", f"{texts[k % 3]}\n#{k}") for k in range(36)] + [("even", texts[0] + "\neven\nevener"), ("odder", texts[1] + "\nodd")]
    names = []
    monkeypatch.setattr(snapshots, "stored", lambda df, name, f=snapshots.stored: names.append(name) or f(df, name))
    same(spark, before, after, 50)
    assert names.count("taken") <= 4


def test_no_list_of_files_is_broadcast(spark, sf):
    plan = snapshots.compare(*catalogue_code.two_snapshots(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan

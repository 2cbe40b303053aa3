import random

import pytest

from tallyframe.operators.hierarchy import breaks, descendants_of, nested_sets
from tallyframe.plans.curation import R


def brute(parent):
    """(verdicts, {node: (depth, root, path)}) by following links one by one."""
    bad, tree = {}, {}
    for n in parent:
        walk, at = [n], parent[n]
        while at is not None and at in parent and at not in walk:
            walk.append(at)
            at = parent[at]
        if parent[n] is not None and parent[n] not in parent:
            bad[n] = "orphan"
        if at is not None and at in walk:
            bad[n] = "in_cycle" if at == n else "below_cycle"
        else:
            tree[n] = (len(walk) - 1, walk[-1], "/".join(map(str, reversed(walk))))
    return bad, tree


def shapes():
    r = random.Random(4)
    deep = {i: i - 1 if i else None for i in range(150)}
    flat = {i: 0 if i else None for i in range(300)}
    wild = {i: r.choice([None, i - 1, r.randrange(120), r.randrange(200)]) for i in range(120)}
    loops = {0: 0, 1: 0, 2: 3, 3: 2, 4: 3, 5: 4, 6: None, 7: 99, 8: 7}
    return {"deep": deep, "flat": flat, "wild": wild, "loops": loops, "one": {1: None}, "self": {1: 1}}


@pytest.mark.parametrize("name", list(shapes()))
def test_against_brute_force(spark, name):
    parent = shapes()[name]
    df = spark.createDataFrame(list(parent.items()), "id int, up int")
    bad, tree = brute(parent)
    assert {r.id: r.verdict for r in breaks(df, ["id"], ["up"]).collect()} == bad
    t = nested_sets(df, ["id"], ["up"], "id").cache()
    rows = t.collect()
    assert {r.id: (r.depth, r.root, r.path) for r in rows} == tree
    below = {n: {m for m in tree if n != m and f"/{n}/" in "/" + tree[m][2]} for n in tree}
    assert {r.id: r.descendants for r in rows} == {n: len(b) for n, b in below.items()}
    pairs = {(r.ancestor, r.descendant) for r in descendants_of(t, t, "id").collect()}
    assert pairs == {(a, d) for a, b in below.items() for d in b}
    for r in rows:  # ranges nest and a tree's positions are 0..n-1
        assert r.rgt - r.lft == r.descendants
    for root in {r.root for r in rows}:
        assert sorted(r.lft for r in rows if r.root == root) == list(range(sum(r.root == root for r in rows)))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (None, 1, "z"), (2, 1, None)], "id int, up int, `__ptr` string")
    assert {(r.id, r.depth) for r in nested_sets(df, ["id"], ["up"], "id").collect()} == {(1, 0), (2, 1)}
    none = df.limit(0)
    assert breaks(none, ["id"], ["up"]).count() == 0 and nested_sets(none, ["id"], ["up"], "id").count() == 0


def test_every_ancestor_of_all_links(spark, tmp_path):
    """No link kind and no ancestor is left out: pairs as listed, and the same from the ranges."""
    q = [(1, None), (2, 1), (3, 2), (20, 3), (4, 20), (5, 6), (6, 5), (7, 6), (8, 99)]
    o = [(0, "IS", "a", None, None), (0, "IS", "b", "a", "h"), (0, "IS", "c", "b", "h"), (0, "IS", "h", None, "k"), (0, "IS", "k", None, None), (7, "IS", "b", "a", None), (7, "IS", "a", "a", None)]
    spark.createDataFrame(q, "id long, abstract_id long").write.parquet(str(tmp_path / "quarterly_financials.parquet"))
    spark.createDataFrame(o, "company_id int, statement string, concept string, parent_concept string, abstract_concept string").write.parquet(str(tmp_path / "concept_normalization_overrides.parquet"))
    chain = ["1", "2", "3", "20", "4"]
    want = {("quarterly_abstract", a, d) for i, a in enumerate(chain) for d in chain[i + 1 :]}
    want |= {("override_parent", f"0/IS/{a}", f"0/IS/{d}") for a, d in ("ab", "ac", "bc")}
    want |= {("override_abstract", f"0/IS/{a}", f"0/IS/{d}") for a, d in ("hb", "hc", "kh", "kb", "kc")}
    pairs = R.queries["p3_pairs"](spark, str(tmp_path)).collect()
    assert len(pairs) == len(want) and {(r.link, r.ancestor, r.descendant) for r in pairs} == want
    n = R.queries["p3_ranges"](spark, str(tmp_path)).collect()
    assert {(a.link, a.node, d.node) for a in n for d in n if (a.link, a.tree) == (d.link, d.tree) and a.lft < d.lft <= a.rgt} == want

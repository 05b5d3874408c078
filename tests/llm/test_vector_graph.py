"""Near-duplicate vectors against all pairs: graph, parts of a hot group, audit, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import vector_graph as vg
from evalframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, least=0.9):
    """{place: (id, n_links, component, kept)} of (id, vector) rows."""
    usable = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, comp = {i: set() for i in range(len(rows))}, {}
    for n in {len(rows[i][1]) for i in usable}:
        own = [i for i in usable if len(rows[i][1]) == n]
        v = vg.unit_rows(np.array([rows[i][1] for i in own], dtype=float))
        for a, b in zip(*np.nonzero(v @ v.T >= least), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    for i in range(len(rows)):
        if i not in comp:
            group, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            comp |= dict.fromkeys(group, name)
    return [(rows[i][0], len(links[i]), comp[i], rows[i][0] == comp[i]) for i in range(len(rows))]


def groups(rng, sizes, dim, spread):
    """Clusters of near vectors; ``spread`` sets their cosines."""
    out = []
    for n in sizes:
        centre = rng.standard_normal(dim)
        out += [centre + spread * rng.standard_normal(dim) for _ in range(n)]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    return sorted((tuple(r) for r in vg.near_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize("spread", [0.05, 0.3])
def test_against_all_pairs(spark, spread):
    """Many shards, and a group of a third of all rows that is dealt into parts."""
    rng = np.random.default_rng(7)
    vectors = groups(rng, [300, 40, 7, 2, 2, 2], 24, spread) + list(rng.standard_normal((550, 24)))
    rows = [(10 * i, list(map(float, x * rng.uniform(0.1, 9)))) for i, x in enumerate(vectors)]
    got, want = run(spark, rows, target=64), sorted(brute(rows), key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.95 * true > 0
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.99 * len(rows)


def test_graph_of_one_shard():
    """Pruned lists keep their bound, and searches from the medoids find what all pairs give."""
    rng = np.random.default_rng(3)
    v = vg.unit_rows(np.array(groups(rng, [200, 90, 30, 3, 3, 3], 32, 0.25) + list(rng.standard_normal((900, 32)))))
    edges = vg.build_graph(v, 48)
    assert edges.shape[1] == vg.SLACK and (edges < len(v)).all() and not (edges == np.arange(len(v))[:, None]).any()
    linked = vg._links_in_range(v, edges, np.zeros(len(v)), 48, 0.9)
    true = v @ v.T >= 0.9
    np.fill_diagonal(true, False)
    assert not (linked & ~true).any() and linked.sum() >= 0.99 * true.sum()
    halves = np.arange(len(v)) % 2
    across = vg._links_in_range(v, edges, halves, 48, 0.9)
    assert not across[halves == 0][:, halves == 0].any() and across.sum() >= 0.95 * true[halves == 0][:, halves == 1].sum() * 2


def test_pruning_rule():
    """A neighbour goes if a nearer kept one is closer to it by ALPHA than the node itself is."""
    rng = np.random.default_rng(5)
    v = vg.unit_rows(rng.standard_normal((120, 6)))
    got = vg.robust_prune(v, np.array([0]), np.tile(np.arange(120), (1, 1)))[0]
    want, left = [], sorted(range(1, 120), key=lambda c: -v[0] @ v[c])
    while left and len(want) < vg.DEGREE:
        best, left = left[0], left[1:]
        want.append(best)
        left = [c for c in left if vg.ALPHA * np.linalg.norm(v[best] - v[c]) > np.linalg.norm(v[0] - v[c])]
    assert [x for x in got if x >= 0] == want


def test_audit_raises_the_overlap(spark, monkeypatch):
    """A poor first graph is found out and built again with more overlap."""
    rng = np.random.default_rng(9)
    rows = [(i, list(map(float, x))) for i, x in enumerate(groups(rng, [6] * 80, 16, 0.28))]
    seen, audit = [], vg.audit_recall
    monkeypatch.setattr(vg, "audit_recall", lambda *a: seen.append(audit(*a)) or seen[-1])
    got = run(spark, rows, target=16, overlap=1, recall=0.9999)
    want = sorted(brute(rows), key=str)
    true = sum(r[1] for r in want)
    assert seen[0] < 0.9999 and seen == sorted(seen) and seen[0] * true < sum(r[1] for r in got) and sum(r[1] for r in got) >= 0.999 * true


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]),
        (9, [inf, 1.0]), (10, [None, 1.0]), (None, [0.0, 2.0]), (None, [-1.0, 0.0]), (11, [1.0]), (12, [5.0]), (13, [1e300, 1e300]), (14, [1e-300, 1e-300]), (15, [-1.0, -1.0]), (5, None),
    ]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    named = df.withColumns({"_key": F.lit("x"), "_id": F.lit(1), "kept": F.lit(2), "_vec": F.lit(3), "component_id": F.lit(4)})
    assert vg.near_vectors(named).columns == ["vec_id", "n_links", "component_id", "kept"] and vg.near_vectors(named).count() == len(rows)
    assert vg.near_vectors(df.limit(0)).count() == 0


def test_query_matches_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, np.float32(x)))) for i, x in enumerate(groups(rng, [12, 5, 2, 1, 1], 8, 0.1))] + [(90, None), (91, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLES["op13_near_vectors"])
    names = [d[0] for d in want.description]
    got = QUERIES["op13_near_vectors"](spark, str(tmp_path))
    assert set(names) == set(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())
    assert QUERIES["op13_near_vectors"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()

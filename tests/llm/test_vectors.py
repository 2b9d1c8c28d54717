"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pytest

from joeira.llm import embedding_dedup, nearest
from joeira.llm.cover_tree import CoverTree, dual_links

NAN, INF = float("nan"), float("inf")


def cloud(n: int, dim: int, seed: int = 3) -> list[tuple]:
    """Two labels, a dense group, a spread one, exact and scaled copies."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim))
    x[: n // 3] = x[0] + 0.04 * rnd.normal(size=(n // 3, dim))
    x[n // 3 : n // 2] = x[n // 3] + 0.35 * rnd.normal(size=(n // 2 - n // 3, dim))
    x[n - 20 : n - 10] = x[:10]
    x[n - 10 :] = 3 * x[10:20]
    return [(int(k), [float(v) for v in np.float32(x[k])], int(k % 7 == 0)) for k in rnd.permutation(n)]


ODD = [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [1.0] * 7 + [NAN], 1), (5003, [1.0] * 7 + [INF], 1), (5004, [1.0] * 7 + [None], 1), (5005, [], 1),
       (5006, [1.0] * 8, None), (None, [1.0] * 8, 1), (5007, [1.0, 2.0], 1), (5008, [1.0, 2.0], 1), (5009, [1e30] * 8, 3), (5010, [1e-30] * 8, 3)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int, cls int")


def plain_links(rows, cosine):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    out = []
    low = {k: k for k in range(len(ok))}
    unit = [np.array(v, dtype=float) / np.abs(v).max() for _, v, _ in ok]
    unit = [u / np.sqrt(u @ u) for u in unit]
    links = [[b for b in range(len(ok)) if a != b and ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine] for a in range(len(ok))]
    for _ in ok:
        new = {a: min([low[a], *(low[b] for b in links[a])], key=lambda k: ok[k][0]) for a in low}
        if new == low:
            break
        low = new
    out = [(r[0], len(links[k]), ok[low[k]][0]) for k, r in enumerate(ok)]
    return sorted(out + [(r[0], 0, r[0]) for r in rows if r not in ok], key=str)


@pytest.mark.parametrize("block", [40, 2048])
def test_links_equal_brute_force(spark, block, monkeypatch):
    rows = cloud(260, 8) + ODD[:4] + ODD[4:]
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # more pivots for small blocks
    out = embedding_dedup.near_duplicates(frame(spark, rows), 0.93, block=block).collect()
    want = plain_links([r for r in rows if r[0] not in (5002,)], 0.93)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id != 5002), key=str)
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out) and len(out) == len(rows)


def test_no_vectors(spark):
    none = frame(spark, [])
    assert embedding_dedup.near_duplicates(none).count() == 0
    assert nearest.search(none, lambda i: i % 2 == 0).count() == 0


@pytest.mark.parametrize("n, dense, spread", [(1, 0, 0.0), (400, 300, 0.01), (700, 650, 0.08), (500, 200, 0.3)])
def test_trees(n, dense, spread):
    rnd = np.random.default_rng(n)
    x = rnd.normal(size=(n, 16))
    x[:dense] = x[0] + spread * rnd.normal(size=(dense, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    weight = rnd.integers(1, 4, n)
    tree = CoverTree.build(x)
    for centre, first, last, child, end in tree.nodes.tolist():
        mine = tree.order[first:last]
        assert centre in mine
        if end > child:
            inner = [k for k in range(child, end)]
            assert sorted(p for k in inner for p in tree.order[tree.nodes[k, 1] : tree.nodes[k, 2]]) == sorted(mine)
            assert tree.nodes[child, 0] == centre and max(tree.radius[inner]) <= max(tree.radius) / 2 + 1e-9
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    a, b = dual_links(tree, tree, x, x, weight, weight, 0.93, True).totals()
    assert (a + b == near @ weight).all()


def test_nearest_equal_brute_force_when_all_leaves_are_visited(spark):
    rows = cloud(240, 6, seed=9) + ODD[:7] + [(300, [0.5] * 6, 0), (301, [0.5] * 6, 0), (302, [0.5] * 6, 1), (310, [1.0, 2.0], 1), (320, [2.0, 2.0], 1)]
    ok = [(i, np.array(v, dtype=float)) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = nearest.search(frame(spark, rows), lambda i: i % 10 == 0, k=5, share=1e9, trees=3, leaves=8, block=50).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i, q in ok:
        if i % 10:
            assert i not in got
            continue
        far = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i and len(v) == len(q))[:5]
        assert [(k, j) for k, j, _ in got[i]] == [(k + 1, j) for k, (_, j) in enumerate(far)]
        assert all(abs(s - d) < 1e-12 for (_, _, s), (d, _) in zip(got[i], far))


def test_recall(spark):
    rnd = np.random.default_rng(0)
    x = np.float32(rnd.normal(size=(3000, 64)))
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(3000)]
    out = nearest.search(frame(spark, rows), lambda i: i % 100 == 0).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        far = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far)[:10].tolist()))
    assert hits / 300 >= 0.9


def test_repeated_rows_hide_no_neighbour(spark):
    v, far = [1.0, 2.0, 3.0, 4.0], [[4.0 + k, 3.0, 2.0, 1.0] for k in range(10)]
    rows = [(100, v, 1)] * 12 + [(k, v, 1) for k in range(101, 106)] + [(150 + k, x, 1) for k, x in enumerate(far)]
    out = nearest.search(frame(spark, rows), lambda i: i == 100, k=10).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == [101, 102, 103, 104, 105, 150, 151, 152, 153, 154]

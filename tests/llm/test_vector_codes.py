"""Codebooks and codes against Lloyd rounds in plain Python."""

import hashlib
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pytest

from joeira.llm import vector_codes as vc

NAN, INF = float("nan"), float("inf")


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [r for r in rows if r[1] and all(x is not None and isfinite(x) and abs(x) < 65536 for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[floor(scale * x) for x in r[1]] for r in kept]
    widths = [len(ints[0]) // parts + (k < len(ints[0]) % parts) for k in range(parts)]
    ends = [sum(widths[: k + 1]) for k in range(parts)]
    split = [[v[b - w : b] for b, w in zip(ends, widths)] for v in ints]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for s in split:
                held[near(p, s[p])[1]].append(s[p])
            new.append([[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else b for k, b in enumerate(books[p])])
        books = new
    found = [[near(p, s[p]) for p in range(parts)] for s in split]
    errors = [sum(d for d, _ in f) for f in found]
    of_label = defaultdict(int)
    for r, e in zip(kept, errors):
        of_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{k:02x}" for _, k in f), e, of_label[r[2]], sha) for r, f, e in zip(kept, found, errors))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 0.5) for r in rows], "vec_id bigint, embedding array<float>, label int, codes int, n int, id string, vector double")


def got(df):
    return Counter(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def cloud(n: int, dim: int, seed: int):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)).astype(np.float32)
    x[: n // 3] = x[0]
    return [(int(k), x[k].tolist(), None if k % 5 == 0 else int(k % 3)) for k in rnd.permutation(n)]


@pytest.mark.parametrize("n, dim, entries, block", [(180, 8, 16, 7), (120, 10, 7, 4096), (40, 3, 256, 3)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, dim, entries, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    monkeypatch.setattr(vc, "HOT_LABELS", 2)  # some labels are joined, some broadcast
    rows = cloud(n, dim, n)
    rows += rows[:5] + [(None, rows[3][1], 9), (None, rows[4][1], None)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [1.0] * (dim - 1) + [NAN], 1), (-4, [1.0] * (dim - 1) + [INF], 1), (-5, [None] * dim, 1), (5000, [1.0] * (dim + 1), 1), (-6, [70000.0] * dim, 1)]
    out = vc.code_table(frame(spark, rows).repartition(5), 4, entries, 4)
    assert got(out) == plain(rows, 4, entries)


def test_large_components_are_exact(spark):
    rows = [(k, [float(np.float32(x)) for x in (60000.5 - k / 7, -65535.9 + k, k, 3.25)], k % 2) for k in range(60)]
    assert got(vc.code_table(frame(spark, rows), 2, 5, 3)) == plain(rows, 2, 5, 3)
    x = np.array([[1 << 26, -(1 << 26)]], dtype=np.int64)
    assert vc.nearest(x, -x)[1].tolist() == [2 * (1 << 27) ** 2]


def test_members_stay_unless_their_entry_changes(spark, tmp_path):
    from joeira.llm.common import Scratch

    rows = cloud(400, 8, 9)
    vectors = frame(spark, rows)
    books = vc.first_books(vectors.selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS vector"), 4, 16, 1024)
    x = np.array([r[1] for r in rows], dtype=np.float64)
    parts = vc.cut(np.floor(x * 1024).astype(np.int64), 4)
    resident = vc.settle(spark.createDataFrame([b for p, part in enumerate(parts) for b in vc._by_entry(p, part, vc.nearest(part, books.books[p])[0])], vc._BLOCKS), Scratch(spark, "t"))
    new = vc.updated(books, resident)
    after = vc._moved(resident, new, Scratch(spark, "t"))
    held = {(r.position, r.entry): r.n for r in after.groupBy("position", "entry").sum("n").toDF("position", "entry", "n").collect()}
    want = Counter((p, int(k)) for p, part in enumerate(parts) for k in vc.nearest(part, new.books[p])[0])
    assert held == want
    changed = sum(int((vc.nearest(part, new.books[p])[0] != vc.nearest(part, books.books[p])[0]).sum()) for p, part in enumerate(parts))
    assert 0 < changed < 4 * 400 / 2
    text = after._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text  # both sides are read as written


def test_codes_are_decoded(spark):
    rows = cloud(100, 8, 2)
    vectors = frame(spark, rows)
    books = vc.train(vectors, 4, 256, 2)
    coded = vc.encode(vectors, books, ["vec_id", "label"])
    x = {r[0]: np.array(r[1]) for r in rows}
    for r in vc.decode(coded, books).collect():
        error = ((np.floor(x[r.vec_id] * 1024) - 1024 * np.array(r.vector)) ** 2).sum()
        assert len(r.codes) == 4 and error == r.error


def test_no_vectors(spark):
    none = frame(spark, [])
    assert vc.train(none) is None and vc.code_table(none).count() == 0
    assert vc.code_table(frame(spark, [(1, None, 1), (2, [None], 2)])).count() == 0

"""Embedding near-dedup: exact cosine links by a dual traversal of cover trees.

Only vectors of one label are compared.  Equal vectors are taken together
first.  The top of the cover tree is laid out by Spark, the rest inside tasks:

* A bounded sample of pivots (at most ``PIVOTS`` in all, none for labels with a
  smaller share) splits each label.  A vector within half the wanted distance of
  its pivot belongs to the pivot's *core*: any two of a core are linked, so a
  core is counted and never compared with itself, however many near copies it
  holds.  The others are *loose* and grouped by their nearest pivot.
* Groups are cut into blocks of at most ``BLOCK`` vectors, each with its own cover
  tree (levels of halving radii).  Pairs of blocks whose balls are too far apart
  are dropped; loose blocks meet each other, cores that may touch meet, and a
  core meets the few loose vectors around it.
* A pair of blocks is one unit of work: both trees are walked at once, pairs of
  nodes are pruned or linked whole by their radii, and what stays open is
  compared in double precision.  A unit gives back counts and a spanning set of
  edges, never all pairs of a group.

Links are exact for the given threshold whatever the sample.

Cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows without a label or identifier link with nothing and are
their own component; vectors of different lengths do not link; equal vectors
(repeated rows too) are linked with each other; other columns are left out,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from joeira.llm.common import Scratch
from joeira.llm.components import connected
from joeira.llm.cover_tree import SLACK, CoverTree, dual_links, spanning

BLOCK = 2048
PIVOTS = 4096  # in all
PIVOTS_PER_LABEL = 64
GROUP = ["label", "dim"]


def usable(vector: str):
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    x = np.vstack([v.values.to_numpy(zero_copy_only=False) for v in column]).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # the squares of the scaled ones neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _pivots(classes: DataFrame, reach: float) -> dict:
    """``(label, dim) -> unit vectors``: at most ``PIVOTS`` in all, more than half the wanted distance apart."""
    counts = classes.groupBy(*GROUP).agg(F.count("*").alias("n"))
    n_all = classes.count()
    wanted = counts.withColumn("p", F.least(F.lit(PIVOTS_PER_LABEL), 1 + F.floor(F.col("n") / BLOCK), F.floor(F.col("n") * PIVOTS / max(1, n_all))))
    ranked = classes.select(*GROUP, "vector", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.xxhash64("vector"), "cls")).alias("r")).where(f"r <= {PIVOTS_PER_LABEL}")
    rows = ranked.join(wanted.where("p > 0"), GROUP).where("r <= p").select(*GROUP, "vector", "r").collect()  # at most PIVOTS
    out: dict = {}
    for r in sorted(rows, key=lambda r: r.r):
        v = np.array(r.vector, dtype=np.float64)
        v = v / np.abs(v).max()
        v = v / np.sqrt(v @ v)
        mine = out.setdefault((r.label, r.dim), [])
        if all(np.sqrt(max(0.0, 2 - 2 * float(v @ w))) > reach / 2 for w in mine):
            mine.append(v)
    return {k: np.array(v) for k, v in out.items()}


def _assign(classes: DataFrame, pivots: dict, reach: float) -> DataFrame:
    """Each class with its group (2 j: core of pivot j, 2 j + 1: loose, nearest to j, -1: no pivot), its distance and the pivots around it."""

    def work(batches):
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            where: dict = {}
            for k, key in enumerate(zip(labels, dims)):
                where.setdefault(key, []).append(k)
            for key, rows in where.items():
                part = batch.take(pa.array(rows))
                x = unit(part.column(4))
                group, far, near = np.full(len(x), -1), np.full(len(x), 2.0), [[] for _ in rows]
                if key in pivots:
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots[key].T)))
                    j = apart.argmin(axis=1)
                    far = apart[np.arange(len(x)), j]
                    core = far <= reach / 2 - SLACK
                    group = 2 * j + ~core
                    for k, p in zip(*np.nonzero((apart <= 1.5 * reach + SLACK) & ~core[:, None])):
                        near[k].append(int(p))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), part.column(3), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(group.astype(np.int32)), pa.array(far), pa.array(near, pa.list_(pa.int32())),
                ], names=["label", "dim", "cls", "n", "unit", "grp", "far", "near"])

    kind = classes.schema["label"].dataType.simpleString()
    rows = classes.select(*GROUP, "cls", "n", "vector")
    return rows.mapInArrow(work, f"label {kind}, dim int, cls bigint, n bigint, unit binary, grp int, far double, near array<int>")


def _blocks(rows: DataFrame, ring: bool, block: int) -> DataFrame:
    """Blocks with their cover trees: ``label, dim, ring, grp, cut, far, tree``."""
    key = [*GROUP, "grp"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    cut = rows.join(sizes, key).withColumn("cut", F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
        tree = CoverTree.build(x)
        data = {"x": x, "cls": table.column("cls").to_numpy(), "n": table.column("n").to_numpy(), "order": tree.order, "nodes": tree.nodes, "radius": tree.radius}
        first = table.slice(0, 1)
        return pa.table({
            "label": first.column("label"), "dim": first.column("dim"), "ring": pa.array([ring]), "grp": first.column("grp"), "cut": first.column("cut"),
            "far": pa.array([float(table.column("far").to_numpy().max())]), "tree": pa.array([pickle.dumps(data)], pa.binary()),
        })

    kind = rows.schema["label"].dataType.simpleString()
    return cut.select(*key, "cut", "cls", "n", "unit", "far").groupBy(*key, "cut").applyInArrow(
        build, f"label {kind}, dim int, ring boolean, grp int, cut int, far double, tree binary"
    )


def _links_of(cosine: float):
    def load(blob: bytes):
        d = pickle.loads(blob)
        return CoverTree(d["order"], d["nodes"], d["radius"]), d["x"], d["cls"], d["n"]

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(2)[k].as_py()
                left = load(batch.column(0)[k].as_py())
                right = left if same else load(batch.column(1)[k].as_py())
                found = dual_links(left[0], right[0], left[1], right[1], left[3], right[3], cosine, same)
                a, b = found.totals()
                n = len(left[2])
                if same:
                    cls, links = left[2], a + b
                    low = spanning(n, found.edges)
                else:
                    cls, links = np.concatenate([left[2], right[2]]), np.concatenate([a, b])
                    # Edges of ``all_of`` join a left and a right point as well, so one numbering serves both.
                    low = spanning(len(cls), [(x, y + n) for x, y in found.edges])
                some = np.flatnonzero(links > 0)
                out = np.flatnonzero(low != np.arange(len(low)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([cls[some], cls[out]])), pa.array(np.concatenate([links[some], np.zeros(len(out), np.int64)])),
                    pa.array([None] * len(some) + cls[low[out]].tolist(), pa.int64()),
                ], names=["cls", "links", "other"])

    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    reach = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable("vector") & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("dim", F.size("vector"))
    good = rows.where("ok")
    classes = scratch.save(
        good.groupBy("label", "dim", "vector").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id())
    )
    pivots = _pivots(classes, reach)
    assigned = scratch.save(_assign(classes, pivots, reach))
    around = assigned.select(*GROUP, F.explode("near").alias("grp"), "cls", "n", "unit", F.lit(0.0).alias("far"))
    blocks = scratch.save(_blocks(assigned.drop("near"), False, block).unionByName(_blocks(around, True, block)))

    # Which blocks meet; only their names are joined, a row per block.
    spark = vectors.sparkSession
    kind = classes.schema["label"].dataType.simpleString()
    gaps = [(label, dim, p, q, float(np.sqrt(max(0.0, 2 - 2 * float(v[p] @ v[q]))))) for (label, dim), v in pivots.items() for p in range(len(v)) for q in range(len(v))]
    gap = spark.createDataFrame(gaps, f"label {kind}, dim int, p int, q int, gap double")  # at most PIVOTS * PIVOTS_PER_LABEL rows
    names = blocks.drop("tree").withColumn("core", ~F.col("ring") & (F.col("grp") % 2 == 0)).withColumn("p", F.when(F.col("ring"), F.col("grp")).otherwise(F.shiftright("grp", 1)))
    left, right = (names.select(*GROUP, *[F.col(c).alias(f"{c}_{s}") for c in ("ring", "grp", "cut", "far", "core", "p")]) for s in "ab")
    met = left.join(right, GROUP).join(gap.withColumnsRenamed({"p": "p_a", "q": "p_b"}), [*GROUP, "p_a", "p_b"], "left")
    plain = ~F.col("ring_a") & ~F.col("ring_b")
    close = F.coalesce(F.col("gap"), F.lit(0.0)) - F.col("far_a") - F.col("far_b") <= reach + SLACK
    ordered = F.struct("grp_a", "cut_a") <= F.struct("grp_b", "cut_b")
    both_loose = plain & ~F.col("core_a") & ~F.col("core_b") & ordered & close
    both_cores = plain & F.col("core_a") & F.col("core_b") & (F.col("grp_a") < F.col("grp_b")) & close
    core_and_ring = F.col("core_a") & F.col("ring_b") & (F.col("p_a") == F.col("p_b"))
    met = met.where(both_loose | both_cores | core_and_ring)
    side = lambda s: blocks.select(*GROUP, *[F.col(c).alias(f"{c}_{s}") for c in ("ring", "grp", "cut", "tree")])
    keys = lambda s: [*GROUP, f"ring_{s}", f"grp_{s}", f"cut_{s}"]
    work = met.join(side("a"), keys("a")).join(side("b"), keys("b")).select(
        "tree_a", "tree_b", F.expr("NOT ring_b AND grp_a = grp_b AND cut_a = cut_b").alias("same")
    )
    found = scratch.save(work.mapInArrow(_links_of(cosine), "cls bigint, links bigint, other bigint"))

    inner = assigned.where("grp >= 0 AND grp % 2 = 0")
    cores = inner.groupBy(*GROUP, "grp").agg(F.sum("n").alias("all"), F.min("cls").alias("head"))
    inside = inner.join(cores, [*GROUP, "grp"]).select("cls", (F.col("all") - F.col("n")).alias("links"), F.col("head").alias("other"))
    every = found.unionByName(inside)
    links = every.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = connected(every.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")), scratch)
    named = classes.drop("vector").join(groups, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    told = named.join(lowest, "component").join(links, "cls", "left").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    by_vector = classes.select("label", "dim", "vector", "cls").join(told, "cls").drop("cls")
    out = good.join(by_vector, ["label", "dim", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

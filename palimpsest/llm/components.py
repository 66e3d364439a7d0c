"""Connected components by contraction.

In each round every vertex hooks onto its smallest neighbour, two steps of
pointer jumping shorten the chains, and the edges are renamed and thinned; the
number of vertices with edges at least halves. Each round is written to the
shared folder. No key's edges are gathered: minima are aggregated before they
are shuffled, and renaming joins large edge sets with one row for each vertex.

Once at most LOCAL_EDGES edges are left, one task names what they connect, so that
few links don't cost many rounds of small jobs. The names are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

LOCAL_EDGES = 1_000_000


def least_names(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges, and the smallest vertex that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    name = np.arange(len(ids))
    while True:
        low = np.minimum(name[x], name[y])
        new = name.copy()
        np.minimum.at(new, name[x], low)  # roots hook onto the smaller root
        np.minimum.at(new, name[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, name):
            return ids, ids[name]
        name = new


def _name_all(batches):
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    ids, names = least_names(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64())], ["v", "p"])


def connected_components(edges: DataFrame, scratch: Scratch, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of every vertex of edges (a, b; long), component being the smallest id reachable.

    Self-loops and repeated edges are fine; null ends are ignored. No edges: no rows.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", small=True)
    names, left = None, edges.count()
    while left:
        if left <= local_edges:
            parents, made = edges.coalesce(1).mapInArrow(_name_all, "v long, p long"), []
        else:
            both = edges.select(F.col("b").alias("v"), F.col("a").alias("u")).unionByName(edges.select(F.col("a").alias("v"), F.col("b").alias("u")))
            hooks = both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p"))
            hooks = scratch.keep(hooks, "hooks", small=True)
            up = hooks.select(F.col("v").alias("w"), F.col("p").alias("q"))
            jumped = scratch.keep(hooks.join(up, F.col("p") == F.col("w")).select("v", F.col("q").alias("p")), "once", small=True)
            up = jumped.select(F.col("v").alias("w"), F.col("p").alias("q"))
            parents = scratch.keep(jumped.join(up, F.col("p") == F.col("w")).select("v", F.col("q").alias("p")), "parents", small=True)
            made = [hooks, jumped, parents]
        moved = parents.select(F.col("v").alias("id"), F.col("p").alias("component"))
        if names is not None:
            moved = names.join(parents, F.col("component") == F.col("v"), "left").select("id", F.coalesce("p", "component").alias("component"))
        old_names, names = names, scratch.keep(moved, "names", small=True)
        old_edges = edges
        if left <= local_edges:
            left = 0
        else:
            at_a = edges.join(parents.select(F.col("v").alias("va"), F.col("p").alias("pa")), F.col("a") == F.col("va")).select("pa", "b")
            at_b = at_a.join(parents.select(F.col("v").alias("vb"), F.col("p").alias("pb")), F.col("b") == F.col("vb")).where("pa <> pb")
            edges = scratch.keep(at_b.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", small=True)
            left = edges.count()
            made.append(old_edges)
        scratch.drop(*made, *([old_names] if old_names is not None else []))
    scratch.drop(edges)
    if names is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    return names

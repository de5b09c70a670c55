"""Minimum spanning forests by Borůvka's rounds, as joins and sums.

In each round every component takes the least of the edges that leave it, by (weight, u, v), a total order, so that the forest is one and the same however rows lie. Components hang on the one at the other
end; of two that took the same edge the lesser becomes the root. Pointers are halved until all point at roots. Edges inside a component go. There are at most log2(n) rounds,
each of a few sums and joins on node numbers; a node with very many edges is an ordinary skewed key, and its least edge is taken map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.store import Workspace


def _roots(parent: DataFrame, store: Workspace) -> DataFrame:
    """node, root of a table node, up in which roots point at themselves."""
    while True:
        above = parent.select(F.col("node").alias("n"), F.col("up").alias("top"))
        step = store.save(parent.join(above, F.col("up") == F.col("n"), "left").select("node", F.col("up").alias("old"), F.coalesce("top", "up").alias("up")), "pointers")
        moved = not step.where("old <> up").isEmpty()
        store.drop(*([parent] if hasattr(parent, "_stored_at") else []))
        at = step._stored_at
        parent = step.select("node", "up")
        parent._stored_at = at
        if not moved:
            return parent.select("node", F.col("up").alias("root"))


def spanning_forest(edges: DataFrame, store: Workspace) -> DataFrame:
    """u, v, w of the forest over ``edges`` (u, v, w; u and v long); of several edges of two nodes the least counts, and an edge from a node to itself doesn't."""
    plain = edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    left = store.save(plain.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "edges")
    kept = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("cu").alias("node"), F.col("cv").alias("other")), F.struct(F.col("cv").alias("node"), F.col("cu").alias("other")))).alias("e"), "w", "u", "v")
        least = store.save(ends.groupBy("e.node").agg(F.min(F.struct("w", "u", "v", F.col("e.other").alias("other"))).alias("m")).select("node", "m.*"), "least")
        taken = least.select("u", "v", "w").distinct()
        kept = store.save(taken, "taken") if kept is None else store.save(kept.unionByName(taken), "taken")
        back = least.select(F.col("node").alias("n"), F.col("other").alias("o"))
        hung = least.join(back, F.col("other") == F.col("n")).select("node", F.when((F.col("o") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("up"))
        roots = _roots(store.save(hung, "hung"), store)
        a, b = (roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "uv")
        new = left.join(a, F.col("cu") == F.col("nu")).join(b, F.col("cv") == F.col("nv")).where("ru <> rv").select("u", "v", "w", F.col("ru").alias("cu"), F.col("rv").alias("cv"))
        new = store.save(new, "edges")
        store.drop(left)
        left = new
    return left.select("u", "v", "w") if kept is None else kept

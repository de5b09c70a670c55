"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A document's size is its number of words (runs of characters other than space, tab, \\n, \\v, \\f, \\r; null: 0). Sources, by code point with null
last, weigh 1, 2, 3, repeating, and share the words of all documents by weight, none above ``MAX_REPEATS`` times its own
words; what is over is shared anew among the others.

A source with target t and s words takes every document floor(t / s) times for certain. The
rest of the target is drawn: document i is included with probability min(1, k * f), f being its factor, with k such that the expected words are those of the rest; those with probability 1 are taken for certain, and
k is that of the others. With U even in (0, 1) and made from the doc_id, the text and a seed, the others are ranked by the
odds U / (1 - U) over the odds of their inclusion, and taken from the least rank on until the words taken come as near to the
rest as whole documents can. The factor is 2 size / (size + mean size of the source), so that long documents, which hold more connected text, go before
short ones; ``inclusion`` may be another one, which should have few distinct values (they are sorted by source to find k, as sizes are).

No source is brought together in one task: ranks are cut into buckets, words are summed by (source, bucket) with map-side sums, and only the bucket in which the
rest ends is cut again, ``LEVELS`` times, before distinct rows are ordered one by one. Equal rows (doc_id, source and text) rank as one with their number; if the draw ends among them, as many as fit are taken, the first
in a saved table of these rows alone. Reruns agree. Sources of no words have target 0. No documents: no rows.
Extra columns are ignored by ``mix`` and carried by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace

MAX_REPEATS, WEIGHTS = 3, 3
BUCKETS, LEVELS = 1024, 2


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, weights: int = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target: one row per source of ``sizes(source, size)``.

    Sources fill up in the order of their limit per weight, so the level at which the others stand follows from sums before each.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    by = by.withColumn("limit", max_repeats * F.col("source_size")).withColumn("per", F.col("limit") / F.col("weight"))
    before = Window.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("words_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    by = by.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    by = by.withColumn("level", F.when(F.col("per") > F.col("words_left") / F.col("weight_left"), F.col("words_left") / F.col("weight_left")))
    by = by.withColumn("level", F.first("level", True).over(Window.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("per") <= F.col("level")), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def by_size() -> Column:
    """The factor of a document's share: 2 size / (size + mean size of its source)."""
    return F.try_divide(F.lit(2.0) * F.col("mix_size"), F.col("mix_size") + F.col("source_size") / F.col("n_docs"))


def _even(seed: str, doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of a digest of doc_id and text."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _own(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """mix_id, mix_source, mix_size and mix_u of each row."""
    return docs.select(
        *more, F.col("doc_id").cast("long").alias("mix_id"), F.col("source").cast("string").alias("mix_source"), size_of(F.col("text")).alias("mix_size"), _even(seed, F.col("doc_id").cast("long"), F.col("text")).alias("mix_u")
    )


def _factored(rows: DataFrame, plan: DataFrame, inclusion: Column | None) -> DataFrame:
    """``rows`` with source_size, target, whole, rest (words left to draw) and factor."""
    rows = rows.join(plan, F.col("mix_source").eqNullSafe(F.col("source")), "left")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(share).cast("long"))
    rest = F.when(share > F.col("whole"), F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    factor = F.when((rest > 0) & (F.col("mix_size") > 0), F.coalesce(by_size() if inclusion is None else inclusion, F.lit(0.0)))
    return rows.withColumns({"rest": rest, "factor": F.coalesce(factor, F.lit(0.0))})


def _scales(rows: DataFrame, store: Workspace) -> DataFrame:
    """c (source), scale and least_certain: inclusion is scale times the factor, and certain for factors over ``least_certain``; ``rows`` come from ``_factored``."""
    by = rows.where("factor > 0").groupBy("source", "factor").agg(F.sum("mix_size").alias("words"), F.first("rest").alias("rest"))
    down = Window.partitionBy("source").orderBy(F.desc("factor"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("open", F.col("rest") - before).withColumn("weighed", F.sum(F.col("factor") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    # the greatest factor that is not certain, once all greater ones are
    first = by.where("open * factor < weighed").groupBy("source").agg(F.max(F.struct("factor", "open", "weighed")).alias("m"))
    return store.save(first.select(F.col("source").alias("c"), (F.greatest("m.open", F.lit(0.0)) / F.col("m.weighed")).alias("scale"), F.col("m.factor").alias("least_certain")), "scales")


def _ranked(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """``rows`` of ``_factored`` with drawn (whether the draw decides) and rank, in [0, 1]."""
    rows = rows.join(scales, F.col("mix_source").eqNullSafe(F.col("c")), "left")
    q = F.col("scale") * F.col("factor")
    odds = (F.col("mix_u") / (1 - F.col("mix_u"))) / (q / (1 - q))
    certain = F.col("scale").isNull() | (F.col("factor") > F.col("least_certain"))
    rank = F.when(certain, 0.0).when(q > 0, odds / (1 + odds)).otherwise(1.0)
    return rows.withColumns({"drawn": F.col("factor") > 0, "rank": rank}).drop("c", "scale", "least_certain", "n_docs", "factor")


def _cuts(rows: DataFrame, store: Workspace) -> DataFrame:
    """s (source), path, last, fit and all: the bucket in which a source's draw ends, the last of the rows drawn there and how many of those that equal it fit; ``rows`` come from ``_ranked``."""
    open_rows = rows.where("drawn").select("mix_id", "mix_u", "source", F.col("mix_size").alias("size"), "rank", "rest")
    cuts = None
    for level in range(1, LEVELS + 1):
        fine = open_rows.withColumn("path", F.floor(F.col("rank") * float(BUCKETS**level)).cast("long"))
        words = fine.groupBy("source", "path").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        if cuts is None:
            words = words.withColumn("base", F.lit(0).cast("long"))
        else:
            old = cuts.select(F.col("source").alias("s"), "base")
            words = words.join(old, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        upto = Window.partitionBy("source").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
        words = words.withColumn("total", F.col("base") + F.sum("words").over(upto))
        # the first bucket by whose end the words reach the rest
        found = words.where("total >= rest").groupBy("source").agg(F.min(F.struct("path", (F.col("total") - F.col("words")).alias("base"))).alias("cut"))
        cuts = store.save(found.select("source", "cut.path", "cut.base"), f"cut{level}")
        here = cuts.select(F.col("source").alias("s"), F.col("path").alias("cut"))
        open_rows = fine.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.col("path") == F.col("cut"))).drop("s", "cut")

    # the bucket that holds the cut, distinct row by row; the next document is taken if that brings the words nearer
    base = cuts.select(F.col("source").alias("s"), F.col("base"))
    tail = open_rows.groupBy("source", "rank", "mix_id", "mix_u", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("rank", "mix_id", "mix_u", "size").rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.join(base, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tail = tail.withColumn("before", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
    fit = F.floor((2 * F.col("rest") - 2 * F.col("before") - F.col("size")) / (2 * F.col("size"))) + 1
    tail = tail.withColumn("fit", F.least(F.greatest(fit, F.lit(0)), F.col("n")).cast("long")).where("fit > 0")
    taken = tail.groupBy("source").agg(F.max(F.struct("rank", "mix_id", "mix_u", "size", "fit", "n")).alias("last"))
    ends = cuts.join(taken.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left")
    last = F.when(F.col("last").isNotNull(), F.struct("last.rank", "last.mix_id", "last.mix_u", "last.size"))
    return store.save(ends.select(F.col("source").alias("s"), "path", last.alias("last"), F.col("last.fit").alias("fit"), F.col("last.n").alias("all")), "ends")


def _first(rows: DataFrame, store: Workspace) -> DataFrame:
    """Of saved rows that all equal the last of their source, ``more``: whether one is among the first ``fit``; counted by partition, then within one."""
    numbered = store.save(rows.withColumn("mix_row", F.monotonically_increasing_id()), "tied")
    part = F.shiftright("mix_row", 33)
    many = numbered.groupBy(F.col("mix_source").alias("ps"), part.alias("part")).agg(F.count(F.lit(1)).alias("here"), F.first("fit").alias("fit"))
    before = Window.partitionBy("ps").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("room", F.col("fit") - F.coalesce(F.sum("here").over(before), F.lit(0)))
    full, cut = many.where("room >= here").select("ps", "part"), many.where("room > 0 and room < here").select("ps", "part", "room")
    of = lambda t: F.col("mix_source").eqNullSafe(F.col("ps")) & (part == F.col("part"))
    some = numbered.join(cut, of(cut)).withColumn("k", F.row_number().over(Window.partitionBy("ps", "part").orderBy("mix_row"))).where("k <= room").select("mix_row")
    chosen = numbered.join(full, of(full)).select("mix_row").unionByName(some).withColumnRenamed("mix_row", "chosen")
    return numbered.join(chosen, F.col("mix_row") == F.col("chosen"), "left").withColumn("more", F.col("chosen").isNotNull()).drop("mix_row", "chosen")


def _copied(rows: DataFrame, ends: DataFrame, store: Workspace) -> DataFrame:
    """``rows`` of ``_ranked`` with copies; only tables of one row for each source are joined, but for rows of which some fit and some don't."""
    rows = rows.join(ends, F.col("mix_source").eqNullSafe(F.col("s")), "left")
    bucket = F.floor(F.col("rank") * float(BUCKETS**LEVELS)).cast("long")
    own = F.struct(F.col("rank"), F.col("mix_id"), F.col("mix_u"), F.col("mix_size").alias("size"))
    more = F.when(~F.col("drawn"), False).when(F.col("path").isNull(), True).when(bucket != F.col("path"), bucket < F.col("path")).otherwise(F.coalesce(own <= F.col("last"), F.lit(False)))
    rows = rows.withColumn("more", more)
    if not ends.where("fit < all").isEmpty():
        tied = F.col("drawn") & F.coalesce((F.col("fit") < F.col("all")) & own.eqNullSafe(F.col("last")), F.lit(False))
        rows = rows.where(~tied).unionByName(_first(rows.where(tied), store).select(rows.columns))
    return rows.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0).cast("long")) + F.col("more").cast("long"))


def _planned(docs: DataFrame, seed: str, inclusion: Column | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Workspace]:
    """(rows with ranks, targets, scales, ends, where they are kept)"""
    store = Workspace(docs.sparkSession, "mix")
    rows = store.save(_own(docs, seed), "sizes")
    plan = store.save(targets(rows.select(F.col("mix_source").alias("source"), F.col("mix_size").alias("size"))), "targets")
    rows = _factored(rows, plan, inclusion)
    scales = _scales(rows, store)
    rows = _ranked(rows, scales)
    return rows, plan, scales, _cuts(rows, store), store


def mix(docs: DataFrame, seed: str = "mix", inclusion: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted) of every row of ``docs``."""
    rows, _, _, ends, store = _planned(docs, seed, inclusion)
    out = _copied(rows, ends, store)
    return out.select(F.col("mix_id").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", inclusion: Column | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they were, each as often as the mix takes it.

    A document's share follows from its own columns and its source's row, so texts are never exchanged, but for those of equal rows among which a draw ends.
    """
    _, plan, scales, ends, store = _planned(docs, seed, inclusion)
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = _ranked(_factored(_own(docs, seed, every.alias("mix_row_of_docs")), plan, inclusion), scales)
    rows = _copied(rows, ends, store).where("copies > 0")
    return rows.select("mix_row_of_docs", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("mix_row_of_docs.*")

"""Classification of the differences between a computed and an expert's outline, and the report on it."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane
from terraloom.operators import spatial_join as sj
from terraloom.operators.components import components
from terraloom.operators.coverage import coverage
from terraloom.store import Workspace

#: Land-use classes by which patches are told to be industrial or residential.
INDUSTRIAL = ("AX_IndustrieUndGewerbeflaeche",)
RESIDENTIAL = ("AX_Wohnbauflaeche", "AX_FlaecheGemischterNutzung", "AX_FlaecheBesondererFunktionalerPraegung")
#: Classes in the order in which a patch is tried for them, by sign.
ORDER = {
    "POS": ("IndCom", "Resid", "Holes", "SettBody", "LargeEmptyAreas", "BdgEdge", "EmptyAreas", "LowDensBdgGrp"),
    "NEG": ("IndCom", "Resid", "Holes", "SettBody", "LargeEmptyAreas", "BdgEdge", "EmptyAreas", "LowDensBdgGrp"),
}


class Limits(NamedTuple):
    upper: float = 15.0
    lower: float = 3.0
    least_area: float = 250.0
    large: float = 10000.0
    share: float = 50.0


PATCH = f"sign string, ugb long, ibs long, part int, is_hole boolean, shape {g.POLYGON}"


def difference_patches(computed: DataFrame, expert: DataFrame, store: Workspace) -> DataFrame:
    """pid, sign (POS: computed only, NEG: expert only), is_hole, body, shape, bounds, is_box, shape_len, shape_area of each single part of the symmetric difference.

    Outlines that meet, directly or through others, are overlaid together. ``is_hole``: the patch is identical to a hole of the other outline.
    ``body``: the whole outline from which the patch comes meets no other one.
    """
    a = computed.select(F.col("fid").alias("ugb"), "bounds", "shape", "is_box")
    b = expert.select(F.col("fid").alias("ibs"), "bounds", "shape", "is_box")
    met = store.save(sj.refine(sj.pairs(a, b)).select(F.col("a.ugb").alias("ugb"), F.col("b.ibs").alias("ibs")), "met")
    # computed outlines are even nodes, the expert's odd ones
    roots = components(met.select((F.col("ugb") * 2).alias("u"), (F.col("ibs") * 2 + 1).alias("v")), store)
    every = a.select((F.col("ugb") * 2).alias("id"), "ugb", F.lit(None).cast("long").alias("ibs"), "shape").unionByName(b.select((F.col("ibs") * 2 + 1).alias("id"), F.lit(None).cast("long").alias("ugb"), "ibs", "shape"))
    every = every.join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("cluster"), "ugb", "ibs", "shape")

    def overlay(rows: pd.DataFrame) -> pd.DataFrame:
        own, other = rows[rows["ugb"].notna()], rows[rows["ibs"].notna()]
        one, two = [plane.as_polygon(s) for s in own["shape"]], [plane.as_polygon(s) for s in other["shape"]]
        out = []
        for sign, parts, sources, opposite, keys in (("POS", 0, one, two, own["ugb"].tolist()), ("NEG", 1, two, one, other["ibs"].tolist())):
            found = plane.symmetric_difference(one, two)[parts]
            holes = {plane.canonical(plane._straight(plane.Polygon(h, [])).shell) for p in opposite for h in p.holes}
            for k, p in enumerate(sorted(found, key=lambda q: min(q.shell))):
                x, y = plane.inside_point(p)
                home = next(int(key) for key, s in zip(keys, sources, strict=True) if plane.holds(s, x, y))
                hole = not p.holes and plane.canonical(p.shell) in holes
                out.append({"sign": sign, "ugb": home if sign == "POS" else None, "ibs": home if sign == "NEG" else None, "part": k, "is_hole": hole, "shape": plane.as_struct(p)})
        return pd.DataFrame(out, columns=["sign", "ugb", "ibs", "part", "is_hole", "shape"]).astype({"ugb": "Int64", "ibs": "Int64"})

    patches = every.groupBy("cluster").applyInPandas(overlay, PATCH)
    touched = met.select(F.col("ugb").alias("tu")).distinct()
    touched_expert = met.select(F.col("ibs").alias("ti")).distinct()
    patches = patches.join(touched, F.col("ugb") == F.col("tu"), "left").join(touched_expert, F.col("ibs") == F.col("ti"), "left")
    body = F.when(F.col("sign") == "POS", F.col("tu").isNull()).otherwise(F.col("ti").isNull())
    pid = F.concat_ws("_", "sign", F.coalesce("ugb", "ibs").cast("string"), F.col("part").cast("string"))
    patches = patches.select(pid.alias("pid"), "sign", F.coalesce("ugb", "ibs").alias("source"), "is_hole", body.alias("body"), "shape")
    return patches.withColumns({"bounds": g.bounds(F.col("shape.shell")), "is_box": g.is_box(F.col("shape")), "shape_len": g.perimeter(F.col("shape")), "shape_area": g.area(F.col("shape"))})


def land_share(patches: DataFrame, landuse: DataFrame, classes: tuple[str, ...], name: str) -> DataFrame:
    """``pid`` and, under ``name``, the percentage of a patch that land of these classes takes; land parts don't overlap."""
    some = landuse.where(F.col("objart_txt").isin(*classes)).select("bounds", "shape", "is_box")
    met = sj.pairs(patches.select("pid", "bounds", "shape", "is_box", "shape_area"), some, strict=True)

    @F.pandas_udf("double")
    def shared(sa: pd.Series, ha: pd.Series, sb: pd.Series, hb: pd.Series) -> pd.Series:
        both = zip(sa, ha, sb, hb, strict=True)
        return pd.Series([0.0 if a is None else sum(map(plane.area, plane.intersection([sj._polygon(a, b)], [sj._polygon(c, d)]))) for a, b, c, d in both], dtype=float)

    box = F.col("a.is_box") & F.col("b.is_box")
    area = F.when(box, sj.shared_box_area(F.col("a.bounds"), F.col("b.bounds"))).otherwise(shared(*sj._shapes()))
    total = met.select(F.col("a.pid").alias("p"), F.col("a.shape_area").alias("whole"), area.alias("area")).groupBy("p").agg((F.sum("area") / F.first("whole") * 100).alias(name))
    return patches.join(total, F.col("pid") == F.col("p"), "left").select("pid", F.coalesce(name, F.lit(0.0)).alias(name))


def classified(patches: DataFrame, buildings: DataFrame, landuse: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Patches of the least area or more with overlap, ind_ratio, res_ratio and error_class, the first class that fits."""
    some = patches.where(F.col("shape_area") >= limits.least_area)
    out = coverage(some, buildings, "pid")
    for classes, name in ((INDUSTRIAL, "ind_ratio"), (RESIDENTIAL, "res_ratio")):
        share = land_share(some, landuse, classes, name).withColumnRenamed("pid", "__p")
        out = out.join(share, F.col("pid") == F.col("__p")).drop("__p")
    area, overlap = F.col("shape_area"), F.col("overlap")
    built = (area > limits.large) & (overlap > limits.upper)
    rules = {
        "IndCom": built & (F.col("ind_ratio") >= limits.share),
        "Resid": built & (F.col("res_ratio") >= limits.share),
        "Holes": F.col("is_hole") & (overlap < limits.lower),
        "SettBody": F.col("body"),
        "LargeEmptyAreas": (overlap <= limits.lower) & (area > limits.large),
        "BdgEdge": overlap > limits.upper,
        "EmptyAreas": overlap <= limits.lower,
        "LowDensBdgGrp": (overlap > limits.lower) & (overlap <= limits.upper),
    }
    cases = None
    for name in ORDER["POS"]:
        cases = F.when(rules[name], name) if cases is None else cases.when(rules[name], name)
    return out.withColumn("error_class", cases)


def report(patches: DataFrame, classes: DataFrame) -> DataFrame:
    """sign, error_class, frequency, area_ha, share_pct. ``All`` counts every patch; what has no class, small patches too, is ``Unclassified``."""
    total = patches.groupBy("sign").agg(F.count("*").alias("all_n"), F.sum("shape_area").alias("all_area"))
    found = classes.groupBy("sign", "error_class").agg(F.count("*").alias("n"), F.sum("shape_area").alias("area"))
    every = total.select("sign", F.lit("All").alias("error_class"), F.col("all_n").alias("n"), F.col("all_area").alias("area"))
    known = found.groupBy(F.col("sign").alias("ks")).agg(F.sum("n").alias("kn"), F.sum("area").alias("ka"))
    rest = total.join(known, F.col("sign") == F.col("ks"), "left").select("sign", F.lit("Unclassified").alias("error_class"), (F.col("all_n") - F.coalesce("kn", F.lit(0))).alias("n"), (F.col("all_area") - F.coalesce("ka", F.lit(0.0))).alias("area"))
    rows = every.unionByName(found).unionByName(rest).join(total.select(F.col("sign").alias("ts"), "all_area"), F.col("sign") == F.col("ts"))
    return rows.select("sign", "error_class", F.col("n").alias("frequency"), F.round(F.col("area") / 10000).cast("long").alias("area_ha"), F.round(F.col("area") / F.col("all_area") * 100, 1).alias("share_pct"))


def printed(rows: DataFrame) -> str:
    """The report as a table of fixed width."""
    lines = [f"{'sign':<5}{'class':<18}{'count':>8}{'ha':>8}{'share %':>9}"]
    for r in rows.orderBy("sign", "error_class").collect():
        lines.append(f"{r.sign:<5}{r.error_class:<18}{r.frequency:>8}{r.area_ha:>8}{r.share_pct:>9.1f}")
    return "\n".join(lines)

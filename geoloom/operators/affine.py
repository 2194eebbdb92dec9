"""Image calibration: affine fits and their use on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col


def fit_affine(
    df: DataFrame, image: str, px: str, py: str, targets: dict[str, str]
) -> DataFrame:
    """Least-squares coefficients (a, b, c) of ``target = a*px + b*py + c`` per image.

    ``targets`` maps an output prefix to a target column. Only sums leave the
    map side. Pixels are centred on their image mean by identity of the sums, and
    images with fewer than four control points or collinear pixels give NULL.
    """
    x, y = F.col(px).cast("double"), F.col(py).cast("double")
    aggs = {
        "__n": F.count(F.lit(1)).cast("double"),
        "__sx": F.sum(x), "__sy": F.sum(y),
        "__sxx": F.sum(x * x), "__sxy": F.sum(x * y), "__syy": F.sum(y * y),
    }
    for p, t in targets.items():
        v = F.col(t).cast("double")
        aggs |= {f"__{p}t": F.sum(v), f"__{p}xt": F.sum(x * v), f"__{p}yt": F.sum(y * v)}
    g = df.groupBy(image).agg(*[v.alias(k) for k, v in aggs.items()])
    n = F.col("__n")
    cxx = F.col("__sxx") - F.col("__sx") * F.col("__sx") / n
    cyy = F.col("__syy") - F.col("__sy") * F.col("__sy") / n
    cxy = F.col("__sxy") - F.col("__sx") * F.col("__sy") / n
    g = g.withColumns({"__cxx": cxx, "__cyy": cyy, "__cxy": cxy})
    det = F.col("__cxx") * F.col("__cyy") - F.col("__cxy") * F.col("__cxy")
    g = g.withColumn("__det", F.when((n >= 4) & (det > 1e-12 * F.col("__cxx") * F.col("__cyy")), det))
    out = []
    for p in targets:
        cxt = F.col(f"__{p}xt") - F.col("__sx") * F.col(f"__{p}t") / n
        cyt = F.col(f"__{p}yt") - F.col("__sy") * F.col(f"__{p}t") / n
        a = (cxt * F.col("__cyy") - cyt * F.col("__cxy")) / F.col("__det")
        b = (cyt * F.col("__cxx") - cxt * F.col("__cxy")) / F.col("__det")
        c = F.col(f"__{p}t") / n - a * F.col("__sx") / n - b * F.col("__sy") / n
        out += [a.alias(f"{p}_a"), b.alias(f"{p}_b"), c.alias(f"{p}_c")]
    return g.select(image, *out)


def apply_affine(px: ColumnOrName, py: ColumnOrName, prefix: str) -> Column:
    return F.col(f"{prefix}_a") * col(px) + F.col(f"{prefix}_b") * col(py) + F.col(f"{prefix}_c")


def invert_affine(e: ColumnOrName, n: ColumnOrName, east: str = "e", north: str = "n") -> tuple[Column, Column]:
    """Pixel position of projected coordinates; NULL when the fit is singular."""
    a, b, c = (F.col(f"{east}_{k}") for k in "abc")
    d, f, g = (F.col(f"{north}_{k}") for k in "abc")
    det = a * f - b * d
    de, dn = col(e) - c, col(n) - g
    safe = F.when(det != 0, det)
    return (f * de - b * dn) / safe, (a * dn - d * de) / safe

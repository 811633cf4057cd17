"""Distances as columns: whole-stage code, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.arrays import let, total

# fixed values: Hart's (1968) rational approximation of the normal tail as given by West (2005)
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_NEAR, TAIL_FAR, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631
# fixed values: shift of means and variances, least variance, and variances that count as equal
SHIFT, LEAST_VARIANCE, SAME_VARIANCE = 1e-7, 1.0, 1e-4
FLOOR = 1e-9


def horner(a: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * a + F.lit(t)
    return out


def normal_cdf(x: Column, a: Column) -> Column:
    """The standard normal distribution function of *x*, whose absolute value is *a*, to about 2e-16."""
    e = F.exp(-a * a / 2)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + F.lit(0.65)))))
    tail = F.when(a > TAIL_FAR, 0.0).when(a < TAIL_NEAR, e * horner(a, TAIL_TOP) / horner(a, TAIL_BOTTOM)).otherwise(e / far / ROOT_TWO_PI)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def with_overlap_area(df: DataFrame, mean_a: str, var_a: str, mean_b: str, var_b: str, out: str = "area", strict: bool = False) -> DataFrame:
    """*df* with the area between the normal densities of one sample's depths in two contigs; null if the sample tells nothing.

    Means and variances are shifted by 1e-7, variances raised to 1. A sample where
    both means are absent tells nothing. *strict* gives the area of two nearly equal
    variances its sign (the first argument's side on ties) and skips equal means
    altogether; else the area is positive, and equal means of equal variances are as
    near as can be. Null means or variances give null.

    The formula is laid out in stages, as one expression it would repeat its parts
    beyond what can be compiled.
    """
    c = lambda n: F.col(f"__{n}")
    whole = reduce(lambda x, y: x & y, (F.col(n).isNotNull() for n in (mean_a, var_a, mean_b, var_b)))
    rows = df.withColumns({"__ma": F.col(mean_a) + SHIFT, "__mb": F.col(mean_b) + SHIFT, "__va": F.greatest(F.col(var_a) + SHIFT, F.lit(LEAST_VARIANCE)), "__vb": F.greatest(F.col(var_b) + SHIFT, F.lit(LEAST_VARIANCE))})
    gap = c("va") - c("vb")
    root = F.sqrt(c("va") * c("vb") * ((c("ma") - c("mb")) * (c("ma") - c("mb")) - 2 * gap * F.ln(F.sqrt(c("vb") / c("va")))))
    rows = rows.withColumns({"__same": F.abs(gap) < SAME_VARIANCE, "__root": root, "__swap": c("va") > c("vb")})
    safe, middle = F.when(c("same"), F.lit(1.0)).otherwise(gap), (c("ma") + c("mb")) / 2
    pick = lambda x, y: F.when(c("swap"), c(y)).otherwise(c(x))
    rows = rows.withColumns(
        {
            "__k1": F.when(c("same"), middle).otherwise((c("root") - c("ma") * c("vb") + c("mb") * c("va")) / safe),
            "__k2": F.when(c("same"), middle).otherwise((c("root") + c("ma") * c("vb") - c("mb") * c("va")) / -safe),
            "__m1": pick("ma", "mb"), "__s1": F.sqrt(pick("va", "vb")), "__m2": pick("mb", "ma"), "__s2": F.sqrt(pick("vb", "va")),
        }
    )
    low, high = F.least(c("k1"), c("k2")), F.greatest(c("k1"), c("k2"))
    points = {"__z1": (low - c("m1")) / c("s1"), "__z2": (low - c("m2")) / c("s2"), "__z3": (high - c("m1")) / c("s1"), "__z4": (high - c("m2")) / c("s2")}
    rows = rows.withColumns(points)
    rows = rows.withColumns({f"__a{i}": F.abs(c(f"z{i}")) for i in range(1, 5)})
    rows = rows.withColumns({f"__f{i}": normal_cdf(c(f"z{i}"), c(f"a{i}")) for i in range(1, 5)})
    single = c("f1") - c("f2")
    rows = rows.withColumn("__area", F.when(F.abs(c("k1") - c("k2")) < SHIFT, single if strict else F.abs(single)).otherwise(F.abs(c("f3") - c("f1") + c("f2") - c("f4"))))
    told = whole & ((c("ma") > SHIFT) | (c("mb") > SHIFT))
    area = F.when(told & (c("ma") != c("mb")), c("area")) if strict else F.when(told, F.greatest(F.when((c("ma") == c("mb")) & c("same"), F.lit(0.0)).otherwise(c("area")), F.lit(FLOOR)))
    return rows.withColumn(out, area).drop(*(n for n in rows.columns if n.startswith("__") and n not in df.columns))


def coverage_distance(area: Column) -> Column:
    """Geometric mean of the areas of a pair's samples (an aggregate); 1 for none or for a negative area, 0 for an area of 0."""
    log = F.when(area == 0, F.lit(float("-inf"))).when(area < 0, F.lit(float("nan"))).otherwise(F.ln(area))
    mean = F.exp(F.avg(log))
    return F.when(mean.isNull() | F.isnan(mean), 1.0).otherwise(mean)


def euclidean(x: Column, y: Column) -> Column:
    """Of two arrays; null if either is null or their lengths differ."""
    return F.when(F.size(x) == F.size(y), F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))))


def proportionality(x: Column, y: Column) -> Column:
    """(1 - rho) / 2 of two arrays: 0 if neither varies, 1 if the centred product is 0 or anything is NaN."""
    n = F.size(x).cast("double")

    def centred(z: Column) -> Column:
        return let(total(z) / n, lambda m: F.transform(z, lambda v: v - m))

    def rho(c: Column, e: Column) -> Column:
        square = lambda z: total(F.transform(z, lambda v: v * v))
        parts = F.struct(total(F.zip_with(c, e, lambda a, b: a * b)).alias("dot"), (square(c) + square(e)).alias("both"))
        return let(
            parts,
            lambda p: F.when(p["both"] == 0, 0.0).when((p["dot"] == 0) | F.isnan(p["dot"]) | F.isnan(p["both"]), 1.0).otherwise(F.lit(0.5) - F.try_divide(p["dot"], p["both"])),
        )

    value = let(centred(x), lambda c: let(centred(y), lambda e: rho(c, e)))
    return F.when((n > 0) & (F.size(x) == F.size(y)), value)


def sketch_metrics(common: Column, n_a: Column, n_b: Column, k: int = 31) -> dict[str, Column]:
    """Containment of a in b's size, Jaccard index, minimum Jaccard index, and the mash distance for k-mers of size *k*."""
    common = common.cast("double")
    total = n_a + n_b - common
    jaccard = F.when(total == 0, 1.0).otherwise(F.try_divide(common, total))
    least = F.when((n_a == 0) & (n_b == 0), 1.0).otherwise(F.try_divide(common, F.least(n_a, n_b)))
    inner = F.try_divide(2 * jaccard, 1 + jaccard)
    mash = F.when(jaccard == 0, 1.0).otherwise(F.least(F.greatest(-F.ln(inner) / k, F.lit(0.0)), F.lit(1.0)))
    return {
        "containment": F.when(n_b == 0, 0.0).otherwise(F.try_divide(common, n_b)),
        "jaccard": jaccard,
        "min_jaccard": least,
        "mash_distance": mash,
        "sketch_distance": F.coalesce(1 - least, F.lit(1.0)),
    }


def percentage(x: Column) -> Column:
    """1 to 100 as hundredths, [0, 1) as it is; an error below 0 or above 100, null for null."""
    bad = F.raise_error(F.concat(F.lit("not a percentage: "), x.cast("string"))).cast("double")
    return F.when(x.isNull(), None).when((x < 0) | (x > 100) | F.isnan(x), bad).when(x >= 1, x / 100).otherwise(x)

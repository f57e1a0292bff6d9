"""Vector expressions on ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either side has zero length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term-frequency vectors of two token arrays.

    The squared norm follows from the run lengths of the sorted tokens, and the dot product
    from the norm of both arrays together: |a + b|^2 = |a|^2 + |b|^2 + 2 ab.
    """

    def squares(tokens: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

        def step(s: Column, t: Column) -> Column:
            run = F.when(s["token"] == t, s["run"]).otherwise(F.lit(0).cast("long"))
            return F.struct(t.alias("token"), (run + 1).alias("run"), (s["sum"] + 2 * run + 1).alias("sum"))

        return F.aggregate(F.array_sort(tokens), start, step, lambda s: s["sum"])

    def ratio(v: Column) -> Column:
        dot_product = ((squares(F.concat(v["a"], v["b"])) - v["x"] - v["y"]) / 2).cast("double")
        return F.coalesce(F.try_divide(dot_product, F.sqrt(v["x"].cast("double")) * F.sqrt(v["y"].cast("double"))), F.lit(0.0))

    both = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda v: F.struct(
        v["a"].alias("a"), v["b"].alias("b"), squares(v["a"]).alias("x"), squares(v["b"]).alias("y")))
    return F.transform(both, ratio)[0]

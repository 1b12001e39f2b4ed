"""Names from templates and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_values(spec: Column) -> Column:
    """A list given as an array of strings; one string ``a..b`` or ``a..b..step`` stands for an exclusive range."""
    first = spec[0]
    is_range = (F.size(spec) == 1) & first.rlike(r"^-?\d+\.\.-?\d+(\.\.-?\d+)?$")
    p = F.split(first, r"\.\.")
    a, b = F.try_element_at(p, F.lit(1)).cast("long"), F.try_element_at(p, F.lit(2)).cast("long")
    step = F.coalesce(F.try_element_at(p, F.lit(3)).cast("long"), F.lit(1).cast("long"))
    some = F.when(step > 0, a < b).otherwise(a > b)
    last = F.when(step > 0, b - 1).otherwise(b + 1)
    numbers = F.when(some, F.transform(F.sequence(a, last, step), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(is_range, numbers).otherwise(spec)


def expand_templates(templates: DataFrame, lists: int, group: str = "mtype", order: str = "seq", fields: tuple[str, ...] = ("name", "hook")) -> DataFrame:
    """Each template with ``subs`` (array of lists) once for each element of their product, in list order.

    ``{}`` in a field takes the next list's value and ``{n}`` that of list n. ``idx`` counts within ``group``, in the
    order of templates and of the product. ``lists`` is the most lists any template has.
    """
    out, places = templates, []
    for i in range(lists):
        values = F.coalesce(list_values(F.try_element_at("subs", F.lit(i + 1))), F.array(F.lit("")))
        out = out.select("*", F.posexplode(values).alias(f"_p{i}", f"_v{i}"))
        places.append(f"_p{i}")
    for f in fields:
        c = F.col(f)
        for i in range(lists):
            has = F.size("subs") > i
            c = F.when(has, F.regexp_replace(F.replace(c, F.lit("{%d}" % i), F.col(f"_v{i}")), r"^([^{]*(?:\{\d+\}[^{]*)*)\{\}", F.concat(F.lit("$1"), F.regexp_replace(f"_v{i}", r"([\\$])", r"\\$1")))).otherwise(c)
        out = out.withColumn(f, c)
    w = Window.partitionBy(group).orderBy(order, *places)
    made = [x for i in range(lists) for x in (f"_p{i}", f"_v{i}")]
    return out.withColumn("idx", F.row_number().over(w) - 1).drop(*made)


def param_grid(templates: DataFrame, lists: int, seed: int = 0, pre: str = "", post: str = "") -> DataFrame:
    """``$`` templates: each ``$`` takes the next list's value, in product; the last list gives each name one value.

    The value is drawn by the md5 of seed and name: (name, value, text), text being pre + name = value + post.
    """
    out = templates.withColumn("_names", F.slice("lists", F.lit(1), F.greatest(F.lit(0), F.size("lists") - 1))).withColumn("_values", list_values(F.element_at("lists", -1)))
    for i in range(lists):
        values = F.coalesce(list_values(F.try_element_at("_names", F.lit(i + 1))), F.array(F.lit("")))
        out = out.withColumn(f"_v{i}", F.explode(values))
        out = out.withColumn("name", F.when(F.size("_names") > i, F.regexp_replace("name", r"^([^$]*)\$", F.concat(F.lit("$1"), F.regexp_replace(f"_v{i}", r"([\\$])", r"\\$1")))).otherwise(F.col("name")))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "name")), 1, 8), 16, 10).cast("long") % F.size("_values") + 1
    out = out.select("name", F.element_at("_values", pick.cast("int")).alias("value"))
    return out.withColumn("text", F.concat(F.lit(pre), F.col("name"), F.lit(" = "), F.col("value"), F.lit(post)))

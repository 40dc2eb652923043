"""Reproducible stratified samples: sizes from counts, members by the order of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.numbering import numbered
from weftline.session import cut, small


def lot(seed: str, key: Column) -> Column:
    """The text by whose order rows are drawn; the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def allocate(rows: DataFrame, group: str, stratum: str, size: int, least: int = 10) -> DataFrame:
    """group, stratum, available, wanted.

    A group gets its share of `size`, at least `least` and at most what it has; a stratum its share
    of the group's number, rounded up, at least 1. What rounding adds is taken from the last strata
    of the group, in order. If the sum still differs from `size`, the last strata of all give the
    rest up, or the first ones with rows to spare add it; wanted sums to `size` where there are as
    many rows.
    """
    counts = rows.groupBy(F.col(group).alias("g"), F.col(stratum).alias("s")).agg(F.count("*").alias("available"))
    of_group = Window.partitionBy("g")
    # all windows run over a row per stratum
    everywhere = Window.orderBy("g", "s").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.agg(F.sum("available").alias("n"))
    sized = counts.crossJoin(F.broadcast(whole)).withColumn("g_n", F.sum("available").over(of_group))  # one row
    g_wanted = F.least(F.greatest(F.round(F.lit(size) * F.col("g_n") / F.col("n")), F.lit(least)), F.col("g_n")).cast("bigint")
    s_wanted = F.least(F.greatest(F.ceil(F.col("available") * F.col("g_wanted") / F.col("g_n")), F.lit(1)), F.col("available"))
    first = sized.withColumn("g_wanted", g_wanted).withColumn("s_wanted", s_wanted)
    before = of_group.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    up_to = lambda column, most, taken: F.greatest(F.least(F.col(column), most - taken), F.lit(0)).cast("bigint")
    in_group = first.withColumn("in_group", up_to("s_wanted", F.col("g_wanted"), ahead("s_wanted", before)))
    trimmed = in_group.withColumn("trimmed", up_to("in_group", F.lit(size), ahead("in_group", everywhere)))
    spare = trimmed.withColumn("spare", F.col("available") - F.col("trimmed")).withColumn("lack", F.lit(size) - F.sum("trimmed").over(Window.partitionBy()))
    wanted = F.col("trimmed") + up_to("spare", F.col("lack"), ahead("spare", everywhere))
    return spare.select(F.col("g").alias(group), F.col("s").alias(stratum), "available", wanted.alias("wanted"))


def stratified_sample(rows: DataFrame, key: str, group: str, stratum: str, size: int, seed: str = "42") -> DataFrame:
    """The rows of each stratum that come first in the order of lot(), as many as allocate() wants.

    Rows whose lot lies far behind the wanted share are left out before any ordering, so only about
    as many rows as are wanted are shuffled and ordered, also in a stratum of very many rows. Lots
    belong to keys: where repeated keys leave fewer rows than wanted, the whole stratum is ordered.
    Rows without a key come last.
    """
    plan = allocate(rows, group, stratum, size)
    same = [F.col(group).eqNullSafe(F.col("_g")), F.col(stratum).eqNullSafe(F.col("_s"))]
    planned = cut(plan.where("wanted > 0").select(F.col(group).alias("_g"), F.col(stratum).alias("_s"), "available", "wanted"))
    # behind every md5
    drawn = rows.withColumn("_lot", F.coalesce(lot(seed, F.col(key)), F.lit("g"))).join(small(planned), same)  # a row per stratum
    # for distinct keys, the part of lots below a bound holds the wanted ones but for odds of far less than 1e-9
    bound = (F.col("wanted") + 8 * F.sqrt(F.col("wanted")) + 64) / F.col("available")
    near = F.coalesce(F.conv(F.when(F.col("_lot") < "g", F.substring("_lot", 1, 8)), 16, 10).cast("double") / 4294967296.0, F.lit(1.0)) <= bound
    enough = drawn.where(near).groupBy("_g", "_s").agg(F.count("*").alias("_near"), F.first("wanted").alias("_wanted")).where("_near >= _wanted").select(F.col("_g").alias("_eg"), F.col("_s").alias("_es"), F.lit(True).alias("_enough"))
    enough = cut(enough)
    drawn = drawn.join(small(enough), F.col("_g").eqNullSafe(F.col("_eg")) & F.col("_s").eqNullSafe(F.col("_es")), "left")
    place = Window.partitionBy("_g", "_s").orderBy("_lot", key)
    chosen = drawn.where(near | F.col("_enough").isNull()).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= F.col("wanted"))
    return chosen.select(*rows.columns)


def replacements(sample: DataFrame, frame: DataFrame, key: str, group: str, stratum: str, failed: Column, seed: str = "42") -> DataFrame:
    """failed key, replacement key, level: for each failed row of the sample another row of the frame.

    The k-th failed row of a stratum gets the k-th unused, sound row of the stratum; those left over
    get one of their group, then any. Rows are numbered by lot() in ranges of its order, so no task
    orders a whole stratum, and each level is written before the next begins. A failed row may stay
    without; null groups and strata are matched with none.
    """
    order = [lot(seed, F.col(key)), F.col(key)]
    need = sample.where(failed).select(F.col(key), group, stratum)
    spare = frame.where(~failed).join(sample.select(key), key, "left_anti").select(key, group, stratum)
    done = None
    for level, keys in (("stratum", [group, stratum]), ("group", [group]), ("any", [])):
        a = cut(numbered(need, keys, order).select(F.col(key).alias("failed"), "k", *keys))
        most = a.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
        b = numbered(spare, keys, order).where(F.col("k") <= most)
        hit = cut(a.join(b.select(F.col(key).alias("replacement"), "k", *keys), ["k", *keys]).select("failed", "replacement", F.lit(level).alias("level")))
        done = hit if done is None else done.unionByName(hit)
        need = need.join(hit.select(F.col("failed").alias(key)), key, "left_anti")
        spare = spare.join(hit.select(F.col("replacement").alias(key)), key, "left_anti")
        if need.isEmpty():
            break
    return done

"""Operator 11, mixing sources to target weights.

Sizes are words of whole texts. Each source gets a share of the budget by weight, but no more than `most` times its
size; what is over goes to the others by weight until none is above. A source's target in whole words is taken in
epochs: every document once for each whole epoch, and the rest of the target in the order of hash-random keys of that
epoch, up to the word at which the budget is reached. So a source's words are its target rounded down, exactly.

Keys are uniform, so a source's rows are dealt into ranges of the key of about RANGE rows and sorted in these; the sizes
of a source's earlier ranges, a row per range, are added to the running sums. A source with any share of all rows is
many ranges. Rows that are equal in doc_id, source and text have one key: they are one row with a count until the
end, when copy j starts j sizes later.

Null texts have no words; a null source is a source of its own, the last; a null doc_id is a doc_id like others. Rows
without words stay, with nothing taken. Empty tables give no rows. Which of equal rows is cut does not matter, as they
are equal. Extra columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.draws import numbered

from .common import stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a range of keys, and copies of a row that one task writes.
RANGE = COPIES = 1 << 13
#: Size of the key space: keys are the first 13 hexadecimal digits of an md5.
KEYS = 1 << 52


def hashed(*parts: Column) -> Column:
    """A number below KEYS from texts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    """sources(source, weight, words) with `target`: share[0] / share[1] of all words, by weight, at most `most` times the words.

    A round finds the sources that are above their limit and shares what they leave; one row comes to the driver.
    """
    limit = F.col("words") * most
    total = sources.agg(F.sum("words")).first()[0] or 0
    budget, capped = share[0] * total, -1
    num, den = budget, sources.agg(F.sum("weight")).first()[0] or 0  # a weight's part is num / (share[1] * den)
    while True:
        above = limit * (share[1] * den) < F.col("weight") * num if den else F.lit(True)
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("free")).first()
        if row["n"] == capped or not row["n"] or not den:
            break
        capped, num, den = row["n"], budget - share[1] * row["held"], row["free"]
    part = (F.col("weight") * num).cast("double") / float(share[1] * den) if den else limit.cast("double")
    return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(part))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs of docs(doc_id, source, text).

    Sources take the weights in turn, in order of code points.
    """
    digest = hashed(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), digest.alias("digest"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies")), "sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("rows"))
    placed = numbered(sources.withColumn("all", F.lit(0)).withColumn("unnamed", F.col("source").isNull()), "all", "unnamed", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("t") - 1) % len(weights) + 1).cast("int")).cast("long")
    placed = stored(placed.select("source", "words", "rows", "t", weight.alias("weight")), "sources")
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("words") > 0, F.floor(whole / F.col("words"))).otherwise(0).cast("long")
    aims = targets(placed, share, most).withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("words"))
    aims = aims.withColumn("ranges", F.ceil(F.col("rows") / RANGE)).drop("rows", "weight")

    met = rows.join(aims.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    met = met.withColumn("key", hashed(F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest").cast("string")))
    met = stored(met.withColumn("range", F.floor(F.col("key") / F.lit(float(KEYS)) * F.col("ranges")).cast("long")).drop("ranges", "digest"), "keyed")
    here = F.col("size") * F.col("copies")
    sums = met.groupBy("t", "range").agg(F.sum(here).alias("held"))
    earlier = Window.partitionBy("t").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("t", "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("t", "range").orderBy("key", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = met.withColumn("inside", F.coalesce(F.sum(here).over(inside), F.lit(0))).join(starts, ["t", "range"])
    each = summed.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "epochs", "rest", "copies", (F.col("start") + F.col("inside")).alias("before"))

    def copied(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.withColumn("copy", F.explode(F.sequence(first, last)))

    few = copied(each.where(F.col("copies") <= COPIES), F.lit(0), F.col("copies") - 1)
    blocks = copied(each.where(F.col("copies") > COPIES), F.lit(0), F.floor((F.col("copies") - 1) / COPIES)).withColumnRenamed("copy", "block")
    blocks = blocks.repartition("doc_id", "source", "before", "block")
    many = copied(blocks, F.col("block") * COPIES, F.least((F.col("block") + 1) * COPIES, F.col("copies")) - 1).drop("block")
    out = few.unionByName(many)
    left = F.col("rest") - F.col("before") - F.col("copy") * F.col("size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "epochs")


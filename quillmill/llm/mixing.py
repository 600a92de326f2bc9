"""Mixing sources to target weights.

Documents get hash-random keys, an MD5 of the document's id, which fall evenly over the key range.
Within each source the key range is cut into equal buckets, as many as keep a bucket's rows about
constant; word counts are summed by bucket, and prefix sums over the buckets say in which one a
source's budget ends. Only that bucket of each source is sorted row by row, and a running sum in it
finds the key at which the budget is cut. So a source's part of the mix is known from one row: how
many whole epochs, the key up to which documents are taken once more, and what is left at that key.
Texts are counted once and never shuffled.

Null and blank texts have size 0 and give nothing. A document without an id takes its key from its
text. Rows that share id, source and text lie at one key; if a budget ends there they are taken in
equal parts. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.words import n_words, words
from quillmill.storage import cut, written

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
BUCKET_ROWS = 20_000
#: Most sources whose plan is broadcast.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for a table (source, size).

    Sources in code-point order, null last, weigh WEIGHTS in turn and share the sum of all sizes;
    a target stops at MOST_EPOCHS times its source, and what is left over goes to the others by
    weight. The level of that sharing is found in one pass: sources in order of limit per weight
    are filled until the first whose share fits.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(WEIGHTS) + 1
    weighed = totals.withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), turn - 1).cast("long"))
    weighed = weighed.withColumn("most", F.col("source_size") * MOST_EPOCHS)
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    before = weighed.select(
        "*",
        F.coalesce(F.sum("most").over(filling), F.lit(0)).alias("filled"),
        F.coalesce(F.sum("weight").over(filling), F.lit(0)).alias("weight_filled"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    level = (F.col("all_size") - F.col("filled")) / (F.col("all_weight") - F.col("weight_filled"))
    share = before.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    first = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("filled"))).over(everything)
    target = F.when(F.col("fits"), first * F.col("weight")).otherwise(F.col("most")).cast("double")
    return share.select("source", "source_size", target.alias("target"))


def _key() -> Column:
    """Key of a row by id, else by text; ties of one id are told apart by the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text.cast("binary"))))
    return F.concat(F.md5(F.concat(of, F.lit(f":{SEED}")).cast("binary")), F.lpad(F.hex(F.crc32(text)), 8, "0"))


def plan(sized: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(of, source_size, target, epochs, cut_key, cut_part) for each source of ``sized`` (source, key, size).

    Documents with a key under ``cut_key`` are taken ``epochs`` + 1 times, those over it ``epochs``
    times, and those at it ``epochs`` times and ``cut_part`` words.
    """
    counts = sized.groupBy("source").agg(F.count("*").alias("n_rows"))
    wanted = targets(sized.select("source", "size"))
    wanted = wanted.join(counts, wanted["source"].eqNullSafe(counts["source"])).select(
        wanted["source"].alias("of"), "source_size", "target", F.ceil(F.col("n_rows") / bucket_rows).alias("n_buckets"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    wanted = cut(wanted.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    cell = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.col("n_buckets"))
    placed = sized.filter("size > 0").join(small(wanted), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", cell)
    sums = placed.groupBy("of", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    crossed = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    crossed = cut(crossed.select(F.col("of").alias("c_of"), F.col("bucket").alias("c_bucket"), (F.col("rest") - F.col("before")).alias("left")))
    inside = placed.join(small(crossed), F.col("of").eqNullSafe(F.col("c_of")) & (F.col("bucket") == F.col("c_bucket")))
    ties = inside.groupBy("c_of", "left", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    run = Window.partitionBy("c_of").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    at = ties.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    at = at.select("c_of", F.col("key").alias("cut_key"), F.floor((F.col("left") - F.col("before")) / F.col("n")).cast("long").alias("cut_part"))
    return cut(wanted.join(at, F.col("of").eqNullSafe(F.col("c_of")), "left").select("of", "source_size", "target", "epochs", "cut_key", "cut_part"))


def small(sources: DataFrame) -> DataFrame:
    """A table of a row per source, broadcast if that is proven small."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _taken() -> Column:
    """Words taken of a row with size, key and its source's plan."""
    more = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_part"))
    return (F.col("epochs") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key().alias("key")), "mix-sizes")


def mix(docs: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` is how many of its words the mix takes, repeats counted.
    """
    sized = _sized(docs)
    joined = sized.join(small(plan(sized, bucket_rows=bucket_rows)), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def mixed_documents(docs: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: left out, once, or repeated by epoch.

    A document that the budget cuts is repeated once more with only its first words, joined by
    single spaces, and ``n_chars`` set to match where that column exists.
    """
    names = docs.columns
    planned = plan(_sized(docs), bucket_rows=bucket_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("m_source"), n_words(F.col("text")).alias("size"), _key().alias("key"))
    taken = rows.join(small(planned), F.col("m_source").eqNullSafe(F.col("of"))).withColumn("taken", _taken()).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    left = F.col("taken") - whole * F.col("size")
    lots = F.concat(F.array_repeat(F.col("size"), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    out = taken.select("row", "size", F.explode(lots).alias("lot"))

    def first_words(text: Column) -> Column:
        return F.when(F.col("lot") == F.col("size"), text).otherwise(F.array_join(F.slice(words(text), F.lit(1), F.col("lot").cast("int")), " "))

    columns = [first_words(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    flat = out.select(*columns)
    return flat.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else flat

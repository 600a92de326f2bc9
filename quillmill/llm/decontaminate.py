"""Benchmark decontamination by winnowing.

Each text is a sequence of 5-word hashes. Of every 6 neighbouring hashes, which span 10 words, the
smallest is kept as a fingerprint, the leftmost on ties. A run of 10 words therefore always yields
the same fingerprint at the same offset, in a document as in a benchmark item, so a join on
fingerprints misses no shared window. A hit is extended by comparing the words around it; only
windows that are equal word by word count.

Items of fewer than 10 words have no such window. They are one window each, of their own length,
and are found by whole runs of that length, of all lengths in one pass.

The benchmark is reduced to distinct windows first, each with the items that hold it, so a window
that many items share is met once in a document.

Null and empty texts have no words and are clean; items without words match nothing; a null item_id
counts as the string ``null``. Rows that repeat a doc_id and a text share one verdict. An empty
benchmark leaves all rows clean, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.words import gram_hashes, indices, let
from quillmill.storage import cut

GRAM = 5
SPAN = 10
WINDOW = SPAN - GRAM + 1
REACH = SPAN - GRAM
#: Largest benchmark, in bytes of text, whose windows are broadcast; beyond it they are shuffled.
BROADCAST_BYTES = 2 << 20
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters a-z and characters beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def fingerprints(w: Column) -> Column:
    """Places and hashes of the winnowed 5-word grams."""

    def lowest(h: Column) -> Column:
        places = F.transform(
            indices(F.size(h) - (WINDOW - 1)),
            lambda i: let(F.slice(h, i + 1, WINDOW), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1),
        )
        return F.transform(F.array_distinct(places), lambda p: F.struct(p.alias("at"), F.get(h, p).alias("hash"), F.lit(SPAN).alias("width")))

    return let(gram_hashes(w, GRAM), lowest)


def _runs(w: Column, width: int) -> Column:
    """Places and hashes of all runs of ``width`` words, under ten."""
    return F.transform(gram_hashes(w, width), lambda h, i: F.struct(i.alias("at"), h.alias("hash"), F.lit(width).alias("width")))


def _marks(w: Column, lengths: list[int]) -> Column:
    """Fingerprints, and the runs of every length of short items."""
    return F.concat(fingerprints(w), *[_runs(w, n) for n in lengths])


def windows(items: DataFrame) -> DataFrame:
    """(window, hash, width, before, theirs, items): distinct windows of ``items`` (item_key, w).

    ``before`` is how many words of the window come before the gram that ``hash`` is of, and
    ``theirs`` the window's words in one string; words hold no spaces.
    """
    mark = F.col("m.at")
    own = items.filter(F.size("w") >= 1).select("item_key", "w", F.explode(F.when(F.size("w") >= SPAN, fingerprints(F.col("w"))).otherwise(
        F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(*[F.get("w", F.lit(i)) for i in range(SPAN - 1)]).alias("hash"), F.size("w").alias("width"))))).alias("m"))
    # a short item's hash leaves out the words it lacks, as the hash of a run of its length does
    starts = F.sequence(F.greatest(F.lit(0), mark - REACH), F.least(mark, F.size("w") - F.col("m.width")))
    each = own.select("item_key", "w", "m", F.explode(starts).alias("start"))
    each = each.select("item_key", F.col("m.hash").alias("hash"), F.col("m.width").alias("width"), (mark - F.col("start")).alias("before"), F.array_join(F.slice("w", F.col("start") + 1, F.col("m.width")), " ").alias("theirs"))
    kinds = each.groupBy("hash", "width", "before", "theirs").agg(F.collect_set("item_key").alias("items"))
    return kinds.select(F.xxhash64("theirs", "width").alias("window"), "*")


def contamination(docs: DataFrame, benchmark: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items, contaminated.

    ``items`` holds the sorted item_ids, as strings, whose windows occur. A benchmark of up to
    ``broadcast_bytes`` of text is broadcast; a larger one is shuffled, with equal results.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    small = size <= broadcast_bytes
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_key"), item_words(F.col("text")).alias("w"))
    known = cut(windows(items))
    lengths = sorted(r["width"] for r in known.filter(F.col("width") < SPAN).select("width").distinct().collect())  # nine at most
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id_key"), text_hash()]
    mine = docs.select(*key, item_words(F.col("text")).alias("w")).select("id_key", "text_hash", "w", F.explode(_marks(F.col("w"), lengths)).alias("m"))
    start = F.col("m.at") - F.col("before")
    table = known.select("window", "hash", F.col("width").alias("span"), "before", "theirs")

    def run_of(words: Column, at: Column) -> Column:
        return F.array_join(F.slice(words, F.greatest(F.lit(0), at) + 1, F.col("span")), " ")

    if small:  # the words are cut out after the join, of the few hits alone
        hits = mine.join(F.broadcast(table), (F.col("m.hash") == F.col("hash")) & (F.col("m.width") == F.col("span"))).filter(start >= 0)
        hits = hits.filter(run_of(F.col("w"), start) == F.col("theirs"))
        hits = hits.select("id_key", "text_hash", "window", start.alias("start"), "span")
    else:
        low = F.greatest(F.lit(0), F.col("m.at") - REACH)
        around = mine.select("id_key", "text_hash", "m", low.alias("low"), F.slice("w", low + 1, F.col("m.at") - low + SPAN).alias("w"))
        hits = around.join(table, (F.col("m.hash") == F.col("hash")) & (F.col("m.width") == F.col("span"))).filter(start >= 0)
        hits = hits.filter(run_of(F.col("w"), start - F.col("low")) == F.col("theirs"))
        hits = hits.select("id_key", "text_hash", "window", start.alias("start"), "span")
    spots = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("span") - 1))))
    # few documents are hit; they are found once and looked up twice
    of_doc = cut(hits.groupBy("id_key", "text_hash").agg(F.size(spots).cast("long").alias("n_hit"), F.collect_set("window").alias("windows")))
    named = known.select("window", F.explode("items").alias("item")).distinct()
    pairs = of_doc.select("id_key", "text_hash", F.explode("windows").alias("window")).join(F.broadcast(named) if small else named, "window")
    found = of_doc.select("id_key", "text_hash", "n_hit").join(pairs.groupBy("id_key", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items")), ["id_key", "text_hash"])
    every = docs.select(*key, "doc_id", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    return every.join(found, ["id_key", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that share no window with the benchmark."""
    bad = contamination(docs.select("doc_id", "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_hash"]), "left_anti")

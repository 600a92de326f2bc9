"""Near-duplicate classes by banded BagMinHash signatures, with exact verification.

Documents of equal words collapse into one node first. Nodes that share a band are candidates; a
pair is a link if the multisets of its five-word shingles have a Jaccard similarity of at least
0.8, counted on the whole texts. Classes are the connected components of the links.

A bucket of nodes is never expanded into all its pairs. Its members are compared with one hub, the
member that shares most buckets, then with the earliest member. Members that are then still outside
the bucket's largest component are compared with the rest, if the shingles they have in common with
anything else can reach the similarity at all, less those that marks show to be on one side only. Pairs inside a component cannot change the result and
are not compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.bagminhash import SHINGLE, SKETCH, sketch, verified
from quillmill.llm.words import gram_hashes, let, words
from quillmill.storage import cut, written

THRESHOLD = 0.8
NO_ID = -(1 << 63)
#: 64-bit words of a node's shingle marks.
MARK_WORDS = 8
#: Parts that a table of labels is copied to, so that the rows of one label meet it in several tasks.
SALTS = 16
#: Outside members of a band that one task compares with the band.
OUTSIDERS = 1000


def text_key(text: Column) -> Column:
    """64 bits of a text, which tell apart different texts of one id."""
    return F.xxhash64(text)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``edges`` (a, b): the least node of its component.

    Least labels travel along edges and jump to their label's label; every round is checkpointed.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("to"))
        fresh = cut(lower.join(jump, lower["label"] == jump["of"], "left").select("node", "was", F.least("label", "to").alias("label")))
        if fresh.filter("label <> was").isEmpty():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label")


def _labelled(rows: DataFrame, of_label: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (node, label) joined with a row per label; a label with many rows is dealt over ``SALTS`` tasks."""
    every = of_label.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(every, ["label", "salt"], how).drop("salt")


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts verify."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    kind = texts.schema["node"].dataType.simpleString()
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(verified(threshold), f"a {kind}, b {kind}")


def _merge(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Component table after more links between components of ``comp``."""
    if comp is None:
        return components(links)
    old = comp.select(F.col("node").alias("n"), "label")
    for side in ("a", "b"):
        links = links.join(old, links[side] == old["n"], "left").withColumn(side, F.coalesce("label", side)).select("a", "b")
    step = components(links)
    joined = _labelled(comp, step.select(F.col("node").alias("label"), F.col("label").alias("new")), "left")
    grown = joined.select("node", F.coalesce("new", "label").alias("label"))
    return cut(grown.unionByName(step.join(comp, "node", "left_anti").select("node", "label")))


def _able(texts: DataFrame, threshold: float) -> DataFrame:
    """(node, size, common, marks) of the nodes that can be linked to another node of ``texts`` at all.

    ``common`` counts the shingles that any other node has too. No overlap exceeds it, so a node
    whose own edits make up too much of it has no link and is compared with nothing. ``marks`` are
    ``MARK_WORDS`` words with a bit set for the hash of each of those shingles: a bit that one node
    has and the other lacks stands for at least one shingle that is not in their overlap.
    """
    grams = texts.select("node", F.explode(let(words(F.col("text")), lambda w: gram_hashes(w, SHINGLE))).alias("gram"))
    held = grams.groupBy("gram", "node").agg(F.count("*").alias("w"))
    again = held.groupBy("gram").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("gram", F.lit(1).alias("again"))
    bit = F.when(F.col("again") == 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram").bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = F.pmod(F.shiftrightunsigned("gram", 6), F.lit(MARK_WORDS))
    marks = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(MARK_WORDS)]
    sums = held.join(again, "gram", "left").groupBy("node").agg(F.sum("w").alias("size"), F.coalesce(F.sum(F.col("w") * F.col("again")), F.lit(0)).alias("common"), F.array(*marks).alias("marks"))
    return sums.filter(F.col("common") >= threshold * F.col("size") - 1e-6)


def _most_common(a: str, b: str) -> Column:
    """An upper bound of the overlap of two nodes with columns ``{a}common``, ``{a}marks`` and ``{b}...``."""

    def own(x: str, y: str) -> Column:
        lacks = [F.bit_count(F.get(f"{x}marks", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{y}marks", F.lit(i))))) for i in range(MARK_WORDS)]
        return F.col(f"{x}common") - reduce(Column.__add__, lacks)

    return F.least(own(a, b), own(b, a))


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, class_id, class_size, is_first.

    ``key`` is a 64-bit hash of the text, which tells rows of one id apart. ``class_id`` is the least doc_id of the class and ``is_first`` marks its row (equal rows share
    the mark). Texts of equal words are copies, so all texts without words form one class. A text
    of under five words is one shingle. Null texts count as empty and null ids sort first; an empty
    table gives no rows; other columns are not read.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(ids, text.alias("text"), text_key(text).alias("key"))
    rows = written(keyed.mapInArrow(sketch, SKETCH), "sketches")
    first = F.min(F.struct("id", "key"))
    nodes = rows.groupBy("h1", "h2").agg(first.alias("head"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = written(nodes.select("h1", "h2", F.struct("head.id", "head.key").alias("node"), "bands", "copies"), "nodes")

    banded = nodes.filter("bands is not null").select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("earliest")).filter("members > 1")
    member = banded.join(shared, "band").select("band", "node", "members", "earliest")
    degree = member.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = member.join(degree, "node").select("band", "node", "earliest", "degree")
    ranked = written(ranked, "members")
    hubs = ranked.groupBy("band").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    starred = ranked.join(hubs, "band").select("band", "node", "earliest", "hub", "degree")
    starred = written(starred, "stars")

    wanted = starred.select("node").distinct()
    keyed_node = keyed.select(F.struct("id", "key").alias("node"), "text")
    texts = written(keyed_node.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    # each node with the strongest of its hubs, then with all hubs of other components
    best = starred.filter("node <> hub").groupBy("node").agg(F.max_by("hub", F.struct("degree", "hub")).alias("hub"))
    comp = _merge(None, cut(_links(best.select(*ordered(F.col("node"), F.col("hub"))).distinct(), texts, threshold)))

    def apart(pairs: DataFrame) -> DataFrame:
        known = comp.select("node", "label")
        for side in ("a", "b"):
            own = known.select(F.col("node").alias(f"{side}_n"), F.col("label").alias(f"{side}_l"))
            pairs = pairs.join(own, F.col(side) == F.col(f"{side}_n"), "left")
        return pairs.filter(~F.coalesce(F.col("a_l"), F.col("a")).eqNullSafe(F.coalesce(F.col("b_l"), F.col("b")))).select("a", "b")

    star = starred.select(F.explode(F.array("hub", "earliest")).alias("other"), "node").filter("node <> other")
    comp = _merge(comp, cut(_links(apart(star.select(*ordered(F.col("node"), F.col("other"))).distinct()), texts, threshold)))

    # what a bucket still holds outside its largest component, against everything in it
    named = starred.select("band", "node").join(comp, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("largest"))
    mixed = named.join(parts.filter("labels > 1").select("band", "largest"), "band")
    able = _able(mixed.select("node").distinct().join(texts, "node"), threshold)
    measured = ("node", "label", "size", "common", "marks", "outside")
    rest = written(mixed.withColumn("outside", F.col("label") != F.col("largest")).join(able, "node").select("band", *measured), "rest")
    other = rest.select("band", *[F.col(c).alias(f"b_{c}") for c in measured])
    sizes = threshold * (F.col("size") + F.col("b_size")) - 1e-6
    once = ~F.col("b_outside") | (F.col("node") < F.col("b_node"))
    reach = (F.col("label") != F.col("b_label")) & once & (F.least("common", "b_common") * (1 + threshold) >= sizes) & (_most_common("", "b_") * (1 + threshold) >= sizes)
    # the outsiders of a band are dealt over tasks, each of which sees the whole band
    lots = rest.filter("outside").groupBy("band").agg(F.ceil(F.count("*") / OUTSIDERS).cast("int").alias("lots"))
    outside = rest.filter("outside").join(lots, "band").withColumn("lot", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int"))
    other = other.join(lots.withColumnRenamed("band", "o_band"), F.col("band") == F.col("o_band")).withColumn("o_lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    pairs = outside.join(other, (outside["band"] == other["band"]) & (F.col("lot") == F.col("o_lot")) & reach).select(*ordered(F.col("node"), F.col("b_node"))).distinct()
    comp = _merge(comp, cut(_links(pairs, texts, threshold)))

    counted = comp.join(nodes.select("node", "copies"), "node")
    sizes = counted.groupBy("label").agg(F.sum("copies").alias("class_size"))
    linked = _labelled(comp, sizes)
    sized = nodes.join(linked, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("label"), F.coalesce("class_size", "copies").alias("class_size"))
    return rows.select("id", "key", "h1", "h2").join(sized, ["h1", "h2"]).select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "key", F.nullif(F.col("label.id"), F.lit(NO_ID)).alias("class_id"), "class_size",
        ((F.col("id") == F.col("label.id")) & (F.col("key") == F.col("label.key"))).alias("is_first"),
    )


def keep_first(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns of ``docs``: that of the least doc_id."""
    from pyspark.sql import Window

    first = near_duplicates(docs.select("doc_id", "text"), threshold=threshold).filter("is_first").select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), text_key(F.coalesce("text", F.lit(""))).alias("key"))
    kept = keyed.join(first, keyed["id"].eqNullSafe(first["k_id"]) & (keyed["key"] == first["k_key"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")

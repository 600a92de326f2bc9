"""Collocations by language: branch-and-bound growth of phrases from their prefixes.

Words are counted first, then pairs of words that are frequent themselves. A pair is a node of the
frontier: with a = f(xyz) no more than f(xy) or f(yz), the cuts of xyz score at most f(xy)/f(x) and
f(yz)/f(z), so the counts of its prefix and its suffix bound every phrase that grows from a node. The
best nodes are expanded first: those whose bounds reach a floor, which is the score that enough pairs
of the language reach; and both sides of every pair that reaches it, as a longer phrase may drop it.
What reaches the floor is then known exactly. Where fewer than the wanted number survive, the floor of
the language falls and the next nodes are expanded; what was counted is not counted again. A language
is settled when enough survive, or when nothing is left.

An expansion is one pass over the texts. Nodes are found there by flags in a table of fixed size that
their hash selects (16 MiB at any size of the corpus): a hash that two pairs share costs counts that were
not needed and changes no result. Counts are exact and by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.joins import with_counts
from quillmill.llm.tokens import Tokens, windows
from quillmill.storage import written

SLOT_BITS = 24
PAGE_BITS = 16
MASK = (1 << SLOT_BITS) - 1
SCALE = 1_000_000
#: Flags of a pair: frequent; its extensions to the right, and to the left, may reach the floor; it does itself.
FREQUENT, RIGHT, LEFT, RIVAL = 1, 2, 4, 8
SEED = 42  # of the xxhash64 column function
NAMES = ("x", "y", "z")
#: Texts of a batch that are copied out at once.
TEXTS = 1000


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    """``xxhash64(lang, word)`` of the column functions."""
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w.as_buffer(), seed) for w in words), np.uint64, len(words))


def _slots_of_words(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(MASK)).astype(np.int64)


def _slots_of_pairs(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    low, high = h & np.uint64(MASK), (h >> np.uint64(SLOT_BITS)) & np.uint64(MASK)
    return (low[x] ^ high[y]).astype(np.int64)


def word_slot() -> Column:
    return F.xxhash64("lang", "x").bitwiseAND(MASK)


def pair_slot() -> Column:
    return word_slot().bitwiseXOR(F.shiftrightunsigned(F.xxhash64("lang", "y"), SLOT_BITS).bitwiseAND(MASK))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        slot, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for page in np.unique(slot >> PAGE_BITS).tolist():
            own = slot >> PAGE_BITS == page
            np.bitwise_or.at(pages.setdefault(page, np.zeros(1 << PAGE_BITS, np.uint8)), slot[own] & ((1 << PAGE_BITS) - 1), flags[own].astype(np.uint8))
    if pages:
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([b.tobytes() for b in pages.values()], pa.binary())], ["page", "flags"])


def _flag_table(rows: DataFrame, slot: Column, flags: Column):
    """Broadcast of 2**SLOT_BITS bytes: each slot holds the flags of all rows that hash to it."""
    each = rows.select(slot.alias("slot"), flags.cast("int").alias("flags")).filter("flags <> 0").groupBy("slot").agg(F.bit_or("flags").alias("flags"))
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in each.repartition(F.shiftright("slot", PAGE_BITS)).mapInArrow(_pages, "page int, flags binary").toLocalIterator():
        out[r["page"] << PAGE_BITS : (r["page"] + 1) << PAGE_BITS] |= np.frombuffer(r["flags"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def _counted(lang: str, tokens: Tokens, at: np.ndarray, n: int) -> pa.RecordBatch:
    """How often each run of ``n`` words starts at the places ``at``."""
    label = tokens.code[at]
    for j in range(1, n):
        # labels stay under the number of places, so products fit
        kinds, label = (None, label) if j == 1 else np.unique(label, return_inverse=True)
        label = label * len(tokens.words) + tokens.code[at + j]
    _, first, count = np.unique(label, return_index=True, return_counts=True)
    texts = tokens.words.cast(pa.large_string())
    columns = [texts.take(pa.array(tokens.code[at[first] + j])).cast(pa.string()) for j in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *columns, pa.array(count.astype(np.int64))], ["lang", *NAMES[:n], "n"])


def _scan(n: int, flags, keep):
    """(lang, text) -> counts of runs of ``n`` words, of those that ``keep(flags, tokens, hashes, places)`` leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                for i in range(0, len(own), TEXTS):
                    for tokens in windows(texts.take(pa.array(own[i : i + TEXTS]))):
                        at = tokens.runs(n)
                        if keep is not None and len(at):
                            at = keep(flags.value, tokens, _hashes(tokens.words, lang), at)
                        if len(at):
                            yield _counted(lang, tokens, at, n)
            pa.default_memory_pool().release_unused()

    return run


def _frequent_words(flags: np.ndarray, t: Tokens, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    often = flags[_slots_of_words(h)] != 0
    return at[often[t.code[at]] & often[t.code[at + 1]]]


def _expanded(flags: np.ndarray, t: Tokens, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places whose two pairs are now nodes, and were not when the flags in the high half were set."""
    p, s = (flags[_slots_of_pairs(h, t.code[at + j], t.code[at + j + 1])] for j in (0, 1))

    def wanted(p: np.ndarray, s: np.ndarray) -> np.ndarray:
        grows = (p & RIGHT != 0) & (s & LEFT != 0)
        return grows | ((p & RIVAL != 0) & (s & FREQUENT != 0)) | ((p & FREQUENT != 0) & (s & RIVAL != 0))

    return at[wanted(p, s) & ~wanted(p >> 4, s >> 4)]


def _count(texts: DataFrame, n: int, flags=None, keep=None) -> DataFrame:
    kinds = ", ".join(f"{c} string" for c in NAMES[:n])
    return texts.mapInArrow(_scan(n, flags, keep), f"lang string, {kinds}, n long").groupBy("lang", *NAMES[:n]).agg(F.sum("n").alias("a"))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exact."""
    d = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"({d(a)} * {d(a)} * cast({SCALE} as decimal(7,0))) div ({d(left)} * {d(right)})").cast("long")


def _kth(scored: DataFrame, langs: DataFrame, k: int) -> DataFrame:
    """(lang, t): the k-th largest score of each language, 0 if it has fewer; by its counts a score, at most ``SCALE`` + 1."""
    bars = scored.groupBy("lang", "score").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    best = bars.withColumn("upto", upto).filter(F.col("upto") >= k).groupBy("lang").agg(F.max("score").alias("t"))
    return langs.join(best, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def mine(docs: DataFrame, *, best: int = 2000, least: int = 10, share: int = 50) -> DataFrame:
    """The ``best`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs ``least`` times or more within pieces of text that ``.,;:!?`` and line ends bound. It
    scores by the lowest of its cuts, and is left out if a longer phrase around it occurs ``share`` percent
    as often. Order: score and a falling, then the phrase's bytes.

    A null lang is ``und``, together with rows that say so; null, blank and short texts count what words
    they have. Repeated rows count each. A very long text is read in windows. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = written(_count(texts, 1), "words")
    langs = written(words.groupBy("lang").agg(F.sum("a").alias("n")), "langs")
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = words.filter(F.col("a") >= least)

    pairs = _count(texts, 2, _flag_table(often, word_slot(), F.lit(1)), _frequent_words).filter(F.col("a") >= least)
    for c in ("x", "y"):
        pairs = with_counts(pairs, often, {"lang": "lang", c: "x"}, {"a": f"f_{c}"}, "a", total)
    own = score("a", "f_x", "f_y")
    pairs = written(pairs.withColumns({"score": own, "right": F.expr(f"a * {SCALE} div f_x"), "left": F.expr(f"a * {SCALE} div f_y")}), "pairs")

    def by_lang(rows: DataFrame, state: DataFrame, *take: str) -> DataFrame:
        return with_counts(rows, state, {"lang": "lang"}, {c: c for c in take}, "n", total)

    # t is the floor now, was the floor before; a language without pairs is settled
    state = langs.withColumns({"t": F.lit(None).cast("long"), "settled": F.lit(False)})
    thirds, k = None, 2 * best
    while True:
        floors = _kth(pairs, langs.select("lang"), k).withColumnRenamed("t", "next")
        state = state.join(floors, "lang").select("lang", "n", F.col("t").alias("was"), F.when(F.col("settled"), F.col("t")).otherwise(F.col("next")).alias("t"), F.col("settled").alias("rest"))
        state = written(state, "floors")
        set_ = lambda t: F.when(F.col(t).isNotNull(), F.lit(FREQUENT) + (F.col("right") >= F.col(t)).cast("int") * RIGHT + (F.col("left") >= F.col(t)).cast("int") * LEFT + (F.col("score") >= F.col(t)).cast("int") * RIVAL).otherwise(0)
        nodes = by_lang(pairs, state, "t", "was", "rest").filter("NOT rest")
        grown = _count(texts, 3, _flag_table(nodes, pair_slot(), set_("t") + set_("was") * 16), _expanded).filter(F.col("a") >= least)
        grown = with_counts(grown, pairs, {"lang": "lang", "x": "x", "y": "y"}, {"a": "f_xy", "f_x": "f_x"}, "a", total)
        grown = with_counts(grown, pairs, {"lang": "lang", "y": "x", "z": "y"}, {"a": "f_yz", "f_y": "f_z"}, "a", total)
        grown = written(grown.withColumns({"s1": score("a", "f_x", "f_yz"), "s2": score("a", "f_xy", "f_z")}), "thirds")
        thirds = grown if thirds is None else thirds.unionByName(grown)

        around = thirds.select("lang", "x", "y", "a").unionByName(thirds.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a"))
        around = around.groupBy("lang", "x", "y").agg(F.max("a").alias("around"))
        rivals = by_lang(pairs, state, "t").filter("score >= t").join(around, ["lang", "x", "y"], "left")
        two = rivals.filter(f"around IS NULL OR 100 * around < {share} * a").select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.col("f_x").alias("l"), F.col("f_y").alias("r"), "score")
        first = F.col("s1") <= F.col("s2")
        pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
        three = thirds.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", pick("f_x", "f_xy").alias("l"), pick("f_yz", "f_z").alias("r"), pick("s1", "s2").alias("score"))
        three = by_lang(three, state, "t").filter("score >= t").drop("t")
        alive = written(two.unionByName(three), "alive")
        enough = alive.groupBy("lang").agg(F.count("*").alias("alive"))
        state = written(state.join(enough, "lang", "left").select("lang", "n", "t", ((F.coalesce("alive", F.lit(0)) >= best) | (F.col("t") <= 0)).alias("settled")), "floors")
        if state.filter("NOT settled").isEmpty():
            break
        k *= 4

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of parts of a language first, then of those
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    near = alive.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", place("lang", "part")).filter(F.col("rank") <= best)
    ranked = near.withColumn("rank", place("lang")).filter(F.col("rank") <= best)
    return by_lang(ranked, langs, "n").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")

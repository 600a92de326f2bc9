"""Removal of byte passages that already occurred, by a distributed sparse suffix array.

``SPAN``-byte passages are represented by anchors (see ``spans``), so suffixes are needed only at
anchors. The steps:

1. Anchor keys that occur twice anywhere are found in a shuffle of packed 8-byte keys and folded
   into a bitmap of fixed size (16 MiB at any input size), which prunes the other passes.
2. Identical segments: everything but the earliest is removed, by one aggregation and a join.
3. The earliest copy of each segment whose key also has other segments: its suffix and its left
   context go to buckets, range-partitioned by the leading bytes with splitters that Spark
   samples. A bucket is taken in the order of those bytes, in pieces of whole keys, and each piece
   is sorted locally by multikey quicksort, eight bytes a step, in both directions; neighbours'
   common prefixes then say which passages are equal. Neither a splitter nor a piece divides a key,
   so equal passages never sit on both sides of a boundary.
4. A key with more than ``hot`` different segments is not sorted in one bucket: its passages are
   hashed and aggregated one by one, which splits such a key over all tasks.

The number of partitions follows the bytes of text, so what a task holds is bounded: the packed keys
of ``PART_BYTES`` of text in step 1, and a piece of ``PIECE_ROWS`` suffixes plus one key in step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.spans import SPAN, WINDOW, anchors, chunks
from quillmill.storage import written

BITMAP_LOG2 = 27
#: A page of the bitmap is 64 Ki bits.
PAGES_LOG2 = BITMAP_LOG2 - 16
#: Text beyond which so much of the bitmap would be set that it prunes nothing; it is then left out.
BITMAP_BYTES = 64 << 30
NO_ID = -(1 << 63)
#: Text per partition, and suffixes per sorted piece.
PART_BYTES = 16 << 20
PIECE_ROWS = 20_000


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - BITMAP_LOG2)).astype(np.int64)


def _packed_keys(buckets: int):
    """Arrow batches of texts -> (bucket, packed keys); a key met twice is sent twice, not oftener."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(n, 2))
            # keys of one page of the bitmap meet in one bucket, or in as many as there are beyond its pages
            page = keys >> np.uint64(64 - PAGES_LOG2)
            to = page % np.uint64(buckets) if buckets <= 1 << PAGES_LOG2 else page + (keys & np.uint64((1 << 20) - 1)) % np.uint64(buckets >> PAGES_LOG2) * np.uint64(1 << PAGES_LOG2)
            order = np.argsort(to, kind="stable")
            keys, to = keys[order], to[order]
            cut = np.flatnonzero(np.diff(to)) + 1
            firsts = np.concatenate(([0], cut))
            return pa.RecordBatch.from_arrays(
                [pa.array(to[firsts].astype(np.int32)), pa.array([x.tobytes() for x in np.split(keys, cut)], pa.binary())], ["bucket", "keys"])

        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                found = anchors(data, offsets)["key"]
                if len(found):
                    held.append(found)
                    size += len(found)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _repeated_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's packed keys -> its part of the bitmap, as the set slots' bytes by page."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for bucket, keys in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
            parts.setdefault(int(bucket), []).append(np.frombuffer(keys.as_buffer(), np.uint64))
    pages: dict[int, np.ndarray] = {}
    for held in parts.values():
        keys = np.sort(np.concatenate(held))
        slots = np.unique(_slot(keys[1:][keys[1:] == keys[:-1]]))
        for page in np.unique(slots >> 16):
            bits = pages.setdefault(int(page), np.zeros(1 << 13, np.uint8))
            at = slots[slots >> 16 == page] & 0xFFFF
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    if pages:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(pages), pa.int32()), pa.array([b.tobytes() for b in pages.values()], pa.binary())], ["page", "bits"])


def _bitmap(spark, texts: DataFrame, buckets: int):
    """Broadcast of 2**BITMAP_LOG2 bits: those of anchor keys that occur at least twice are set."""
    packed = texts.select("text").mapInArrow(_packed_keys(buckets), "bucket int, keys binary")
    pages = packed.repartition(buckets, "bucket").mapInArrow(_repeated_slots, "page int, bits binary")
    bits = np.zeros(1 << (BITMAP_LOG2 - 3), np.uint8)
    for row in pages.toLocalIterator():
        at = row["page"] << 13
        bits[at : at + (1 << 13)] |= np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits)


def _anchor_rows(bitmap):
    """(id, tag, text) -> anchors whose key may repeat: key, segment, id, tag, place.

    ``place`` packs the anchor's byte position and the reach of its segment, so that (id, place)
    orders anchors as the documents and their bytes are ordered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap else None
        for batch in batches:
            ids, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, offsets in chunks(batch.column(2)):
                a = anchors(data, offsets)
                slot = _slot(a["key"])
                keep = np.arange(len(slot)) if bits is None else np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                doc, at = a["doc"][keep], a["at"][keep]
                reach = ((at - a["first"][keep]) << 7) | (at - a["last"][keep])
                place = ((at - offsets[doc]) << 14) | reach
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a["key"][keep].view(np.int64)), pa.array(a["segment"][keep].view(np.int64)), pa.array(ids[row + doc]), pa.array(tag[row + doc]), pa.array(place)],
                    ["key", "segment", "id", "tag", "place"],
                )

    return run


def _places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, and how far before it its first and last passages start."""
    return place >> 14, (place >> 7) & 127, place & 127


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, text, [(key, place)]) -> one row per anchor with the bytes on both sides of it."""
    for batch in batches:
        rows = {"key": [], "lead": [], "id": [], "tag": [], "place": [], "left": [], "right": []}
        held = 0
        for doc, tag, text, list_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            at = np.fromiter((x["place"].as_py() for x in list_), np.int64)
            a, before, after = _places(at)
            for x, pos, b, e, p in zip(list_, a.tolist(), before.tolist(), after.tolist(), at.tolist(), strict=True):
                rows["key"].append(x["key"].as_py())
                rows["id"].append(doc)
                rows["tag"].append(tag)
                rows["place"].append(p)
                rows["left"].append(data[pos - b : pos][::-1])
                rows["right"].append(right := data[pos : pos - e + SPAN])
                rows["lead"].append(right[:24])
                held += 1
            if held > 20_000:
                yield _suffix_batch(rows)
                rows, held = {k: [] for k in rows}, 0
        if held:
            yield _suffix_batch(rows)


SUFFIXES = "key long, lead binary, id long, tag long, place long, left binary, right binary"


def _suffix_batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "id": pa.int64(), "tag": pa.int64(), "place": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()], list(rows))


def _steps(values: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of big-endian 8-byte steps, padded with zeros."""
    width = -(-width // 8) * 8
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), ">u8")
    return flat.reshape(len(values), width // 8).astype(np.uint64)


def multikey_sort(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): sorted order, and each row's common prefix in bytes with the row before.

    Rows that tie on the first step are sorted by the second, and so on; rows that are already
    alone are not touched again.
    """
    n, depth = steps.shape
    order = np.arange(n)
    common = np.full(n, depth * 8, np.int64)
    common[:1] = 0
    group = np.zeros(n, np.int64)  # of the rows in order
    open_ = np.arange(n)  # positions that still tie with a neighbour
    for d in range(depth):
        if not len(open_):
            break
        value = steps[order[open_], d]
        by = np.lexsort((value, group[open_]))
        order[open_] = order[open_][by]
        value = value[by]
        same = group[open_][1:] == group[open_][:-1]
        differ = np.flatnonzero(same & (value[1:] != value[:-1])) + 1
        xor = value[differ] ^ value[differ - 1]
        # leading equal bytes of the two steps
        equal = np.zeros(len(differ), np.int64)
        for byte in range(7):
            equal += (xor >> np.uint64(56 - 8 * byte) == 0).astype(np.int64)
        common[open_[differ]] = 8 * d + equal
        start = np.zeros(len(open_), np.int64)
        start[differ] = 1
        fresh = np.concatenate(([True], ~same)) if len(open_) else same
        label = np.cumsum(fresh | (start > 0))
        group[open_] = label
        size = np.bincount(label)
        open_ = open_[size[label] > 1]
    return order, common


def _removed(ids, place, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of segments with bytes: (row, first offset, last offset) of runs of passages seen earlier.

    An offset is the distance from a passage's start to the anchor. Passages of equal offset are
    equal if their ``offset`` bytes to the left and ``SPAN - offset`` to the right are.
    """
    n = len(ids)
    at, before, after = _places(place)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, ids))] = np.arange(n)
    # repeated rows of one document are one place
    o = np.argsort(rank)
    again = np.concatenate(([False], (ids[o][1:] == ids[o][:-1]) & (at[o][1:] == at[o][:-1])))
    spot = np.empty(n, np.int64)
    spot[o] = np.cumsum(~again)
    r_order, r_common = multikey_sort(_steps(right, SPAN))
    l_order, l_common = multikey_sort(_steps(left, WINDOW))
    gone = np.zeros((n, WINDOW), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(WINDOW):
        valid = np.flatnonzero((after <= offset) & (offset <= before))
        if len(valid) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < SPAN - offset)
        l_class[l_order] = np.cumsum(l_common < offset)
        both = r_class[valid] * (n + 1) + l_class[valid]
        by = np.lexsort((spot[valid], both))
        both, where = both[by], spot[valid][by]
        head = np.concatenate(([True], both[1:] != both[:-1]))
        first = where[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        gone[valid[by[where > first]], offset] = True
    flat = np.zeros((n, WINDOW + 2), np.int8)
    flat[:, 1:-1] = gone
    edge = np.diff(flat, axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, low, high - 1


SPANS = "id long, tag long, lo long, hi long"


def _span_batch(ids, tag, place, row, low, high) -> pa.RecordBatch:
    at, _, _ = _places(place)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], tag[row], at[row] - high, at[row] - low + SPAN)], ["id", "tag", "lo", "hi"])


def _sort_bucket(piece_rows: int):
    """Suffixes in the order of their leading bytes -> byte spans of passages that occurred earlier."""

    def sorted_piece(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, tag, place = t["id"].to_numpy(), t["tag"].to_numpy(), t["place"].to_numpy()
        return _span_batch(ids, tag, place, *_removed(ids, place, t["left"].to_pylist(), t["right"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            if not batch.num_rows:
                continue
            if size + batch.num_rows > piece_rows:
                # a piece ends where the leading bytes change
                lead = batch.column(1).to_pylist()
                last = held[-1].column(1)[-1].as_py() if held else lead[0]
                for i in range(batch.num_rows):
                    if size >= piece_rows and lead[i] != last:
                        if i > start:
                            held.append(batch.slice(start, i - start))
                        yield sorted_piece(held)
                        held, size, start = [], 0, i
                    last, size = lead[i], size + 1
            else:
                size += batch.num_rows
            held.append(batch.slice(start))
        if held:
            yield sorted_piece(held)

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of hot keys -> one row per passage: its digest and where it starts."""
    for batch in batches:
        out = {"digest": [], "id": [], "tag": [], "lo": []}
        ids, tag = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        at, before, after = (x.tolist() for x in _places(batch.column(4).to_numpy()))
        for i, (left, right) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
            whole = left[::-1] + right
            for s in range(before[i] - after[i] + 1):
                out["digest"].append(hashlib.blake2b(whole[s : s + SPAN], digest_size=16).digest())
                out["id"].append(ids[i])
                out["tag"].append(tag[i])
                out["lo"].append(at[i] - before[i] + s)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "digest" else pa.int64()) for k, v in out.items()], list(out))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _rebuilt(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for doc, text, spans in zip(part.column(0), part.column(1), part.column(2), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    kept, n = data, 0
                    if spans.is_valid and len(spans):
                        x = np.array([(s["lo"], s["hi"]) for s in spans.as_py()], np.int64)
                        x = x[np.argsort(x[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(x[:, 1])
                        new = np.concatenate(([True], x[1:, 0] > reach[:-1]))
                        begin = x[new, 0].tolist()
                        end = reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(x) - 1]))].tolist()
                        n = len(begin)
                        kept = b"".join(data[a:b] for a, b in zip([0, *end], [*begin, len(data)], strict=True))
                    out["doc_id"].append(doc.as_py())
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(len(data) - len(kept))
                    out["n_spans"].append(n)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept if with_bytes else None)
                kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    return run


def remove_repeats(docs: DataFrame, *, hot: int = 50_000, with_bytes: bool = False, part_bytes: int = PART_BYTES, piece_rows: int = PIECE_ROWS, bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Each byte goes that lies in a SPAN-byte string which also starts earlier: in a document of
    smaller doc_id, or earlier in the same document. ``kept`` holds the bytes left if
    ``with_bytes``, else null. Null and short texts lose nothing; a null doc_id sorts first; rows
    that share a doc_id count as one document, whose positions may coincide and then do not remove
    each other; where any doc_id is shared, rows are told apart by 64 bits of their text's hash. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")
    # ids that are all different need no hash beside them
    shared = not docs.select(own).groupBy("id").count().filter("count > 1").isEmpty()
    tag = F.xxhash64(F.coalesce("text", F.lit(""))) if shared else F.lit(0).cast("long")
    keyed = docs.select(own, tag.alias("tag"), F.col("text"))
    # what names a row in the shuffles
    who = ["id", "tag"] if shared else ["id"]

    def thin(df: DataFrame) -> DataFrame:
        return df if shared else df.drop("tag")

    def full(df: DataFrame, *columns: str) -> DataFrame:
        return (df if shared else df.withColumn("tag", F.lit(0).cast("long"))).select(*columns)

    bitmap = _bitmap(spark, docs.select("text").filter(F.octet_length("text") >= SPAN), parts) if total <= bitmap_bytes else None
    found = thin(keyed.filter(F.octet_length("text") >= SPAN).mapInArrow(_anchor_rows(bitmap), "key long, segment long, id long, tag long, place long"))

    at = F.shiftright("place", 14)
    segments = written(found.groupBy("key", "segment").agg(F.min(F.struct("id", "place", *who[1:])).alias("first"), F.count("*").alias("n")), "segments")
    doubled = segments.filter("n > 1").select(F.col("key").alias("k"), F.col("segment").alias("s"), F.col("first.id").alias("f_id"), F.shiftright("first.place", 14).alias("f_at"))
    copies = found.join(doubled, (F.col("key") == F.col("k")) & (F.col("segment") == F.col("s")))
    copies = copies.filter((F.col("id") > F.col("f_id")) | (at > F.col("f_at"))).select(
        *who,
        (at - F.shiftright("place", 7).bitwiseAND(127)).alias("lo"),
        (at - F.col("place").bitwiseAND(127) + SPAN).alias("hi"),
    )

    # the earliest copy of each segment, where a key has several segments
    counts = segments.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = segments.select("key", *[f"first.{c}" for c in (*who, "place")]).join(counts, "key")
    wanted = several.groupBy(*who).agg(F.collect_list(F.struct(F.when(F.col("kinds") > hot, 1).otherwise(0).cast("long").alias("key"), "place")).alias("at"))
    by_doc = thin(keyed).repartition(parts, *who)
    names = [c.split()[0] for c in SUFFIXES.split(", ")]
    suffixes = thin(full(by_doc.join(wanted, who), "id", "tag", "text", "at").mapInArrow(_suffixes, SUFFIXES))
    sorted_ = suffixes.filter("key = 0").repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    cold = thin(full(sorted_, *names).mapInArrow(_sort_bucket(piece_rows), SPANS))

    passages = thin(full(suffixes.filter("key <> 0"), *names).mapInArrow(_passages, "digest binary, id long, tag long, lo long"))
    first = passages.groupBy("digest").agg(F.min(F.struct("id", "lo")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("digest", "f")
    warm = passages.join(first, "digest").filter((F.col("id") > F.col("f.id")) | ((F.col("id") == F.col("f.id")) & (F.col("lo") > F.col("f.lo"))))
    warm = warm.select(*who, "lo", (F.col("lo") + SPAN).alias("hi"))

    spans = copies.unionByName(cold).unionByName(warm)
    gathered = spans.groupBy(*who).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = by_doc.join(gathered, who, "left").select(F.nullif("id", F.lit(NO_ID)).alias("id"), "text", "spans")
    return joined.mapInArrow(_rebuilt(with_bytes), RESULT)

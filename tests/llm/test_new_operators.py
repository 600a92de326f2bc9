"""Collocations, archives and clusters against brute force, odd rows and both sides of every switch."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import collocations, tokens, va_cluster, warc

DOCS = "doc_id long, text string, lang string, source string, f_x string"


def phrases(rows, best, least=10, share=50):
    """Every count in dictionaries, every candidate scored."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in found.items():
        longer = [found.get((lang, *x), 0) for x in {p[1:] for p in found if p[0] == lang and len(p) == 4} if len(w) == 2 and tuple(w) in (x[:2], x[1:])]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows_ in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:best]))


@pytest.mark.parametrize("best", [3, 25, 10_000])
def test_collocations_are_those_of_brute_force(spark, best):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ünd", "The"]
    fixed = ["kick the bucket", "red herring here", "one two three", "New York", "a b"]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(1, 30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "s", "clash"))
    rows += [(1, None, "en", None, None), (None, "", None, None, None), (5, " \t.,", "fr", None, None), (6, "x " * 50, "xx", None, None), (7, "hot pair " * 3000, "en", None, None)]
    got = collocations.mine(spark.createDataFrame(rows, DOCS).repartition(5), best=best)
    assert sorted(map(tuple, got.collect())) == phrases([(r[1], r[2]) for r in rows], best)


def test_the_floor_falls_until_enough_phrases_survive(spark):
    # most pairs are inside a triple as common as they are, so the first floors leave too few
    rows = [(i, ". ".join(f"a{j} b{j} c{j}" for j in range(60)) + ". " + " ".join(f"u{(i * 7 + j) % 9}" for j in range(30)), "en", "s", "") for i in range(15)]
    got = collocations.mine(spark.createDataFrame(rows, DOCS), best=58)
    assert sorted(map(tuple, got.collect())) == phrases([(r[1], r[2]) for r in rows], 58)


def test_collocations_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    values = [(9_000_000_000_000_001, 9_000_000_000_000_007, 9_100_000_000_000_003), (10, 10, 10), (3, 7, 11), (0, 5, 5)]
    got = spark.createDataFrame(values, "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000 * a * a // (left * right) for a, left, right in values]


@pytest.mark.parametrize("most", [16, 40, 1000])
def test_windows_of_one_text_count_as_the_whole(most):
    rng = random.Random(most)
    text = "".join(rng.choice(["ab", "CD", "longer-word-é", "x" * 50, "q"]) + rng.choice([" ", ". ", "\n", "\t"]) for _ in range(300))
    for n in (1, 2, 3):
        counts = []
        for size in (most, 1 << 20):
            c = Counter()
            for t in tokens.windows(pa.array([text]), size):
                w = t.words.to_pylist()
                c.update(tuple(w[t.code[i + j]] for j in range(n)) for i in t.runs(n))
            counts.append(c)
        assert counts[0] == counts[1]


PAGES = "page_id long, url string, html string, payload string, head string"


def page_rows():
    rng = random.Random(3)
    big = "é" * 700
    long_ = "".join(rng.choice("abcdef \n\r<>") for _ in range(200_000))
    rows = [(i, f"http://h/{i}", rng.choice([big, "short", f"own {i} " * 300, long_, "\r\n\r\nWARC/1.1\r\n" * 90]), "x", "y") for i in range(60)]
    return rows + [(61, None, None, None, None), (62, "http://h/a b\r\nX: y", "", None, None), (None, "u", big, None, None), (63, "u", big, None, None), (63, "u", big, None, None), (None, None, "n" * 2000, None, None), (None, None, "n" * 2000, None, None)]


@pytest.mark.parametrize("groups", [500_000, 0])
@pytest.mark.parametrize("chunk", [7 << 10, 1 << 18])
def test_archives_hold_every_page_once_and_refer_to_the_largest_id(spark, tmp_path, groups, chunk):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = str(tmp_path / "a")
    spark.dataSource.register(warc.WarcSource)
    typed = warc.with_types(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target_uri"), "html"), F.col("html"), broadcast_groups=groups)
    warc.chunk_rows(typed, chunk).write.format("warc").option("archiveBytes", 5000).mode("append").save(path)
    read = warc.read_archives(spark, path, chunk=chunk).toPandas()
    last = read[read.is_last]
    head = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            head[b] = max(i, head.get(b, -1))
    want = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        again = b in head and head[b] != i
        want.append(("" if i is None else str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", str(head[b]) if again else ""))
    assert sorted(want) == sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in last.itertuples())
    assert (last[last.record_type == "response"].running_digest == last[last.record_type == "response"].payload_digest).all()
    # the payloads themselves, from their chunks in order
    parts = {}
    for r in read[(read.record_type == "response") & (read.record_id != "")].sort_values(["record_id", "chunk_no"]).itertuples():
        assert len(r.data) <= chunk
        if r.record_id != "63":
            parts[r.record_id] = parts.get(r.record_id, b"") + r.data
    by_id = {str(r[0]): (r[2] or "").encode() for r in rows}
    assert parts and all(by_id[i] == b for i, b in parts.items())


def test_archived_pages_of_odd_rows_and_of_none(spark):
    got = warc.archived_pages(spark.createDataFrame(page_rows(), PAGES)).toPandas()
    assert len(got) == len(page_rows()) and got.verified.all()
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_plain_archives_of_others_are_read(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hi</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(info + record)
    got = [(r["record_type"], bytes(r["data"]), r["is_last"]) for r in warc.read_archives(spark, str(tmp_path / "x.warc")).collect()]
    assert got == [("warcinfo", b"a: b\n", True), ("response", b"<p>hi</p>", True)]


def test_an_archive_that_ends_within_a_record_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, str(tmp_path / "x.warc")).collect()


def nearest(rows, dim, k, rounds):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for _, v in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"2:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), tuple(x[j])))[:k]
    c = x[order].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    far = d[np.arange(len(a)), a]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted((-1 if i is None else i, int(j), int(f), int(far[a == j].sum()), int(far.sum()), digest[j]) for (i, _), j, f in zip(kept, a, far, strict=True))


@pytest.mark.parametrize("k", [3, 12, 5000])
def test_clusters_are_those_of_every_distance(spark, k):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(c) for c in (centres[i % 6] + rng.normal(size=8) * 0.2).astype(np.float32)]) for i in range(600)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[3][1]), (900, [1000.0] * 8), (901, [-1000.0, *[0.0] * 7])]
    odd = [(1000, None), (1001, []), (1002, [0.5] * 7), (1003, [0.5] * 7 + [None]), (1004, [0.5] * 7 + [float("nan")]), (1005, [float("inf")] * 8), (1006, [0.5] * 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, cells string, row long").repartition(4)
    seen = []
    got = va_cluster.cluster_vectors(df, dim=8, k=k, fetched=seen)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == nearest(rows, 8, k, 5)
    if k == 3:
        assert seen[0] == (605, 605) and all(read < 605 for _, read in seen[1:5])  # the cells alone decide most rows


def test_clusters_of_an_empty_table(spark):
    got = va_cluster.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_huge_components_are_held_to_the_range(spark):
    got = va_cluster.cluster_vectors(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>"), dim=2, k=1, rounds=0).collect()
    assert {r["distance"] for r in got} == {0, (2 << 27) ** 2}

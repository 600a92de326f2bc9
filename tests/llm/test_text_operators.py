import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bagminhash, decontaminate, html_extract, line_templates, mixing, near_dedup, quality_rules, sanitise, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, node string"


def docs_of(spark, texts):
    """Documents with null metadata and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    shared = say(60)
    out = [None, "", " \n\t ", "one", "one", say(3), "é😀 " * 80, say(4000), shared, f"{say(40)}\n{shared}\n{say(40)}", f"{say(30)} {shared}", shared + " " + shared]
    base = say(200).split()
    for k in range(6):
        near = list(base)
        near[k * 30] = "changed"
        out.append(" ".join(near))
    return out + [say(int(n)) for n in rng.integers(5, 120, 20)] + [out[7]]


def test_ledger(spark, texts):
    got = {r.doc_id: r for r in quality_rules.judged(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = Counter(grams)
        hit = {j + d for j, g in enumerate(grams) if n[g] > 1 for d in range(5)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
    assert quality_rules.keep_documents(docs_of(spark, texts)).columns == docs_of(spark, texts).columns
    assert quality_rules.ledger(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup(spark, texts, hot):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts), hot=hot).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_removed, got[i].kept_sha256) == (gone.sum(), hashlib.sha256(kept).hexdigest())


def test_near_duplicates(spark, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common, total = sum((sets[a] & sets[b]).values()), sum(sets[a].values()) + sum(sets[b].values())
            if (total == 0) or (common and common >= 0.8 * (total - common)):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert near_dedup.keep_first(docs_of(spark, texts)).count() == len(set(label))


def test_near_duplicates_of_one_id_and_crc(spark):
    """Texts that share id and CRC-32 stay apart, and each class keeps its own row."""
    seen = {}
    for i in range(2_000_000):
        text = "one two three four " + hashlib.md5(str(i).encode()).hexdigest()
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, other), (5, text), (None, text + " five"), (None, near), (9, near + " x"), (5, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs)
    assert sorted((r.class_size, r.doc_id is None, r.is_first) for r in got.collect()) == [(1, False, True), (1, True, True), (2, False, True), (2, False, True), (3, False, False), (3, False, False), (3, True, True)]
    kept = sorted(((r.doc_id is None, r.doc_id, r.text) for r in near_dedup.keep_first(docs).collect()), key=str)
    assert kept == sorted([(False, 5, text), (False, 5, other), (True, None, text + " five"), (True, None, near)], key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    a, b = rng.integers(1, 9, 80), rng.integers(1, 9, 80)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = []
    for s in range(12):
        x = bagminhash.mix(h + np.uint64(s))
        sig = bagminhash.signatures(np.repeat([0, 1], 80), np.concatenate((x, x)), np.concatenate((a, b)), 2)
        same.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(same) - want) < 0.05


def test_decontamination(spark, texts):
    w = (texts[7] or "").split()
    items = [(1, " ".join(w[5:30])), (2, "One"), (3, None), (4, "..."), (5, " ".join(w[40:46])), (None, "zz yy xx ww vv uu tt ss rr qq pp oo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        k = min(10, len(words(t)))
        for j in range(len(words(t)) - k + 1 if k else 0):
            windows[tuple(words(t)[j : j + k])].add(str(i) if i is not None else "null")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        d, hit, found = words(t), set(), set()
        for x, of in windows.items():
            for j in range(len(d) - len(x) + 1):
                if tuple(d[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found |= of
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(d), len(hit), sorted(found))


def test_mix(spark, texts):
    rows = mixing.mix(docs_of(spark, texts), bucket_rows=5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for source in by.values():
        assert abs(sum(r.taken for r in source) - source[0].target) <= 1
    assert mixing.mixed_documents(docs_of(spark, texts)).count() > 0
    assert mixing.mix(docs_of(spark, texts).limit(0)).count() == 0


def test_shards(spark, texts):
    rows = sharding.shard(docs_of(spark, texts + texts[20:] * 3), shards=4).collect()
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())


def test_personal_data_and_terms(spark):
    rows = [(i, f"note {i} about zorblatt wrote to jane@corp.org on {'abcdefgh'[i] * 5} okay") for i in range(8)] + [(100 + i, f"plain filler wrote about okay {i}") for i in range(30)] + [(200, "Zorblatt was here, 4111 1111 1111 1111"), (201, None)]
    found = sanitise.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    clean = {r.doc_id: r.text for r in sanitise.sanitised(found).collect()}
    assert clean[0] == "note 0 about <term> wrote to <email> on aaaaa okay"
    assert clean[200] == "<term> was here, <card>"
    assert clean[100] == rows[8][1] and clean[201] == ""


def test_terms_of_footers_far_away_and_short(spark):
    footer = lambda i: "Kind regards, Quimby Li\n" + "of the office " * (2 if i < 2 else 8) + "jane@corp.org " + "and the office " * 8
    rows = [(i, f"note {'abcdefgh'[i] * 5} {footer(i)}") for i in range(8)] + [(100 + i, f"and the kind office of note regards {i}") for i in range(30)] + [(200, "Li and QUIMBY, the office"), (201, "Liz")]
    found = sanitise.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    clean = {r.doc_id: r.text for r in sanitise.sanitised(found).collect()}
    assert clean[0] == rows[0][1].replace("Quimby Li", "<term> <term>").replace("jane@corp.org", "<email>")
    assert clean[200] == "<term> and <term>, the office" and clean[201] == "Liz" and clean[100] == rows[8][1]


def test_line_templates(spark):
    rows = [(i, f"body {c * 3} text\nUser has logged in from h{c} with status good today by {c}{c}") for i, c in enumerate("abcdefghijkl")] + [(50, None)]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].text == f"body {c * 3} text" for i, c in enumerate("abcdefghijkl")) and out[50].text == ""


def test_short_and_long_recurring_lines(spark):
    passage = " ".join(f"w{c}" * 2 for c in "abcdefghijklmnopqrstuvwxyz") + " " + " ".join(f"v{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"own {c * 4}\nAll rights reserved.\n\nOnly {'few' if i < 9 else c}") for i, c in enumerate("abcdefghijkl")] + [(50 + i, f"own {c * 4}\n{passage}") for i, c in enumerate("mn")] + [(60, "own oooo\n" + passage.upper())]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == "own aaaa\n\nOnly few" and out[11].text == "own llll\n\nOnly l"
    assert [out[i].text for i in (50, 51)] == ["own mmmm", "own nnnn"]
    assert out[60].text == rows[-1][1] and out[60].n_dropped == 0


def test_templates_that_share_a_leaf(spark):
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(400)]
    a = lambda i: f"User has logged in from {names[i]} with status good today by {names[i + 50]}"
    b = lambda i: f"User has logged in again {names[i]} after reset of the password {names[i + 50]}"
    chance = [" ".join(["User has logged in", *names[200 + 8 * i : 208 + 8 * i]]) for i in range(20)]
    many = "\n".join(["User has logged in on every day of that year or two"] * 300)
    lines = [a(i) for i in range(12)] + [b(i) for i in range(12)] + chance + [many]
    rows = [(i, f"body {names[i]}\n{line}") for i, line in enumerate(lines)]
    out = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == f"body {names[i]}" for i in range(24))
    assert all(out[i] == rows[i][1] for i in range(24, len(rows)))


def test_html(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>Some  words in\n a sentence, really.<p>More words in a sentence, too.</article><footer>&copy; x</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page.replace("Some", f"Some{i}")) for i in range(20)] + [(98, None, None), (99, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[3] == "A & B\nSome3 words in a sentence, really.\nMore words in a sentence, too." and got[98] == got[99] == ""


@pytest.mark.parametrize("id_", [None, 5])
def test_suffix_dedup_keeps_apart_texts_of_one_id(spark, id_):
    """Rows of one id lose what starts earlier under that id or a smaller one, and nothing else."""
    import zlib

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = word(199)
    first = word(41) + passage + passage
    want = zlib.crc32(first.encode()) & 0x3FFFF
    stem = word(478)
    # a text of other bytes whose CRC agrees in the low 18 bits
    other = next(t for t in (stem + f"{i:07d}" for i in range(10_000_000)) if zlib.crc32(t.encode()) & 0x3FFFF == want)
    rows = [(id_, first), (id_, other), (9, word(300)), (id_, first)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()
    kept = sorted(bytes(r["kept"]).decode() for r in got)
    assert kept == sorted([first[:-199], other, rows[2][1], first[:-199]])

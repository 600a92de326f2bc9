"""Information-theoretic sanitisation of personal data.

Values of four kinds (email, ip, card, phone) are protected entities and are always spans. Other
wording can give an entity away: a name that the corpus shows with one address only is as good as
the address. Terms are words and pairs of neighbouring words, so a full name is a term even if both
its parts are common. For every entity the terms that stand beside it anywhere are counted over the
whole corpus; such a term discloses the entity if at least ``min_texts`` different texts hold both,
near or far, and if at least the share ``disclosure`` of all texts with the term are texts of the
entity, that is, if log2 1/P(entity | term) <= log2 1/disclosure bits are left to guess. Such terms
become spans of kind ``term`` wherever they occur; a pair needs no span where one of its words is a
term by itself. Copies of a text count once.

Null and empty texts have no spans; repeated rows give repeated rows with equal spans; an empty
table gives no rows; other columns are neither read nor returned. The work on a text grows in
proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.words import indices, let
from quillmill.storage import cut

#: In the order of the output. The possessive forms match what the plain ones do, without
#: backtracking; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only whole runs of 14 to 19 digits; other runs match the plain form and then fail
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = (*PATTERNS, "term")
CONTEXT = 60
MIN_TEXTS = 3
DISCLOSURE = 0.8
#: Most terms, as numbers, most copied texts and most texts with their terms that are broadcast.
BROADCAST_TERMS, BROADCAST_COPIES, BROADCAST_TEXTS = 2_000_000, 500_000, 50_000
#: One text in this many bounds the counts of common terms before all texts are counted.
PART = 64
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Values per block of a running sum.
BLOCK = 64


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(found, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(found, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def running_sums(values: Column) -> Column:
    """For every value of an array the sum of those before it.

    Sums are taken in blocks, then over the blocks' totals: appending to one long list would copy it
    once a value.
    """

    def sums(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["before"], a["at"]).alias("before")), lambda a: a["before"])

    def add(x: Column, y: Column) -> Column:
        return x + y

    def whole(v: Column) -> Column:
        blocks = F.transform(indices(F.ceil(F.size(v) / BLOCK)), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, sums(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0)), sums)))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, sums(v, F.lit(0))).otherwise(whole(v)))


def _matches(text: Column, pattern: Column, number: int, kind: str) -> Column:
    """Valid matches of a pattern as spans: the pieces between matches give the places."""

    def place(pieces: Column, found: Column) -> Column:
        # pieces and matches take turns, and there is one piece more
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        every = F.zip_with(F.arrays_zip(running_sums(steps).alias("before"), pieces.alias("piece")), found, lambda b, m: F.struct((b["before"] + F.length(b["piece"])).alias("start"), m.alias("m")))
        good = F.filter(every, lambda e: e["m"].isNotNull() & _valid(kind, e["m"]))
        return F.transform(good, lambda e: F.struct(e["start"].alias("start"), F.lit(number).alias("kind"), (e["start"] + F.length(e["m"])).alias("end")))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), lambda p: place(p, m))))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds by start, then kind."""
    each = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = _matches(text, F.lit(pattern), number, kind)
        each.append(F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPAN)) if NEEDS[kind] else spans)
    return F.sort_array(F.concat(*each))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def _words(text: Column) -> Column:
    """Lower-cased words of letters, in order."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}]+"), "")


def _pairs(w: Column, make) -> Column:
    return F.transform(indices(F.size(w) - 1), lambda i: make(F.get(w, i), F.get(w, i + 1)))


def _term_keys(text: Column) -> Column:
    """Distinct hashes of a text's words and pairs of words."""
    return let(_words(text), lambda w: F.array_distinct(F.concat(F.transform(w, lambda x: F.xxhash64(x)), _pairs(w, lambda x, y: F.xxhash64(x, y)))))


def _candidates(side: Column) -> Column:
    """Terms of the text on one side of an entity: words that can be names, and pairs of words that can be full names.

    Words of under four letters in small letters are no names by themselves, and a full name has no
    part that begins with a small letter.
    """
    big = "^[^\\p{Ll}]"
    term = lambda *w: F.struct(F.xxhash64(*w).alias("key"), F.array(*w).alias("term"))

    def of(w: Column) -> Column:
        single = F.filter(w, lambda x: (F.length(x) >= 4) | x.rlike(big))
        double = F.filter(_pairs(w, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].rlike(big) & p["y"].rlike(big))
        return F.concat(F.transform(single, lambda x: term(F.lower(x))), F.transform(double, lambda p: term(F.lower(p["x"]), F.lower(p["y"]))))

    return let(F.array_remove(F.split(side, "[^\\p{L}]+"), ""), of)


def _small(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, broadcast if they are proven few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _holding(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, share, key): which rows hold which of the terms in ``keys``."""
    every = docs.select("text_key", "share", F.explode(_term_keys(F.col("text"))).alias("key"))
    return every.join(_small(keys, BROADCAST_TERMS), "key")


def disclosing_terms(docs: DataFrame, *, min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(key, term, entity, n_both, n_term) of terms that give an entity away, and where terms stand.

    ``docs`` has text_key and text. The second table is (text_key, key) and covers at least those
    terms. Both are checkpointed.
    """
    spans = docs.select("text_key", "text", F.explode(base_spans(F.col("text"))).alias("s"))
    value = F.regexp_replace(F.lower(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))), "[ ()-]", "")
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), value)
    # words cut by the edges of the context do not count
    before = F.regexp_replace(F.substr("text", F.greatest(F.lit(1), F.col("s.start") - CONTEXT + 1), F.least(F.lit(CONTEXT), F.col("s.start"))), "^\\p{L}+", "")
    after = F.regexp_replace(F.substr("text", F.col("s.end") + 1, F.lit(CONTEXT)), "\\p{L}+$", "")
    seen = cut(spans.select("text_key", entity.alias("entity"), F.array_distinct(F.concat(_candidates(before), _candidates(after))).alias("terms")))
    holders = seen.select("text_key", "entity").distinct()
    often = holders.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= min_texts)
    beside = cut(seen.join(often, "entity").select("entity", "n_entity", F.explode("terms").alias("t")).select("entity", "n_entity", "t.*").distinct())
    # each of a text's copies is its share of one text, so texts are counted before anything is shuffled
    copies = cut(docs.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1"))
    shared = docs.join(_small(copies, BROADCAST_COPIES), "text_key", "left").withColumn("share", 1 / F.coalesce("copies", F.lit(1)))
    # a part of the texts bounds a term's count from below; terms that are too common by that part alone cannot pass
    wanted = cut(beside.groupBy("key").agg(F.max("n_entity").alias("most")))
    part = _holding(shared.filter(F.pmod("text_key", F.lit(PART)) == 0), wanted.select("key")).groupBy("key").agg(F.sum("share").alias("least"))
    wanted = cut(wanted.join(part, "key", "left").filter(disclosure * F.coalesce("least", F.lit(0.0)) <= F.col("most") + 1e-6).select("key"))
    counts = _holding(shared, wanted).groupBy("key").agg(F.round(F.sum("share")).cast("long").alias("n_term")).filter(F.col("n_term") >= min_texts)
    # a term in more texts than the entity's by that share cannot pass
    near = cut(beside.join(counts, "key").filter(F.col("n_entity") >= disclosure * F.col("n_term")))
    held = cut(_holding(shared, cut(near.select("key").distinct())).select("text_key", "key").distinct())
    both = held.join(near, "key").join(holders, ["text_key", "entity"])
    both = both.groupBy("key", "term", "entity", "n_term").agg(F.count("*").alias("n_both")).select("key", "term", "entity", "n_both", "n_term")
    found = cut(both.filter((F.col("n_both") >= min_texts) & (F.col("n_both") >= disclosure * F.col("n_term"))))
    words = found.filter(F.size("term") == 1).select(F.col("term")[0].alias("word")).distinct()
    within = found.filter(F.size("term") == 2).select("key", F.explode("term").alias("word")).join(words, "word").select("key")
    return cut(found.join(within, "key", "left_anti")), held


def find_personal_data(docs: DataFrame, *, min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, base, spans.

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points, by start, then kind; a
    null text is empty. The base spans are always part of ``spans``. Of terms that overlap, the one
    that starts first is a span, the longer of two that start together.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    keyed = docs.select("doc_id", text, F.xxhash64(text, F.crc32(text)).alias("text_key"))
    terms, held = disclosing_terms(keyed, min_texts=min_texts, disclosure=disclosure)
    terms = terms.select("key", "term").distinct()
    based = keyed.select("doc_id", "text", "text_key", base_spans(F.col("text")).alias("base"))
    if terms.isEmpty():
        return based.select("doc_id", "text", "base", F.col("base").alias("spans"))
    longest = F.sort_array(F.collect_set(F.struct(F.length(F.array_join("term", " ")).alias("n"), "term")), asc=False)
    of_text = held.join(terms, "key").groupBy("text_key").agg(F.transform(longest, lambda t: F.array_join(t["term"], "[^\\p{L}]+")).alias("terms"))
    both = based.join(_small(cut(of_text), BROADCAST_TEXTS), "text_key", "left")
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}])(?:"), F.array_join("terms", "|"), F.lit(")(?![\\p{L}])"))
    added = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", _matches(F.col("text"), pattern, len(PATTERNS), "term"))))
    return both.select("doc_id", "text", "base", added.alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, text) with spans replaced by their kind in angle brackets; a span inside another goes with it."""
    name = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        tag = F.concat(F.lit("<"), F.get(name, s["kind"]), F.lit(">"))
        cut_ = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece, tag)).alias("parts"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(cut_)

    tail = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.select("doc_id", tail.alias("text"))

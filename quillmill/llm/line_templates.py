"""Line deduplication with a log-template tree.

Every line is parsed by a tree of fixed depth: first its number of tokens, then its leading
tokens, with tokens that hold digits generalised to ``<*>``. A template is either a whole line after
that masking, or what a group of a leaf's lines has in common: a leaf holds as many groups as it has
sets of common tokens, and the whole leaf is one more. At each place the token that at least 70 % of
a group's lines share is fixed, and elsewhere is a variable field; a line counts once for each
different text. Templates with too few fixed tokens are no templates, and lines of fewer than
``LEAF_TOKENS`` tokens are in no group: they recur as whole lines only.
A template that occurs in enough different texts is boilerplate, and its lines are dropped from
every document. Copies of a text count as one text. A whole line needs the fewer texts the longer it
is: ``MIN_DOCS`` up to ten tokens, two from ``PASSAGE`` tokens on, where chance does not repeat it; so
a passage that only two near copies of a text share goes from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.words import words
from quillmill.storage import written

MIN_DOCS = 10
#: Tokens from which on two different texts are enough.
PASSAGE = 50
DEPTH = 4
LEAF_TOKENS = 6
FIELD = "<*>"
#: Most line kinds of open leaves that are broadcast.
BROADCAST_KINDS = 200_000


def masked(line: Column) -> Column:
    """A line's tokens, those with ASCII digits as variable fields."""
    tokens = words(line)
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))).otherwise(tokens)


def texts_needed(n: Column, min_docs: int) -> Column:
    """How many different texts a whole line of ``n`` tokens must recur in."""
    return F.least(F.lit(min_docs), F.greatest(F.lit(2), F.ceil(2 * PASSAGE / n)))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), *[F.get(tokens, F.lit(i)) for i in range(DEPTH)])


def recurring_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(docs with their key, (key, at) of the lines to drop)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.struct("doc_id", F.xxhash64(text).alias("t")).alias("key"))

    def light(tokens: Column) -> Column:
        return F.struct(F.size(tokens).alias("n"), _leaf(tokens).alias("leaf"), F.xxhash64(tokens).alias("line"))

    lines = keyed.select("key", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    # filtered inside the generator: a filter above would be pushed down and parse every line twice
    parsed = F.filter(F.transform(F.array(masked(F.col("raw"))), light), lambda x: x["n"] > 0)
    lines = lines.select("key", "at", F.inline(parsed))
    lines = written(lines, "lines")

    seen = lines.groupBy("leaf", "line", "n", F.col("key.t").alias("t")).count().drop("count")
    kinds = written(seen.groupBy("leaf", "line", "n").agg(F.count("*").alias("texts")), "kinds")
    same = kinds.filter(F.col("texts") >= texts_needed(F.col("n"), min_docs)).select("line")

    # leaves of several kinds of lines, leaving out the kinds that recur often by themselves
    other = kinds.filter((F.col("texts") < min_docs) & (F.col("n") >= LEAF_TOKENS))
    leaves = other.groupBy("leaf").agg(F.sum("texts").alias("texts"), F.count("*").alias("kinds")).filter((F.col("kinds") > 1) & (F.col("texts") >= min_docs))
    kinds_open = other.join(leaves, "leaf", "left_semi").select("line", "texts")
    n_open = kinds_open.count()
    if n_open:
        # one place of every kind is enough to read its tokens
        one = lines.join(F.broadcast(kinds_open) if n_open <= BROADCAST_KINDS else kinds_open, "line").groupBy("leaf", "line", "texts").agg(F.min(F.struct("key", "at")).alias("one"))
        wanted = one.groupBy("one.key").agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "leaf", "line", "texts")).alias("open"))
        full = keyed.join(F.broadcast(wanted) if n_open <= BROADCAST_KINDS else wanted, "key").select(F.split("text", "\n").alias("raw"), F.explode("open").alias("o"))
        full = full.select("o.leaf", "o.line", "o.texts", masked(F.get("raw", F.col("o.at"))).alias("tokens")).dropDuplicates(["line"])
        fits = written(fitting(written(full, "open"), min_docs), "fits")
        support = lines.join(fits, ["leaf", "line"]).select("leaf", "group", "key.t").distinct().groupBy("leaf", "group").agg(F.count("*").alias("texts"))
        general = fits.join(support.filter(F.col("texts") >= min_docs), ["leaf", "group"], "left_semi")
        same = same.unionByName(general.select("line")).distinct()
    return keyed, lines.join(same, "line", "left_semi").select("key", "at")


def fitting(kinds: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, line, group): the groups whose template a kind of line fits.

    ``kinds`` has leaf, line, texts and tokens. The kinds of a leaf that share the commonest tokens
    of their leaf, in six places of ten, form a group; all of the leaf together are group 0. A kind
    fits the group it is in by those tokens, and any template of its leaf that it agrees with in
    nine fixed places of ten.
    """
    core = -(-7 * min_docs // 10)
    token = kinds.select("leaf", "line", "texts", F.posexplode("tokens").alias("place", "token")).filter((F.col("place") >= DEPTH) & (F.col("token") != FIELD))
    counts = token.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n")).filter(F.col("n") >= core)
    # commonest first, so the tokens of variable fields come after those of the template around them
    chain = token.join(counts, ["leaf", "place", "token"]).groupBy("line").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "place", "token"))).alias("chain"))
    lead = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda w: w != FIELD))
    more = F.greatest(F.lit(0), F.ceil(F.size("tokens") * 6 / 10).cast("int") - lead)
    held = F.coalesce("chain", F.array().cast("array<struct<less:bigint,place:int,token:string>>"))
    first = F.sort_array(F.transform(F.slice(held, F.lit(1), more), lambda c: F.struct(c["place"].alias("place"), c["token"].alias("token"))))
    group = F.when(F.size(held) >= more, F.xxhash64("leaf", first))
    grouped = written(kinds.join(chain, "line", "left").select("leaf", "line", "texts", "tokens", group.alias("group")), "grouped")

    member = grouped.select("leaf", "texts", "tokens", F.explode(F.array_compact(F.array(F.lit(0).cast("long"), "group"))).alias("group"))
    tokens = member.select("leaf", "group", "texts", F.posexplode("tokens").alias("place", "token"))
    voted = tokens.groupBy("leaf", "group", "place", "token").agg(F.sum("texts").alias("n"))
    places = voted.groupBy("leaf", "group", "place").agg(F.sum("n").alias("total"), F.max(F.struct("n", F.col("token"))).alias("top")).filter(F.col("total") >= core)
    fixed = F.when(10 * F.col("top.n") >= 7 * F.col("total"), F.col("top.token")).otherwise(F.lit(FIELD))
    template = places.groupBy("leaf", "group").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", fixed.alias("token")))), lambda p: p["token"]).alias("template"))
    template = template.withColumn("fixed", F.size(F.filter("template", lambda t: t != FIELD))).filter(10 * F.col("fixed") >= 6 * F.size("template"))
    of_leaf = template.groupBy("leaf").agg(F.collect_list(F.struct("group", "template", "fixed")).alias("templates"))

    def agree(template: Column) -> Column:
        return F.size(F.filter(F.zip_with("tokens", template, lambda a, b: (b != FIELD) & (a == b)), lambda x: x))

    near = F.transform(F.filter("templates", lambda t: 10 * agree(t["template"]) >= 9 * t["fixed"]), lambda t: t["group"])
    near = F.coalesce(near, F.array().cast("array<bigint>"))
    return grouped.join(of_leaf, "leaf", "left").select("leaf", "line", F.explode(F.array_distinct(F.array_compact(F.concat(near, F.array("group"))))).alias("group"))


def drop_recurring_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text without the dropped lines.

    A null text counts as empty and stays empty; repeated rows give repeated rows; of tokens that tie
    for a place of a template the greatest in code-point order stands; an empty table gives no rows;
    other columns are not read. A text's lines are parsed one by one, so long texts cost in proportion.
    """
    by_doc, drops = recurring_lines(docs, min_docs=min_docs)
    gone = drops.groupBy("key").agg(F.collect_set("at").alias("gone"))

    def kept(lines: Column) -> Column:
        return F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)))

    joined = by_doc.join(gone, "key", "left")
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept(F.split("text", "\n")), "\n").alias("text"),
    )

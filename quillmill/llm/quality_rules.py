"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document. A rule that fails sets its bit in ``fail_bits``; the
measurements behind it are stored beside it. A policy is a named, versioned set of rules, so
applying another policy, or asking what one rule alone rejects, is a bitwise test on the ledger
and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.words import covered, gram_hashes, let, n_chars, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a function from a measurement's name to its column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: The position of a rule is its bit; add new rules at the end.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 20 * m("n_symbols") > m("word_chars")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("capitals", lambda m: 10 * m("n_upper") > 3 * m("n_letters")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 25 * m("n_words"))),
)

BASE = ("few_words", "repeated_words")

#: Versioned policies. ``repeated_lines`` is measured for ablations and rejects nothing by itself.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "capitals"),
    "v2": (*BASE, "symbols", "capitals", "word_length"),
}
PRODUCTION = "v2"


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in names)


def repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur at least twice, first occurrences included."""

    def places(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            rows,
            lambda s: F.sort_array(F.filter(
                F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"])),
                lambda p: p.isNotNull(),
            )),
        )

    none = F.lit(0).cast("long")
    return let(
        gram_hashes(w, 5),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(places(h), lambda p: covered(p, 5))),
    )


def measurements(text: Column) -> Column:
    """One struct of all measurements; a null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        n_chars(text, SYMBOLS).alias("n_symbols"),
        n_chars(text, "\\p{Lu}").alias("n_upper"),
        n_chars(text, "\\p{L}").alias("n_letters"),
    )


def failures(m: Callable[[str], Column]) -> Column:
    """The bits of the rules that fail, from measurements by name."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits + F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, the measurements and ``fail_bits``; one row per row of ``docs``.

    Null and empty texts have zero words and fail ``few_words``; repeated rows give repeated rows; an
    empty table gives no rows; only ``carry`` and the text are read, and a carried column of a
    measurement's name is the caller's to rename. Long texts are measured whole, windows by sorting.
    """
    m = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("k"), measurements(F.col(text)).alias("m"))
    flat = m.select("k", "m.w.*", "m.l.*", *[f"m.{c}" for c in ("n_symbols", "n_upper", "n_letters")])
    return flat.select("k", *MEASURES, failures(F.col).alias("fail_bits")).select("k.*", *MEASURES, "fail_bits")


def passes(policy: str = PRODUCTION) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(kept: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those only it rejects.

    The ledger shrinks to one row per distinct bitmask before the rules are expanded.
    """
    used = F.lit(mask(POLICIES[policy]))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in POLICIES[policy]])
    masks = kept.groupBy(F.col("fail_bits").bitwiseAND(used).cast("long").alias("bits")).agg(F.count("*").alias("n"))
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def judged(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with the base rules' verdict and the policy's."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", passes(policy) & ~base)


def keep_documents(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Rows of ``docs``, with all their columns, that the policy keeps. Nothing is shuffled."""
    place = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}

    def fails(m: Column) -> Column:
        return failures(lambda n: m[place[n]][n] if n in place else m[n])

    # one expression that measures once; a filter on the ledger's columns would repeat what they stand for
    return docs.filter(let(measurements(F.col("text")), fails).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)

"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per rule; a policy is a versioned mask, so applying another
policy, or asking what a rule alone removes, is bitwise arithmetic over the ledger and never reads a text again.

Null and empty texts have no words and fail the length rule.  Long texts are measured whole; the work is n log n in the words of a text.  Rows are
independent: repeated rows give equal rows, an empty table an empty ledger, and of the input only ``doc_id`` and ``text`` are read.
Repeated three-word windows are matched by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"

#: name -> failing condition over the measurements; a rule's bit is its position.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "3 * n_upper > n_chars",
    "exclaiming": "2 * n_exclaim > n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines and n_lines > 2",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}

#: version -> the rules that decide.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeats"),
    "v1": tuple(RULES),
}


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _count(pattern: str) -> Column:
    return F.regexp_count("_text", F.lit(pattern)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``rule_bits`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length("_text").cast("long").alias("n_chars"),
        _count("[A-Z]").alias("n_upper"),
        _count("!").alias("n_exclaim"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    rows = rows.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= 3, window).alias("_hashes"),
    ).drop("_words", "_lines")
    # most texts repeat no window: only the others' are paired with their places and sorted, which takes the most memory
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_hashes")
    # windows that stand beside an equal one in hash order occur twice or more; their positions, in order, cover a union of three-word stretches
    same = lambda i, j: F.get("_sorted", i).getField("h") == F.get("_sorted", j).getField("h")
    twice = F.filter("_sorted", lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    rows = rows.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.getField("i")))).drop("_sorted")
    covered = F.aggregate(F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(RULES.values())), F.lit(0))
    return rows.withColumn("rule_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v1", out: str = "kept") -> DataFrame:
    return rows.withColumn(out, F.col("rule_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Of each rule of a policy: documents that fail it, that fail it alone, and how many would be kept without it."""
    full = mask(POLICIES[version])
    by_bits = rows.groupBy(F.col("rule_bits").bitwiseAND(F.lit(full)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit")) for r in POLICIES[version]]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    n_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        n_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        n_if(F.col("bits") == F.col("bit")).alias("fails_alone"),
        n_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )

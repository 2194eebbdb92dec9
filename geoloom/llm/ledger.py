"""Quality rules as a ledger of failure bits; policies are masks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import WORD, pinned

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


#: What fails a text. The place of a rule in this list is its bit; new rules go to the end.
FAILS = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "more_symbols_than_words": "n_symbols > n_words",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
RULES = tuple(FAILS)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject.
POLICIES = {"base": BASE, "v1": RULES}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, <MEASURES>, bits)``: each input row as a struct, its measurements, and a bit for each failed rule.

    One pass without a shuffle; every rule is evaluated once and policies are applied later.
    Windows are compared by 64-bit hashes of their three words. A null text counts as empty:
    it has no words and fails ``few_words``. Repeated rows are judged alike. Columns of the
    input stay inside ``row`` and so never clash.
    """
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = pinned(df, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    window = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.inline(F.array(F.struct(F.when(F.size("words") >= 3, window).alias("windows")))),
    )
    # only texts in which some window comes back are sorted
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    df = pinned(df, F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("sorted"))
    twin = lambda x, i: F.coalesce(F.get("sorted", i)["h"] == x["h"], F.lit(False))
    df = pinned(df, F.sort_array(F.transform(F.filter("sorted", lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x["p"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.coalesce(F.get("at", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    df = pinned(df, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    bits = sum((F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(FAILS.values())), F.lit(0))
    return pinned(df.select("row", *MEASURES), bits.cast("long").alias("bits"))


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("bits").bitwiseAND(F.lit(mask(policy))) == 0


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return ledger(docs, text_col).where(passes(policy)).select("row.*")


def ablations(marked: DataFrame, policy: str = "v1") -> DataFrame:
    """``(rule, n_failed, n_only)``: rows that fail each rule of a policy, and rows that no other rule of it rejects.

    The ledger shrinks to one row per bit pattern (at most ``2**len(RULES)``) first. An
    empty ledger gives zeros.
    """
    patterns = marked.groupBy(F.col("bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).count()
    each = [F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[policy]]
    sums = patterns.agg(
        *(F.sum(F.when(F.col("bits").bitwiseAND(x["bit"]) != 0, F.col("count")).otherwise(0)).alias(f"f{k}") for k, x in enumerate(each)),
        *(F.sum(F.when(F.col("bits") == x["bit"], F.col("count")).otherwise(0)).alias(f"o{k}") for k, x in enumerate(each)),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = F.array(*(F.struct(x["rule"].alias("rule"), zero(f"f{k}").alias("n_failed"), zero(f"o{k}").alias("n_only")) for k, x in enumerate(each)))
    return sums.select(F.inline(rows))

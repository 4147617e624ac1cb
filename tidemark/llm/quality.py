"""Quality rules: a ledger with one failure bit a rule, read by versioned policies through bitwise operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import SPACE, let, window_hashes, words

#: Words of a window of which a repetition counts.
REPEAT_WINDOW = 5
#: What a bulleted line begins with, what an ellipsis line ends with, a word without letters, and control or replacement characters.
BULLET, ELLIPSIS = f"^[{SPACE}]*[-*•‣◦]", f"(\\.\\.\\.|…)[{SPACE}]*$"
LETTERLESS, CONTROL = f"(?<![^{SPACE}])[^\\p{{L}}{SPACE}]++(?![^{SPACE}])", "[\\x00-\\x08\\x0E-\\x1F\\x7F\\x{FFFD}]"
#: The measurements of a document.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines", "n_ellipsis_lines", "n_alpha_words", "longest_word", "n_control")


def repeated_words(word_list: Column, n: int = REPEAT_WINDOW) -> Column:
    """Words covered by n-word windows that stand in the text twice or more, the first included. Windows are told apart by 64-bit hashes.

    Pairs of a window's hash and place are sorted, so equal windows become neighbours; the places of those that have an equal neighbour, in
    order, cover min(n, gap to the next) words each. Holds for texts of any length."""

    def places(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def hits(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return F.coalesce(a.h == b.h, F.lit(False))

            near = F.filter(s, lambda v, i: same(v, F.get(s, i - 1)) | same(v, F.get(s, i + 1)))
            return F.sort_array(F.transform(near, lambda v: v.i))

        return let(keyed, hits)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda v, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - v, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return let(
        window_hashes(word_list, n),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(places(h), covered)),
    )


def measurements(df: DataFrame, text: str = "text") -> DataFrame:
    """df's rows with a struct column _m of MEASURED."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return df.withColumn(
        "_m",
        let(
            words(F.col(text)),
            lambda w: let(
                lines,
                lambda x: F.struct(
                    F.size(w).cast("bigint").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                    F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                    F.size(x).cast("bigint").alias("n_lines"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                    repeated_words(w).alias("n_repeat_words"),
                    F.size(F.filter(x, lambda v: v.rlike(BULLET))).cast("bigint").alias("n_bullet_lines"),
                    F.size(F.filter(x, lambda v: v.rlike(ELLIPSIS))).cast("bigint").alias("n_ellipsis_lines"),
                    (F.size(w) - F.regexp_count(t, F.lit(LETTERLESS))).cast("bigint").alias("n_alpha_words"),
                    F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("bigint").alias("longest_word"),
                    F.regexp_count(t, F.lit(CONTROL)).cast("bigint").alias("n_control"),
                ),
            ),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A failure bit: fails(measurements) tells whether a document breaks the rule."""

    bit: int
    name: str
    fails: object


#: Bits are never reused: a changed rule gets a new bit, and a new policy version names it.
RULES = (
    Rule(0, "few_words", lambda m: m.n_words < 10),
    Rule(1, "repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
    Rule(2, "symbols", lambda m: m.n_symbols > m.n_words),
    Rule(3, "repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * m.n_lines),
    Rule(4, "short_words", lambda m: 10 * m.word_chars < 15 * m.n_words),
    Rule(5, "long_words", lambda m: m.word_chars > 25 * m.n_words),
    Rule(6, "bullet_lines", lambda m: 10 * m.n_bullet_lines > 9 * m.n_lines),
    Rule(7, "ellipsis_lines", lambda m: 10 * m.n_ellipsis_lines > 3 * m.n_lines),
    Rule(8, "few_alphabetic", lambda m: 10 * m.n_alpha_words < 5 * m.n_words),
    Rule(9, "unbroken", lambda m: m.longest_word > 1000),
    Rule(10, "control_characters", lambda m: 10 * m.n_control > m.n_words),
)

#: Versioned policies: the rules a version enforces. Version 1 is the base alone.
POLICIES = {1: ("few_words", "repeated_windows"), 2: tuple(r.name for r in RULES[:6]), 3: tuple(r.name for r in RULES)}
NEWEST = max(POLICIES)


def mask(names) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements as columns and fail_bits (bigint): bit r.bit is set if the document breaks rule r.

    Every rule is evaluated once, in one pass without a shuffle. A null text counts as empty: it fails few_words. Columns of docs
    that have a measurement's name are replaced."""
    m = measurements(docs, text)
    bits = F.lit(0).cast("bigint")

    class View:
        def __getattr__(self, name: str) -> Column:
            return F.col(f"_m.{name}")

    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(View()), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    m = m.withColumn("fail_bits", bits)
    return m.withColumns({n: F.col(f"_m.{n}") for n in MEASURED}).drop("_m")


def verdict(fail_bits: Column, version: int = NEWEST) -> Column:
    """Whether the policy version keeps a document with these bits."""
    return fail_bits.bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) == 0


def ablation(led: DataFrame, version: int = NEWEST) -> DataFrame:
    """A row a rule of the policy: documents that fail it, that fail it alone, and that would be kept without it. Only the ledger's bits are read.

    Documents are counted by their bits under the policy's mask, map-side first, so at most 2^rules short rows are shuffled however many documents
    share one pattern; all else is bit operations on these patterns. An empty ledger gives zeros."""
    full = mask(POLICIES[version])
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if r.name in POLICIES[version]])
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    none = led.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("bits"), F.lit(0).cast("bigint").alias("n"))
    each = patterns.unionByName(none).select("bits", "n", F.inline(rules))
    bits, bit = F.col("bits"), F.col("bit")

    def total(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).cast("bigint")

    return each.groupBy("rule").agg(
        total(bits.bitwiseAND(bit) != 0).alias("failed"), total(bits == bit).alias("failed_alone"), total(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without")
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """A row a document with the ledger's bits and the newest policy's verdict; null and empty texts have zeros and fail. Repeated rows come out as
    often as they are there, a null doc_id stays null, other columns are left out."""
    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[1])).cast("bigint")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict(F.col("fail_bits")).alias("kept"), "fail_bits")


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy does to the whole table, from the ledger of op10."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")))

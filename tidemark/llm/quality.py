"""Quality rules as a bitmask ledger, with DataFrame functions only.

Each document is measured and each rule evaluated once; the ledger keeps the
measurements and one failure bit for each rule. A policy is a versioned mask
over those bits: applying or comparing policies reads the ledger alone.

Null texts have no words, so they fail the base rules. Empty texts likewise.
Every row is judged by itself: ties, repeated rows and null ids change nothing.
Measurements never pass a row's own text, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: A bit, once given, keeps its meaning; rules are only ever added.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(3, "long_words", "word_chars > 15 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "no_letters", "5 * n_letter_words < 3 * n_words"),
    Rule(7, "too_many_words", "n_words > 5000000"),
)
BASE = 0b11
#: Policy versions: name to mask. A document is kept if no bit of the mask failed.
POLICIES = {"base-1": BASE, "strict-1": 0b1111111, "default-1": 0b1011111}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")


def _repeated(words: str) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted with their places, neighbours compared, and the places
    found sorted again: n log n, whatever repeats.
    """
    return F.expr(
        f"array_sort(transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (w, i) -> struct(concat_ws(' ', w, {words}[i + 1], {words}[i + 2]) as t, i as i)))"
    )


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and the measurements of its text.

    The non-deterministic ``_at`` keeps filters on measurements above this
    projection; pushed below, they would measure each text many times over.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    squeezed = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = docs.select(F.struct("*").alias("row")).withColumns({"_words": words_of(F.col("row.text")), "_lines": lines})
    rows = rows.withColumn("_windows", _repeated("_words"))
    # Places of windows that equal a neighbour in sorted order, rising.
    places = F.expr(
        "array_sort(transform(filter(transform(_windows, (x, k) -> struct(x.i as i, (k > 0 and _windows[k - 1].t = x.t) or coalesce(get(_windows, k + 1).t = x.t, false) as twice)), x -> x.twice), x -> x.i))"
    )
    rows = rows.withColumn("_places", places)
    covered = F.expr("aggregate(_places, named_struct('end', -1, 'n', 0L), (a, p) -> named_struct('end', p + 2, 'n', a.n + p + 2 - greatest(a.end, p - 1)), a -> a.n)")
    return rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(squeezed).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
            "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
        }
    ).drop("_words", "_lines", "_windows", "_places").withColumn("_at", F.monotonically_increasing_id())


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One long whose bit ``rule.bit`` is set where the rule fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, measurements and failed_bits, one row for each row of ``docs``."""
    rows = measured(docs.select("doc_id", "text"))
    bits = failure_bits(rules).bitwiseOR(F.when(F.col("_at") < 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return rows.select("row.doc_id", *MEASURES, bits.alias("failed_bits"))


def verdict(mask: int, bits: str = "failed_bits") -> Column:
    """True where a policy of this mask keeps the row."""
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(ledger_rows: DataFrame, policies: dict[str, int] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, rule, n_failed, n_only: documents that a rule rejects, and that no other rule of the policy rejects.

    The ledger shrinks to its distinct bit patterns first.
    """
    spark = ledger_rows.sparkSession
    patterns = ledger_rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    masks = spark.createDataFrame([(p, int(m), r.name, 1 << r.bit) for p, m in (policies or POLICIES).items() for r in rules if m >> r.bit & 1], "policy string, mask long, rule string, bit long")
    hit = patterns.join(F.broadcast(masks), F.expr("failed_bits & bit <> 0"))
    return hit.groupBy("policy", "rule").agg(F.sum("n").alias("n_failed"), F.sum(F.expr("case when failed_bits & mask = bit then n else 0 end")).alias("n_only"))


def filtered(docs: DataFrame, mask: int = POLICIES["default-1"], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the policy keeps, with the columns they came with."""
    rows = measured(docs)
    return rows.filter(failure_bits(rules).bitwiseAND(F.lit(mask).cast("long")) == 0).filter("_at >= 0").select("row.*")

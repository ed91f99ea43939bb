"""Operator 4: quality rules as a short-circuit cascade of SQL expressions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import discard, materialize, quoted

#: White space between words, a fixed value.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Rows of the sample on which costs and selectivities are estimated; they set the order alone, never a verdict.
SAMPLE_ROWS = 2000


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_repeat_words(word: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the sorted window hashes."""
    n = F.size(word)
    windows = F.slice(F.arrays_zip(word.alias("a"), F.slice(word, 2, n).alias("b"), F.slice(word, 3, n).alias("c")), 1, F.greatest(n - 2, F.lit(0)))
    hashed = F.transform(windows, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(F.sort_array(hashed), covered)


#: Arrays that several statistics share; a cascade makes each at most once a row.
ARRAYS = {"words": words, "lines": word_lines}


def statistics(text: Column, held: dict[str, Column] | None = None) -> dict[str, Column]:
    """The figures that the rules use, each as an expression over the whole text or over arrays that are there already."""
    t = F.coalesce(text, F.lit(""))
    w, lines = (dict(held or {}).get(k, make(text)) for k, make in ARRAYS.items())
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": n_repeat_words(w).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects a row where `reject` is true; `reject` is given the statistics by name, and `needs` names the arrays they rest on."""

    name: str
    reject: object
    needs: tuple[str, ...] = ("words",)

    def on(self, stats: dict[str, Column]) -> Column:
        return F.coalesce(self.reject(stats), F.lit(False))


#: Rejected by the contract's base.
BASE_RULES = (
    Rule("few_words", lambda s: s["n_words"] < 50),
    Rule("repeated_windows", lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"]),
)
#: The method's own rules; texts of common prose are far from every bound.
OWN_RULES = (
    Rule("symbols", lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("word_length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"])),
    # a heading or footer that stands twice among a handful of lines is no fault
    Rule("repeated_lines", lambda s: (s["n_lines"] >= 10) & (10 * s["n_dup_lines"] > 3 * s["n_lines"]), ("lines",)),
)
RULES = BASE_RULES + OWN_RULES


def rule_costs(sample: DataFrame, rules=RULES, runs: int = 3) -> list[float]:
    """Seconds that each rule takes over the sample: the least of some runs, less those of a job without a rule."""

    def seconds(condition: Column) -> float:
        took = []
        for _ in range(runs):
            began = time.monotonic()
            sample.agg(F.count_if(condition)).first()
            took.append(time.monotonic() - began)
        return min(took)

    alone = seconds(F.col("t").isNull())
    return [max(seconds(~cascade([rule], F.col("t"))) - alone, 1e-4) for rule in rules]


def order_rules(df: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample: always the one that rejects most of what the earlier ones let pass; those that reject nothing come last, cheapest first.

    The sample is a seeded fraction that holds about sample_rows rows whatever the table's size. The order
    changes how much work the cascade does and no verdict.
    """
    rules = list(rules)
    total = df.count()
    if not total or not rules:
        return rules
    sample = materialize(df.select(quoted(text).alias("t")).sample(min(1.0, sample_rows / total), seed=7), "rule-sample")
    costs = rule_costs(sample, rules)
    # how many rows each set of rules rejects together: 2^rules rows at most
    flags = [(~cascade([rule], F.col("t"))).alias(f"r{i}") for i, rule in enumerate(rules)]
    seen = [([r[i] for i in range(len(rules))], r["n"]) for r in sample.select(*flags).groupBy(*(f"r{i}" for i in range(len(rules)))).agg(F.count("*").alias("n")).collect()]
    discard(sample)
    order: list[int] = []
    while len(order) < len(rules):
        open_ = [(f, n) for f, n in seen if not any(f[i] for i in order)]
        left = [i for i in range(len(rules)) if i not in order]
        order.append(max(left, key=lambda i: (sum(n for f, n in open_ if f[i]) / costs[i], -costs[i])))
    return [rules[i] for i in order]


def cascade(rules, text: Column, held: dict[str, Column] | None = None) -> Column:
    """True where no rule rejects. CASE branches are evaluated in turn, so that a later rule's arrays and figures are only made for rows that the earlier ones let pass, and once."""
    rules, held = list(rules), dict(held or {})
    if not rules:
        return F.lit(True)
    for need in rules[0].needs:
        if need not in held:
            return let(ARRAYS[need](text), lambda v: cascade(rules, text, {**held, need: v}))
    return F.when(rules[0].on(statistics(text, held)), F.lit(False)).otherwise(cascade(rules[1:], text, held))


def keep_good(df: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their columns; rules run in the order found on a sample.

    Null and empty texts have no words and are rejected. Verdicts depend on the row's text alone, so repeated
    rows share theirs; columns named like a statistic are not touched. An empty table stays empty.
    """
    return df.where(cascade(order_rules(df, rules, text, sample_rows), quoted(text)))


def quality_report(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=OWN_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """keep, all statistics, base_failed and kept. The cascade's rules run on the rows that the base lets pass.

    Null texts count as empty (no words, base_failed); input columns named like an output are left out.
    """
    ordered = order_rules(df, rules, text, sample_rows)
    made = df.select(*(quoted(c) for c in keep), F.coalesce(quoted(text), F.lit("")).alias("__t"), words(quoted(text)).alias("__w"), word_lines(quoted(text)).alias("__l"))
    made = made.select(*(quoted(c) for c in keep), *(c.alias(n) for n, c in statistics(F.col("__t"), {"words": F.col("__w"), "lines": F.col("__l")}).items()))
    stats = {n: F.col(n) for n in made.columns if n not in keep}
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.on(stats)
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(rule.on(stats), F.lit(False)).otherwise(verdict)
    return made.withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict))

"""Quality rules as a short-circuit cascade (DataFrame functions only).

Cost and selectivity of every rule are estimated on a bounded sample (rows whose texts have the least hashes, of which those that the base rules let
through are stored with their features); rules then run in order of rejections per second, and ``CASE`` stops at the first that fails. The order never changes a verdict, only the work.

Defined results: null text has no words and fails the base rules; a rule that yields null passes; repeated rows,
ties and extra columns pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, let, table, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where the rule rejects a row."""

    name: str
    fails: Column


def _repeat_words(w: Column) -> Column:
    """Words inside ``WINDOW``-word windows found at least twice in the text, the first finding included."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    def covered(s: Column) -> Column:
        same = lambda i, j: s[i]["h"] == s[j]["h"]
        twice = F.filter(s, lambda x, i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < F.size(s) - 1, same(i, i + 1)).otherwise(False))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(p[i + 1] - x, F.lit(WINDOW))).otherwise(WINDOW)), F.lit(0), lambda a, x: a + x))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, count))


def features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    big = lambda c, name: c.cast("long").alias(name)
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("rep")))
    both = let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda x: F.struct(
        big(x["w"]["n"], "n_words"), big(x["w"]["chars"], "word_chars"),
        big(F.length(full) - F.length(F.translate(full, SYMBOLS, "")), "n_symbols"),
        big(x["l"]["n"], "n_lines"), big(x["l"]["dup"], "n_dup_lines"), big(x["w"]["rep"], "n_repeat_words")))
    return both


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 10), Rule("repeated_words", 100 * F.col("n_repeat_words") > 20 * F.col("n_words"))]


def default_rules() -> list[Rule]:
    """Rules after the base ones. They read the feature columns and ``text``."""
    letters = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\P{L}]+", ""))
    capitals = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\P{Lu}]+", ""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 20 * F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("few_letters", 100 * letters < 50 * F.col("word_chars")),
        Rule("shouting", 100 * capitals > 60 * F.col("word_chars")),
    ]


def ranked(sample: DataFrame, rules: Sequence[Rule], times: int = 40) -> list[Rule]:
    """Rules by falling rejections per second on a small stored sample of rows that reach them; ties by name. Order only, never a verdict.

    Each rule has one timed pass, over each row ``times`` times, less the time of a pass without a rule; one pass before all warms up."""
    spread = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def timed(fails: Column) -> tuple[float, int, int]:
        # a fresh literal in the condition keeps one row's evaluations from being shared
        began = time.perf_counter()
        seen, hit = spread.agg(F.count("*"), F.count_if((F.col("_again") > 0) & F.coalesce(fails, F.lit(False)))).first()
        return time.perf_counter() - began, seen, hit

    timed(reduce(lambda a, b: a | b, [r.fails for r in rules], F.lit(False)))
    idle = timed(F.lit(False))[0]
    found = []
    for rule in rules:
        took, seen, hit = timed(rule.fails)
        found.append((-(hit / max(seen, 1)) / max(took - idle, 1e-3), rule.name, rule))
    return [x[2] for x in sorted(found, key=lambda x: x[:2])]


def verdict(rules: Sequence[Rule]) -> Column:
    """True if no rule fails; later rules aren't evaluated after a failure."""
    return reduce(lambda rest, rule: F.when(rule.fails, False).otherwise(rest), reversed(rules), F.lit(True))


def quality_filter(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """``df`` with the feature columns, ``base_failed`` and ``kept``; columns of ``df`` with those names are replaced."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [c for c in df.columns if c not in (*names, "base_failed", "kept", "_f", "text")]
    wide = df.select(*keep, F.col(text).alias("text"), features(F.col(text)).alias("_f")).select(*keep, "text", *[F.col("_f")[n].alias(n) for n in names])
    base = reduce(lambda a, b: a | b, [r.fails for r in base_rules()])
    rules = default_rules() if rules is None else rules
    hashed = F.xxhash64(text)  # distinct ones, so that copies of a text take one place
    last = df.select(hashed.alias("h")).distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    few = df.where(hashed <= F.lit(last)).select(*keep, F.col(text).alias("text")).limit(2 * sample_rows)
    probe = few.withColumn("_f", features(F.col("text"))).select(*keep, "text", *[F.col("_f")[n].alias(n) for n in names]).where(~base)
    sample = written(df.sparkSession, probe, "quality-sample")
    order = ranked(sample, rules)
    drop(sample)
    return wide.withColumn("base_failed", base).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(order)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_filter(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS r(i)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS q(k) GROUP BY rid),
f AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * length(regexp_replace(t, '\P{L}+', '', 'g')) < 50 * word_chars
            OR 100 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > 60 * word_chars) AS kept
FROM b
"""
QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": SQL}

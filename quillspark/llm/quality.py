"""Operator 5: quality rules.

A table of thresholds is compiled into one projection; nothing is shuffled and no user function runs. Every
bound is a comparison of integers, so that the rules mean the same in any engine.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged each for itself;
an empty table gives an empty table; extra columns are passed through `quality_filter` untouched and are left
out by `quality_report`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, count_chars, let, positions, table, text_or_empty, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by an at this or from he not have "
    "der die das und zu den von ist des sich mit für nicht ein eine auf dem im auch es "
    "de la le et les des en un une du que est pour qui dans par sur pas au plus "
    "el los las y que se del un una por con no su para lo como al más o"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects a text where left_factor * left > right_factor * right."""

    name: str
    left_factor: int
    left: str
    right_factor: int
    right: str


# The base rules of the contract.
BASE_RULES = (
    Rule("too_short", 50, "one", 1, "n_words"),
    Rule("repeats", 100, "n_repeat_words", 50, "n_words"),
)
#: The method's own rules; shares of words, word characters or lines.
RULES = (
    Rule("symbols", 5, "n_symbols", 1, "n_words"),
    Rule("long_words", 1, "word_chars", 20, "n_words"),
    Rule("short_words", 2, "n_words", 1, "word_chars"),
    Rule("capitals", 2, "n_upper", 1, "word_chars"),
    Rule("few_stop_words", 1, "n_words", 100, "n_stop_words"),
    Rule("repeated_lines", 2, "n_dup_lines", 1, "n_lines"),
)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text. Texts without a repeat stop at the distinct count; others sort (window, place) once, so the work is n log n in the text's length."""

    def covered(grams: Column) -> Column:
        def marked(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("last"))
            return F.aggregate(places, start, lambda a, p: F.struct((a["c"] + F.least(F.lit(3), p - a["last"])).alias("c"), p.alias("last")))["c"]

        s = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(s, marked))

    def grams_of(w: Column) -> Column:
        return F.transform(positions(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: let(grams_of(w), covered))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measures that the rules name."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumns(
        {
            "_w": counts,
            "_l": dup,
            "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
            "n_symbols": count_chars(text, SYMBOLS),
            "n_upper": (F.size(F.split(text, r"\p{Lu}", -1)) - 1).cast("long"),
        }
    ).withColumns({"n_words": F.col("_w.n_words"), "n_stop_words": F.col("_w.n_stop_words"), "n_repeat_words": F.col("_w.n_repeat_words"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines"), "one": F.lit(1).cast("long")})


def broken(rules: tuple[Rule, ...]) -> Column:
    """True where a rule rejects."""
    found = F.lit(False)
    for r in rules:
        found = found | (F.col(r.left) * r.left_factor > F.col(r.right) * r.right_factor)
    return found


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return measured(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        broken(BASE_RULES).alias("base_failed"), (~broken(BASE_RULES + rules)).alias("kept"),
    )


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns of docs."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    return measured(held).where(~broken(BASE_RULES + rules)).select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    return " OR ".join(f"{r.left_factor} * {r.left} > {r.right_factor} * {r.right}" for r in rules)


def measures_sql(source: str) -> str:
    """DuckDB SQL of `measured` over source(doc_id, text); doc_id must be unique."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
    SELECT d.doc_id, d.n_words, d.n_stop_words, d.word_chars, d.n_symbols, d.n_upper, d.n_lines, d.n_dup_lines,
           coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, 1::BIGINT AS one
    FROM (
      SELECT doc_id, len(w)::BIGINT AS n_words, len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             (length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_upper,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
      FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
            FROM {source}) s
    ) d LEFT JOIN (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
            SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
              SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {source}) x) y) z) q
        WHERE n > 1) v GROUP BY doc_id
    ) r ON d.doc_id = r.doc_id"""


def report_sql(source: str) -> str:
    return f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      ({_sql_rules(BASE_RULES)}) AS base_failed, NOT ({_sql_rules(BASE_RULES + RULES)}) AS kept FROM ({measures_sql(source)}) m"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE = {"op5_quality_rules": report_sql("documents")}

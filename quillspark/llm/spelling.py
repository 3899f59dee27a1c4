"""Operator 13: spelling variants grouped by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Words at edit distance one share exactly one key: the
shorter word where a code point was put in, the common deletion where one was replaced. So an equality join of the keys
finds every near pair once, an exact distance drops the rest (exchanged neighbours), and partial aggregates give each
word's form. Words that share a key differ from it by one letter, so a key has at most 90 times its length of words: no
key is hot however often its words occur. Counts are summed before any word is shuffled. A form occurs at least five
times as often as its word, so chains of forms end; pointers are doubled until none moves.

Defined cases: a null or empty text has no words; a null doc_id reads as the empty string; repeated rows count each for
itself; ties of counts go to the smaller word in code-point order; long texts and long words are taken whole; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, let, parts_of, positions, table, text_or_empty

#: Fixed values of the contract: what stands between words, and how words are changed, kept and grouped.
GAPS = "[^A-Za-zÀ-ÿ]+"
CHANGED = 199
MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, i: Column) -> Column:
    """word without the code point at i."""
    return F.concat(F.substring(word, F.lit(1), i), F.substr(word, i + 2))


def changed(run: Column, doc_id: Column) -> Column:
    """run, less a code point where the checksum of document and run says so."""
    mark = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    return let(mark, lambda h: F.when(h % CHANGED == 0, without(run, (h % F.length(run)).cast("int"))).otherwise(run))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    runs = parts_of(F.translate(text_or_empty(), UPPER, LOWER), GAPS)
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    long = docs.select(doc_id.alias("id"), F.explode(F.filter(runs, lambda r: F.length(r) >= MIN_LENGTH)).alias("run"))
    words = long.select(changed(F.col("run"), F.col("id")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def keyed(words: DataFrame) -> DataFrame:
    """A row for each word and key: 96 bits of hashes of the word and of each of its single deletions."""
    both = lambda w: F.struct(F.xxhash64(w).alias("k"), F.hash(w).alias("k2"))
    keys = F.array_distinct(F.array_append(F.transform(positions(F.length("word")), lambda i: both(without(F.col("word"), i))), both(F.col("word"))))
    return words.select("word", "n", F.explode(keys).alias("key")).select("word", "n", "key.k", "key.k2")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best(n, word): the near words of each word that has one, and the most frequent of them."""
    a = keyed(words)
    b = a.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "k", "k2")
    sizes = F.abs(F.length("word") - F.length("near")) <= 1
    pairs = a.join(b, ["k", "k2"]).where((F.col("word") != F.col("near")) & sizes & (F.levenshtein("word", "near", 1) == 1))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the last word that forms lead to. A word's form has a count five times its own, so the rounds are logarithmic in the logarithm of the largest count."""
    now = Written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = Written(now.df.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now.drop()
        if not after.df.where("moved").limit(1).count():
            return after.df.drop("moved")
        now = Written(after.df.drop("moved"), "roots")
        after.drop()


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = Written(word_counts(docs.select("doc_id", "text")), "words").df
    near = near_words(words)
    taken = -F.col("best.less") >= TIMES * F.col("n")
    listed = words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.less")).alias("form_n"),
    )
    listed = Written(listed, "forms").df
    roots = followed(listed.where("form IS NOT NULL"))
    return listed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def variants_sql(source: str) -> str:
    """DuckDB SQL of `spelling_variants`; the checksum is folded byte by byte over its table, which a rule gives."""
    return f"""
    WITH RECURSIVE bits AS (
      SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
      UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
    ), crcs AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
    ), runs AS (
      SELECT id, run, count(*) AS n FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM {source}) x
      WHERE length(run) >= {MIN_LENGTH} GROUP BY id, run
    ), marked AS (
      SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
          lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))),
          lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h
      FROM runs, crcs
    ), words AS (
      SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % {CHANGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM marked) m
      WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
    ), keys AS (
      SELECT DISTINCT word, n, unnest(list_append(list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)), word)) AS k FROM words
    ), pairs AS (
      SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b USING (k) 
      WHERE (length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)
         OR (abs(length(a.word) - length(b.word)) = 1 AND (k = a.word OR k = b.word))
    ), ranked AS (
      SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs
    ), forms AS (
      SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near_n END AS form_n
      FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1
    ), chain AS (
      SELECT word, word AS at, form AS next FROM forms
      UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word
    )
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL"""


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE = {"op13_spelling_variants": variants_sql("documents")}

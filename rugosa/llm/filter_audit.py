"""How filters applied one after another interact, in every order of them.

Documents are reduced to cells: one row for each part, set of failed filters (a bit mask) and
measures. Cells are unpivoted against the steps of all orders of the filters. Along an order, a
running bit-or over a window of the steps before tells whether a cell was removed earlier; with it,
conditional sums give each step's figures, and a window over a filter's steps in all orders gives
its Shapley sum. Only the cells depend on the corpus, and they are as many as there are parts times
sets of failed filters.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, min_words: int = 200) -> dict[str, Column]:
    """The failure conditions of filters that look at one text, which must not be null, by letter.

    A: fewer than min_words words. B: under half of the words are distinct. C: over 3 % of the code
    points are A-Z. D: holds one of # $ % & * |. An empty text fails A only.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(letter: str, filters: str = FILTERS) -> int:
    return 1 << filters.index(letter)


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and failed filters, with labelled ones counted.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. Null texts are empty, a null lang is
    the part ''. E fails where a smaller doc_id has the very same text; a null id is neither smaller
    nor larger than another, and rows alike in id and text are not smaller than each other, so they
    all stay. Each row counts. A document is good or toxic if any row of its labels says so.

    Rows travel without texts, as a SHA-256. Copies are counted before they meet: a text copied a
    million times comes to the place of its least id as one row for each task, part and label.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    failed = sum(F.when(fails, bit(f)).otherwise(0) for f, fails in text_failures(F.col("text")).items())
    d = d.select("doc_id", "part", failed.alias("mask"), F.unhex(F.sha2("text", 256)).alias("same"))
    # null ids have no labels; they are spread, so that many of them are not one key
    d = d.withColumn("spread", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("same"), F.lit(1024))).otherwise(0))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    marks = marks.select("doc_id", F.lit(0).cast("long").alias("spread"), "quality", "toxic")
    d = d.withColumn("spread", F.col("spread").cast("long")).join(marks, ["doc_id", "spread"], "left")
    of = ["same", "part", "mask", "quality", "toxic"]
    d = d.na.fill(0, ["quality", "toxic"])
    rows = d.groupBy(*of, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = rows.groupBy(*of).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first
    )
    # a row for each part and label of a text: few, however many copies it has
    least = F.min("first.doc_id").over(Window.partitionBy("same"))
    stay = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("least", least).withColumn("stay", stay)
    copy = F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))
    split = groups.select("part", "quality", "toxic", F.explode(F.array(F.struct("mask", F.col("stay").alias("n")), copy)).alias("c"))
    split = split.select("part", "quality", "toxic", "c.mask", "c.n").where("n > 0")
    counted = [F.sum("n").alias("n"), F.sum(F.expr("n * quality")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic")]
    return split.groupBy("part", "mask").agg(*counted)


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, ...): figures of each step of every order of the filters.

    cells: (part, mask, n, good, toxic), the bit of filter i of `filters` set where it fails. A part
    without cells has no rows; a part with any has a row for each order and step, zeros included.
    Cells alike add up.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    letters = F.sequence(F.lit(1), F.lit(len(filters)))
    # a part's cells meet once, before they are unpivoted: at most 2^filters rows
    cells = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).repartition("part")
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(letters))
    steps = steps.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    own = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("filter")) - 1)
    steps = steps.withColumn("own", own).withColumn("fails", F.col("mask").bitwiseAND(F.col("own")))
    along = Window.partitionBy("part", "filter_order", "mask").orderBy("step")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") > 0, F.col("earlier") > 0
    total = lambda where, c="n": F.sum(F.when(where, F.col(c)).otherwise(0)).cast("long")
    figures = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(fails & (F.col("mask") == F.col("own"))).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return figures.withColumn("shapley", shapley).select("part", "filter_order", "step", *MEASURES)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(document_cells(docs, labels))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS failed
  FROM w LEFT JOIN marks m ON w.doc_id = m.doc_id
), cells AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT l AS o FROM letters
  UNION ALL SELECT o || l FROM orders, letters WHERE NOT contains(o, l)
), steps AS (
  SELECT o, s AS step, o[s] AS l, o[1:s - 1] AS ahead FROM orders, range(1, 6) r(s) WHERE length(o) = 5
), x AS (
  SELECT part, o, step, l, n, good, toxic, failed, contains(failed, l) AS fails,
    length(translate(failed, ahead, '')) < length(failed) AS gone
  FROM cells, steps
), g AS (
  SELECT part, o AS filter_order, step::INT AS step, l,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = l), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, o, step, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM g
"""

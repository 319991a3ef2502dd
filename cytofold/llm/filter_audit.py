"""What filters do to each other: survivors of every subset of them, and what each removes at each place of every order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


WORDS = r"[\x20\x09-\x0D]+"
MARKS = ("good", "toxic")


def tokens(text: Column) -> Column:
    """The maximal runs of other than ASCII white space."""
    return F.filter(F.split(text, WORDS), lambda w: w != "")


def document_filters(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions that look at a document alone. words: tokens(text), made once."""
    n, chars = F.size(words), F.char_length(text)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * chars,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part that fail exactly the filters of `mask` (bit k for the k-th of ABCDE), apart by their marks.

    marks: (doc_id, good, toxic), 0 or 1, a row for each id at most. E, a text that a row of smaller id has too, is told from (digest, id) rows: of a digest's rows those of its least
    id pass and all others fail. Texts stay where they are: what is shuffled is a few numbers a row, first by id to meet the marks, then by digest after
    rows of equal digest, part and marks were combined, so that a text that a third of all rows hold is a few rows for each task.

    Null text: empty. Null part: the empty string. Null id: no marks, and E passes. Repeated rows each count; of equal text and id, both pass E or both fail.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("words", tokens(F.col("text")))
    alone = document_filters(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(alone.values())), F.lit(0))
    rows = of.select("id", "part", mask.alias("mask"), F.unhex(F.md5("text")).alias("digest"))
    last = 1 << len(alone)
    rows = rows.join(marks, rows["id"] == marks["doc_id"], "left").select("id", "part", "mask", "digest", *(F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MARKS))
    key = ["digest", "part", "mask", *MARKS]
    byid = rows.groupBy("id", *key).agg(F.count(F.lit(1)).alias("n"))  # stays where the join left it
    # rows of null id never fail E and are nobody's smaller id: they go past the digests
    least = byid.where("id is not null").groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = least.withColumn("min", F.min("first.id").over(Window.partitionBy("digest")))
    passed = F.when(F.col("first.id") == F.col("min"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct("mask", passed.alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - passed).alias("n")))
    counted = least.select("part", *MARKS, F.inline(split)).unionByName(byid.where("id is null").select("part", *MARKS, "mask", "n"))
    return counted.where("n > 0").groupBy("part", "mask", *MARKS).agg(F.sum("n").alias("n"))


def zeta(counts: Column, n: int) -> Column:
    """Subset sums of an array of 2^n counts by mask: entry S becomes the sum over all subsets of S, a bit at a time."""
    bits = F.array(*[F.lit(1 << k) for k in range(n)])
    step = lambda now, bit: F.transform(now, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(now, i.bitwiseXOR(bit))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, counts, step)


def survivors(counts: DataFrame, n: int, weights: Mapping[str, str]) -> DataFrame:
    """(part, one array for each weight): entry S is the sum of n x weight over the documents that fail none of the filters in S. Weights are SQL."""
    sums = [F.expr(f"cast(sum(if(mask = {m}, n * {w}, 0)) as bigint) as {name}_{m}") for name, w in weights.items() for m in range(1 << n)]
    arrays = {name: F.expr(f"array({', '.join(f'{name}_{m}' for m in range(1 << n))})") for name in weights}
    return counts.groupBy("part").agg(*sums).select("part", *(F.reverse(zeta(a, n)).alias(name) for name, a in arrays.items()))  # reversed, entry S counts the masks inside S's complement


def audit(counts: DataFrame, letters: Sequence[str] = "ABCDE") -> DataFrame:
    """For each part, order of all filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, all long.

    Everything is a difference between survivors of neighbouring subsets, which the subset-zeta transform of the mask counts gives for all
    subsets at once; the documents aren't gone through again for any order. shapley: what the filter removes, summed over all orders: a subset before it
    weighs as many orders as have it there. No rows: no rows.
    """
    n = len(letters)
    full = (1 << n) - 1
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, x in enumerate(order):
            steps.append(("".join(letters[i] for i in order), k + 1, before, before | 1 << x, 1 << x))
            before |= 1 << x
    # long lists are given as SQL text, as a column made in Python costs a call for each literal
    table = F.expr("inline(array(" + ", ".join(f"struct('{o}' as filter_order, {s} as step, {b} as b, {a} as a, {x} as x)" for o, s, b, a, x in steps) + "))")
    by = survivors(counts, n, {"all": "1", "good": "good", "toxic": "toxic"})
    at = lambda name, s: F.get(F.col(name), s)
    orders = [factorial(s) * factorial(n - 1 - s) for s in range(n)]
    worth = [" + ".join(f"{orders[s.bit_count()]} * (get(`all`, {s}) - get(`all`, {s | 1 << x}))" for s in range(full + 1) if not s >> x & 1) for x in range(n)]
    by = by.withColumn("worth", F.expr(f"map({', '.join(f'{1 << x}, {w}' for x, w in enumerate(worth))})"))
    rows = by.select("part", "all", "good", "toxic", "worth", table)
    b, a, x = F.col("b"), F.col("a"), F.col("x")
    removed = at("all", b) - at("all", a)
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        at("all", a).alias("kept"),
        removed.alias("removed"),
        (at("all", F.lit(0)) - at("all", x) - removed).alias("redundant"),
        (at("all", F.lit(full).bitwiseXOR(x)) - at("all", F.lit(full))).alias("unique_fails"),
        (at("good", b) - at("good", a)).alias("good_lost"),
        (at("toxic", b) - at("toxic", a)).alias("toxic_lost"),
        F.element_at("worth", x).alias("shapley"),
    )


def label_marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) of each labelled id: whether any row of it says quality 1, and toxic 1. Null ids and labels say nothing."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_counts(docs.select("doc_id", "text", "lang"), label_marks(labels)))


SQL = r"""
WITH RECURSIVE letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o, used) AS (
  SELECT l, bit FROM letters
  UNION ALL
  SELECT o || l, used + bit FROM orders, letters WHERE used & bit = 0
), steps AS (
  SELECT o AS filter_order, i AS step, l.bit AS x,
         (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE contains(left(o, i - 1), p.l)) AS before
  FROM orders, range(1, 6) t(i), letters l
  WHERE used = 31 AND l.l = substr(o, i, 1)
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masked AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * len(t.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN t.doc_id > f.least THEN 16 ELSE 0 END AS mask
  FROM texts t JOIN firsts f ON t.text = f.text LEFT JOIN marks m ON t.doc_id = m.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
), told AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (WHERE mask & (before | x) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & x <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & x <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = x), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & x <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & x <> 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, x, before
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM told
"""

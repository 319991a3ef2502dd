"""Line-level deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cytofold.llm.common import SPACE, ascii_lower, free


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(ascii_lower(key)))


def _among(digest: Column, sorted_digests: Column, steps: Column) -> Column:
    """Whether an ordered array holds a digest, by halving: `steps` are the powers of 2 up to its size, the largest first."""
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(sorted_digests, at + s - 1) < digest, at + s).otherwise(at))
    return F.coalesce(F.get(sorted_digests, below) == digest, F.lit(False))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, into: str = "_lines") -> DataFrame:
    """docs with a column `into`: struct(n_lines, n_dropped, text), text being what is left.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least min_chars
    code points that occurs in at least min_docs documents (distinct ids) loses its lines everywhere but in the
    document of the largest id that holds it; all lines there stay.

    Whether a line goes depends on its key and its document's id alone, so (digest, id) pairs are what is
    shuffled: pairs are made distinct before the exchange, counts are combined per task, and the join back is an ordinary equi-join,
    whose hot digests AQE splits. Documents then meet the digests that they lose, in order, so that each line is looked up by halving and a page of very many lines that all
    go costs no more than n log n; lines stay in their places, and those that go are left out when they are joined again. The text itself is shuffled once.

    A very long text is one row, whose lines and lost digests are arrays of that row. No rows: no rows. Null or empty text: one empty line, which stays. Null id: such rows count as no document and stay whole.
    Repeated rows of an id are one document to the count, and each is cleaned. Other columns pass through, whatever their names; one that is called as `into` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    pairs = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.explode(F.filter(lines, lambda x: F.octet_length(x) >= min_chars)).alias("_line"))
        .select("_id", _key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", _digest(F.col("_key")).alias("_h"))
        .distinct()
    )
    common = pairs.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).where(F.col("_n") >= min_docs).select("_h", "_keep")
    key, lost = free(docs.columns, "_id"), free(docs.columns, "_lost")
    losers = pairs.join(common, "_h").where("_id < _keep").groupBy(F.col("_id").alias(key)).agg(F.sort_array(F.collect_list("_h")).alias(lost))
    name, steps, digests = (free([*docs.columns, key, lost], c) for c in ("_left", "_steps", "_digests"))
    out = docs.join(losers, F.col(id_col) == F.col(key), "left")
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    out = out.withColumn(steps, F.filter(powers, lambda s: s <= F.size(lost))).withColumn(digests, F.when(F.col(lost).isNotNull(), F.transform(lines, lambda x: F.when(F.char_length(_key(x)) >= min_chars, _digest(_key(x))))))
    stays = lambda x, d: F.when(d.isNull() | ~_among(d, F.col(lost), F.col(steps)), x)
    out = out.withColumn(name, F.when(F.col(lost).isNull(), lines).otherwise(F.zip_with(lines, digests, stays)))
    cleaned = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(lost).isNull(), 0).otherwise(F.size(F.filter(name, lambda x: x.isNull()))).cast("long").alias("n_dropped"),
        F.when(F.col(lost).isNull(), text).otherwise(F.array_join(name, "\n")).alias("text"),
    )
    return out.withColumn(into, cleaned).drop(key, lost, name, steps, digests)


def digest(spark, docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.text"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT y.doc_id, y.pos, y.line, c.k IS NOT NULL AND y.doc_id < c.keep AS lost FROM keyed y LEFT JOIN common c ON y.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

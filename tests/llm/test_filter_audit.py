"""The audit against a plain simulation of every order, on odd rows: nulls, empty tables, repeated rows, ties, long texts and clashing names."""

import itertools
import re

from pyspark.sql import functions as F

from cytofold.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, labels):
    """Each order applied document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)

    def fails(i, t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }

    docs = [(part or "", fails(i, t), i in good, i in toxic) for i, t, part in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(d[1][x] for d in own) - len(gone),
                    sum(d[1][x] and sum(d[1].values()) == 1 for d in own),
                    sum(d[2] for d in gone),
                    sum(d[3] for d in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_odd_rows(spark):
    many = " ".join(f"w{k}" for k in range(300))
    rows = [(k, many if k % 3 else f"Some TEXT {k} #", ["en", "de", None, ""][k % 4]) for k in range(24)]
    rows += [(30, None, "en"), (31, "", "en"), (None, many, "en"), (None, None, None), (5, many, "de"), (5, many, "de"), (0, many, "fr"), (0, "other", "fr"), (40, "a\x0bb c " * 40_000, "en"), (41, "X" * 200, "fr"), (42, "  \t\n ", "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, 1), (40, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "part", "mask", "digest", "n", "good", "toxic", "words", "first", "min")})
    marks = filter_audit.label_marks(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = told(filter_audit.audit(filter_audit.mask_counts(docs, marks)))
    assert got == plain(rows, labels)
    assert len(got) == 600 * 4


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.digest(spark, none, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], SCHEMA)
    assert told(filter_audit.digest(spark, one, labels)) == plain([(1, "a", "en")], [])

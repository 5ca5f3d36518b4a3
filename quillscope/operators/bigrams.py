"""The most frequent adjacent token pairs of a corpus, exactly, without counting every pair.

A pair occurs no more often than either of its tokens. Tokens are counted first; pairs of the most
frequent tokens are counted by number, and the count of the k-th of them is a bound: a pair with a token
below it can't be among the first k. If tokens that were left out reach the bound, the pairs of all tokens
that reach it are counted. Every text takes part in both counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscope.operators.textmodel import written

FIRST = 1000  # tokens whose pairs give the bound
MOST = 500_000  # tokens that are broadcast


def top_pairs(tokens: DataFrame, k: int, sep: str) -> DataFrame:
    """``(bg, n)``: the ``k`` most frequent pairs (equal counts by ``bg``) of ``tokens``, arrays in written data.

    ``bg`` is both tokens with ``sep`` between; pairs do not cross rows.
    """
    counts = written(tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")), "token-counts")
    order = [F.col("c").desc(), F.col("token")]
    head = [(i, r["token"], r["c"]) for i, r in enumerate(counts.orderBy(*order).limit(FIRST + 1).collect())]
    least = head[FIRST][2] if len(head) > FIRST else 0  # of the tokens left out
    spark = tokens.sparkSession
    known = spark.createDataFrame([x[:2] for x in head[:FIRST]], "id long, token string")
    found = written(pair_counts(tokens, known, k, sep), "bigrams")
    bound = found.agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    bound = bound["n"] if bound["rows"] == k else 0
    if least and least >= bound:
        known = counts.where(F.col("c") >= bound)
        if known.count() <= MOST:
            known = written(known.select(F.monotonically_increasing_id().alias("id"), "token"), "bigram-known")
            found = pair_counts(tokens, known, k, sep)
        else:
            found = first(pairs(tokens).groupBy("a", "b").agg(F.count("*").alias("n")).select(F.concat("a", F.lit(sep), "b").alias("bg"), "n"), k)
    return first(found, k)


def first(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.col("n").desc(), "bg").limit(k)


def pairs(tokens: DataFrame) -> DataFrame:
    n: Column = F.greatest(F.size("tokens") - 1, F.lit(0))
    both = F.arrays_zip(F.slice("tokens", F.lit(1), n).alias("a"), F.slice("tokens", F.lit(2), n).alias("b"))
    return tokens.select(F.inline(both)).toDF("a", "b")


def pair_counts(tokens: DataFrame, known: DataFrame, k: int, sep: str) -> DataFrame:
    """The first ``k`` pairs of two of the tokens ``(id, token)``, counted by their ids."""
    x = F.broadcast(known.toDF("ia", "a"))
    y = F.broadcast(known.toDF("ib", "b"))
    n = pairs(tokens).join(x, "a").join(y, "b").groupBy("ia", "ib").agg(F.count("*").alias("n"))
    named = n.join(F.broadcast(known.toDF("ia", "a")), "ia").join(F.broadcast(known.toDF("ib", "b")), "ib")
    return first(named.select(F.concat("a", F.lit(sep), "b").alias("bg"), "n"), k)

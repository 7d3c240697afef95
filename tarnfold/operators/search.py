"""Token indexes and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import non_word_tokens

#: Words that full-text search passes over.
STOP_WORDS = ("a", "about", "an", "are", "as", "at", "be", "by", "com", "de", "en", "for", "from", "how", "i", "in", "is", "it", "la", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "who", "will", "with", "und", "www")


def token_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token, id``: distinct pairs."""
    return df.select(F.explode(F.array_distinct(non_word_tokens(F.col(text_col)))).alias("token"), F.col(id_col).alias("id"))


def search_any(index: DataFrame, words: list[str]) -> DataFrame:
    """Ids that hold any of the words."""
    return index.where(F.col("token").isin([w.lower() for w in words])).select("id").distinct()


def ranked_search(df: DataFrame, id_col: str, text_col: str, words: list[str], min_length: int = 3) -> DataFrame:
    """Ids with any of the words and ``score``, the sum of ln(rows / rows with the word)."""
    kept = [w.lower() for w in words if len(w) >= min_length and w.lower() not in STOP_WORDS]
    hits = token_index(df, id_col, text_col).where(F.col("token").isin(kept))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    weight = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(rows)).select("token", F.log(F.col("rows") / F.col("df")).alias("idf"))
    # At most one row for each word that was asked for.
    return hits.join(F.broadcast(weight), "token").groupBy("id").agg(F.sum("idf").alias("score"))


def vocabulary(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """``token, rank``: the most frequent tokens from 1 (ties by token); only ``size`` rows are ranked."""
    from pyspark.sql import Window

    counts = df.select(F.explode(non_word_tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token"))).select("token", "rank")


def sequences(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, length: int) -> DataFrame:
    """``id, sequence``: ranks of known tokens in order, the last ``length`` of them, padded with 0 on the left."""
    each = df.select(F.col(id_col).alias("id"), F.posexplode(non_word_tokens(F.col(text_col))).alias("at", "token"))
    ranked = each.join(F.broadcast(vocab), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("s"))
    ranks = F.transform("s", lambda x: x["rank"])
    last = F.slice(ranks, F.greatest(F.size(ranks) - length + 1, F.lit(1)), F.lit(length))
    padded = F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(last), F.lit(0))), last)
    empty = F.array_repeat(F.lit(0), length)
    return df.select(F.col(id_col).alias("id")).join(ranked.select("id", padded.alias("p")), "id", "left").select("id", F.coalesce("p", empty).alias("sequence"))

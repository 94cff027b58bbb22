"""Search over an inverted index, spelling, ranking, entities (§2.10, M62, M63, M68-M71)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .records import index_search


def total(index: DataFrame, words: list[str], prefix_last: bool) -> DataFrame:
    """Ids and their exact number; without a prefix the postings are whole, so the total is exact (Q2)."""
    ids = index_search(index, words, prefix_last).distinct()
    return ids.groupBy().agg(F.count("*").alias("total"))


def spelled(words: DataFrame, vocabulary: DataFrame, times: float) -> DataFrame:
    """(word, replacement, n): for words that are rare, the known word within the typo budget that is at
    least ``times`` as frequent: least distance, then most frequent, then smallest (Q3).

    Candidates share a deletion variant with the word, so no word meets the whole vocabulary: a word
    within two edits shares one after at most two deletions a side."""
    budget = 2

    def variants(c: Column) -> Column:
        out = F.array(c)
        for _ in range(budget):
            out = F.array_distinct(F.flatten(F.transform(out, lambda w: F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))), w))))
        return out

    distance = S.osa_distance(budget)
    asked = words.select("word").distinct().join(vocabulary.select(F.col("token").alias("word"), F.col("n").alias("_own")), "word", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    a = asked.withColumn("_v", F.explode(variants(F.col("word"))))
    b = vocabulary.withColumn("_v", F.explode(variants(F.col("token"))))
    pairs = a.join(b, "_v").where("token <> word").select("word", "_own", "token", "n").distinct()
    near = pairs.withColumn("_d", distance(F.col("word"), F.col("token"))).where((F.col("_d") <= S.typo_budget(F.col("word"))) & (F.col("n") >= times * F.greatest("_own", F.lit(1))))
    best = F.min(F.struct(F.col("_d"), (-F.col("n")).alias("_n"), F.col("token")))
    return near.groupBy("word").agg(best.alias("_b")).select("word", F.col("_b.token").alias("replacement"), (-F.col("_b._n")).alias("n"))


def ranked_references(df: DataFrame, reference: str, name: str, n: str, asked: str) -> DataFrame:
    """Rows that match a reference: exactly, by prefix, or by name, in this order, then the most sold (Q4)."""
    key = asked.lower()
    rank = F.when(F.lower(reference) == key, 0).when(F.lower(reference).startswith(key), 1).when(F.lower(name).contains(key), 2)
    return df.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc(n), reference)


def sections(parts: dict[str, DataFrame], order: list[str], most: int) -> DataFrame:
    """Union of ranked sections, ``most`` rows of each, in the order given (Q5). Parts have label, score and id."""
    out = None
    for i, s in enumerate(order):
        top = parts[s].orderBy(F.desc("score"), "id").limit(most).select(F.lit(i).alias("section_rank"), F.lit(s).alias("section"), "label", "score", "id")
        out = top if out is None else out.union(top)
    return out


def text_matches(df: DataFrame, id_col: str, text: Column, words: list[str]) -> DataFrame:
    """Ids whose words each begin one of the text's words (Q6)."""
    tokens = F.split(F.lower(text), "[^a-z0-9]+")

    def begun(w: str):
        return F.exists("_t", lambda t: t.startswith(w))

    held = F.lit(True)
    for w in words:
        held = held & begun(w)
    return df.withColumn("_t", tokens).where(held).select(id_col)


def top_names(df: DataFrame, name: str, least: int, most: int) -> DataFrame:
    """Most frequent names (M63), ties by name."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), name).limit(most)


def buckets(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """kind, label, n and newest of live rows by several keys in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("label")) for k, c in keys.items()])
    return df.select(F.explode(cells).alias("f"), "day").select("f.*", "day").where("label is not null").groupBy("kind", "label").agg(F.count("*").alias("n"), F.min("day").alias("next"))


def tiers(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """``df`` with tier main for the first rows of each key, tail for the others."""
    return df.withColumn("tier", F.when(F.row_number().over(W.partitionBy(*keys).orderBy(*order)) <= most, "main").otherwise("tail"))


def slugs(df: DataFrame, name: str, qualifier: str, id_col: str) -> DataFrame:
    """id and slug: the name's own where it is alone, with its qualifier where names collide, with a
    number from the second row of equal name and qualifier on (M71)."""
    rows = df.withColumn("_s", S.slug(F.col(name))).withColumn("_q", S.slug(F.col(qualifier).cast("string")))
    many = F.count("*").over(W.partitionBy("_s")) > 1
    again = F.row_number().over(W.partitionBy("_s", "_q").orderBy(id_col))
    qualified = F.concat_ws("-", "_s", "_q", F.when(again > 1, again.cast("string")))
    return rows.select(id_col, F.when(many, qualified).otherwise(F.col("_s")).alias("slug"))


def about_not_by(title: Column, maker: Column, marks: list[str]) -> Column:
    """Whether a title names the maker only after a mark such as "after" or "portrait of" (M62)."""
    out = F.lit(False)
    for m in marks:
        out = out | F.lower(title).contains(F.concat(F.lit(f"{m} "), F.lower(maker)))
    return out

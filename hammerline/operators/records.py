"""Set operations, dedupe, merges and gates on lots (§2.2, §2.7)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def status_rank(status: str, ranks: list[str]) -> Column:
    out = F.lit(len(ranks))
    for i, s in reversed(list(enumerate(ranks))):
        out = F.when(F.col(status) == s, i).otherwise(out)
    return out


def relist(df: DataFrame, key: str, day: str, tie: str, days: int) -> DataFrame:
    """Sold rows that another sale of the item follows within so many days, with its id."""
    order = W.partitionBy(key).orderBy(day, tie)
    rows = df.withColumn("_next", F.lead(day).over(order)).withColumn("relisted_as", F.lead(tie).over(order))
    return rows.where((F.col("status") == "sold") & (F.datediff("_next", day) <= days)).drop("_next")


def upsert(old: DataFrame, new: DataFrame, key: str, carry: list[str], first: list[str]) -> DataFrame:
    """Fresh rows win; ``carry`` columns keep an old value where the new is null, ``first`` the old one."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    out = []
    for c in new.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key or c in carry:
            out.append(F.coalesce(b, a).alias(c))
        elif c in first:
            out.append(F.coalesce(a, b).alias(c))
        else:
            out.append(F.when(F.col(f"n.{key}").isNotNull(), b).otherwise(a).alias(c))
    return joined.select(*out)


def collapse_aliases(df: DataFrame, key: str, canonical: Column) -> DataFrame:
    """Canonical id, its rows' ids as a sorted set (U4)."""
    return df.groupBy(canonical.alias("canonical")).agg(F.array_sort(F.collect_set(key)).alias("aliases"))


def replace_owners(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Old rows of owners that the new slice lacks, and the slice."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def components(edges: DataFrame, checkpoint_every: int = 3) -> DataFrame:
    """(id, component): smallest reachable id, by propagating minima and jumping (U8)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    step, before = 0, None
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("_m"))
        nearer = labels.join(near, labels.id == near.a).select("id", F.least("component", "_m").alias("c"), F.col("component").alias("was"))
        jump = nearer.alias("x").join(nearer.alias("y"), F.col("x.c") == F.col("y.id"), "left").select(F.col("x.id").alias("id"), F.least(F.col("x.c"), F.coalesce(F.col("y.c"), F.col("x.c"))).alias("component"), F.col("x.was").alias("was"))
        step += 1
        held = jump
        jump = jump.checkpoint() if edges.sparkSession.sparkContext.getCheckpointDir() else jump.persist()
        if before is not None:
            before.unpersist()
        before = jump if jump is held else None
        if jump.where("component <> was").isEmpty():
            return jump.select("id", "component")
        labels = jump.select("id", "component")


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The first reason that holds."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows against each rule, one pass (P10)."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("v")).select("v.*")


def facets_pass(row: str, groups: list[list[str]]) -> Column:
    """All groups, any value within a group."""
    return F.forall(F.array(*[F.array(*[F.lit(v) for v in g]) for g in groups]), lambda g: F.arrays_overlap(F.col(row), g))


def relaxations(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Rows gained if only that filter is lifted."""
    every = F.lit(True)
    for c in filters.values():
        every = every & c
    counts = []
    for name in filters:
        rest = F.lit(True)
        for other, c in filters.items():
            if other != name:
                rest = rest & c
        counts.append(F.struct(F.lit(name).alias("filter"), F.count_if(rest & ~every).alias("n")).alias(name))
    return df.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("r")).select("r.*").where("n > 0")


def signature_scan(df: DataFrame, house: str, price: str, day: str, least: int) -> DataFrame:
    """Prices that a house repeats: count, top date and the share of that date."""
    by_day = df.groupBy(house, price, day).agg(F.count("*").alias("c"))
    return by_day.groupBy(house, price).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by(day, F.struct(-F.col("c"), F.col(day))).alias("top_day")).where(F.col("n") >= least)


def shrink_gate(before: DataFrame, now: DataFrame, key: str, least: float) -> DataFrame:
    """Counts side by side and the verdict by key."""
    joined = before.groupBy(key).agg(F.count("*").alias("n_before")).join(now.groupBy(key).agg(F.count("*").alias("n_now")), key, "full_outer").na.fill(0, ["n_before", "n_now"])
    return joined.withColumn("verdict", F.when(F.col("n_now") >= least * F.col("n_before"), "pass").otherwise("refuse"))


def posting_chunks(df: DataFrame, id_col: str, token_array: Column, width: int = 65_536) -> DataFrame:
    """token, chunk, n of the chunk and its ascending postings; no token is dropped, and a common one is
    dealt over chunks of ``width`` neighbouring ids, which bounds a row (Q1)."""
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(token_array)).alias("token"))
    salted = rows.withColumn("chunk", F.floor(F.col("id") / width))
    return salted.groupBy("token", "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("postings"))


def index_search(index: DataFrame, words: list[str], prefix_last: bool) -> DataFrame:
    """Ids that the postings of ``posting_chunks`` give for all words, the last as a prefix while typing (Q2).

    An id has the same chunk under every token, so chunks are intersected one by one, rarest word first."""
    def of(w: str, begun: bool) -> DataFrame:
        return index.where(F.col("token").startswith(w) if begun else F.col("token") == w)

    parts = [of(w, prefix_last and i == len(words) - 1) for i, w in enumerate(words)]
    # one row a word
    counts = [p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("i", F.lit(i)) for i, p in enumerate(parts)]
    order = [r["i"] for r in functools.reduce(DataFrame.unionAll, counts).orderBy("n", "i").collect()]
    held = [parts[i].groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("postings"))).alias(f"p{i}")) for i in order]
    joined = functools.reduce(lambda a, b: a.join(b, "chunk"), held)
    return joined.select(F.explode(functools.reduce(F.array_intersect, [F.col(f"p{i}") for i in order])).alias("id"))

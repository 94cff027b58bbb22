"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source shares of the tokens are raised to an exponent and normalised; the exponent is bisected to
meet a target entropy or a limit on how often a source is repeated. Without a budget, the smallest
one is taken at which no source is cut, so every document appears. Documents fall by hash into blocks,
of which a source has a number in proportion to its tokens (``blocks`` in all) and LEAST_BLOCKS at
least; each epoch of a source runs through its blocks in an order of its own. The last, partial epoch
takes, in its order, each block that the quota still has room for, in FILLS rounds: a source never
passes its quota and misses it by less than its smallest block left out. ``mix_key`` (0 to 1)
interleaves the sources: sorting by it gives a stream that holds the target weights throughout.

All steps are DataFrame expressions. The driver holds one row a source (at most MAX_SOURCES, more
raise). The plan has at most 2 * blocks + sources rows an epoch; it is broadcast up to MAX_BROADCAST
rows and joined by (source, block) beyond, where a hot source is split by its blocks.
Edge cases: a null source is a source of its own; null or empty text has 0 tokens; a source without
tokens passes through once; an empty table gives an empty result; repeated rows of an id share its
block; rows with a null id are dealt by their text; other columns pass through ``mix``, but for
columns named as those it adds, which give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

MAX_SOURCES, BLOCKS, LEAST_BLOCKS, MAX_BROADCAST, FILLS = 20_000, 20_000, 256, 400_000, 4
ADDED = ["_block", "_copy", "_mix_key"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights_at(shares: dict, exponent: float) -> dict:
    powered = {s: math.exp(exponent * math.log(x)) for s, x in shares.items()}
    total = math.fsum(powered.values())
    return {s: x / total for s, x in powered.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def epochs_at(shares: dict, exponent: float, budget_share: float | None) -> dict:
    """Times each source is read; ``budget_share``: budget by tokens at hand, None: no source is cut."""
    w = weights_at(shares, exponent)
    budget = budget_share if budget_share is not None else max(shares[s] / w[s] for s in shares)
    return {s: w[s] * budget / shares[s] for s in shares}


def exponent_for(shares: dict, target_entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = None) -> float:
    """Smallest exponent in [0, 1] (the flattest mixture) within the limits: an entropy of at most
    ``target_entropy`` nats, and no source read more than ``max_repeats`` times. Both relax as the
    exponent grows to 1, the natural mixture, which is the answer if the limits can't be met."""

    def within(t: float) -> bool:
        if target_entropy is not None and entropy(weights_at(shares, t)) > target_entropy + 1e-12:
            return False
        return max_repeats is None or max(epochs_at(shares, t, budget_share).values()) <= max_repeats + 1e-12

    low, high = 0.0, 1.0
    if not shares or within(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if within(middle) else (middle, high)
    return high


def plan(totals: list[tuple], target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None) -> list[tuple[str | None, int, float]]:
    """(source, tokens, epochs) from (source, tokens)."""
    tokens = {s: n for s, n in totals if n}
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}
    part = None if budget_tokens is None else budget_tokens / max(total, 1)
    t = exponent_for(shares, target_entropy, max_repeats, part)
    epochs = epochs_at(shares, t, part) if shares else {}
    return [(s, n, round(epochs.get(s, 1.0), 12)) for s, n in totals]


def blocks_of(tokens: int, total: int, sources: int, blocks: int = BLOCKS) -> int:
    """Blocks of a source: its part of ``blocks``, and LEAST_BLOCKS if that many sources leave room for them."""
    least = max(1, min(LEAST_BLOCKS, blocks // max(1, sources)))
    return max(least, -(-blocks * tokens // max(1, total)))


def permuted(*parts: str, seed: int) -> Column:
    """Key of a block permutation."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts], F.lit(seed)).cast("binary"))


def block_of(key: str, seed: int) -> Column:
    """Block of a row, from 60 bits of a hash of its key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key), F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(bits, F.col("blocks"))


def row_key(id_col: str, text: Column) -> Column:
    """What deals a row: its id, or its text if it has none."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def block_plan(counted: DataFrame, blocks: int, seed: int, **limits) -> tuple[DataFrame, DataFrame, bool]:
    """From rows (key, source, n_tokens): (source, blocks), the places (source, block, copy, mix_key) and
    whether these are few enough to broadcast."""
    spark = counted.sparkSession
    totals = [(r["source"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()]  # bounded: more raise
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    planned = plan(totals, **limits)
    total = sum(n for _, n, _ in planned)
    rows = [(s, blocks_of(n, total, len(planned), blocks), n, e, round(e * n, 6)) for s, n, e in planned]
    few = sum(b * max(1, math.ceil(e)) for _, b, _, e, _ in rows) <= MAX_BROADCAST
    sources = spark.createDataFrame(rows, "source string, blocks long, tokens long, epochs double, quota double")
    sized = counted.join(F.broadcast(sources), counted.source.eqNullSafe(sources.source)).select(sources.source, block_of("key", seed).alias("block"), "n_tokens", "epochs", "tokens", "quota")
    held = written(sized.groupBy("source", "block", "epochs", "tokens", "quota").agg(F.sum("n_tokens").alias("n")), "blocks")
    whole = F.floor("epochs").cast("int")
    copies = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int") - 1, F.lit(0)))))
    # a block is taken in round 0 if its epoch is a whole one, else in the round in which it still fits
    at = copies.withColumn("order", permuted("source", "block", "copy", seed=seed)).withColumn("taken", F.when((F.col("copy") < whole) | (F.col("tokens") == 0), 0)).withColumn("left", F.col("quota") - F.col("copy") * F.col("tokens"))
    epoch = W.partitionBy("source", "copy")
    for i in range(1, FILLS + 1):
        fits = F.when(F.col("taken").isNull() & (F.col("n") <= F.col("left")), F.col("n"))
        at = at.withColumn("_sum", F.sum(fits).over(epoch.orderBy("order", "block").rowsBetween(W.unboundedPreceding, 0)))
        at = at.withColumn("taken", F.when(F.col("taken").isNotNull(), F.col("taken")).when((F.col("n") <= F.col("left")) & (F.col("_sum") <= F.col("left")), i))
        at = at.withColumn("left", F.col("left") - F.coalesce(F.sum(F.when(F.col("taken") == i, F.col("n"))).over(epoch), F.lit(0)))
    chosen = at.where("taken is not null")
    before = F.coalesce(F.sum("n").over(epoch.orderBy("taken", "order", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("copy") * F.col("tokens")
    key = F.when(F.col("quota") > 0, F.least(F.lit(1.0), before / F.col("quota"))).otherwise(0.0)
    return sources.select("source", "blocks"), chosen.select("source", "block", "copy", F.round(key, 9).alias("mix_key")), few


def place(rows: DataFrame, sources: DataFrame, places: DataFrame, few: bool, key: str, source_col: str, seed: int) -> DataFrame:
    """``rows`` once for each place of their block, with _block, _copy and _mix_key."""
    # one row a source, at most MAX_SOURCES
    own = rows.join(F.broadcast(sources.select(F.col("source").alias("_s"), "blocks")), F.col(source_col).cast("string").eqNullSafe(F.col("_s")))
    own = own.withColumn("_block", block_of(key, seed)).drop("blocks")
    many = places.select(F.col("source").alias("_p"), F.col("block").alias("_b"), F.col("copy").alias("_copy"), F.col("mix_key").alias("_mix_key"))
    return own.join(F.broadcast(many) if few else many, F.col("_s").eqNullSafe(F.col("_p")) & (F.col("_block") == F.col("_b"))).drop("_s", "_p", "_b")


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    return written(docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("key"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("n_tokens")), "token-counts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, seed: int = 11, max_repeats: float | None = 1.5, target_entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """``docs``, each row once a realised copy, with _block, _copy and _mix_key."""
    sources, places, few = block_plan(_counted(docs, id_col, text_col, source_col), blocks, seed, max_repeats=max_repeats, target_entropy=target_entropy, budget_tokens=budget_tokens)
    fields = [f for f in docs.schema.names if f not in ADDED]
    # names of other columns can't meet those used here
    plain = docs.select(*[F.col(f"`{f}`").alias(f"c{i}") for i, f in enumerate(fields)], row_key(id_col, F.col(text_col)).alias("key"))
    return place(plain, sources, places, few, "key", f"c{fields.index(source_col)}", seed).drop("key").toDF(*fields, *ADDED)


def mix_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, seed: int = 11, max_repeats: float | None = 1.5, target_entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """The same mixture without texts: id, source, n_tokens, block, copy, mix_key."""
    counted = _counted(docs, id_col, text_col, source_col)
    sources, places, few = block_plan(counted, blocks, seed, max_repeats=max_repeats, target_entropy=target_entropy, budget_tokens=budget_tokens)
    placed = place(counted, sources, places, few, "key", "source", seed)
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", F.col("_block").alias("block"), F.col("_copy").alias("copy"), F.col("_mix_key").alias("mix_key"))

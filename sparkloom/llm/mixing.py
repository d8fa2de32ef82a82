"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power `a`, normalised: a = 1 keeps
the corpus's own mix, a = 0 gives every source the same. The exponent is the
greatest one whose weights have at least `entropy` times the greatest entropy, or the least one
under which no source is repeated more than `repeats` times while none is cut; both are found by bisection, many
exponents a pass over the totals of sources.

The weights are then realised under a token budget: a source takes its quota as whole epochs and
one partial epoch. For that, documents are permuted in blocks: a hash of the id deals them to blocks, blocks are taken in order of their number
until one would pass the quota, that block is dealt into smaller blocks, and so on; only the
last, smallest block is taken document by document. No task sees more than the totals of one source's blocks.

Null sources are a source of their own. Null and empty texts have no tokens: they are kept
once in each whole epoch and in a partial one if their turn comes. A repeated row is taken or left like its twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import cut_rows, word_spans
from .store import free_name, settle

FANOUT, LEVELS = 256, 3
GRID = 32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in cut_rows(batch, "text"):
            n = np.diff(word_spans(data, offsets)[2])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])


def token_counts(documents: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens (words `[^\\x20\\x09-\\x0D]+`)."""
    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    return documents.select("doc_id", "source", "text").mapInArrow(_count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens long")


def _entropies(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: entropy of the weights, log of the sum of powers, sources with tokens."""
    rows = totals.where("tokens > 0")
    most = rows.agg(F.max("tokens").alias("m")).first()["m"]
    if most is None:
        return [(0.0, 0.0, 0)] * len(exponents)
    log = F.log(F.col("tokens") / float(most))
    sums: list[Column] = [F.count("*").alias("n")]
    for k, a in enumerate(exponents):
        sums += [F.sum(F.exp(log * a)).alias(f"z{k}"), F.sum(F.exp(log * a) * log * a).alias(f"y{k}")]
    r = rows.agg(*sums).first()
    return [(float(np.log(r[f"z{k}"]) - r[f"y{k}"] / r[f"z{k}"]), float(np.log(r[f"z{k}"])), r["n"]) for k in range(len(exponents))]


def exponent_for_entropy(totals: DataFrame, entropy: float) -> float:
    """The greatest exponent in [0, 1] whose weights have at least `entropy` times the greatest entropy (log of the sources)."""
    low, high = 0.0, 1.0
    for _ in range(4):
        grid = np.linspace(low, high, GRID + 1)
        told = _entropies(totals, grid.tolist())
        good = [k for k, (h, _, n) in enumerate(told) if h >= entropy * np.log(max(n, 1)) - 1e-12]
        k = max(good, default=0)
        if k == GRID:
            return float(high)
        low, high = float(grid[k]), float(grid[k + 1])
    return low


def exponent_for_repeats(totals: DataFrame, repeats: float) -> float:
    """The least exponent under which the smallest source is shown at most `repeats` times as often as the largest one."""
    r = totals.where("tokens > 0").agg(F.min("tokens").alias("a"), F.max("tokens").alias("b")).first()
    if r["a"] is None or r["a"] == r["b"]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(40):
        a = (low + high) / 2
        low, high = (low, a) if (r["b"] / r["a"]) ** (1 - a) <= repeats else (a, high)
    return high


def plan(totals: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """totals: source, tokens. Returns source, tokens, weight, quota, epochs (whole ones), rest (tokens of the partial one).

    Without a budget it is the least one under which every source is shown whole at least once.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a limit of repeats")
    if repeats is not None and budget is not None:
        raise ValueError("a limit of repeats sets the budget itself")
    a = exponent_for_entropy(totals, entropy) if repeats is None else exponent_for_repeats(totals, repeats)
    r = totals.where("tokens > 0").agg(F.max("tokens").alias("m"), F.min("tokens").alias("l")).first()
    most, least = float(r["m"] or 1), float(r["l"] or 1)
    power = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / most) * a)).otherwise(0.0)
    sum_ = totals.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    # The source whose share of the budget, against its own tokens, is least: the largest one, as the exponent is at most 1.
    budget = most * sum_ if budget is None else float(budget)
    weight = power / sum_
    rows = totals.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * budget).cast("long"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1 if budget >= least else 0)).cast("long")
    return rows.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("tokens") * F.col("epochs")).otherwise(0))


def realise(counts: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """counts: doc_id, source, n_tokens. Returns them with copies: how often the document is shown."""
    turn = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    rows = counts.withColumn("turn", turn)
    for k in range(LEVELS):
        rows = rows.withColumn(f"b{k}", F.pmod(F.shiftright("turn", 8 * k), F.lit(FANOUT)).cast("int"))
    rows = rows.join(planned.select(F.col("source").alias("p_source"), "epochs", "rest"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    rows = settle(rows, "mix-rows")
    # (source, rest): what is left for the block that the levels so far have run into. One row a source.
    open_ = planned.where("rest > 0").select(F.col("source").alias("s"), F.col("rest").alias("left"))
    taken = None
    inside = rows
    for k in range(LEVELS):
        names = [f"b{i}" for i in range(k)]
        inside = inside.select(*rows.columns).join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.lit(True) if not names else F.expr(" AND ".join(f"{n} = o_{n}" for n in names))))
        blocks = inside.groupBy("source", *names, f"b{k}", "left").agg(F.sum("n_tokens").alias("block_tokens"))
        upto = Window.partitionBy("source").orderBy(f"b{k}").rowsBetween(Window.unboundedPreceding, 0)  # FANOUT rows at most
        blocks = blocks.withColumn("upto", F.sum("block_tokens").over(upto))
        blocks = settle(blocks, f"mix-blocks-{k}")
        whole = blocks.where("upto <= left").select(F.col("source").alias("t"), *[F.col(n).alias(f"t_{n}") for n in names], F.col(f"b{k}").alias(f"t_b{k}"))
        got = inside.join(whole, F.col("source").eqNullSafe(F.col("t")) & F.expr(" AND ".join(f"{n} = t_{n}" for n in [*names, f"b{k}"])), "left_semi").select("turn", "doc_id", "source")
        taken = got if taken is None else taken.unionByName(got)
        cut = Window.partitionBy("source").orderBy(f"b{k}")
        open_ = blocks.where("upto > left").withColumn("r", F.row_number().over(cut)).where("r = 1").select(
            F.col("source").alias("s"), *[F.col(n).alias(f"o_{n}") for n in [*names, f"b{k}"]], (F.col("left") - F.col("upto") + F.col("block_tokens")).alias("left"))
    names = [f"b{i}" for i in range(LEVELS)]
    last = inside.select(*rows.columns).join(open_, F.col("source").eqNullSafe(F.col("s")) & F.expr(" AND ".join(f"{n} = o_{n}" for n in names)))
    # Rows with one turn count together, so twins share their fate.
    by_turn = last.groupBy("source", "turn", "left").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_turn.withColumn("upto", F.sum("n").over(upto)).where("upto <= left").select(F.col("source").alias("t"), F.col("turn").alias("t_turn"))
    got = last.join(ends, F.col("source").eqNullSafe(F.col("t")) & (F.col("turn") == F.col("t_turn")), "left_semi").select("turn", "doc_id", "source")
    extra = taken.unionByName(got).select(F.col("turn").alias("x_turn"), F.col("source").alias("x_source")).distinct().withColumn("extra", F.lit(1))
    out = rows.join(extra, (F.col("turn") == F.col("x_turn")) & F.col("source").eqNullSafe(F.col("x_source")), "left")
    return out.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix(documents: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document."""
    counts = settle(token_counts(documents), "mix-counts")
    totals = settle(counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-totals")
    return realise(counts, settle(plan(totals, entropy, repeats, budget), "mix-plan"), seed)


def repeat(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents, all columns, each row as often as its copies say.

    How often is decided by id and source, so rows that repeat both share it; rows of no copies are left out.
    """
    d, s, n, k = (free_name(documents, c) for c in ("mix_id", "mix_source", "mix_copies", "mix_turn"))
    key = mixed.groupBy(F.col("doc_id").alias(d), F.col("source").alias(s)).agg(F.max("copies").alias(n))
    rows = documents.join(key, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)))
    return rows.where(F.col(n) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*documents.columns)

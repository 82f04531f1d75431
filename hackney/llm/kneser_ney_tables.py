"""The model of `kneser_ney` as Spark tables, for corpora with more runs than one machine should hold.

The formulas are those of `kneser_ney.build`. Runs of a context lie in one group,
and a context has at most 65,536 of them. The frequent runs are broadcast; texts
join the others with the table, and runs that the model has not seen go on to the
tables of shorter runs, so that every run of every text counts with its own
probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hackney.llm.common import checkpointed
from hackney.llm.kneser_ney import BITS, ORDER, SYMBOLS, discounts_of, find, mask


@dataclass(frozen=True)
class Frequent:
    """Log probabilities of the frequent runs, sorted by run."""

    runs: np.ndarray
    log_probability: np.ndarray

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, 0 where the run is not among these, and whether it is."""
        if not len(self.runs):
            return np.zeros(len(codes)), np.zeros(len(codes), bool)
        place, known = find(self.runs, codes)
        return np.where(known, self.log_probability[place], 0.0), known


@dataclass(frozen=True)
class Tables:
    """For each length from one symbol on: run, seen, context, left (the share for others in that context) and p."""

    levels: list[DataFrame]
    frequent: Frequent


def _last(run: Column, length: int) -> Column:
    return run if length == ORDER else run.bitwiseAND(F.lit(mask(length)))


def build(counted: DataFrame, most: int) -> Tables:
    """Of the rows code and n, one for each run and read again and again; the most frequent runs, at most `most`, are broadcast."""
    counts = [counted.select(F.col("code").alias("run"), F.col("n").alias("seen"))]
    for length in range(ORDER - 1, 0, -1):
        shorter = counts[0].groupBy(_last(F.col("run"), length).alias("run")).agg(F.count(F.lit(1)).alias("seen"))
        counts.insert(0, checkpointed(shorter))
    levels: list[DataFrame] = []
    same = Window.partitionBy("context")
    for length, runs in enumerate(counts, 1):
        seen = F.col("seen")
        off = [float(x) for x in discounts_of(*runs.agg(*(F.count_if(seen == times) for times in range(1, 5))).first())]
        kinds = [seen == 1, seen == 2, seen >= 3]
        whole = F.sum("seen").over(same)
        left = sum((F.lit(x) * F.count_if(kind).over(same) for x, kind in zip(off, kinds, strict=True)), F.lit(0.0)) / whole
        taken = F.when(kinds[0], off[0]).when(kinds[1], off[1]).otherwise(off[2])
        rows = runs.withColumn("context", F.shiftrightunsigned("run", BITS))
        rows = rows.withColumns({"left": left, "own": (seen - taken) / whole})
        if levels:
            below = levels[-1].select(F.col("run").alias("shorter"), F.col("p").alias("below"))
            rows = rows.join(below, _last(F.col("run"), length - 1) == F.col("shorter"))
        else:
            rows = rows.withColumn("below", F.lit(1 / SYMBOLS))
        p = F.col("own") + F.col("left") * F.col("below")
        levels.append(checkpointed(rows.select("run", "seen", "context", "left", p.alias("p"))))
    return Tables(levels, _frequent(levels[-1], most))


def _frequent(runs: DataFrame, most: int) -> Frequent:
    size = F.floor(F.log2("seen"))
    held, least = 0, None
    for row in runs.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():
        held += row.n
        if held > most:
            break
        least = row.size
    if least is None:
        return Frequent(np.zeros(0, np.uint64), np.zeros(0))
    found = runs.filter(size >= least).select("run", "p").toArrow()
    codes = found.column("run").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return Frequent(codes[order], np.log(found.column("p").to_numpy()[order]))


def sums(rest: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """row and log_sum, of the rows row, code and times: the log probabilities of the codes, so many times each.

    They are added up as decimals, so that the order of tasks cannot change a sum.
    """

    def added(rows: DataFrame, found: Column) -> DataFrame:
        exact = (F.col("times") * found).cast("decimal(30,15)")
        return rows.groupBy("row").agg(F.sum(exact).alias("log_sum"), F.count_if(found.isNull()).alias("unseen"))

    done: list[DataFrame] = []
    rest = rest.withColumn("so_far", F.lit(0.0))
    for length in range(ORDER, 0, -1):
        level = levels[length - 1]
        wanted = _last(F.col("code"), length)
        joined = rest.join(level.select("run", "p"), wanted == F.col("run"), "left")
        done.append(checkpointed(added(joined, F.col("so_far") + F.log("p"))))
        if done[-1].filter(F.col("unseen") > 0).isEmpty():
            break
        contexts = level.groupBy("context").agg(F.max("left").alias("left"))
        unseen = joined.filter(F.col("p").isNull()).drop("run", "p")
        others = unseen.join(contexts, F.shiftrightunsigned(wanted, BITS) == F.col("context"), "left")
        so_far = F.col("so_far") + F.coalesce(F.log("left"), F.lit(0.0))
        rest = checkpointed(others.select("row", "code", "times", so_far.alias("so_far")))
    else:
        done.append(added(rest, F.col("so_far") - F.lit(math.log(SYMBOLS))))
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    return total.groupBy("row").agg(F.sum("log_sum").cast("double").alias("log_sum"))

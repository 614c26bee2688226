"""Mixing sources to target weights by balanced (cube) sampling.

A source is to give ``target`` words, a share of all words by its weight but three
times its own words at most.  Each of its documents is taken
``floor(target / size of source)`` times, and once more with probability equal to the
rest.  Drawing these independently would miss the target by chance; the cube method
keeps it: while three undecided documents are left, their probabilities are moved
along a line on which both the expected words and the expected number of documents
stay as they are, until one of them is 0 or 1.

Documents are worked on in blocks of bounded size within a source.  Each block ends
with at most two undecided documents, which meet in blocks of the next turn, until
one block holds those of a source.  The largest documents of a source wait until then:
with a few others and what the flight leaves, all their outcomes are tried, and the nearest to the
expected words is taken (the landing).
All draws are hashes of ids, so reruns agree.

Defined results: a null text has no words; a null source is a source of its own, the
last one; documents without words, or of a source without words, are taken with their
source's rate and add nothing; rows with the same id (or none) are separate rows; an
empty table gives an empty table; other columns are not looked at.  A source misses its target by half of
its largest document at most; with a few dozen documents of different sizes, by some ten words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.llm.work import small, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that are balanced in one go.
BLOCK = 1024
#: Documents of a source that are left to the landing, its largest and any others, besides two that a flight leaves undecided.
LANDING, OTHERS = 9, 5
#: Parts of a group whose largest documents are found apart.
SALTS = 64


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """With ``place``: the number of a source in code point order, null last.

    Ranges are sorted in their own tasks; only the counts of ranges are collected.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    rows = stored(rows, "sources")
    counts = {r["range"]: r["count"] for r in rows.groupBy("range").count().collect()}
    before = {k: sum(n for j, n in counts.items() if j < k) for k in counts}
    spark = sources.sparkSession
    starts = small(spark, range=pa.array(before.keys(), pa.int32()), before=pa.array(before.values(), pa.int64()))
    number = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return rows.withColumn("number", number).join(F.broadcast(starts), "range").withColumn("place", F.col("before") + F.col("number") - 1).drop("range", "before", "number")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    The level at which ``min(level * weight, most * size)`` adds up to all words is
    raised until no source is newly above its bound; the driver sees three sums a turn.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(_numbered(sources).withColumn("weight", weight), "weights")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    bound = most * F.col("source_size")
    level, before = None, -1
    full = F.lit(False)
    while True:
        at = rows.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0)).alias("bounded"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if at.n == before or not at.open:
            break
        before, level = at.n, (total - at.bounded) / at.open
        full = full | (F.col("weight") * F.lit(level) > bound)
    target = F.when(full, bound.cast("double")).otherwise(F.col("weight") * F.lit(float(level or 0)))
    return rows.select("source", "source_size", target.alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move the chances to 0 or 1, all but two at most, keeping their sum and the expected words.

    Three undecided documents span a line on which both totals stand still: the
    differences of their sizes, in turn.  ``draws`` says which way to go.
    """
    chance = chance.copy()
    open_: list[int] = []
    for i in range(len(chance)):
        if not 0 < chance[i] < 1:
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        move = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not move.any():
            # Equal sizes: only the number of documents is left to keep.
            move = np.array([1.0, -1.0, 0.0])
        p = chance[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(move > 0, (1 - p) / move, np.where(move < 0, -p / move, np.inf)).min()
            down = np.where(move > 0, p / move, np.where(move < 0, (p - 1) / move, np.inf)).min()
        # The mean of the two ends, weighted so, is where the chances are now.
        p = p + up * move if draws[i] * (up + down) < down else p - down * move
        p = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
        chance[open_] = p
        open_ = [k for k in open_ if 0 < chance[k] < 1]
    return chance


def landing(size: np.ndarray, chance: np.ndarray, draw: float) -> np.ndarray:
    """Decide the last documents: of all outcomes the one nearest to the expected words, then to the expected number.

    ``draw`` decides between outcomes that are equally near.
    """
    chance = chance.copy()
    left = np.flatnonzero((chance > 0) & (chance < 1))
    if not len(left):
        return chance
    outcomes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words = np.abs(outcomes @ size[left] - (size[left] * chance[left]).sum())
    number = np.abs(outcomes.sum(axis=1) - chance[left].sum())
    best = np.flatnonzero(words <= words.min() + 1e-6)
    best = best[number[best] <= number[best].min() + 1e-6]
    chance[left] = outcomes[best[min(len(best) - 1, int(draw * len(best)))]]
    return chance


def _flights(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", "row"])
    rows["chance"] = flight(rows["size"].to_numpy(), rows["chance"].to_numpy(), rows["draw"].to_numpy())
    return rows


def _landings(rows: pd.DataFrame) -> pd.DataFrame:
    """The last turn of a group: all but the held documents by the flight, then these and what it left over."""
    rows = rows.sort_values(["held", "draw", "row"])
    size, chance, draws = (rows[c].to_numpy().copy() for c in ("size", "chance", "draw"))
    early = max(0, int((~rows["held"]).sum()) - OTHERS)
    chance[:early] = flight(size[:early], chance[:early], draws[:early])
    rows["chance"] = landing(size, chance, float(draws[0]))
    return rows


def _with_held(rows: DataFrame) -> DataFrame:
    """``held`` marks the ``LANDING`` largest undecided documents of each group, ties by draw.

    The largest of each of ``SALTS`` parts come first, so that no task sorts a whole group.
    """
    largest = [F.desc("size"), F.asc("draw"), F.asc("row")]
    some = rows.filter("chance > 0 AND chance < 1").select("group", "row", "size", "draw").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    for part in (["group", "salt"], ["group"]):
        some = some.withColumn("at", F.row_number().over(Window.partitionBy(*part).orderBy(*largest))).filter(F.col("at") <= LANDING)
    held = stored(some.select("group", F.col("row").alias("held_row")), "held").groupBy("group").agg(F.collect_list("held_row").alias("held_rows"))
    held = rows.join(held, "group", "left").withColumn("held", F.coalesce(F.array_contains("held_rows", F.col("row")), F.lit(False)))
    return held.select(*rows.columns, "held")


def balanced(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with every ``chance`` decided; they need ``row, group, size, chance, draw``.

    Blocks hold ``block`` rows on average, whatever the size of a group.  The largest documents of a group wait
    until the others are decided or fit into one block, as only they can outweigh what these leave over.
    """
    names, block, decided, turn = rows.columns, max(block, 4 * (LANDING + OTHERS)), [], 0
    rows = stored(_with_held(rows), "mix-held")
    schema, columns = rows.schema, rows.columns

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        return (_landings if part["part"].iloc[0] < 0 else _flights)(part)[columns]

    while True:
        undecided = rows.filter("chance > 0 AND chance < 1")
        decided.append(rows.filter("chance <= 0 OR chance >= 1"))
        groups = stored(undecided.groupBy("group").agg(F.count("*").alias("n"), F.count_if("held").alias("h")), "groups")
        if groups.isEmpty():
            return reduce(DataFrame.unionByName, decided).select(names)
        fits = F.col("n") <= block
        dealt = F.pmod(F.xxhash64("row", F.lit(turn)), F.ceil((F.col("n") - F.col("h")) / block))
        cut = undecided.join(groups, "group").withColumn("part", F.when(fits, F.lit(-1).cast("bigint")).when(~F.col("held"), dealt))
        moved = cut.filter("part IS NOT NULL").select(*columns, "part").groupBy("group", "part").applyInPandas(decide, schema)
        rows = stored(moved.unionByName(cut.filter("part IS NULL").select(columns)), "flight")
        turn += 1


def _mix_rows(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """``doc_id, print, number, size, source_size, target, copies``: ``number`` tells rows of one id and text apart."""
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            word_count(F.col(text)).alias("size"),
            F.col(source).cast("string").alias("source"),
            F.xxhash64(text).alias("print"),
        ),
        "sizes",
    )
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    targets = targets.withColumnRenamed("source", "name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        rows.withColumn("number", _number("doc_id", "print", "source"))
        .withColumn("row", F.xxhash64("doc_id", "print", "number"))
        .join(targets, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("whole", F.floor(rate))
        .withColumn("chance", rate - F.col("whole"))
        .withColumn("draw", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) / float(1 << 30))
        .withColumn("group", F.xxhash64("source"))
        .drop("source", "name")
    )
    copies = F.col("whole") + (F.col("chance") >= 1).cast("bigint")
    return balanced(stored(rows, "mix-rows"), block).withColumn("copies", copies)


def _number(doc_id: str, print_: str, source: str) -> Column:
    return F.row_number().over(Window.partitionBy(doc_id, print_).orderBy(source))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row of ``docs``; ``copies`` is how often it is taken."""
    rows = _mix_rows(docs, doc_id, text, source, weights, most, block)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are found again by their id; only ids with several rows need the text as well.
    """
    found = stored(_mix_rows(docs, "doc_id", "text", "source", weights, MOST, block).select("doc_id", "print", "number", "copies"), "mixed")
    several = stored(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "several")
    same = lambda id_: F.col("doc_id").eqNullSafe(F.col(id_))
    copies = found.select(F.col("doc_id").alias("__of"), F.col("print").alias("__print"), F.col("number").alias("__number"), F.col("copies").alias("__copies"))
    if several.isEmpty():
        rows = docs.join(copies.filter("__copies > 0"), same("__of"))
    else:
        one = docs.join(several, same("__id"), "left_anti").join(copies, same("__of"))
        more = docs.join(several, same("__id"), "left_semi").withColumn("__own", F.xxhash64("text"))
        more = more.withColumn("__at", _number("doc_id", "__own", "source"))
        more = more.join(copies, same("__of") & (F.col("__own") == F.col("__print")) & (F.col("__at") == F.col("__number")))
        rows = one.select(*docs.columns, "__copies").unionByName(more.select(*docs.columns, "__copies"))
    rows = rows.filter("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return rows.select(*docs.columns)

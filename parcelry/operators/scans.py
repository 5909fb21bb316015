"""Scans over ordered rows of a group that may be longer than a task can take: two levels.

Rows are cut into blocks by an expression that grows with the order (line_no / 100,000, say). A block is scanned in one
task, a summary of each block is scanned over its group, and what the blocks before hand on is added. Summaries are
partial before their shuffle, and meet the rows where the rows are: one shuffle of the rows for a chain of scans.
Without a block a group is one block. Null keys are a group of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, BLOCK = "__key", "__block"


class Scan:
    """A chain of scans of df in the order of (block, order), which should be total within `by`."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column | None = None):
        self.order = [F.col(c) for c in order]
        # a struct, so that two null keys are equal in the join, and the join finds the rows dealt as the window left them
        self.df = df.withColumns({KEY: F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]), BLOCK: F.lit(0) if block is None else block})
        self.plain = block is None
        self.here = Window.partitionBy(KEY, BLOCK).orderBy(*self.order)
        # over the summaries of a group's blocks: those before a block, and all
        self.before, self.whole = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(KEY)
        self.place = F.struct(*self.order)

    def _with_carry(self, inner: Mapping[str, Column], summary: Mapping[str, Column], carry: Mapping[str, Column]) -> DataFrame:
        """The rows with the inner columns, and with what the summaries of the blocks before them give."""
        within = self.df.withColumns(dict(inner))
        if self.plain:
            return within.withColumns({c: F.lit(None) for c in carry})
        blocks = self.df.groupBy(KEY, BLOCK).agg(*[c.alias(n) for n, c in summary.items()])
        before = blocks.select(F.col(KEY).alias("__k"), F.col(BLOCK).alias("__b"), *[c.alias(n) for n, c in carry.items()])
        return within.join(before, (F.col(KEY) == F.col("__k")) & (F.col(BLOCK) == F.col("__b")), "left").drop("__k", "__b")

    def carried(self, values: Mapping[str, Column]) -> Scan:
        """Adds columns: the last value that isn't null, at or before each row."""
        names = {out: f"__{i}" for i, out in enumerate(values)}
        self.df = self.df.withColumns({f"{n}v": values[out] for out, n in names.items()})
        w = self.here.rowsBetween(Window.unboundedPreceding, 0)
        joined = self._with_carry(
            {f"{n}i": F.last(f"{n}v", ignorenulls=True).over(w) for n in names.values()},
            {f"{n}s": F.max_by(f"{n}v", F.when(F.col(f"{n}v").isNotNull(), self.place)) for n in names.values()},
            {f"{n}c": F.last(f"{n}s", ignorenulls=True).over(self.before) for n in names.values()},
        )
        self.df = joined.withColumns({out: F.coalesce(f"{n}i", f"{n}c") for out, n in names.items()}).drop(*[f"{n}{x}" for n in names.values() for x in "visc"])
        return self

    def previous(self, out: str, value: str) -> Scan:
        """Adds the value of the row before each row, null at the first. Values aren't null."""
        joined = self._with_carry({"__i": F.lag(value).over(self.here)}, {"__s": F.max_by(value, self.place)}, {"__c": F.last("__s", ignorenulls=True).over(self.before)})
        self.df = joined.withColumn(out, F.coalesce("__i", "__c")).drop("__i", "__c")
        return self

    def counted(self, out: str, flag: Column, total: str | None = None) -> Scan:
        """Adds the number of rows that the flag holds for, at or before each row, and that of the whole group as total."""
        self.df = self.df.withColumn("__v", F.coalesce(flag.cast("long"), F.lit(0).cast("long")))
        inner = {"__i": F.sum("__v").over(self.here.rowsBetween(Window.unboundedPreceding, 0))}
        joined = self._with_carry(inner, {"__s": F.sum("__v")}, {"__c": F.sum("__s").over(self.before), "__t": F.sum("__s").over(self.whole)})
        joined = joined.withColumn(out, F.col("__i") + F.coalesce(F.col("__c").cast("long"), F.lit(0).cast("long")))
        if total is not None:
            joined = joined.withColumn(total, F.sum("__v").over(Window.partitionBy(KEY, BLOCK)) if self.plain else F.col("__t"))
        self.df = joined.drop("__v", "__i", "__c", "__t")
        return self

    def rows(self) -> DataFrame:
        return self.df.drop(KEY, BLOCK)


def chain_starts(links: DataFrame, starts: DataFrame, keep) -> DataFrame:
    """(node) of all nodes that chains reach: those of starts, and what links (node, next; one next a node) leads to from
    them. Each round doubles how far a link leads, so rounds are the logarithm of the longest chain; keep writes a table
    and reads it again."""
    found, links = starts.select("node"), keep(links.filter("next is not null"))
    while not links.isEmpty():
        reached = found.join(links, "node").select(F.col("next").alias("node"))
        found = keep(found.unionByName(reached))
        further = links.select(F.col("node").alias("next"), F.col("next").alias("after"))
        links = keep(links.join(further, "next").select("node", F.col("after").alias("next")))
    return found

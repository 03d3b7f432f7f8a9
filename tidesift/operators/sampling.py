"""Seeded exact-size samples by hash order.

A row's place is the md5 of its key (or its text and copy number) and the seed: any engine can recompute it and it does not
depend on partitions. A split's cut-off hash is found by counting (``ranked_values``), so no task sorts a class.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import ranked_values
from .staging import evaluated, stage

_DIGITS = 13  # 52 bits: exact in a double


def seeded_hash(text: Column, seed: int) -> Column:
    return F.md5(F.concat(text.cast("string"), F.lit(f"-{seed}")))


def number_text(c: Column) -> Column:
    """A double as two whole numbers, its multiple of 2^-20 and the rest in 2^-80: a text any engine can state."""
    fits = F.abs(c) < 1e25
    units = F.rint(c * 2.0**20)
    rest = F.rint((c - units / 2.0**20) * 2.0**80).cast("bigint")
    exact = F.concat(units.cast("decimal(38,0)").cast("string"), F.lit(":"), rest.cast("string"))
    return F.when(fits, exact).otherwise(c.cast("string"))


def row_text(df: DataFrame) -> Column:
    """All columns of a row as one text, NULL told apart from empty."""
    def text(f: T.StructField) -> Column:
        c = F.col(f.name)
        return number_text(c.cast("double")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")

    return F.concat_ws("|", *[F.coalesce(text(f), F.lit("\\N")) for f in df.schema.fields])


def _leading_bits(hash_text: Column) -> Column:
    return F.conv(F.substring(hash_text, 1, _DIGITS), 16, 10).cast("double")


@dataclass(frozen=True)
class Cut:
    """Where the taken rows of a group end.

    ``bits`` are the leading bits of the last hash. ``last`` is that hash in full if not all rows with these bits are
    taken; then ``shared`` rows have even the full hash in common and ``taken`` of them belong to the sample.
    """

    bits: float
    last: str | None = None
    taken: int = 0
    shared: int = 0

    def holds(self, hash_text: Column) -> Column:
        """Rows up to and including the last hash."""
        bits = _leading_bits(hash_text)
        if self.last is None:
            return bits <= self.bits
        return (bits < self.bits) | ((bits == self.bits) & (hash_text <= self.last))


def hash_cuts(df: DataFrame, hash_column: str, take: Mapping[str, int], group: Column | None = None) -> dict[str, Cut]:
    """For each group the end of its first ``take[group]`` rows in hash order."""
    grp = F.lit("all") if group is None else group
    bits = _leading_bits(F.col(hash_column)).alias("x")
    ranked = ranked_values(evaluated(df, grp.alias("grp"), bits), lambda g, n: [take.get(g, 0) - 1])
    cuts: dict[str, Cut] = {}
    for g, r in ranked.items():
        rank = take.get(g, 0) - 1
        if rank not in r.values:
            continue
        last, left = r.values[rank], take[g] - r.smaller[rank]
        if left == r.equal[rank]:
            cuts[g] = Cut(last)
            continue
        # Copies of a row, or hashes equal in their leading bits: few different ones, counted per full hash.
        keyed = evaluated(df, grp.alias("grp"), bits, F.col(hash_column).alias("hash"))
        tied = (keyed.where((F.col("grp") == g) & (F.col("x") == F.lit(last))).groupBy("hash")
                .agg(F.count(F.lit(1)).alias("n")).orderBy("hash").collect())
        for t in tied:
            if left > 0:
                cuts[g] = Cut(last, t["hash"], min(left, t["n"]), t["n"])
                left -= t["n"]
    return cuts


def sample_rows(df: DataFrame, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows without replacement, all rows if there are no more: a sample of rows, copies included.

    Copy 1, 2, ... of a row has the md5 of its text and that number as its place, so copies are taken or left independently of each
    other. The hashes are spread evenly, so nearly all first copies drop out in a scan of the rows. Which rows have more copies is found
    by counting 64-bit hashes of the rows, the only thing that all rows send (combined in the tasks first, so a hot row sends one).
    Rows that are near or have copies are counted exactly, and what is left is ordered. ``size`` is a documented limit
    of the report that asks for a sample.
    """
    names = df.columns
    total = df.count()
    if size >= total:
        return df
    # Out of a generator, a row's text is worked out once for both of its hashes.
    text = row_text(df)
    keyed = df.select(*names, F.explode(F.array(text)).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    repeated = stage(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_key"), "repeated-rows")
    share = (size + 8 * math.sqrt(size) + 64) / total
    while True:
        limit = min(1.0, share) * 16.0**_DIGITS
        first = seeded_hash(F.concat_ws("#", "_text", F.lit(1)), seed)
        near = keyed.withColumn("_near", _leading_bits(first) <= limit).join(
            repeated.withColumn("_again", F.lit(True)), "_key", "left").where(F.col("_near") | F.col("_again").isNotNull())
        counted = near.groupBy(*names, "_text").agg(F.count(F.lit(1)).alias("_n"))
        copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
        placed = copies.withColumn("_hash", seeded_hash(F.concat_ws("#", "_text", "_copy"), seed)).select(*names, "_hash")
        found = stage(placed.where(_leading_bits(F.col("_hash")) <= limit), "sample-candidates")
        if share >= 1 or found.count() >= size:
            return found.orderBy("_hash", *names).limit(size).drop("_hash")
        share *= 2


def share_by_class(counts: Mapping[str, int], share: float) -> dict[str, int]:
    """Test rows per class: ceil(share * n) in total, spread by largest remainder."""
    n = sum(counts.values())
    total = math.ceil(share * n)
    exact = {c: counts[c] * total / n for c in counts}
    taken = {c: math.floor(v) for c, v in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (-(exact[c] - taken[c]), c))
    for c in by_remainder[:total - sum(taken.values())]:
        taken[c] += 1
    return taken


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """``df`` with a boolean ``is_test``; the classes keep their proportions in both parts. ``key`` must be unique."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sorted(str(c) for c, n in counts.items() if n < 2)
    if small or not counts:
        raise ValueError(f"every class needs at least two rows to be split; too small: {small or 'all'}")
    hashed = df.withColumn("_hash", seeded_hash(F.col(key), seed))
    cuts = hash_cuts(hashed, "_hash", share_by_class(counts, share), F.col(label))
    is_test = F.lit(False)
    for c, cut in cuts.items():
        is_test = F.when(F.col(label) == c, cut.holds(F.col("_hash"))).otherwise(is_test)
    return hashed.withColumn("is_test", is_test).drop("_hash")

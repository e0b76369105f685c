"""Ranks within groups by multiplicity compression, for groups of any size and ties of any number.

Rows that are equal in the group's and all ordering columns are one tuple with a count: batches
are folded where they are read, so that a tuple which a third of all rows share travels as a few
rows. Tuples are range-partitioned by group and order; as they are distinct there, no group
and no tie decides how large a partition gets. Each partition, a bucket, merges equal tuples, sorts, and adds up
counts from the beginning of each group that it has. This table is written once. A group's
counts in its earlier buckets are summed over a tree of ``FAN`` buckets a node, so a window
sees at most that many rows, and a tuple's first place is the sum before its bucket plus the sum
within it. Its duplicates have the places that follow: a sequence that is exploded, beyond
``BLOCK`` of them in blocks that are dealt out first.

Nothing is collected but the number of buckets, and nothing is broadcast.

Defined cases: nulls of a group column make a group, and nulls of an ordering column are equal and
stand where the key says; equal rows have places of their own, one after the other, and are the
same in all columns of the result; numbers that aren't finite count as null in ``op13_ranking``;
an empty table gives an empty result; columns that aren't named are ignored, whatever their names
(the module's own begin with two underscores), and texts among the keys may be of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import materialize, table

#: Buckets under one node of the tree of sums.
FAN = 64
#: Duplicates that one row is exploded into, at most.
BLOCK = 1 << 16
#: Rows that are folded at once where they are read.
FOLDED = 1 << 16


@dataclass(frozen=True)
class Key:
    """A column to order by."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def _fold(batches):
    """Equal rows of some batches as one with their number."""

    def folded(held):
        rows = pa.Table.from_batches(held)
        names = rows.column_names
        counted = rows.group_by(names, use_threads=False).aggregate([([], "count_all")])
        return counted.select([*names, "count_all"]).rename_columns([*names, "__n"]).to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOLDED:
            yield from folded(held)
            held, rows = [], 0
    if rows:
        yield from folded(held)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it, from the second on; nulls are equal."""
    a, b = column[:-1], column[1:]
    unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return unlike.to_numpy(zero_copy_only=False)


def _adding(group: list[str]):
    """Adds the bucket's number and the count of the group's rows before a tuple in this bucket; tuples come sorted."""

    def run(batches):
        bucket, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("__n").to_numpy()
            starts = np.zeros(len(n), bool)
            for name in group:
                starts[1:] |= _differs(batch.column(name))
            first = [batch.column(name)[0].as_py() for name in group]
            starts[0] = first != last
            before = np.cumsum(n) - n
            if not starts[0]:
                before += carried
            at = np.flatnonzero(starts)
            own = before - np.concatenate([np.zeros(at[0] if len(at) else len(n), np.int64), np.repeat(before[at], np.diff(np.append(at, len(n))))])
            last, carried = [batch.column(name)[-1].as_py() for name in group], int(own[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(np.full(len(n), bucket, np.int64))], names=[*batch.schema.names, "__own", "__bucket"])

    return run


def compressed(rows: DataFrame, group: list[str], order: list[Key]) -> DataFrame:
    """The written table of distinct tuples: the named columns, __n (rows that have it), __bucket, __own (rows of its group before it in its bucket)."""
    names = [*group, *(k.name for k in order)]
    plain = rows.select(*names)
    counted = T.StructType([*plain.schema.fields, T.StructField("__n", T.LongType())])
    folded = plain.mapInArrow(_fold, counted)
    by = [*(F.col(g).asc_nulls_first() for g in group), *(k.order() for k in order)]
    # the range exchange has equal tuples together already, so that this aggregate moves nothing
    distinct = folded.repartitionByRange(*by).groupBy(*names).agg(F.sum("__n").alias("__n")).sortWithinPartitions(*by)
    placed = T.StructType([*counted.fields, T.StructField("__own", T.LongType()), T.StructField("__bucket", T.LongType())])
    return materialize(distinct.mapInArrow(_adding(group), placed), "ranking")


def _before(totals: DataFrame, nodes: int, fan: int) -> DataFrame:
    """(__group, __bucket, __before) of (__group, __bucket, __total): a group's sum over earlier buckets, by a tree."""
    earlier = lambda *by: F.coalesce(F.sum("__total").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if nodes <= fan:
        return totals.select("__group", "__bucket", earlier("__group").alias("__before"))
    below = totals.withColumn("__node", F.floor(F.col("__bucket") / fan))
    above = _before(below.groupBy("__group", F.col("__node").alias("__bucket")).agg(F.sum("__total").alias("__total")), -(-nodes // fan), fan)
    above = above.select(F.col("__group").alias("__g"), F.col("__bucket").alias("__b"), F.col("__before").alias("__over"))
    inside = below.withColumn("__inside", earlier("__group", "__node"))
    joined = inside.join(above.hint("merge"), (F.col("__group") == F.col("__g")) & (F.col("__node") == F.col("__b")))
    return joined.select("__group", "__bucket", (F.col("__inside") + F.col("__over")).alias("__before"))


def _restored(runs: DataFrame, block: int) -> DataFrame:
    """A row for each place from __first to __last."""
    small = runs.where(F.col("__last") - F.col("__first") < block).withColumn("pos", F.explode(F.sequence("__first", "__last")))
    blocks = runs.where(F.col("__last") - F.col("__first") >= block).withColumn("__at", F.explode(F.sequence("__first", "__last", F.lit(block).cast("long"))))
    dealt = blocks.repartition("__bucket", "__at").withColumn("pos", F.explode(F.sequence("__at", F.least(F.col("__last"), F.col("__at") + block - 1)))).drop("__at")
    return small.unionByName(dealt)


def ranked(rows: DataFrame, group: list[str], order: list[Key], tie: int, most: int | None = None, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """A row for each of ``rows`` with the group's and ordering columns, ``pos`` (its place in its group, from 1) and ``tied`` (rows of the group that equal it in the first ``tie`` keys).

    most: only places up to this one are returned; all rows are ranked and counted nevertheless.
    """
    names = [*group, *(k.name for k in order)]
    if len(set(names)) < len(names) or not group or not 0 < tie <= len(order):
        raise ValueError("group and order need names of their own, and ties are of the first keys")
    runs = compressed(rows, group, order)
    key = F.struct(*[F.col(g) for g in group])
    buckets = (runs.agg(F.max("__bucket")).first()[0] or 0) + 1
    totals = runs.groupBy(key.alias("__group"), "__bucket").agg(F.sum("__n").alias("__total"))
    before = _before(totals, buckets, fan).select(F.col("__group").alias("__g"), F.col("__bucket").alias("__b"), "__before")
    # no tuple's place is below the sum of its own bucket
    near = runs if most is None else runs.where(F.col("__own") < most)
    near = near.withColumn("__group", key)
    found = near.join(before.hint("merge"), (F.col("__group") == F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    first = F.col("__before") + F.col("__own") + 1
    last = first + F.col("__n") - 1
    found = found.withColumns({"__first": first, "__last": last if most is None else F.least(last, F.lit(most))}).where("__first <= __last")
    pair = F.struct(*[F.col(k.name) for k in order[:tie]])
    ties = runs.groupBy(key.alias("__tg"), pair.alias("__tp")).agg(F.sum("__n").alias("tied"))
    joined = found.withColumn("__pair", pair).join(ties.hint("merge"), (F.col("__group") == F.col("__tg")) & (F.col("__pair") == F.col("__tp")))
    return _restored(joined.select(*names, "tied", "__bucket", "__first", "__last"), block).select(*names, "pos", "tied")


# Fixed values of the query: lines whose sale number's checksum has no rest by HOT_SHARE are one group; places up to PLACES are returned.
HOT_SHARE, PLACES = 5, 2


def _rounded(value: Column) -> Column:
    """floor(value + 0.5) as a long; null where the value isn't finite."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.floor(finite + 0.5).cast("long")


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    hot = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % HOT_SHARE == 0, F.lit(False))
    own = lambda value: F.when(hot, F.lit(-1)).otherwise(value).cast("long")
    rows = lines.select(
        own(F.col("vendor_id")).alias("vendor_id"),
        own(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"),
        own(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
        _rounded(100 * F.col("discount")).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        _rounded(100 * F.col("amount")).alias("amount_cents"),
    )
    order = [Key("tens", descending=True, nulls_first=True), Key("percent", nulls_first=True), Key("sale_id"), Key("line_no"), Key("quantity"), Key("amount_cents")]
    out = ranked(rows, ["vendor_id", "part", "month"], order, tie=2, most=PLACES)
    return out.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


OP13_SQL = f"""WITH ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
crc AS (SELECT sale_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM ids),
l AS (SELECT s.*, coalesce(crc % {HOT_SHARE} = 0, false) AS hot FROM sale_lines s LEFT JOIN crc USING (sale_id)),
k AS (SELECT CAST(CASE WHEN hot THEN -1 ELSE vendor_id END AS BIGINT) AS vendor_id, CAST(CASE WHEN hot THEN -1 ELSE coalesce(item_id % 5, -1) END AS BIGINT) AS part,
  CAST(CASE WHEN hot THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS BIGINT) AS month,
  CAST(floor(quantity / 10) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST, sale_id ASC NULLS LAST, line_no ASC NULLS LAST, quantity ASC NULLS LAST, amount_cents ASC NULLS LAST) AS pos,
  count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM k)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= {PLACES}"""

"""Stored rows and questions that meet block by block.

Stored rows lie in cells, a cell in blocks of bounded size. A question goes to the blocks
that it asks for, and the stored rows of a block come before the questions of the block in
the same sorted partition. A task holds one block and lets the questions stream past it, so
its memory does not depend on how many there are. Very many questions of a block are cut into
slices that work side by side, each with its copy of the block. The only exchange is the one
that brings both sides together.
"""

import math

import numpy as np
from pyspark.sql import functions as F

PLACE = ["_cell", "_block", "_slice"]


def scan_blocks(stored, asked, score, schema, order=()):
    """``score(block)(questions)`` for every block and the questions that meet it.

    Both sides have the integer columns of PLACE. ``score`` gets the record batches of a
    block, once; what it returns is called with record batches of questions and gives a
    record batch, or None.
    """
    both = stored.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # the number is given so that small shuffles are not merged into few tasks of heavy work
    both = both.repartition(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE)
    both = both.sortWithinPartitions(*PLACE, "_side", *order)

    def scan(batches):
        place, held, ready = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in [*PLACE, "_side"]])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if b == a:
                    continue
                here, part = tuple(at[:3, a]), batch.slice(a, b - a)
                if here != place:
                    place, held, ready = here, [], None
                if at[3, a] == 0:
                    held.append(part)
                elif held or ready is not None:
                    if ready is None:
                        ready, held = score(held), []
                    out = ready(part)
                    if out is not None and out.num_rows:
                        yield out

    return both.mapInArrow(scan, schema)


def meet(stored, asked, keys, block_rows, slice_rows, score, schema, order=()):
    """``scan_blocks`` of sides with a column ``cell``: cells are cut into blocks and slices by their counts.

    A question goes to every block of its cells. ``keys`` tell questions apart.
    """
    spark = stored.sparkSession
    # one row per cell on the driver; the number of cells is a bounded parameter of the index
    size = dict(stored.groupBy("cell").count().collect())
    asks = dict(asked.groupBy("cell").count().collect())
    plan = [(c, math.ceil(size[c] / block_rows), math.ceil(asks[c] / slice_rows)) for c in size if c in asks]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, blocks int, slices int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda cols, n: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    s = stored.join(plan, "cell").withColumn("_block", part(order or ["id"], "blocks")).withColumn("_slice", upto("slices"))
    q = asked.join(plan, "cell").withColumn("_slice", part(keys, "slices")).withColumn("_block", upto("blocks"))
    placed = [df.drop("blocks", "slices").withColumnRenamed("cell", "_cell") for df in (s, q)]
    return scan_blocks(*placed, score, schema, order)

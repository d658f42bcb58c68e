"""Joins on two inequalities, such as ``a.x < b.x and a.y > b.y``, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.ordering import cell_join, numbered, shuffle_partitions

#: A block's pairs are found in Python, a million at once at most.
BLOCK, CELL = 1 << 11, 4096
#: Blocks and nodes of a task where there are more of them than tasks.
EDGES = 16
OPERATORS = ("<", "<=", ">", ">=")


def dominating_pairs(ax, ay, bx, by):
    """Index pairs (i, j) with ax[i] < bx[j] and ay[i] < by[j], by sorted runs and a bit set.

    The right rows are taken by ascending y; before each, the left rows below it are
    marked at their place by x, and those marked before its own place by x are its pairs.
    """
    import numpy as np

    left_x, left_y = np.argsort(ax, kind="stable"), np.argsort(ay, kind="stable")
    place = np.empty(len(ax), np.int64)
    place[left_x] = np.arange(len(ax))
    right = np.argsort(by, kind="stable")
    upto, below = np.searchsorted(ax[left_x], bx[right], "left"), np.searchsorted(ay[left_y], by[right], "left")
    marked, done, out_i, out_j = np.zeros(len(ax), bool), 0, [], []
    for j, n, m in zip(right.tolist(), upto.tolist(), below.tolist(), strict=True):
        if m > done:
            marked[place[left_y[done:m]]] = True
            done = m
        if n and m:
            found = np.flatnonzero(marked[:n])
            if len(found):
                out_i.append(left_x[found])
                out_j.append(np.full(len(found), j))
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def inequality_join(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Pairs that satisfy both conditions, each (left column, operator, right column); rows with a null in one match nothing.

    Both sides are sorted as one table by each attribute, downwards for > and >=, and
    equal values so that a left row comes before a right one if they match.  Then a
    condition says that the left row's number is the smaller one.  Numbers fall into
    blocks, and of two different blocks the smaller one has a 0 where the other one has a
    1 at the highest bit in which they differ; so each row goes to the nodes (bit, bits
    above) of its own zeros (left) or ones (right), log2(blocks) of them.

    * Pairs in different blocks by both attributes meet in exactly one pair of nodes, and
      all pairs that meet there match: an equi join, whose large nodes are cut into cells.
    * Pairs in one block by an attribute meet in that block, and by the other attribute in
      a node or block; a task sorts what meets there, at most ``block`` rows, and holds
      their pairs, block**2 / 4 at most.
    """
    if set(left.columns) & set(right.columns):
        raise ValueError("the sides' columns need different names")
    if first[1] not in OPERATORS or second[1] not in OPERATORS:
        raise ValueError(f"operators are {', '.join(OPERATORS)}")

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        x, y = (F.col(c[0 if is_left else 2]) for c in (first, second))
        own = F.struct(*df.columns)
        nothing = lambda other: F.lit(None).cast(other.schema.simpleString())
        l, r = (own, nothing(right)) if is_left else (nothing(left), own)
        return df.select(x.alias("__x"), y.alias("__y"), F.lit(is_left).alias("__left"), l.alias("__l"), r.alias("__r")).filter("__x is not null and __y is not null").withColumn("__tie", F.monotonically_increasing_id())

    def order(name: str, op: str) -> list[Column]:
        value = F.col(name).asc() if op[0] == "<" else F.col(name).desc()
        return [value, F.col("__left").desc() if op.endswith("=") else F.col("__left").asc(), F.col("__tie").asc()]

    both = side(left, True).unionByName(side(right, False))
    both = numbered(numbered(both, [], order("__x", first[1]), "__nx"), [], order("__y", second[1]), "__ny")
    rows = both.withColumns({"__bx": F.expr(f"__nx div {block}"), "__by": F.expr(f"__ny div {block}")}).drop("__x", "__y", "__tie")
    blocks = -(-both.count() // block)
    bits = F.array(*(F.lit(b) for b in range(max(1, blocks).bit_length())))
    shifted = lambda n, b: F.call_function("shiftright", n, b)

    def nodes(name: str, is_left: bool) -> Column:
        """(bit, bits above) where a left row has a 0, a right one a 1."""
        n = F.col(name)
        own = F.filter(bits, lambda b: shifted(n, b).bitwiseAND(F.lit(1)) == (0 if is_left else 1))
        return F.transform(own, lambda b: F.struct(b.alias("bit"), shifted(n, b + 1).alias("above")))

    def of(is_left: bool) -> DataFrame:
        return rows.filter(F.col("__left") == is_left).drop("__left", "__r" if is_left else "__l")

    def whole(is_left: bool) -> DataFrame:
        own = of(is_left).withColumn("__node", F.explode(nodes("__bx", is_left))).withColumn("__under", F.explode(nodes("__by", is_left)))
        return own.select(F.col("__nx").alias("__nl" if is_left else "__nr"), "__l" if is_left else "__r", F.col("__node.bit").alias("__b1"), F.col("__node.above").alias("__a1"), F.col("__under.bit").alias("__b2"), F.col("__under.above").alias("__a2"))

    pairs = cell_join(whole(True), whole(False), ["__b1", "__a1", "__b2", "__a2"], cell).select("__l.*", "__r.*")

    def edge(is_left: bool) -> DataFrame:
        """Rows by block of the first attribute (bit -1), and by node of the first and block of the second."""
        block_x = F.array(F.struct(F.lit(-1).alias("bit"), F.col("__bx").alias("above"), F.lit(-1).cast("bigint").alias("inner")))
        block_y = F.transform(nodes("__bx", is_left), lambda n: F.struct(n["bit"].alias("bit"), n["above"].alias("above"), F.col("__by").alias("inner")))
        own = of(is_left).withColumn("__at", F.explode(F.concat(block_x, block_y)))
        return own.select(F.col("__nx").alias("__x"), F.col("__ny").alias("__y"), F.col("__l" if is_left else "__r").alias("__row"), "__at")

    names = left.columns + right.columns

    def compared(a, b):
        import pyarrow as pa

        numbers = lambda t: (t.column("__x").to_numpy(), t.column("__y").to_numpy())
        i, j = dominating_pairs(*numbers(a), *numbers(b)) if len(a) and len(b) else ([], [])
        taken = [*a.column("__row").combine_chunks().take(pa.array(i, pa.int64())).flatten(), *b.column("__row").combine_chunks().take(pa.array(j, pa.int64())).flatten()] if len(i) else [pa.array([], f.type) for t in (a, b) for f in t.schema.field("__row").type]
        return pa.Table.from_arrays(taken, names)

    tasks = max(shuffle_partitions(left), blocks * (blocks.bit_length() + 1) // EDGES)
    near = edge(True).repartition(tasks, "__at").groupBy("__at").cogroup(edge(False).repartition(tasks, "__at").groupBy("__at")).applyInArrow(compared, StructType(left.schema.fields + right.schema.fields))
    return pairs.unionByName(near)

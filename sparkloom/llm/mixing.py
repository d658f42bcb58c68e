"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain > language > source.  A node's capacity is the tokens below
it times EPOCHS.  From the root down, a node's budget goes to its children in
proportion to their weights; what a child can't use goes to its siblings, and as
no node gets more than its capacity, only what all siblings together can't use
is left to the level above.  With children in order of capacity / weight, the
share per weight is the largest of (budget - capacity before) / (weight from
here on), so a level is one pass of window functions over the table of nodes.

A leaf's documents are put in a new order for every epoch, by md5 of seed, epoch
and id, and the leaf takes the longest prefix of epoch 0, 1, ... whose tokens
fit its budget.  Running sums are taken within bins of the order (BINS hex
digits) after the sums of the bins before, so no leaf, however large, is
gathered in one task.

Defined cases: null or empty text has no tokens, and is taken with the prefix it
stands in; rows that repeat an id count as one document, and so do rows without
an id that agree in text, language and source; null domain, language or source are the empty string; a leaf of weight 0 gets
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, sized

SEED, EPOCHS, SHARE, BINS = 11, 2, 0.8, 3
#: Integer weights by path in the tree; what isn't named has weight 1.
WEIGHTS: dict[tuple[str, ...], int] = {("web",): 3, ("reference",): 2, ("web", "en"): 4, ("web", "de"): 2, ("reference", "en"): 3}
DOMAIN = "CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'reference' END"
LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    """Words outside ASCII white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def unit_key(id_col: str, text_col: str) -> Column:
    """What tells documents apart: the id, or without one the row's own values."""
    own = F.md5(F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s"), F.col(text_col).cast("string").alias("t"))))
    return F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.concat(F.lit("null "), own))


def _weight(level: int, weights: dict[tuple[str, ...], int]) -> Column:
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == level + 1:
            same = F.lit(True)
            for name, part in zip(LEVELS, path, strict=False):
                same &= F.col(name) == part
            out = F.when(same, w).otherwise(out)
    return out.cast("double")


def budgets(leaves: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict[tuple[str, ...], int] | None = None) -> DataFrame:
    """leaves (domain, lang, source, tokens) with ``budget``, a whole number of tokens."""
    weights = WEIGHTS if weights is None else weights
    nodes = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    root = nodes.agg((F.sum("tokens") * share).alias("given"))
    for level in range(len(LEVELS)):
        above, own = list(LEVELS[:level]), list(LEVELS[: level + 1])
        children = nodes.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights)).filter("weight > 0")
        # the root is one row; below it, a parent's budget joins its children
        children = children.join(root, above) if above else children.crossJoin(F.broadcast(root))
        order = Window.partitionBy(*above).orderBy(F.col("capacity") / F.col("weight"), LEVELS[level])
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        children = children.withColumn("each", (F.col("given") - before) / rest)
        children = children.withColumn("each", F.max("each").over(Window.partitionBy(*above)))
        root = children.select(*own, F.least("capacity", F.col("weight") * F.col("each")).alias("given"))
    return leaves.join(root, list(LEVELS)).select(*leaves.columns, F.floor("given").alias("budget"))


def mix(docs: DataFrame, domain: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[tuple[str, ...], int] | None = None, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """The documents taken, one row for each epoch: id, epoch, domain, lang, source, tokens, budget (of the leaf)."""
    named = docs.select(
        unit_key(id_col, text_col).alias("key"),
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.expr(DOMAIN) if domain is None else domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        n_words(F.col(text_col)).alias("tokens"),
    )
    units = durable(named.groupBy("key", "id").agg(F.min(F.struct(*LEVELS)).alias("leaf"), F.sum("tokens").alias("tokens")).select("key", "id", "leaf.*", "tokens"), "units")
    leaves = durable(budgets(units.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), share, epochs, weights).withColumnRenamed("tokens", "all_tokens"), "budgets")
    turn = units.withColumn("epoch", F.explode(F.lit(list(range(epochs)))))
    turn = turn.withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "key")))
    turn = turn.withColumn("bin", F.substring("order", 1, BINS))
    leaf_bin = [*LEVELS, "epoch", "bin"]
    bins = turn.groupBy(*leaf_bin).agg(F.sum("tokens").alias("bin_tokens"))
    before = Window.partitionBy(*LEVELS, "epoch").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.join(leaves, list(LEVELS)).withColumn("before", F.col("epoch") * F.col("all_tokens") + F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))
    bins = bins.filter("before <= budget").select(*leaf_bin, "before", "budget")
    within = Window.partitionBy(*leaf_bin).orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)
    taken = turn.join(bins, leaf_bin).withColumn("upto", F.col("before") + F.sum("tokens").over(within)).filter("upto <= budget")
    return taken.select(*(["key"] if with_key else []), "id", "epoch", *LEVELS, "tokens", "budget")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mix() takes, once for each epoch; same columns."""
    taken = mix(docs, **options, with_key=True).groupBy(F.col("key").alias("__taken")).agg(F.count(F.lit(1)).cast("int").alias("__times"))
    own = unit_key(options.get("id_col", "doc_id"), options.get("text_col", "text"))
    # texts move only if there are too many keys to broadcast
    out = docs.withColumn("__own", own).join(sized(durable(taken, "taken")), F.col("__own") == F.col("__taken"))
    return out.select(*(out[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col("__times"))).alias("__epoch")).drop("__epoch")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _sql_weight(level: int) -> str:
    cases = " ".join("WHEN " + " AND ".join(f"{n} = '{p}'" for n, p in zip(LEVELS, path, strict=False)) + f" THEN {w}" for path, w in WEIGHTS.items() if len(path) == level + 1)
    return f"CAST(CASE {cases} ELSE 1 END AS DOUBLE)" if cases else "CAST(1 AS DOUBLE)"


def sql(table: str = "documents") -> str:
    """DuckDB SQL for mix() over a table or view."""
    steps, given = [], f"(SELECT sum(tokens) * CAST({SHARE} AS DOUBLE) AS given FROM leaves)"
    for level in range(len(LEVELS)):
        above, own = ", ".join(LEVELS[:level]), ", ".join(LEVELS[: level + 1])
        part = f"PARTITION BY {above} " if above else ""
        source = f"n{level} JOIN b{level - 1} USING ({above})" if above else f"n{level}, {given}"
        steps.append(f"""n{level} AS (SELECT {own}, sum(CAST(tokens * {EPOCHS} AS DOUBLE)) AS capacity, {_sql_weight(level)} AS weight FROM leaves GROUP BY {own}),
e{level} AS (SELECT {own}, capacity, weight, (given - coalesce(sum(capacity) OVER ({part}ORDER BY capacity / weight, {LEVELS[level]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({part}ORDER BY capacity / weight, {LEVELS[level]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each FROM {source}),
b{level} AS (SELECT {own}, least(capacity, weight * max(each) OVER ({part.strip()})) AS given FROM e{level})""")
    return f"""
WITH units AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM {table}),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM units GROUP BY ALL),
{", ".join(steps)},
turn AS (SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, u.domain, u.lang, u.source, u.tokens, CAST(floor(given) AS BIGINT) AS budget,
    epoch * l.tokens + sum(u.tokens) OVER (PARTITION BY epoch, u.domain, u.lang, u.source ORDER BY md5(concat_ws(':', {SEED}, epoch, doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM units u CROSS JOIN range({EPOCHS}) AS r(epoch) JOIN leaves l USING (domain, lang, source) JOIN b2 USING (domain, lang, source))
SELECT doc_id, epoch, domain, lang, source, tokens, budget FROM turn WHERE upto <= budget
"""


QUERIES = {"op5_source_mixing": op5_source_mixing}
ORACLES = {"op5_source_mixing": sql()}

"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The tree has one level per path column (domain, language, source). Capacities
go up: a leaf can give its tokens ``max_epochs`` times, a node what its
children can. Budgets go down: a node's budget is dealt among its children in
proportion to their weights, and what a child cannot give goes to its siblings
(water filling). A node never gets more than its children can give together,
so a shortage reaches an ancestor's siblings only after the node's own
children are exhausted. Budgets are whole tokens and add up exactly.

A leaf with a budget of more than its tokens is taken whole as many times as
fit; the rest is a prefix of one more epoch, whose order is a seeded hash of
(seed, epoch, id). The end of the prefix is found by narrowing: token sums by
the leading digits of the hash, then within the digits where the budget ends.
No task sorts a whole leaf.

Defined cases: null path values are nodes of their own; null and empty texts
have no tokens and are taken with the whole epochs, and in a prefix up to its
end; a node with weight 0 gets nothing; rows with a null id have the hash of
an empty id; rows of a leaf that share an id are taken together; a target
above the capacity takes everything ``max_epochs`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.llm.common import column, fresh
from seqrec.operators.skew import HOT_ROWS, spread_join
from seqrec.session import cut_lineage

SEED = 29
#: Leading hex digits of the hash by which each step narrows the end of a prefix.
DIGITS, STEPS = 3, 2
_WIDE, _WEIGHT = "decimal(19,0)", "decimal(18,0)"


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _node(value: Column) -> Column:
    """A text that tells null from every value, so that plain equality joins nodes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def epoch_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"),
                          F.coalesce(doc_id.cast("string"), F.lit(""))))


def _filled(nodes: DataFrame, parents: list[str], own: str) -> DataFrame:
    """Deal ``given`` (per parent) among its children with ``weight`` and ``cap``: the ``budget`` of each."""
    family = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    ordered = family.orderBy(F.try_divide("cap", "weight").asc_nulls_last(), own)
    before, upto = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(W.unboundedPreceding, 0)
    live = nodes.withColumn("weight", F.when(F.col("cap") > 0, F.col("weight")).otherwise(F.lit(0)))

    def wide(c: Column, kind: str = _WIDE) -> Column:
        return F.coalesce(c, F.lit(0)).cast(kind)

    live = live.withColumns({
        "cap_before": wide(F.sum("cap").over(before)), "weight_before": wide(F.sum("weight").over(before), _WEIGHT),
        "weights": wide(F.sum("weight").over(family), _WEIGHT)})
    # full: its part of what is left when all before it are full reaches its capacity
    left = F.col("given").cast(_WIDE) - F.col("cap_before")
    left_weight = (F.col("weights") - F.col("weight_before")).cast(_WEIGHT)
    live = live.withColumn("full", F.col("cap").cast(_WIDE) * left_weight
                           <= F.col("weight").cast(_WEIGHT) * F.greatest(left, F.lit(0)).cast(_WIDE))
    live = live.withColumns({
        "open_weight": F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight")),
        "rest": wide(F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(family))})
    live = live.withColumns({"open_upto": wide(F.sum("open_weight").over(upto), _WEIGHT),
                             "open_all": wide(F.sum("open_weight").over(family), _WEIGHT)})
    part = "CAST({} * rest AS DECIMAL(38,0)) div nullif(open_all, 0)"
    share = F.expr(part.format("open_upto")) - F.expr(
        part.format("CAST(open_upto - CAST(open_weight AS DECIMAL(18,0)) AS DECIMAL(18,0))"))
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.coalesce(share, F.lit(0)), F.col("cap")))
    return live.select(*nodes.columns, budget.cast("long").alias("budget"))


def leaf_plan(sizes: DataFrame, levels: Sequence[str], weights: Sequence[Column], *,
              fraction: tuple[int, int], max_epochs: int) -> DataFrame:
    """Per leaf: rows, tokens, ``budget``, ``epochs`` taken whole and ``rest`` tokens of one more.

    ``sizes`` has the node columns ``levels`` and ``tokens``; ``weights`` gives,
    for each level, the whole-number weight of a node among its siblings as a
    column over the levels down to it. The target is ``fraction`` of all tokens.
    """
    levels = list(levels)
    leaves = cut_lineage(sizes.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")))
    weighed, usable = leaves, F.lit(True)
    for at, weight in enumerate(weights):
        weighed = weighed.withColumn(f"weight_{at}", weight.cast("long"))
        usable = usable & (F.col(f"weight_{at}") > 0)
    weighed = weighed.withColumn("cap", F.when(usable, F.col("tokens") * max_epochs).otherwise(F.lit(0)))
    target = leaves.agg(F.expr(f"sum(tokens) * {fraction[0]} div {fraction[1]}").alias("target")).scalar()
    capacity = weighed.agg(F.sum("cap").alias("cap")).scalar()
    above = None
    for at in range(len(levels)):
        path = levels[:at + 1]
        nodes = weighed.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"weight_{at}").alias("weight"))
        nodes = (nodes.withColumn("given", F.least(capacity, target)) if above is None
                 else nodes.join(above, levels[:at]))
        above = _filled(nodes, levels[:at], levels[at]).select(*path, F.col("budget").alias("given"))
    plan = leaves.join(above.withColumnRenamed("given", "budget"), levels)
    whole = F.expr("coalesce(budget div nullif(tokens, 0), 0L)")
    return plan.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _prefix_ends(keyed: DataFrame, plan: DataFrame, levels: list[str], hot_rows: int) -> DataFrame:
    """For each leaf with a rest, the last (hash, id) of its prefix, if any.

    ``keyed`` holds leaf, ``key``, ``doc_id`` and ``tokens`` of the rows of such leaves.
    """
    state = plan.select(*levels, "rest", F.lit("").alias("prefix"), "n_rows")
    for step in range(STEPS):
        # rows before the digits where the budget ends are in, rows after them are out
        near = spread_join(keyed, state.select(*levels, "rest", "prefix"), levels,
                           counts=state.select(*levels, "n_rows"), hot_rows=hot_rows)
        near = near.filter(F.substring("key", 1, DIGITS * step) == F.col("prefix"))
        digits = F.substring("key", 1, DIGITS * (step + 1))
        sums = near.groupBy(*levels, "rest", digits.alias("digits")).agg(
            F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        run = F.sum("t").over(W.partitionBy(*levels).orderBy("digits"))
        ends = sums.withColumn("run", run).filter(F.col("run") > F.col("rest"))
        state = cut_lineage(ends.groupBy(*levels).agg(
            F.min("digits").alias("prefix"), F.min_by(F.col("rest") - F.col("run") + F.col("t"), "digits").alias("rest"),
            F.min_by("n", "digits").alias("n_rows")).select(*levels, "rest", "prefix", "n_rows"))
    near = spread_join(keyed, state.select(*levels, F.col("rest"), "prefix"), levels,
                       counts=plan.select(*levels, "n_rows"), hot_rows=hot_rows)
    near = near.filter(F.substring("key", 1, DIGITS * STEPS) == F.col("prefix"))
    # rows that share an id are one step of the prefix
    units = near.groupBy(*levels, "rest", "prefix", "key").agg(F.sum("tokens").alias("t"))
    run = F.sum("t").over(W.partitionBy(*levels).orderBy("key"))
    inside = units.withColumn("run", run).groupBy(*levels, "prefix").agg(
        F.max(F.when(F.col("run") <= F.col("rest"), F.col("key"))).alias("last"))
    return inside.select(*levels, F.coalesce("last", "prefix").alias("last"))


def mix(docs: DataFrame, levels: Sequence[Column], weights: Sequence[Column], *, doc_id: str = "doc_id",
        text: str = "text", fraction: tuple[int, int] = (1, 2), max_epochs: int = 1, seed: int = SEED,
        hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns of the documents that are taken and ``copies``, how often.

    ``levels`` are the path columns from the root down; in ``weights`` the
    nodes are called ``level_0``, ``level_1`` ..., values with ``=`` in front.
    Every key in a prefix ends before any longer key with the same start, so
    ``last`` may be a hash or its leading digits.
    """
    names = [f"level_{i}" for i in range(len(levels))]
    sizes = cut_lineage(docs.select(column(doc_id).cast("string").alias("doc_id"), tokens_of(column(text)).alias("tokens"),
                                    *[_node(v).alias(n) for v, n in zip(levels, names)]))
    plan = cut_lineage(leaf_plan(sizes, names, weights, fraction=fraction, max_epochs=max_epochs))
    partial = plan.filter(F.col("rest") > 0)
    keyed = spread_join(sizes, partial.select(*names, "epochs"), names, counts=partial.select(*names, "n_rows"),
                        hot_rows=hot_rows)
    keyed = cut_lineage(keyed.select(*names, "tokens", epoch_key(seed, F.col("epochs"), F.col("doc_id")).alias("key")))
    ends = _prefix_ends(keyed, partial, names, hot_rows)
    chosen = cut_lineage(plan.join(ends, names, "left").select(*names, "epochs", "last", "n_rows",
                                                              (F.col("rest") > 0).alias("partial")))
    own = fresh(docs, *[f"_{n}" for n in names], "_epochs", "_last", "_partial", "copies")
    nodes, (epochs, last, partial_, copies) = own[:len(names)], own[len(names):]
    tagged = docs.withColumns({n: _node(v) for n, v in zip(nodes, levels)})
    looked_up = chosen.select(*[F.col(a).alias(b) for a, b in zip(names, nodes)], F.col("epochs").alias(epochs),
                              F.col("last").alias(last), F.col("partial").alias(partial_))
    counts = chosen.select(*[F.col(a).alias(b) for a, b in zip(names, nodes)], "n_rows")
    joined = spread_join(tagged, looked_up, nodes, counts=counts, hot_rows=hot_rows)
    # a leaf whose prefix nowhere exceeds its rest has no end: all of it fits
    key = epoch_key(seed, column(epochs), column(doc_id))
    in_prefix = column(partial_) & (column(last).isNull() | (key <= column(last)))
    joined = joined.withColumn(copies, (column(epochs) + in_prefix.cast("long")).cast("long"))
    return joined.filter(column(copies) > 0).select(*[column(c) for c in docs.columns], copies)

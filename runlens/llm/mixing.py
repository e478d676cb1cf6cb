"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the combinations of the ``levels`` columns (domain, language,
source), a tree. Capacities (tokens times the epochs allowed) are summed
upwards; then the budget goes down. At each node the children share its budget
in proportion to their weights; a child that cannot use its share gets its
capacity, and what it leaves goes to its siblings. Only what no sibling can use
was never given to their parent, so it has gone to the parent's siblings first
allowed by the capacities above. Shares are whole tokens by largest remainder.

Each leaf takes a prefix of its tokens from seeded epochs: whole epochs first,
then the prefix of one more in the order of md5(seed:epoch:id). Sums per leading
byte of the hash find the byte at which the prefix ends, sums per next byte the next
one, and rows are put in order only within these bytes, so no leaf, however large,
is sorted in one task.

Defined results: null level values are the empty name; null and empty texts have
no tokens and are never taken; a null id counts as the name 'null'; rows with one
id, or with none, are taken in the order of their tokens and text hashes, equal
ones counted and not sorted; a weight missing
from the table is ``default_weight``, and weight 0 takes nothing; an empty table
gives no rows. Columns named like the levels are used, all others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, expand, fresh_name, materialise, text_or_empty


def tokens_of(text: str) -> Column:
    """The engine's token estimate of a text: a quarter of its bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Column ``given``: ``budget`` (of the parent) shared over the children.

    Needs columns budget, capacity (longs) and weight (long).
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    group = W.partitionBy(*parent)
    order = group.orderBy(F.col("full_at"), F.col(name))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    c = children.where("weight > 0").withColumn("full_at", F.col("capacity").cast("double") / F.col("weight").cast("double"))
    c = c.withColumn("c0", F.coalesce(F.sum(wide("capacity")).over(before), F.lit(0)).cast("decimal(38,0)"))
    c = c.withColumn("w0", F.sum(wide("weight")).over(group) - F.coalesce(F.sum(wide("weight")).over(before), F.lit(0)))
    fits = F.col("capacity").cast("decimal(19,0)") * F.col("w0").cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * (wide("budget") - F.col("c0")).cast("decimal(19,0)")
    c = c.withColumn("full", fits)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    c = c.withColumn("rest", (F.col("budget") - taken).cast("decimal(19,0)"))
    c = c.withColumn("ws", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(group), F.lit(1)).cast("decimal(18,0)"))
    product = F.col("rest") * F.col("weight").cast("decimal(18,0)")
    c = c.withColumn("over", F.when(~F.col("full"), (product % F.col("ws")).cast("long")))
    c = c.withColumn("base", F.when(F.col("full"), F.col("capacity")).otherwise(((product - F.col("over")) / F.col("ws")).cast("long")))
    c = c.withColumn("spare", F.col("budget") - F.sum("base").over(group))
    c = c.withColumn("place", F.row_number().over(group.orderBy(F.col("full"), F.col("over").desc(), F.col(name))))
    extra = (~F.col("full")) & (F.col("place") <= F.col("spare"))
    return c.withColumn("given", F.col("base") + extra.cast("long")).drop("full_at", "c0", "w0", "full", "rest", "ws", "over", "base", "spare", "place")


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: int, default_weight: int = 1) -> DataFrame:
    """Column ``given`` for each leaf (levels, capacity)."""
    w = weights.select("level", "value", F.col("weight").cast("long").alias("weight"))
    nodes = {len(levels): leaves.select(*levels, "capacity")}
    for depth in range(len(levels), 0, -1):
        at = w.where(F.col("level") == levels[depth - 1]).select(F.col("value").alias(levels[depth - 1]), "weight")
        nodes[depth] = nodes[depth].join(at, levels[depth - 1], "left").withColumn("weight", F.coalesce("weight", F.lit(default_weight)))
        usable = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)
        nodes[depth - 1] = nodes[depth].groupBy(*levels[: depth - 1]).agg(F.sum(usable).alias("capacity"))
    given = nodes[0].select(F.least(F.lit(budget), "capacity").alias("given"))
    for depth in range(1, len(levels) + 1):
        parent = levels[: depth - 1]
        above = given.select(*parent, F.col("given").alias("budget"))
        children = nodes[depth].join(above, parent) if parent else nodes[depth].crossJoin(above)  # one row: the whole budget
        given = materialise(share(children, parent, levels[depth - 1]).drop("budget"), "budgets")
    return given


def mix(docs: DataFrame, levels: list[str], weights: DataFrame, budget_share: float, max_epochs: int = 1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", default_weight: int = 1, steps: int = 3) -> DataFrame:
    """What is taken: id, levels, epoch, doc_tokens, taken.

    ``weights``: rows (level, value, weight); the budget is ``budget_share`` of
    all tokens. A row per document and epoch it is taken in. ``steps``: so many
    bytes of the hash are told apart before rows are put in order.
    """
    return _taken(docs, levels, weights, budget_share, max_epochs, seed, id_col, text_col, default_weight, steps).drop("_th")


def _taken(docs: DataFrame, levels: list[str], weights: DataFrame, budget_share: float, max_epochs: int, seed: int, id_col: str, text_col: str, default_weight: int, steps: int) -> DataFrame:
    """:func:`mix`, with the hash of the text as ``_th``."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    light = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_th"), *names, tokens_of(text_col).alias("_tokens"))
    light = materialise(light.where("_tokens > 0"), "mix-rows")
    leaves = materialise(light.groupBy(*levels).agg(F.sum("_tokens").alias("size")).withColumn("capacity", F.col("size") * max_epochs), "mix-leaves")
    total = leaves.agg(F.sum("size")).first()[0] or 0
    given = budgets(leaves, levels, weights, int(total * budget_share), default_weight)
    whole = F.expr("given div size")
    plan = given.join(leaves.drop("capacity"), levels).select(*levels, whole.alias("_whole"), (F.col("given") - whole * F.col("size")).alias("_part"))
    plan = materialise(plan, "mix-plan")
    rows = light.join(broadcast_if_small(plan), levels)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.withColumn("_key", key)
    prefix = lambda step: F.substring("_key", 1, 2 * step)
    ends, inside = plan.select(*levels, F.lit(0).cast("long").alias("_before")), rows
    for step in range(1, steps + 1):
        sums = inside.groupBy(*levels, prefix(step).alias("_cut")).agg(F.sum("_tokens").alias("_n"), F.first("_part").alias("_part")).join(broadcast_if_small(ends.select(*levels, "_before")), levels)
        upto = F.sum("_n").over(W.partitionBy(*levels).orderBy("_cut"))  # 256 rows of a leaf at most
        sums = sums.withColumn("_before", F.col("_before") + upto - F.col("_n")).where("_before <= _part and _part < _before + _n")
        ends = materialise(sums.select(*levels, "_cut", "_before"), "mix-ends")
        if step < steps:
            found = inside.join(broadcast_if_small(ends.select(*levels, "_cut")), levels).where(prefix(step) == F.col("_cut"))
            inside = materialise(found.select(*rows.columns), "mix-inside")
    rows = rows.join(broadcast_if_small(ends), levels, "left").withColumn("_digits", prefix(steps))
    last = F.when(F.col("_digits") < F.col("_cut"), F.col("_tokens")).otherwise(0)
    columns = ["_id", "_th", *levels, "_tokens", "_whole"]
    out = rows.where("_cut is null or _digits <> _cut").select(*columns, last.alias("_last"))
    out = out.unionByName(_at_the_end(rows.where("_digits = _cut"), levels, columns))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("_whole"))
    out = out.withColumn("epoch", F.explode(epochs)).withColumn("taken", F.when(F.col("epoch") < F.col("_whole"), F.col("_tokens")).otherwise(F.col("_last")))
    return out.where("taken > 0").select(F.col("_id").alias(id_col), "_th", *levels, "epoch", F.col("_tokens").alias("doc_tokens"), "taken")


def _at_the_end(rows: DataFrame, levels: list[str], columns: list[str]) -> DataFrame:
    """Where prefixes end: rows put in order, equal ones as one with their number."""
    alike = rows.groupBy(*columns, "_key", "_part", "_before").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*levels).orderBy("_key", "_tokens", "_th").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_part") - F.col("_before") - F.coalesce(F.sum(F.col("_tokens") * F.col("_n")).over(order), F.lit(0))
    alike = alike.withColumn("_left", F.greatest(F.lit(0), F.least(left, F.col("_tokens") * F.col("_n"))))
    alike = alike.withColumn("_full", F.expr("_left div _tokens")).withColumn("_rest", F.col("_left") % F.col("_tokens"))
    cut = (F.col("_rest") > 0).cast("long")
    kind = lambda last, n: F.struct(last.cast("long").alias("_last"), n.cast("long").alias("copies"))
    kinds = F.array(kind(F.col("_tokens"), F.col("_full")), kind(F.col("_rest"), cut), kind(F.lit(0), F.col("_n") - F.col("_full") - cut))
    listed = alike.select(*columns, F.inline(kinds)).where("copies > 0 and (_last > 0 or _whole > 0)")
    return expand(listed)


def keep_mixed(docs: DataFrame, rows: DataFrame, levels: list[str], weights: DataFrame, budget_share: float, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", default_weight: int = 1, steps: int = 3) -> DataFrame:
    """The rows of ``docs`` that one epoch takes, all columns as they are, but
    texts that a leaf's prefix ends in are cut there, to whole characters.

    ``rows``: ``docs`` with the level columns. Rows with one id and text share
    the largest part that any of them got.
    """
    own_id, own_hash, taken, size = (fresh_name(docs, c) for c in ("id", "th", "taken", "size"))
    got = _taken(rows, levels, weights, budget_share, 1, seed, id_col, text_col, default_weight, steps)
    got = got.groupBy(F.col(id_col).alias(own_id), F.col("_th").alias(own_hash)).agg(F.max("taken").alias(taken), F.max("doc_tokens").alias(size))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(own_hash))
    out = docs.join(got, same)
    data, upto = F.col(text_col).cast("binary"), F.col(taken) * 4
    # the last character may begin in the three bytes before the end
    whole = F.coalesce(*(F.try_validate_utf8(F.substr(data, F.lit(1), (upto - k).cast("int")).cast("string")) for k in range(4)))
    text = F.when(F.col(taken) < F.col(size), whole).otherwise(F.col(text_col))
    return out.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))

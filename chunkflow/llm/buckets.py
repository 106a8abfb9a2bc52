"""Links inside buckets of candidates that never become all pairs of a bucket's members.

Members of a bucket are held against a few hubs; what is linked becomes components, and only
buckets of several components go on. There, members of small buckets meet in pairs. In a large
one, what lies outside its largest component, its rest, is compared with all of the bucket in
blocks of bounded size: no link that joins components is lost, and rows are copied in proportion
to the rest alone. While that would copy many rows, further hubs come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import connected_components, materialize, scratch

#: Orders of nodes: hubs are the least after these bits are flipped. HUBS of them come at once.
ORDERS = [0, 0x2F0B4C47E3A91D5C, 0x51C64E6D1B873593, 0x3C6EF372FE94F82B, 0x6A09E667F3BCC908]
HUBS, BLOCK, COPIES = 3, 256, 8


def _hub(order: int) -> Column:
    return F.min(F.col("node").bitwiseXOR(F.lit(order))).bitwiseXOR(F.lit(order))


def with_hubs(members: DataFrame) -> DataFrame:
    """(key, node, m, h0, h1, ...): the buckets of two members or more, their size and hubs."""
    hubs = members.groupBy("key").agg(F.count("*").alias("m"), *(_hub(ORDERS[k]).alias(f"h{k}") for k in range(HUBS))).where("m > 1")
    return materialize(members.join(hubs, "key"), "buckets")


def hub_pairs(buckets: DataFrame, few: int) -> DataFrame:
    """Pairs (a, b) of members and hubs: one hub in buckets of at most few members."""
    out = None
    for k in range(HUBS):
        rows = buckets.where((F.col("node") != F.col(f"h{k}")) & (F.lit(k == 0) | (F.col("m") > few)))
        pairs = rows.select(F.least("node", f"h{k}").alias("a"), F.greatest("node", f"h{k}").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _mixed(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, node, m, component) of the buckets that hold several components."""
    rows = materialize(buckets.select("key", "node", "m").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return materialize(rows.join(keys, "key", "left_semi"), "mixed")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components."""
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _against_one(rows: DataFrame, order: int) -> DataFrame:
    """Pairs (a, b) of each member and one hub of its bucket."""
    hubs = rows.groupBy("key").agg(_hub(order).alias("hub"))
    pairs = rows.join(hubs, "key").where("node <> hub")
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _parts(n: Column, times: int = 1) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(times * BLOCK))).cast("long")


def _sizes(rows: DataFrame) -> DataFrame:
    """(key, main, g, r) of mixed buckets: the largest component, its size and that of the rest."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("g"), (F.sum("n") - F.max("n")).alias("r"))


def deal_in_blocks(rows: DataFrame, times: int = 1) -> DataFrame:
    """Rows (key, node, component, ...) of mixed buckets for every two blocks (i, j) to compare.

    A bucket's largest component is dealt by a hash into blocks of about `times` BLOCK rows, and so is the
    rest. Blocks of the rest meet all blocks of the largest component (side 1) and one
    another (side 1 is the later one); rows of one block that meets itself have side 0.
    """
    rows = rows.join(_sizes(rows).select("key", "main", _parts(F.col("g"), times).alias("_g"), _parts(F.col("r"), times).alias("_r")), "key")
    rows = rows.withColumn("_in", F.col("component") == F.col("main")).withColumn("_at", F.pmod(F.xxhash64("key", "node"), F.when(F.col("_in"), F.col("_g")).otherwise(F.col("_r"))))
    meets = F.when(F.col("_in"), F.sequence(F.lit(0), F.col("_r") - 1)).otherwise(F.sequence(F.lit(0), F.col("_g") + F.col("_r") - 1))
    rows = rows.withColumn("_with", F.explode(meets))
    rest = F.col("_with") - F.col("_g")  # of two blocks of the rest the other one
    both = ~F.col("_in") & (rest >= 0)
    return rows.withColumns({
        "i": F.when(F.col("_in"), F.col("_with")).when(both, F.least("_at", rest)).otherwise(F.col("_at")),
        "j": F.when(F.col("_in"), F.col("_at")).when(both, F.col("_g") + F.greatest("_at", rest)).otherwise(F.col("_with")),
        "side": F.when(F.col("_in") | (both & (F.col("_at") > rest)), 1).otherwise(0),
    }).drop("main", "_g", "_r", "_in", "_at", "_with")


def settle(buckets: DataFrame, links: DataFrame, test: Callable[[DataFrame], DataFrame], span: Callable[[DataFrame], DataFrame], few: int) -> DataFrame:
    """(node, component) once all links inside the buckets of with_hubs() have been followed.

    links: those known. test turns pairs (a, b) into the links (u, v) among them; span turns rows
    of mixed buckets (key, node, component) into links that join their components.
    """
    with scratch(buckets.sparkSession):
        groups = connected_components(links.unionByName(test(hub_pairs(buckets, few))))
        rest = _mixed(buckets.where("m > 2"), groups)
        found = test(_pairs(rest.where(F.col("m") <= few)))
        rest = rest.where(F.col("m") > few)
        for order in ORDERS[HUBS:]:
            g, r = _parts(F.col("g")), _parts(F.col("r"))
            copies, rows = _sizes(rest).agg(F.sum(F.col("g") * r + F.col("r") * (g + r)), F.sum(F.col("g") + F.col("r"))).first()
            if not rows or copies <= COPIES * rows:
                break
            links = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
            groups = connected_components(links.unionByName(found).unionByName(test(_against_one(rest, order))))
            rest, found = _mixed(rest, groups), found.limit(0)
        if rows:
            found = found.unionByName(span(rest))
        # components stand for what they hold
        groups = connected_components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found))
        return materialize(groups, "settled", keep=True)

"""Redirect chains from single redirects: where each ends, how long it is, whether it loops, and whether it stays public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.ip import BLOCKED_NETWORKS
from sitegauge.operators.joins import stored_lookup
from sitegauge.operators.safety import url_verdicts


def _id(url: Column) -> Column:
    return F.unhex(F.md5(url))  # half as wide as the text


def _tally(chains: DataFrame) -> tuple[int, int, int]:
    """How many chains ended, are open, and are open without an unsafe address so far."""
    open_ = ~F.col("done")
    return tuple(chains.agg(F.count_if("done"), F.count_if(open_), F.count_if(open_ & F.col("unsafe_at").isNull())).first())


def followed(edges: DataFrame) -> DataFrame:
    """`id, at, steps, unsafe_at, done`: every chain followed to its end by pointer doubling.

    `edges` holds `id, at, unsafe_at`: one redirect per id, and the place of the first unsafe
    address so far, if any. In each round all open chains jump as far again as they have
    come, so one of length n takes log2(n) rounds. The rest of a chain is a chain, too: as
    long as some that end are open, each round ends one, and so it is with unsafe addresses
    that are not found yet. So the first round that ends no chain leaves only those that run
    in loops (`done` is false), which lead to none that ended; the first that also finds no unsafe
    address is the last. Chains that ended are not touched again; what a round leaves is written to the shared folder.
    """
    live = stored_lookup(edges.select("id", "at", F.lit(1).cast("bigint").alias("steps"), "unsafe_at", F.lit(False).alias("done")))
    ended = live.limit(0)
    _, open_, unknown = _tally(live)
    loops_only = False
    while open_:
        ahead = (live if loops_only else ended.unionByName(live)).select(
            F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"),
            F.col("unsafe_at").alias("later"), F.col("done").alias("there"),
        )
        # Many chains may lead to one address: that is the open side, which the planner may split.
        moved = live.join(ahead, "at", "left").select(
            "id",
            F.coalesce("next", "at").alias("at"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.coalesce("unsafe_at", F.col("steps") + F.col("later")).alias("unsafe_at"),
            F.coalesce("there", F.lit(True)).alias("done"),
        )
        moved = stored_lookup(moved)
        before = unknown
        n_ended, open_, unknown = _tally(moved)
        live = moved.where(~F.col("done"))
        if n_ended:
            ended = ended.unionByName(moved.where("done"))
        elif unknown == before:
            break
        loops_only = not n_ended
    return ended.unionByName(live)


def redirect_chains(
    edges: DataFrame, dns: DataFrame, networks: tuple[str, ...] | DataFrame = BLOCKED_NETWORKS
) -> DataFrame:
    """`url, final_url, n_hops, loops, safe, first_unsafe_hop` of every address that redirects.

    `edges` holds `from_url, to_url`. A chain is safe when it ends and every address on
    it, first and last included, is; hop 0 is the address itself. A looping chain has no
    `final_url` and no `n_hops`. Where an address redirects to several, the chain follows
    the least by code point, and is unsafe if any of them is. Rows with a null are left out.
    """
    known = edges.where("from_url IS NOT NULL AND to_url IS NOT NULL").select("from_url", "to_url").distinct()
    known = stored_lookup(known)
    urls = known.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct()
    judged = stored_lookup(url_verdicts(urls, dns, "url", networks).select(_id(F.col("url")).alias("id"), "url", "safe"))
    targets = known.select(_id(F.col("from_url")).alias("id"), "to_url", _id(F.col("to_url")).alias("to_id"))
    safe_of = lambda name: judged.select(F.col("id").alias(name), F.col("safe").alias(f"{name}_safe"))
    first = (
        targets.join(safe_of("to_id"), "to_id")
        .groupBy("id")
        .agg(F.min_by("to_id", "to_url").alias("at"), F.bool_and("to_id_safe").alias("targets_safe"))
        .join(judged.select("id", "safe"), "id")
        .select("id", "at", F.when(~F.col("safe"), 0).when(~F.col("targets_safe"), 1).cast("bigint").alias("unsafe_at"))
    )
    chains = followed(first)
    ends = judged.select(F.col("id").alias("at"), F.col("url").alias("end_url"), F.col("safe").alias("end_safe"))
    names = judged.select("id", "url")
    unsafe_at = F.coalesce("unsafe_at", F.when(F.col("done") & ~F.col("end_safe"), F.col("steps")))
    return chains.join(ends, "at").join(names, "id").select(
        "url",
        F.when(F.col("done"), F.col("end_url")).alias("final_url"),
        F.when(F.col("done"), F.col("steps")).alias("n_hops"),
        (~F.col("done")).alias("loops"),
        (F.col("done") & unsafe_at.isNull()).alias("safe"),
        unsafe_at.alias("first_unsafe_hop"),
    )

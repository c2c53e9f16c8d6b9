"""Networks from a table: which addresses lie in any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sitegauge.functions.ip import in_networks, ip_bytes
from sitegauge.functions.text import let
from sitegauge.operators.joins import stored_lookup

# Disjoint networks that travel with a task: 32 bytes each.
BROADCAST_NETWORKS = 1_000_000
_V4 = r"\A[0-9.]+\z"


def _edges(cidr: Column) -> Column:
    """First and last address of a network and its length in bits of the sixteen-byte form.

    A bare address is a network of its own; bits behind the length are ignored. A text
    that is no network ends the job: a list that is read in part would let addresses through.
    """
    address = F.regexp_extract(cidr, r"\A\s*([^/\s]+)", 1)
    given = F.regexp_extract(cidr, r"/([0-9]{1,3})\s*\z", 1)
    raw = ip_bytes(address)
    most = F.when(address.rlike(_V4), 32).otherwise(128)
    bits = F.when(cidr.rlike(r"\A\s*[^/\s]+\s*\z"), most).otherwise(F.when(given != "", given.cast("int")))
    bad = raw.isNull() | bits.isNull() | (bits > most)
    length = bits + 128 - most

    def masked(parts: Column) -> Column:
        digits, n = parts["digits"], parts["length"]
        whole = F.floor(n / 4).cast("int")
        nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
        step = F.pow(F.lit(2), 4 - n % 4).cast("int")
        head = F.substring(digits, F.lit(1), whole)
        # The digit the length ends in, and the digits behind it.
        low = F.when(n % 4 > 0, F.hex((nibble - nibble % step).cast("bigint"))).otherwise("")
        high = F.when(n % 4 > 0, F.hex((nibble - nibble % step + step - 1).cast("bigint"))).otherwise("")
        return F.struct(
            F.unhex(F.rpad(F.concat(head, low), 32, "0")).alias("low"),
            F.unhex(F.rpad(F.concat(head, high), 32, "F")).alias("high"),
            n.alias("bits"),
        )

    edges = let(F.struct(F.hex(raw).alias("digits"), length.alias("length")), masked)
    wrong = F.raise_error(F.concat(F.lit("not a network: "), F.coalesce(cidr, F.lit("NULL"))))
    return F.when(F.coalesce(bad, F.lit(True)), wrong.cast("struct<low:binary,high:binary,bits:int>")).otherwise(edges)


def disjoint_networks(networks: DataFrame) -> DataFrame:
    """`low, high, bits` of the networks (`cidr`) that no other one holds: disjoint, and together as large as all.

    Networks are nested or apart, so one is held by another exactly if an address at
    or before its first has been seen to reach its last. The table is cut into cells by the
    leading sixteen bits of the address space, and only what reaches beyond a cell is carried on.
    """
    edges = networks.select(_edges(F.col("cidr")).alias("e")).select("e.*").distinct()
    digits = F.hex("low")
    cell = F.when(digits.startswith("0" * 20 + "FFFF"), F.substring(digits, 1, 28)).otherwise(F.substring(digits, 1, 4))
    placed = edges.withColumn("cell", cell)
    # At most 2 * 65,536 rows, whatever the number of networks. Cells of IPv4 addresses lie inside that of 0000.
    reach = placed.groupBy(F.rpad("cell", 28, "0").alias("at"), "cell").agg(F.max("high").alias("high"))
    before = W.orderBy("at", "cell").rowsBetween(W.unboundedPreceding, -1)
    carried = reach.select("cell", F.max("high").over(before).alias("reached"))
    inside = W.partitionBy("cell").orderBy("low", F.desc("high")).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("own", F.max("high").over(inside)).join(carried, "cell")
    held = F.greatest("own", "reached") >= F.col("high")
    return ranked.where(~F.coalesce(held, F.lit(False))).select("low", "high", "bits")


def _searched(low: list[bytes], high: list[bytes]):
    """Binary search of addresses in sorted disjoint networks, as a column function."""
    starts, ends = np.array(low, "S16"), np.array(high, "S16")

    @F.arrow_udf("boolean")
    def inside(address: pa.Array) -> pa.Array:
        known = np.array([a or b"" for a in address.to_pylist()], "S16")
        if not len(starts):
            return pa.array(np.zeros(len(known), bool), mask=np.asarray(address.is_null()))
        at = np.searchsorted(starts, known, side="right") - 1
        found = (at >= 0) & (known <= ends[np.maximum(at, 0)])
        return pa.array(found, mask=np.asarray(address.is_null()))

    return inside


def flag_networks(rows: DataFrame, address: str, networks: DataFrame | tuple[str, ...], flag: str, most: int | None = None) -> DataFrame:
    """`rows` with `flag`: whether the sixteen bytes in `address` lie in any network; NULL where there are none.

    A tuple of networks is constant range tests. A table is made disjoint and written
    once; up to a million networks (32 MB) then travel with the tasks and are searched
    where the row is. More are joined by address prefix, one equal join over all lengths
    that occur, on distinct addresses: so nothing is compared by range, and a hot address is one row.
    """
    if isinstance(networks, tuple):
        return rows.withColumn(flag, in_networks(F.col(address), networks))
    most = BROADCAST_NETWORKS if most is None else most
    disjoint = stored_lookup(disjoint_networks(networks))
    if disjoint.count() <= most:
        found = disjoint.orderBy("low").collect()
        # A step of its own: merged into the call, an expression with nested lambdas would not be taken out to Python.
        apart = rows.select("*", F.explode(F.array(address)).alias("network_address"))
        inside = _searched([bytes(r.low) for r in found], [bytes(r.high) for r in found])
        return apart.withColumn(flag, inside("network_address")).drop("network_address")
    lengths = [r.bits for r in disjoint.select("bits").distinct().collect()]  # 128 at most
    asked = rows.select(F.col(address).alias("a")).where(F.col("a").isNotNull()).distinct()
    digits = F.hex("a")

    def prefix(n: int) -> Column:
        whole, rest = divmod(n, 4)
        nibble = F.conv(F.substring(digits, whole + 1, 1), 16, 2).cast("string")
        return F.concat(F.substring(digits, 1, whole), F.substring(F.lpad(nibble, 4, "0"), 1, rest) if rest else F.lit(""))

    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("bits"), prefix(n).alias("prefix")) for n in lengths]))
    mine = asked.select("a", keys.alias("k")).select("a", "k.*")
    theirs = disjoint.select("bits", F.col("low").alias("a")).withColumn(
        "prefix", F.coalesce(*[F.when(F.col("bits") == n, prefix(n)) for n in lengths])
    )
    hits = mine.join(theirs.select("bits", "prefix"), ["bits", "prefix"], "left_semi").select("a").distinct()
    hits = hits.select(F.col("a").alias(address), F.lit(True).alias(flag))
    joined = rows.join(hits, address, "left")
    return joined.withColumn(flag, F.when(F.col(address).isNotNull(), F.coalesce(flag, F.lit(False)))).select(*rows.columns, flag)

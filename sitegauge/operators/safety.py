"""Which URLs of a crawl frontier may be fetched. Anything unclear is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.ip import BLOCKED_NETWORKS, ip_bytes
from sitegauge.functions.text import strip
from sitegauge.functions.urls import authority_malformed, hostname, netloc, scheme
from sitegauge.operators.joins import left_join_lookup
from sitegauge.operators.networks import flag_networks

# --- fixed values: names that never leave the local network ---------------------
DENIED_HOSTS = (
    "localhost",
    "ip6-localhost",
    "ip6-loopback",
    "metadata",
    "metadata.google.internal",
    "metadata.aws",
    "instance-data",
)
DENIED_SUFFIXES = (".internal", ".local", ".localhost", ".intranet", ".corp", ".home", ".lan")

# Networks as constants, or as a table (`cidr`).
Networks = tuple[str, ...] | DataFrame

# One answer for every refusal: it must not tell which rule matched.
REFUSAL = "Only public web pages can be scored; give a public URL."


def normal_host(host: Column) -> Column:
    return F.rtrim(strip(F.lower(host)), F.lit("."))


def scheme_allowed(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def host_denied(host: Column) -> Column:
    denied = host.isin(*DENIED_HOSTS)
    for suffix in DENIED_SUFFIXES:
        denied = denied | host.endswith(suffix)
    return denied


def url_parts(frontier: DataFrame) -> DataFrame:
    """Scheme, authority and host of each URL; `host` is NULL when there is none to resolve."""
    authority = netloc(F.col("url"))
    return frontier.select(
        "*", scheme(F.col("url")).alias("scheme"), authority.alias("authority")
    ).select(
        "*",
        F.when(~authority_malformed(F.col("authority")), normal_host(hostname(F.col("authority")))).alias("host"),
    )


def local_verdicts(frontier: DataFrame, networks: Networks = BLOCKED_NETWORKS) -> DataFrame:
    """Everything a URL itself tells: `decided` is NULL where only DNS can say."""
    parts = url_parts(frontier).withColumn("address", ip_bytes(F.col("host")))
    parts = flag_networks(parts, "address", networks, "address_blocked")
    refused = (
        ~F.col("scheme").isin("http", "https")
        | F.col("host").isNull()
        | (F.col("host") == "")
        | host_denied(F.col("host"))
    )
    decided = (
        F.when(F.coalesce(refused, F.lit(True)), False)
        .when(F.col("address").isNotNull(), ~F.col("address_blocked"))
    )
    return parts.withColumn("decided", decided).drop("address_blocked")


def host_verdicts(dns: DataFrame, networks: Networks = BLOCKED_NETWORKS) -> DataFrame:
    """A host is safe when every one of its answers is a public address."""
    answers = dns.select(normal_host(F.col("host")).alias("host"), ip_bytes(F.col("ip")).alias("address"))
    judged = flag_networks(answers, "address", networks, "blocked")
    return judged.groupBy("host").agg(
        F.count("*").alias("answers"), (~F.bool_or(F.coalesce("blocked", F.lit(True)))).alias("host_safe")
    )


def url_verdicts(frontier: DataFrame, dns: DataFrame, row_id: str, networks: Networks = BLOCKED_NETWORKS) -> DataFrame:
    """`frontier` plus `safe` and `reason`. Only undecided hosts meet the DNS table."""
    local = local_verdicts(frontier, networks).withColumn(
        "dns_host", F.when(F.col("decided").isNull(), F.col("host"))
    )
    verdicts = host_verdicts(dns, networks).select(F.col("host").alias("dns_host"), "host_safe")
    joined = left_join_lookup(local, verdicts, "dns_host", row_id)
    safe = F.coalesce(F.col("decided"), F.col("host_safe"), F.lit(False))
    return joined.select(
        *frontier.columns, F.col("host"), safe.alias("safe"), F.when(~safe, F.lit(REFUSAL)).alias("reason")
    )


def safe_only(frontier: DataFrame, dns: DataFrame, row_id: str) -> DataFrame:
    return url_verdicts(frontier, dns, row_id).where("safe").select(*frontier.columns)


def chain_verdicts(hops: DataFrame, dns: DataFrame) -> DataFrame:
    """A redirect chain is safe when every hop is; also the first unsafe hop."""
    judged = url_verdicts(hops.withColumn("_row", F.xxhash64("fetch_id", "hop_no")), dns, "_row")
    return judged.groupBy("fetch_id").agg(
        F.bool_and("safe").alias("safe"),
        F.min(F.when(~F.col("safe"), F.col("hop_no"))).alias("first_unsafe_hop"),
        F.count("*").alias("n_hops"),
    )

"""Networks as a table."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.functions.ip import BLOCKED_NETWORKS, ip_bytes
from sitegauge.operators.networks import disjoint_networks, flag_networks
from sitegauge.operators.safety import host_verdicts, url_verdicts

MAPPED = 0xFFFF << 32


def number(address) -> int:
    return int(address) + (MAPPED if address.version == 4 else 0)


def span(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    return number(net[0]), number(net[-1])


def networks(spark, cidrs):
    return spark.createDataFrame([(c,) for c in cidrs], "cidr string")


def some(seed: int, n: int) -> list[str]:
    """Networks of all lengths, many inside others, some written with bits behind the length."""
    rnd = random.Random(seed)
    v4 = [f"{ipaddress.IPv4Address(rnd.getrandbits(32))}/{rnd.randrange(8, 33)}" for _ in range(n)]
    v6 = [f"{ipaddress.IPv6Address(rnd.getrandbits(128))}/{rnd.randrange(8, 129)}" for _ in range(n)]
    inner = [f"{c.split('/')[0]}/{min(int(c.split('/')[1]) + 5, 32)}" for c in v4[: n // 3]]
    return [*v4, *v6, *inner, *v4[:5], "8.8.8.8", " 2001:db8::1 ", *BLOCKED_NETWORKS]


def addresses(cidrs, seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    edges = []
    for c in cidrs:
        net = ipaddress.ip_network(c.strip(), strict=False)
        edges += [str(net[0]), str(net[-1])]
        if 0 < int(net[0]):
            edges.append(str(type(net[0])(int(net[0]) - 1)))
    free = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(200)]
    return [*edges, *free, "::ffff:10.0.0.1", "no address", None, edges[0], edges[0]]


@pytest.mark.parametrize("most", [None, 0])
def test_a_table_of_networks(spark, most):
    """Searched with the task, and joined by prefix: the same answers, those of the standard library."""
    cidrs = some(3, 60)
    rows = list(enumerate(addresses(cidrs, 4)))
    frame = spark.createDataFrame(rows, "i int, ip string").withColumn("address", ip_bytes(F.col("ip")))
    spans = [span(c) for c in cidrs]

    def expected(ip):
        try:
            n = number(ipaddress.ip_address(ip))
        except ValueError:
            return None
        return any(low <= n <= high for low, high in spans)

    for _ in range(2):  # a plan built twice in a session
        got = {r.i: r.hit for r in flag_networks(frame, "address", networks(spark, cidrs), "hit", most).collect()}
    assert got == {i: expected(ip or "") for i, ip in rows}


def test_the_table_is_disjoint_and_as_large(spark):
    cidrs = some(8, 80)
    found = [(int.from_bytes(r.low, "big"), int.from_bytes(r.high, "big")) for r in disjoint_networks(networks(spark, cidrs)).orderBy("low").collect()]
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    spans = {span(c) for c in cidrs}
    widest = {s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)}
    assert set(found) == widest


def test_the_constants_as_a_table_judge_alike(spark):
    hosts = spark.createDataFrame([("a.test", "198.41.0.4"), ("b.test", "172.20.1.9"), ("c.test", "n/a"), ("a.test", "2001:500:2f::f"), ("d.test", None)], "host string, ip string")
    urls = spark.createDataFrame(list(enumerate(["http://a.test/", "http://b.test", "https://[fd00::1]/", "http://10.0.0.1/", "http://198.41.0.4/", "http://c.test"])), "i int, url string")
    table = networks(spark, BLOCKED_NETWORKS)
    assert sorted(host_verdicts(hosts).collect()) == sorted(host_verdicts(hosts, table).collect())
    assert sorted(url_verdicts(urls, hosts, "i").collect(), key=str) == sorted(url_verdicts(urls, hosts, "i", table).collect(), key=str)


def test_no_networks_block_nothing(spark):
    frame = spark.createDataFrame([("10.0.0.1",), (None,)], "ip string").withColumn("address", ip_bytes(F.col("ip")))
    for most in (None, 0):
        got = flag_networks(frame, "address", networks(spark, []), "hit", most).collect()
        assert sorted((r.ip, r.hit) for r in got if r.ip) == [("10.0.0.1", False)] and [r.hit for r in got if not r.ip] == [None]


@pytest.mark.parametrize("text", ["10.0.0.0/33", "nonsense", "10.0.0/8", "::/129", "1.2.3.4/", None, ""])
def test_a_text_that_is_no_network_ends_the_job(spark, text):
    # Two stages may fail at once, which is another kind of error with the same words.
    with pytest.raises(Exception, match="not a network"):
        disjoint_networks(networks(spark, ["10.0.0.0/8", text])).collect()

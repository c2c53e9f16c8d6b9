"""URL and address safety."""

from __future__ import annotations

import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge.functions.ip import BLOCKED_NETWORKS, in_networks, ip_bytes
from sitegauge.operators.safety import DENIED_HOSTS, DENIED_SUFFIXES, REFUSAL, chain_verdicts, safe_only, url_verdicts



def literal(address) -> str:
    return f"[{address}]" if address.version == 6 else str(address)


def edges(network: str) -> tuple[list, list]:
    """First and last address of a network, and the two next to it that no other blocked network holds."""
    net = ipaddress.ip_network(network)
    inside = [net[0], net[-1]]
    top = 2**net.max_prefixlen - 1
    beside = [type(net[0])(int(a) + step) for a, step in ((net[0], -1), (net[-1], 1)) if 0 <= int(a) + step <= top]
    nets = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS]
    return inside, [a for a in beside if not any(a in n for n in nets if n.version == a.version)]


INSIDE = [a for n in BLOCKED_NETWORKS for a in edges(n)[0]]
# Mapped IPv4 addresses are judged as IPv4.
OUTSIDE = [a for n in BLOCKED_NETWORKS for a in edges(n)[1] if not getattr(a, "ipv4_mapped", None)]
OPEN_V4 = ["198.41.0.4", "199.7.83.42", "2001:500:2f::f"]
DNS = [
    ("open.test", OPEN_V4[0]), ("open.test", OPEN_V4[2]), ("shut.test", "172.20.1.9"), ("half.test", OPEN_V4[1]), ("half.test", "fd12::1"),
    ("broken.test", "n/a"),
]
BAD = [
    *(f"http://{literal(a)}/" for a in INSIDE), *(f"http://[::ffff:{a}]/" for a in INSIDE if a.version == 4),
    *(f"{s}://{h}{e}" for h in DENIED_HOSTS for s, e in (("http", "/"), ("https", ".:9000/x"))),
    *(f"https://{sub}{suffix}/" for suffix in DENIED_SUFFIXES for sub in ("kiosk", "a.b")),
    *(f"http://{host}/" for host in ("shut.test", "half.test", "broken.test", "unknown.test", "300.1.1.1", "[12345::]", "[x]", "[::1")),
    *(f"{scheme}open.test/" for scheme in ("mailto:", "ssh://", "blob:", "//", "", "view-source:http://")), "https://", "http:///x", "http://@/",
]
GOOD = [
    *(f"https://{literal(a)}/p" for a in OUTSIDE if a.version == 4 or int(a) >> 125 == 1),
    *(f"http://{literal(ipaddress.ip_address(a))}:81/" for a in OPEN_V4),
    *(f"{prefix}open.test{rest}" for prefix, rest in (("http://", "/"), ("HTTP://", ""), ("https://u:p@", ":8443/a?b=c#d"), ("\t https://", "/x"), ("https://", "./"))),
]


@pytest.fixture(scope="module")
def dns(spark):
    return spark.createDataFrame(DNS, "host string, ip string")


def test_urls(spark, dns):
    urls = BAD + GOOD
    frame = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    rows = url_verdicts(frame, dns, "i").collect()
    assert sorted(urls[r.i] for r in rows if r.safe) == sorted(GOOD)
    # Every refusal reads the same.
    assert {r.reason for r in rows if not r.safe} == {REFUSAL}
    assert len(rows) == len(urls)
    assert safe_only(frame, dns, "i").count() == len(GOOD)


def test_redirect_chains(spark, dns):
    fine, bad = [u for u in GOOD[:3]], [u for u in BAD[:3]]
    chains = {1: fine, 2: [fine[0], bad[0]], 3: [bad[1]], 4: [fine[1], fine[2], bad[2], fine[0], bad[0]]}
    hops = [(fetch, no, url) for fetch, urls in chains.items() for no, url in enumerate(urls)]
    rows = chain_verdicts(spark.createDataFrame(hops, "fetch_id int, hop_no int, url string"), dns).collect()
    assert {(r.fetch_id, r.safe, r.first_unsafe_hop) for r in rows} == {(1, True, None), (2, False, 1), (3, False, 0), (4, False, 2)}


_V4 = st.integers(0, 2**32 - 1).map(lambda n: str(ipaddress.IPv4Address(n)))
_V6 = st.one_of(
    st.integers(0, 2**128 - 1), st.integers(0, 2**32 - 1).map(lambda n: n << 96), st.sampled_from([0, 1, 0xFC << 120, 0xFE80 << 112])
).map(ipaddress.IPv6Address)
_SHAPES = st.one_of(
    _V4, _V6.map(str), _V6.map(lambda a: a.exploded), _V6.map(lambda a: str(a).upper()), _V4.map(lambda v: "::ffff:" + v), _V4.map(lambda v: "64:ff9b::" + v),
    st.text(alphabet="0123456789abcdef:.%", max_size=24),
    st.sampled_from(["1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", ":", ":::", "::1::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "::%eth0", "fe80::1%eth0", "1.2.3.4%x", "::1.2.3", "1:2:3:4:5:6:7:1.2.3.4", "g::1", ""]),
)


@settings(max_examples=12, deadline=None)
@given(texts=st.lists(_SHAPES, min_size=60, max_size=120))
def test_addresses_match_the_standard_library(spark, texts):
    nets = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS]

    def expected(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None, None
        plain = ip.ipv4_mapped if ip.version == 6 and ip.ipv4_mapped else ip
        packed = plain.packed if plain.version == 6 else bytes(10) + b"\xff\xff" + plain.packed
        return packed, any(plain in n for n in nets)

    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", ip_bytes(F.col("t")).alias("b")).select("i", "b", in_networks(F.col("b")).alias("x")).collect()
    for r in rows:
        assert (r.b and bytes(r.b), r.x) == expected(texts[r.i]), texts[r.i]

"""Fixed-window rate limits over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegauge.functions.ip import is_ip
from sitegauge.functions.text import built_once, let, strip
from sitegauge.sources.pages import header

PER_MINUTE, PER_DAY = 20, 200
MINUTE, DAY = 60, 86_400
STORE_RETRY = 60
CACHE_SECONDS = 600


def caps(per_minute: object = PER_MINUTE, per_day: object = PER_DAY) -> tuple[int, int]:
    """Configured caps; a value that is no integer puts both back to the defaults. At least 1."""
    try:
        pair = int(per_minute), int(per_day)
    except (TypeError, ValueError):
        pair = PER_MINUTE, PER_DAY
    return max(1, pair[0]), max(1, pair[1])


@built_once
def client_ip(headers: str = "headers") -> Column:
    """Leftmost forwarded address, else the real-ip header, else NULL; invalid text never counts."""
    headers = F.col(headers)

    def valid(text: Column) -> Column:
        return let(text, lambda t: F.when(is_ip(t), t))

    forwarded = F.split(header(headers, "x-forwarded-for"), ",")[0]
    return F.coalesce(valid(strip(forwarded)), valid(strip(header(headers, "x-real-ip"))))


def with_buckets(requests: DataFrame) -> DataFrame:
    """Client, epoch second, minute and day bucket (UTC) of each request."""
    return requests.select(
        "*", client_ip("headers").alias("client_ip"), F.unix_seconds("ts").alias("second")
    ).select(
        "*",
        F.expr(f"second div {MINUTE}").alias("minute_bucket"),
        F.expr(f"second div {DAY}").alias("day_bucket"),
    )


def bucket_counts(requests: DataFrame, unit: str) -> DataFrame:
    """Requests per client and `minute` or `day` bucket. Counted map-side before the shuffle."""
    bucket = f"{unit}_bucket"
    return (
        with_buckets(requests)
        .where(F.col("client_ip").isNotNull())
        .groupBy("client_ip", bucket)
        .agg(F.count("*").alias("n"))
    )


def slice_offsets(bucketed: DataFrame) -> DataFrame:
    """Per client and second: how many of its minute's and day's requests came in earlier seconds.

    Counts are aggregated map-side, so the windows see at most 86,400 rows per
    client and day however many requests one client sends. Both windows share
    one exchange (by client and day) and one sort.
    """
    slices = bucketed.groupBy("client_ip", "day_bucket", "minute_bucket", "second").agg(
        F.count("*").alias("n")
    )
    day = W.partitionBy("client_ip", "day_bucket").orderBy("minute_bucket", "second")
    minute = W.partitionBy("client_ip", "day_bucket", "minute_bucket").orderBy("second")
    before = (W.unboundedPreceding, -1)
    return slices.select(
        "client_ip",
        "day_bucket",
        "minute_bucket",
        "second",
        "n",
        F.coalesce(F.sum("n").over(minute.rowsBetween(*before)), F.lit(0)).alias("minute_before"),
        F.coalesce(F.sum("n").over(day.rowsBetween(*before)), F.lit(0)).alias("day_before"),
    )


def number_requests(bucketed: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each request's running number in its minute and day: earlier seconds plus its place in its second.

    No task holds more than one client-second of requests, so a client that
    sends a third of the whole log is spread over all its seconds, and so are the
    requests without a client, whose numbers stay NULL. Requests of one instant
    are ordered by `request_id`; blocked requests count as well.
    """
    place = W.partitionBy("client_ip", "second").orderBy("ts", "request_id")
    keyed = offsets.select("client_ip", "second", "minute_before", "day_before")
    return (
        bucketed.withColumn("_place", F.row_number().over(place))
        .join(keyed, ["client_ip", "second"], "left")
        .withColumns(
            {
                "minute_count": F.col("minute_before") + F.col("_place"),
                "day_count": F.col("day_before") + F.col("_place"),
            }
        )
        .drop("_place", "minute_before", "day_before")
    )


def request_ordinals(requests: DataFrame) -> DataFrame:
    """Running minute and day numbers of every identified request."""
    bucketed = with_buckets(requests)
    return number_requests(bucketed, slice_offsets(bucketed)).where(F.col("client_ip").isNotNull())


def retry_after(second: Column, minute_count: Column, day_count: Column, per_minute: int, per_day: int) -> Column:
    """Seconds until the exceeded window rolls over: the longer wait, at least 1; 0 when nothing is exceeded."""
    wait = F.greatest(
        F.when(minute_count > per_minute, MINUTE - second % MINUTE),
        F.when(day_count > per_day, DAY - second % DAY),
    )
    return F.coalesce(F.greatest(F.lit(1), wait.cast("int")) * F.when(wait.isNotNull(), 1), F.lit(0))


def decide(numbered: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Blocked iff a running number exceeds its cap; the cap itself is still allowed.

    A request without a client has no numbers: allowed, and nothing is enforced.
    """
    over = (F.col("minute_count") > per_minute) | (F.col("day_count") > per_day)
    return numbered.withColumns(
        {
            "allowed": ~F.coalesce(over, F.lit(False)),
            "retry_after_seconds": retry_after(
                F.col("second"), F.col("minute_count"), F.col("day_count"), per_minute, per_day
            ),
            "enforced": F.col("client_ip").isNotNull(),
        }
    )


def rate_limit(requests: DataFrame, per_minute: object = PER_MINUTE, per_day: object = PER_DAY) -> DataFrame:
    """Every request with its decision."""
    bucketed = with_buckets(requests)
    return decide(number_requests(bucketed, slice_offsets(bucketed)), *caps(per_minute, per_day))


def limiter_outcome(configured: Column, identified: Column, store_status: Column, parsed: Column) -> Column:
    """What a limiter does when its counter store answers this way; `counted` leaves the choice to the counts."""

    def outcome(allowed: bool | None, retry: int, enforced: bool, label: str) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(allowed).cast("boolean").alias("allowed"),
            F.lit(retry).alias("retry_after_seconds"),
            F.lit(enforced).alias("enforced"),
        )

    def open_(label: str) -> Column:
        return outcome(True, 0, False, label)

    return (
        F.when(~configured, open_("unconfigured"))
        .when(~identified, open_("unidentified"))
        .when(store_status.isNull(), open_("unreachable"))
        .when(store_status.isin(429, 403), outcome(False, STORE_RETRY, True, "drained"))
        .when(store_status >= 400, open_("store_error"))
        .when(~F.coalesce(parsed, F.lit(False)), open_("unreadable"))
        .otherwise(outcome(None, 0, True, "counted"))
    )


def retry_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.ceil(seconds / 60).cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.ceil(seconds / 3600).cast("string"), F.lit(" h")))
    )


def query_parameter(path: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; NULL when missing."""

    def decode(text: Column) -> Column:
        return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))

    query = F.regexp_extract(path, r"\A[^?#]*\?([^#]*)", 1)
    hits = F.filter(
        F.split(query, "&"),
        lambda p: (decode(F.substring_index(p, "=", 1)) == name) & p.rlike("=."),
    )
    return decode(F.regexp_replace(F.try_element_at(hits, F.lit(1)), r"\A[^=]*=", ""))


def request_outcome(allowed: Column, url: Column, failed: Column | None = None) -> Column:
    """HTTP status of a scoring request: the limiter first, then the parameter, then the work."""
    failed = F.lit(False) if failed is None else failed
    return F.when(~allowed, 429).when(url.isNull(), 400).when(failed, 500).otherwise(200)

"""URL filters: a temporal join of captures with a dated list of domains.

The list is a log of dated entries (domain, since, action), action 'block' or 'allow' to enter a domain and 'drop' to
take it off. Each domain's entries become disjoint validity intervals [since, until); a capture looks up its host and
every parent domain in one equi-join with the fetch time inside the interval, and the longest domain with an active
entry decides ('allow' if there is none). Only DataFrame functions are used.

Entries of one domain and time: the action that sorts last counts ('drop' over 'block' over 'allow'). Entries without
domain, time or action are ignored. A null or hostless URL, or a null fetch time, has no active entry and is allowed.
An address in brackets (IPv6) is one host without parents. Repeated captures are reported row by row; an empty list allows
everything; columns of captures that are named like a result column are replaced by it, all others are passed on whatever
they are called (they travel in one struct). The join is by domain: a host with a third of all captures is a skewed key of
the capture side only, which adaptive execution splits, and at most one interval of a domain is active at a time, so a
capture makes at most one row per label of its host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import table, written

#: Host of a URL: after the scheme and any user part, to the port, path, query or fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)"
#: Labels of a host that are looked up, from the right (DNS allows no more).
LABELS = 127


def host_of(url: F.Column) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def domains_of(host: F.Column) -> F.Column:
    """The host and its parent domains, longest first."""
    labels = F.slice(F.reverse(F.filter(F.split(host, r"\."), lambda x: x != "")), 1, LABELS)
    return F.when(host.startswith("["), F.array(host)).otherwise(_parents(labels))


def _parents(labels: F.Column) -> F.Column:
    return F.transform(F.sequence(F.size(labels), F.lit(1)), lambda n: F.array_join(F.reverse(F.slice(labels, F.lit(1), n)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until) of a log of entries (domain, since, action); until is null while it is active."""
    rows = entries.where("domain is not null and since is not null and action is not null")
    rows = rows.groupBy(F.lower("domain").alias("domain"), "since").agg(F.max("action").alias("action"))
    return rows.withColumn("until", F.lead("since").over(W.partitionBy("domain").orderBy("since"))).where("action <> 'drop'")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched and others) with host, matched_domain, active_since and verdict."""
    names = [c for c in captures.columns if c.lower() not in ("host", "matched_domain", "active_since", "verdict")]
    capture = F.struct(*[F.col(f"`{c}`") for c in {"url", "fetched", *names}])
    rows = captures.select(capture.alias("capture"), F.monotonically_increasing_id().alias("row"), host_of(F.col("url")).alias("host"))
    listed = written(validity(entries), "validity")  # an exchange on both sides of the join lets adaptive execution split a hot host
    asked = rows.withColumn("domain", F.explode_outer(F.when(F.col("host").isNotNull(), domains_of(F.col("host")))))
    fetched = F.col("capture.fetched")
    active = (asked["domain"] == listed["domain"]) & (fetched >= F.col("since")) & (F.col("until").isNull() | (fetched < F.col("until")))
    met = asked.join(listed, active, "left").select("row", "capture", "host", asked["domain"], "action", "since")
    longest = lambda c: F.max_by(c, F.when(F.col("action").isNotNull(), F.length("domain")))
    one = met.groupBy("row", "host").agg(F.any_value("capture").alias("capture"), longest("domain").alias("matched_domain"), longest("since").alias("active_since"), longest("action").alias("action"))
    return one.select(*[F.col(f"capture.`{c}`").alias(c) for c in names], "host", "matched_domain", "active_since", F.coalesce("action", F.lit("allow")).alias("verdict"))


DAY0 = "2024-01-01"


def dated_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): pages with a fetch time made from page_id, as the table has none."""
    return pages.select("page_id", "url", F.expr(f"timestamp'{DAY0}' + make_dt_interval(cast(pmod(page_id * 37, 365) as int), cast(pmod(page_id, 24) as int))").alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the table's own domains: by the digest of its name a host, or the parent of one, enters, leaves and returns on set days."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(F.slice(domains_of(F.col("host")), 1, 2)).alias("domain")).distinct()
    h = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")
    named = names.select("domain", h.alias("h")).where("h % 3 = 0 and domain like '%.%'")
    steps = F.expr("array(named_struct('day', h % 120, 'action', if(h % 2 = 0, 'block', 'allow')), named_struct('day', 120 + h % 100, 'action', 'drop'), named_struct('day', 220 + h % 140, 'action', 'block'))")
    return named.select("domain", F.explode(steps).alias("s")).select("domain", F.expr(f"timestamp'{DAY0}' + make_dt_interval(cast(s.day as int))").alias("since"), "s.action")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = judged(dated_captures(pages), dated_list(pages))
    return out.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd HH").alias("fetched_hour"), "matched_domain", F.date_format("active_since", "yyyy-MM-dd").alias("active_since"), "verdict")


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE = {
    "op7_url_filter": r"""
WITH c AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 37) % 365 AS INTEGER)) + to_hours(page_id % 24) AS fetched FROM pages
), l AS (SELECT DISTINCT host, list_filter(string_split(host, '.'), lambda x: x <> '') AS ls FROM c WHERE host IS NOT NULL
), d AS (SELECT host, unnest(range(1, len(ls) + 1)) AS i, ls FROM l
), a AS (SELECT host, i, array_to_string(ls[i:], '.') AS domain FROM d
), n AS (SELECT DISTINCT domain, CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT) AS h FROM a WHERE i <= 2 AND contains(domain, '.')
), e AS (
  SELECT domain, h % 120 AS day, CASE WHEN h % 2 = 0 THEN 'block' ELSE 'allow' END AS action FROM n WHERE h % 3 = 0
  UNION ALL SELECT domain, 120 + h % 100, 'drop' FROM n WHERE h % 3 = 0 UNION ALL SELECT domain, 220 + h % 140, 'block' FROM n WHERE h % 3 = 0
), v AS (SELECT domain, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS since, action FROM e
), s AS (SELECT c.page_id, c.fetched, a.i, a.domain, v.since, v.action, row_number() OVER (PARTITION BY c.page_id, a.i ORDER BY v.since DESC) AS r
  FROM c JOIN a USING (host) JOIN v ON v.domain = a.domain AND v.since <= c.fetched
), b AS (SELECT page_id, min_by(domain, i) AS matched_domain, min_by(since, i) AS since, min_by(action, i) AS action FROM s WHERE r = 1 AND action <> 'drop' GROUP BY page_id)
SELECT c.page_id, c.host, strftime(c.fetched, '%Y-%m-%d %H') AS fetched_hour, b.matched_domain, strftime(b.since, '%Y-%m-%d') AS active_since, coalesce(b.action, 'allow') AS verdict
FROM c LEFT JOIN b USING (page_id)"""
}

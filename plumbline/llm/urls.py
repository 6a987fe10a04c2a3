"""URL filters by a temporal list join.

A list is a log of dated events: from `day` on, `action` ('block' or 'allow') holds for `entry`, or,
with 'remove', nothing does. Events become validity intervals: an entry's state lasts until its next
event (events of one entry and day: the last in the order allow, block, remove counts). An entry is
a domain, which covers its subdomains, alone or with the first parts of a path. A capture is judged
by the state of the list on the day it was fetched: of the entries that cover it and are active
then, the longest decides.

Built-in functions only. A capture has a key for each suffix of its host, alone and with each prefix of
its path that is no deeper than the deepest entry of the list; the join is by key, with the interval as a further condition. The list is broadcast if it has BROADCAST_ROWS
at most (it is counted); a longer one is joined by shuffle, with captures spread over SALT parts of
each key and the list's rows repeated in each, so that a host with a third of all captures is no
hot key.

A null, empty or malformed URL has no host and no decision; so has a capture without a day. Equal
rows of id, URL and day are one result, with their number. Events without entry or day are ignored.
Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS, SALT = 200_000, 32
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#][^?#]*)"


def host(url):
    h = F.regexp_replace(F.regexp_extract(F.lower(url), _HOST, 1), r"\.+$", "")
    return F.when(h != "", h)


def path_parts(url, depth: int):
    """The first parts of a path, depth at most; none of a path that is empty or begins with a slash."""
    p = F.regexp_extract(F.lower(url), _PATH, 1)
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(p, "/"), 1, depth))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, action, since, until) of the times at which an entry blocks or allows; until is null if it still does."""
    rank = F.when(F.col("action") == "allow", 1).when(F.col("action") == "block", 2).otherwise(3)
    e = events.select(F.lower("entry").alias("entry"), "action", "day").where("entry is not null and day is not null and action in ('allow', 'block', 'remove')")
    e = e.groupBy("entry", "day").agg(F.max_by("action", rank).alias("action"))
    by = Window.partitionBy("entry").orderBy("day")
    return e.select("entry", "action", F.col("day").alias("since"), F.lead("day").over(by).alias("until")).where("action <> 'remove'")


def judge(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(page_id, url, day, host, n_rows, decision, entry, since) of every capture."""
    listed = intervals(events)
    c = captures.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day"))
    c = c.groupBy("page_id", "url", "day").agg(F.count("*").alias("n_rows"))
    c = c.withColumn("host", host(F.col("url")))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    depth = listed.agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0] or 0
    parts = path_parts(F.col("url"), depth)
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(domains, F.flatten(F.transform(domains, lambda h: F.transform(paths, lambda p: F.concat_ws("/", h, p)))))
    keyed = c.where("host is not null and day is not null").select("page_id", "url", "day", F.explode(keys).alias("entry"))
    on = ["entry"]
    if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(listed)
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
        table = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        on.append("salt")
    active = keyed.join(table, on).where("since <= day and (until is null or day < until)")
    longest = active.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("day").alias("d")).agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "action", "since")).alias("best"))
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("day") == F.col("d"))
    return c.join(longest, same, "left").select("page_id", "url", "day", "host", "n_rows", F.coalesce("best.action", F.lit("none")).alias("decision"), F.col("best.entry").alias("entry"), F.col("best.since").alias("since"))


def dated(pages: DataFrame) -> DataFrame:
    """The table `pages` has no fetch times: its pages count as fetched over thirty days, by id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(30)).cast("int")).alias("day"))


def sample_list(pages: DataFrame) -> DataFrame:
    """There is no list among the tables either: a dated log over the hosts that occur, by the lengths of their names."""
    h = pages.select(host(F.col("url")).alias("host")).where("host is not null").distinct()
    n, start = F.length("host"), F.lit("2024-01-01").cast("date")
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    hosts = [("block", n * 7 % 20, F.col("host")), ("remove", n * 7 % 20 + 10, F.col("host")), ("allow", F.lit(3), F.concat("host", F.lit("/en"))), ("remove", F.lit(25), F.concat("host", F.lit("/en")))]
    m = F.length("parent")
    parents = [("block", m * 3 % 10, F.col("parent")), ("remove", m * 3 % 10 + 5, F.col("parent")), ("block", m * 3 % 10 + 12, F.col("parent"))]
    p = h.select(parent.alias("parent")).where("parent <> ''").distinct()
    row = lambda a, d, e: F.struct(e.alias("entry"), F.lit(a).alias("action"), F.date_add(start, d.cast("int")).alias("day"))
    return h.select(F.inline(F.array(*(row(*x) for x in hosts)))).unionByName(p.select(F.inline(F.array(*(row(*x) for x in parents)))))


SQL = r"""
WITH c AS (SELECT page_id::BIGINT AS page_id, url, DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS day, count(*) AS n_rows FROM pages GROUP BY ALL),
h AS (SELECT *, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.+$', ''), '') AS host,
        nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS part FROM c),
hosts AS (SELECT DISTINCT host, length(host) AS n FROM h WHERE host IS NOT NULL),
parents AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS parent FROM hosts),
ev AS (SELECT host AS entry, 'block' AS action, n * 7 % 20 AS d FROM hosts UNION ALL SELECT host, 'remove', n * 7 % 20 + 10 FROM hosts
   UNION ALL SELECT host || '/en', 'allow', 3 FROM hosts UNION ALL SELECT host || '/en', 'remove', 25 FROM hosts
   UNION ALL SELECT parent, 'block', length(parent) * 3 % 10 FROM parents WHERE parent <> '' UNION ALL SELECT parent, 'remove', length(parent) * 3 % 10 + 5 FROM parents WHERE parent <> ''
   UNION ALL SELECT parent, 'block', length(parent) * 3 % 10 + 12 FROM parents WHERE parent <> ''),
dayed AS (SELECT entry, DATE '2024-01-01' + CAST(d AS INTEGER) AS day, arg_max(action, CASE action WHEN 'allow' THEN 1 WHEN 'block' THEN 2 ELSE 3 END) AS action FROM ev GROUP BY ALL),
iv AS (SELECT entry, action, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM dayed),
lab AS (SELECT *, string_split(host, '.') AS l FROM h WHERE host IS NOT NULL AND day IS NOT NULL),
keyed AS (SELECT page_id, url, day, unnest(list_concat(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')), CASE WHEN part IS NULL THEN [] ELSE [host || '/' || part] END)) AS entry FROM lab),
act AS (SELECT k.page_id, k.url, k.day, k.entry, iv.action, iv.since, row_number() OVER (PARTITION BY k.page_id, k.url, k.day ORDER BY length(k.entry) DESC, k.entry DESC) AS r
   FROM keyed k JOIN iv ON k.entry = iv.entry AND iv.since <= k.day AND (iv.until IS NULL OR k.day < iv.until) WHERE iv.action <> 'remove')
SELECT h.page_id, h.url, h.day, h.host, h.n_rows::BIGINT AS n_rows, coalesce(a.action, 'none') AS decision, a.entry, a.since
FROM h LEFT JOIN act a ON h.page_id IS NOT DISTINCT FROM a.page_id AND h.url = a.url AND h.day = a.day AND a.r = 1"""

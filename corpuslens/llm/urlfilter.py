"""URL filters by a temporal join: dated list entries become validity intervals, captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import fits, read, stored

FOREVER = "9999-12-31"


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, since, until) from dated entries (list_name, pattern, action 'add' or 'remove', at date).

    An entry holds from its day until the day before the next of the same list and pattern. Of entries on one day 'remove' comes first, so an
    addition that day holds. Additions that follow an addition go on from the first. Entries with a null field are ignored.
    """
    known = entries.where("list_name is not null and pattern is not null and at is not null and action in ('add', 'remove')").select("list_name", F.lower("pattern").alias("pattern"), "action", "at").distinct()
    history = Window.partitionBy("list_name", "pattern").orderBy("at", F.desc("action"))
    turned = known.withColumn("_before", F.lag("action").over(history)).where("_before is null or _before <> action")
    ended = turned.withColumn("until", F.coalesce(F.lead("at").over(history), F.to_date(F.lit(FOREVER))))
    return ended.where("action = 'add' and at < until").select("list_name", "pattern", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a final dot; '' if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])", 1)


def _lengths(held: DataFrame) -> tuple[list[int], list[int]]:
    """The different lengths of a list's patterns of hosts, and of those with a path: as many numbers as its longest pattern has characters at most."""
    path = F.contains("pattern", F.lit("/")).alias("path")
    found = held.select(path, F.length("pattern").alias("n")).where("n > 0").distinct().collect()
    return tuple(sorted(r.n for r in found if r.path == want) for want in (False, True))


def patterns(url: Column, of_hosts: list[int], of_paths: list[int]) -> Column:
    """What a list may hold of a URL: its host, each domain above it, and its host with each leading part of its path (ending in '/' or whole).

    Only those of a length that the list has are made, so that the work and the size are bounded by the list, however long the URL is.
    """
    none = F.array().cast("array<string>")
    numbers = lambda found: F.array(*[F.lit(n) for n in found]) if found else F.array().cast("array<int>")
    h = host(url)
    most = max(of_paths, default=0)
    # The character after the longest pattern tells whether the URL goes on.
    whole = F.substring(F.concat(h, F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)), 1, most + 1)

    def made(both: Column) -> Column:
        name, rest = both["name"], both["whole"]
        n, m = F.length(name), F.length(rest)
        above = F.filter(numbers(of_hosts), lambda k: (k == n) | ((k < n) & (F.substring(name, n - k, F.lit(1)) == ".")))
        leading = F.filter(numbers(of_paths), lambda k: (k > n) & ((k == m) | ((k < m) & (F.substring(rest, k, F.lit(1)) == "/"))))
        ends = F.transform(above, lambda k: F.substring(name, n - k + 1, k))
        return F.concat(ends, F.transform(leading, lambda k: F.substring(rest, F.lit(1), k)))

    # made() uses both texts often: they are worked out once.
    once = F.get(F.transform(F.array(F.struct(h.alias("name"), whole.alias("whole"))), made), F.lit(0))
    return F.when(h == "", none).otherwise(once)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with blocked and the entry that blocks: list_name, pattern, since.

    Of several active entries the longest pattern counts, then the least list_name and pattern. URLs that are null or without a host, and
    captures without a date, are not blocked. Repeated captures stay; empty tables on either side are no error. Only the three columns are read.

    A list that fits is broadcast. Else it is first asked for the different pairs of pattern and day, which a pattern that very many captures share makes few of, and its
    answers, stored, are joined to the captures; that join's large keys are split as skewed.
    """
    held = intervals(entries)
    rows = captures.select("page_id", "url", "fetched")
    asked = rows.where("url is not null and fetched is not null").distinct().select("page_id", "url", "fetched", F.explode(patterns(F.col("url"), *_lengths(held))).alias("pattern"))
    best = F.min_by(F.struct("list_name", "pattern", "since"), F.struct(-F.length("pattern"), "list_name", "pattern"))
    if fits(held):
        active = asked.join(F.broadcast(held), "pattern").where("since <= fetched and fetched < until")
    else:
        pairs = asked.select("pattern", "fetched").distinct().join(held, "pattern").where("since <= fetched and fetched < until")
        answers = stored(pairs.groupBy(F.col("pattern").alias("_pattern"), F.col("fetched").alias("_fetched")).agg(best.alias("_hit")), "answers")
        found = asked.join(answers, (F.col("pattern") == F.col("_pattern")) & (F.col("fetched") == F.col("_fetched")))
        active = found.select("page_id", "url", "fetched", "_hit.list_name", "_hit.pattern", "_hit.since")
    hits = active.groupBy(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("fetched").alias("_day")).agg(best.alias("_hit"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_day"))
    return rows.join(hits, same, "left").select("page_id", "url", "fetched", F.col("_hit").isNotNull().alias("blocked"), "_hit.list_name", "_hit.pattern", "_hit.since")


def _draw(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("long")


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages, drawn by a hash: the tables hold none. Hosts, domains above them and paths are added, some removed, some added again."""
    seen = pages.select(host(F.col("url")).alias("host"), F.regexp_extract(F.lower("url"), r"://[^/?#]*(/[^/?#]*/)", 1).alias("dir")).where("host <> ''")
    domain = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    named = seen.select("host", F.when(F.size(F.split("host", r"\.")) > 3, domain).alias("domain"), F.when(F.col("dir") != "", F.concat("host", "dir")).alias("path"))
    parts = [named.select(F.lit(n).alias("list_name"), F.col(c).alias("pattern"), F.lit(m).alias("m")).where("pattern is not null") for n, c, m in (("hosts", "host", 3), ("domains", "domain", 5), ("paths", "path", 7))]
    drawn = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().withColumn("d", _draw(F.concat("list_name", F.lit(":"), "pattern"))).where("d % m = 0")
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-01")), n.cast("int"))
    start = (F.col("d") / 11).cast("long") % 200
    dated = F.array(
        F.struct(F.lit("add").alias("action"), day(start).alias("at")),
        F.struct(F.when(F.col("d") % 2 == 0, "remove").alias("action"), day(start + 40).alias("at")),
        F.struct(F.when(F.col("d") % 4 == 0, "add").alias("action"), day(start + 90).alias("at")),
    )
    return drawn.select("list_name", "pattern", F.explode(dated).alias("e")).select("list_name", "pattern", "e.action", "e.at").where("action is not null")


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a list drawn from the hosts; the day of its fetch is drawn from page_id, as pages hold none."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int")))
    return evaluate(captures, demo_entries(pages))


QUERIES = {"op2_urlfilter": op2_urlfilter}
ORACLE = {
    "op2_urlfilter": r"""
WITH c AS (
    SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
           regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])', 1) AS host,
           regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
           regexp_extract(lower(url), '://[^/?#]*(/[^/?#]*/)', 1) AS dir
    FROM pages
), names AS (
    SELECT 'hosts' AS list_name, host AS pattern, 3 AS m FROM c WHERE host <> ''
    UNION SELECT 'domains', array_to_string(string_split(host, '.')[-3:], '.'), 5 FROM c WHERE len(string_split(host, '.')) > 3
    UNION SELECT 'paths', host || dir, 7 FROM c WHERE host <> '' AND dir <> ''
), drawn AS (
    SELECT * FROM (SELECT *, CAST('0x' || md5(list_name || ':' || pattern)[1:6] AS BIGINT) AS d FROM names) WHERE d % m = 0
), spans AS (
    SELECT list_name, pattern, CAST(DATE '2024-01-01' + CAST((d // 11) % 200 AS INTEGER) AS DATE) AS since,
           CASE WHEN d % 2 = 0 THEN CAST(DATE '2024-01-01' + CAST((d // 11) % 200 + 40 AS INTEGER) AS DATE) ELSE DATE '9999-12-31' END AS until FROM drawn
    UNION ALL
    SELECT list_name, pattern, CAST(DATE '2024-01-01' + CAST((d // 11) % 200 + 90 AS INTEGER) AS DATE), DATE '9999-12-31' FROM drawn WHERE d % 4 = 0
), hits AS (
    SELECT page_id, url, list_name, pattern, since,
           row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, list_name, pattern) AS n
    FROM c JOIN spans s ON s.since <= c.fetched AND c.fetched < s.until AND (
        host = pattern OR (host <> '' AND ends_with(host, '.' || pattern)) OR host || path = pattern
        OR (ends_with(pattern, '/') AND starts_with(host || path, pattern)))
)
SELECT c.page_id, c.url, c.fetched, h.pattern IS NOT NULL AS blocked, h.list_name, h.pattern, h.since
FROM c LEFT JOIN hits h ON h.page_id = c.page_id AND h.url = c.url AND h.n = 1
"""
}

"""URL filters: temporal list join.

Dated list entries (an entry adds a pattern to a list or removes it) become validity intervals: a row for each list and
pattern holds the changes of its state in order of time, ``CHANGES`` of them at most, and covers the time from its first
change to the next row's. Each capture asks for all its domain suffixes and path prefixes by equi-join; the as-of part is a
binary search for its fetch time in the row, so the join makes a row for each list that names a pattern, not for each of
its intervals. The most specific active entry decides (longer pattern, then a path prefix before a domain, then an
allow list before a block list). Functions of DataFrames and SQL only.

Folders deeper or shallower than all entries' can't match, so a long path is asked only at the depths that entries have.

Defined results: an entry that is added and removed at the same instant is removed; a repeated entry counts once; entries
without a date, pattern or list are left out; hosts compare in lower case without a final dot; a capture without a
usable host or time has no active entries and is not blocked; repeated captures are answered each; empty tables give
no entries or an empty result; further columns of captures are kept, those that clash with the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADDED = ("host", "n_active", "decided_by", "decided_list", "blocked")
#: Changes of one pattern on one list that a row holds at most; a power of two. More make more rows.
CHANGES = 1024


def host_of(url: str = "url") -> Column:
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.regexp_replace(found, r"\.$", "")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _states(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, dated, allow, active: the state of a pattern on a list from each instant with an entry on."""
    known = entries.filter("list is not null and pattern is not null and dated is not null and action in ('add', 'remove')")
    return known.groupBy("list", "kind", "pattern", "dated").agg(F.bool_or("allow").alias("allow"), (~F.bool_or(F.col("action") == "remove")).alias("active"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, allow, kind, pattern, action, dated) -> (list, allow, kind, pattern, valid_from, valid_to); the end is open."""
    by_entry = Window.partitionBy("list", "kind", "pattern").orderBy("dated")
    return _states(entries).withColumn("valid_to", F.lead("dated").over(by_entry)).filter("active").select("list", "allow", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def histories(entries: DataFrame, changes: int = CHANGES) -> DataFrame:
    """list, kind, pattern, since, until (null: open), times (ascending), states (allow, active): the intervals of a pattern, in rows of bounded size."""
    by_entry = Window.partitionBy("list", "kind", "pattern").orderBy("dated")
    placed = _states(entries).withColumns({"part": F.floor((F.row_number().over(by_entry) - 1) / changes), "next": F.lead("dated").over(by_entry)})
    rows = placed.groupBy("list", "kind", "pattern", "part").agg(F.array_sort(F.collect_list(F.struct("dated", "allow", "active"))).alias("x"), F.max(F.struct("dated", "next"))["next"].alias("until"))
    return rows.select("list", "kind", "pattern", F.col("x")[0]["dated"].alias("since"), "until", F.col("x.dated").alias("times"), F.transform("x", lambda x: F.struct(x["allow"].alias("allow"), x["active"].alias("active"))).alias("states"))


def as_of(times: Column, at: Column, changes: int = CHANGES) -> Column:
    """The place of the last of the ascending times that is not after at, by binary search; times[0] must not be after it."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(changes.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda place, step: F.when(F.get(times, place + step) <= at, place + step).otherwise(place))


def questions(host: Column, path: Column, depths: list[int]) -> Column:
    """The patterns that may decide a capture: its domain and all parents, its path and the folders above of these depths."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    asked = F.filter(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>"), lambda i: i <= F.size(parts))
    prefixes = F.transform(asked, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern")))
    return F.array_distinct(F.concat(domains, prefixes))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", changes: int = CHANGES) -> DataFrame:
    """captures plus host, n_active, decided_by (a pattern), decided_list and blocked."""
    known = histories(entries, changes)
    depth = F.when(F.col("pattern").rlike("/$"), 0).otherwise(F.regexp_count("pattern", F.lit("/")))
    depths = sorted(r["depth"] for r in known.filter("kind = 'prefix'").select(depth.cast("int").alias("depth")).distinct().collect())
    own = [F.col(f"`{c}`") for c in captures.columns if c not in ADDED]
    rows = captures.select(F.struct(*own).alias("row"), host_of(url).alias("host"), F.col(url).alias("url"), F.col(fetched).alias("at"))
    asked = rows.select("url", "at", "host").filter("host <> '' and at is not null").distinct()
    keys = asked.select("url", "at", F.explode(questions(F.col("host"), path_of("url"), depths)).alias("q")).select("url", "at", "q.kind", "q.pattern")
    met = keys.join(known, ["kind", "pattern"]).filter("since <= at and (until is null or at < until)")
    found = met.select("url", "at", "kind", "pattern", "list", F.get("states", as_of(F.col("times"), F.col("at"), changes)).alias("state")).filter("state.active")
    rank = F.struct(F.length("pattern").alias("n"), (F.col("kind") == "prefix").alias("p"), F.col("state.allow").alias("allow"), F.col("list").alias("list"), F.col("pattern").alias("pattern"))
    best = found.groupBy("url", "at").agg(F.count("*").alias("n_active"), F.max(rank).alias("r"))
    best = best.select("url", "at", "n_active", F.col("r.pattern").alias("decided_by"), F.col("r.list").alias("decided_list"), (~F.col("r.allow")).alias("blocked"))
    return rows.join(best, ["url", "at"], "left").select("row.*", "host", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "decided_by", "decided_list", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries drawn from the hosts and folders of all pages: what a list maintainer's history looks like.

    Each host is added to a block list, removed and added again at dates from its digest; each host's first folders
    are on an allow list for some time; two thirds of the parent domains are blocked from some day on.
    """
    parts = pages.select(host_of("url").alias("host"), F.regexp_extract(path_of("url"), r"^/([^/]+)", 1).alias("folder")).filter("host <> ''").distinct()

    def entry(df, name, allow, kind, pattern, action, salt, first, span):
        day = F.conv(F.substring(F.md5(F.concat(pattern, F.lit(salt)).cast("binary")), 1, 6), 16, 10).cast("int") % span + first
        return df.select(F.lit(name).alias("list"), F.lit(allow).alias("allow"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp")).alias("dated"))

    hosts = parts.select("host").distinct()
    host, folder = F.col("host"), F.concat_ws("/", "host", "folder")
    parent = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    parents = hosts.filter(F.size(F.split(host, r"\.")) >= 2).select(parent.alias("host")).distinct()
    parents = parents.filter(F.conv(F.substring(F.md5(host.cast("binary")), 1, 4), 16, 10).cast("int") % 3 > 0)
    folders = parts.filter("folder <> ''")
    out = [entry(hosts, "hosts", False, "domain", host, a, s, f, 200) for a, s, f in (("add", "a", 0), ("remove", "b", 150), ("add", "c", 400))]
    out += [entry(folders, "folders", True, "prefix", folder, a, s, f, 300) for a, s, f in (("add", "d", 0), ("remove", "e", 300))]
    out.append(entry(parents, "parents", False, "domain", host, "add", "f", 0, 600))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each page, fetched at a time that follows from its number, against the lists of that time."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.timestamp_add("SECOND", (F.col("page_id") * 7919 % 63072000).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    found = filter_urls(pages.withColumn("fetched_at", fetched), sample_entries(pages))
    return found.select("page_id", "host", "n_active", "decided_by", "decided_list", "blocked")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
    TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % 63072000) AS t
  FROM pages
), part AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS folder FROM p WHERE host <> ''),
hosts AS (SELECT DISTINCT host FROM part),
parents AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS host FROM hosts WHERE len(string_split(host, '.')) >= 2),
named AS (
  SELECT 'hosts' AS list, false AS allow, 'domain' AS kind, host AS pattern, s.action, s.salt, s.first, 200 AS span
  FROM hosts, (VALUES ('add', 'a', 0), ('remove', 'b', 150), ('add', 'c', 400)) AS s(action, salt, first)
  UNION ALL
  SELECT 'folders', true, 'prefix', host || '/' || folder, s.action, s.salt, s.first, 300
  FROM part, (VALUES ('add', 'd', 0), ('remove', 'e', 300)) AS s(action, salt, first) WHERE folder <> ''
  UNION ALL
  SELECT 'parents', false, 'domain', host, 'add', 'f', 0, 600 FROM parents WHERE ('0x' || md5(host)[1:4])::INT % 3 > 0
), entries AS (
  SELECT *, TIMESTAMP '2024-01-01' + to_days((('0x' || md5(pattern || salt)[1:6])::INT % span + first)::INT) AS dated FROM named
), change AS (
  SELECT list, kind, pattern, dated, bool_or(allow) AS allow, NOT bool_or(action = 'remove') AS active FROM entries GROUP BY ALL
), valid AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, kind, pattern ORDER BY dated) AS until FROM change
), asked AS (
  SELECT page_id, t, 'domain' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
  UNION
  SELECT page_id, t, 'prefix', host || '/' || array_to_string(segs[1:i], '/')
  FROM (SELECT *, unnest(range(0, len(segs) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM p WHERE host <> ''))
), best AS (
  SELECT page_id, count(*) AS n_active, max(struct_pack(n := length(pattern), p := kind = 'prefix', allow := allow, list := list, pattern := pattern)) AS r
  FROM asked JOIN valid USING (kind, pattern) WHERE active AND dated <= t AND (until IS NULL OR t < until) GROUP BY page_id
)
SELECT page_id, host, coalesce(n_active, 0) AS n_active, r.pattern AS decided_by, r.list AS decided_list, coalesce(NOT r.allow, false) AS blocked
FROM p LEFT JOIN best USING (page_id)
"""

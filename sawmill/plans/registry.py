"""Registered queries of the log engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import discover, mining, search, stats, timechart
from ..operators.aliases import Aliases, table, values
from ..operators.fields import ColumnFields
from ..sources import lines as source
from ..sources.store import Catalog, expired, scratch
from ..streaming import ingest
from . import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ColumnFields]:
    lines = source.events_view(_read(spark, sf_dir, "events"))
    return lines, ColumnFields(["event_type", "user_id", "value", "event_id"])


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# The events table as lines, in DuckDB.
LINES = """(SELECT *, concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type, 'user=' || user_id, 'props=' || props) AS raw, epoch_us(ts) // 1000 AS ms FROM events)"""
_DELIM = "[ \\t:=,]+"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, fields = _events(spark, sf_dir)
    return engine.query(lines, "user | stats count by event_type", fields)


# ------------------------------------------------------------------------------- search


def _docs(query: str, sql: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = source.table_view(_read(spark, sf_dir, "documents"), "text", "doc_id")
        return search.matching(lines, query).select("doc_id", "lang")

    _query(name, f"SELECT doc_id, lang FROM documents WHERE {sql}")(run)


_docs("License", "contains(text, 'License')", "search_term")
_docs("GNU*License", "regexp_matches(text, '(?s)GNU.*License')", "search_wildcard")
_docs("Lic*un*BY", "regexp_matches(text, '(?s)Lic.*un.*BY')", "search_wildcard_three_parts")
_docs('"under the Apache"', f"regexp_matches(text, 'under{_DELIM}the{_DELIM}Apache')", "search_phrase")
_docs("Licensed under", "contains(text, 'Licensed') AND contains(text, 'under')", "search_implicit_and")
_docs("License AND Version", "contains(text, 'License') AND contains(text, 'Version')", "search_and")
_docs("MIT OR Apache", "contains(text, 'MIT') OR contains(text, 'Apache')", "search_or")
_docs("License AND NOT Apache", "contains(text, 'License') AND NOT contains(text, 'Apache')", "search_not")
_docs("License not Apache", "contains(text, 'License') AND NOT contains(text, 'Apache')", "search_inline_not")
_docs("( MIT or Apache ) and not ( Released or Version )", "(contains(text, 'MIT') OR contains(text, 'Apache')) AND NOT (contains(text, 'Released') OR contains(text, 'Version'))", "search_parentheses")
_docs("password=*5", "contains(text, 'password') AND contains(text, '=') AND contains(text, '5')", "search_delimiter_and")
_docs("/[0-9]{3}-[0-9]{4}/", "regexp_matches(text, '[0-9]{3}-[0-9]{4}')", "search_regex")


@_query("search_pages_url", "SELECT page_id, url FROM pages WHERE contains(url || ' ' || html, 'https') AND contains(url || ' ' || html, 'href')")
def search_pages_url(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return search.matching(pages.withColumn("raw", F.concat_ws(" ", "url", "html")), "https AND href").select("page_id", "url")


@_query("search_limit", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'License') ORDER BY doc_id LIMIT 20")
def search_limit(spark, sf_dir):
    lines = source.table_view(_read(spark, sf_dir, "documents"), "text", "doc_id")
    return search.search(lines, "License", 20).select("doc_id", "n_chars")


@_query("search_cli_limit", "SELECT doc_id FROM documents WHERE contains(text, 'e') ORDER BY doc_id LIMIT 200")
def search_cli_limit(spark, sf_dir):
    lines = source.table_view(_read(spark, sf_dir, "documents"), "text", "doc_id")
    return search.search(lines, "e", search.CLI_LIMIT).select("doc_id")


@_query("search_records", "SELECT text AS log_line, -1::INT AS template_id, 'OUTLIER' AS template, doc_id AS line_number FROM documents WHERE contains(text, 'Apache')")
def search_records(spark, sf_dir):
    lines = source.table_view(_read(spark, sf_dir, "documents"), "text", "doc_id")
    return search.records(search.search(lines, "Apache", None))


@_query("search_time_range", f"SELECT event_id, event_type FROM {LINES} WHERE contains(raw, 'click') AND ms BETWEEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-06 12:00:00')")
def search_time_range(spark, sf_dir):
    lines, fields = _events(spark, sf_dir)
    return search.matching(lines, 'click -time "2024-01-05 00:00:00" "2024-01-06 12:00:00"', fields).select("event_id", "event_type")


@_query("search_conversations", "SELECT role, count(*) AS n FROM conversations WHERE contains(text, 'the') GROUP BY role")
def search_conversations(spark, sf_dir):
    lines = source.table_view(_read(spark, sf_dir, "conversations"), "text", "conv_id")
    return search.matching(lines, "the").groupBy("role").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------ field filters


def _event_filter(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, fields = _events(spark, sf_dir)
        return search.matching(lines, text, fields).select("event_id", "user_id")

    _query(name, f"SELECT event_id, user_id FROM {LINES} WHERE {sql}")(run)


_event_filter("filter_field_contains", "event_type:ick", "contains(event_type, 'ick')")
_event_filter("filter_field_strict", "event_type:view |strict", "contains(event_type, 'view')")
_event_filter("filter_numeric_equal", "user_id:==7", "user_id = 7")
_event_filter("filter_numeric_not_equal", "user_id:!=7", "user_id <> 7")
_event_filter("filter_numeric_greater", "user_id:>100", "user_id > 100")
_event_filter("filter_numeric_at_least", "user_id:>=100", "user_id >= 100")
_event_filter("filter_numeric_less", "user_id:<5", "user_id < 5")
_event_filter("filter_numeric_at_most", "user_id:<=5", "user_id <= 5")
_event_filter("filter_numeric_range", "user_id:10..20", "user_id BETWEEN 10 AND 20")
_event_filter("filter_mixed", "( user_id:10..20 or user_id:>140 ) and not event_type:click", "(user_id BETWEEN 10 AND 20 OR user_id > 140) AND NOT contains(event_type, 'click')")


# ----------------------------------------------------------------------------- analytics


def _piped(name: str, text: str, sql: str | None, round_value: bool = False, exact: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, fields = _events(spark, sf_dir)
        out = engine.query(lines, text, fields, exact_distinct=exact)
        return out.withColumn("value", F.round(F.col("value"), 4)) if round_value else out

    _query(name, sql)(run)


_CLICK = f"FROM {LINES} WHERE contains(raw, 'click')"
_piped("stats_count", "click | stats count", f"SELECT count(*) AS count {_CLICK}")
_piped("stats_count_all", "| stats count()", "SELECT count(*) AS count FROM events")
_piped("stats_count_unpiped", "stats count by event_type", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
_piped("stats_count_by", "user | stats count by event_type", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
_piped("stats_count_by_user", "click | stats count() by user_id", f"SELECT user_id::VARCHAR AS key, count(*) AS value {_CLICK} GROUP BY user_id")
for _f in ("sum", "avg", "min", "max"):
    _piped(f"stats_{_f}", f"click | stats {_f}(value)", f"SELECT '{_f}' AS op, 'value' AS field, round({_f}(value), 4) AS value {_CLICK}", True)
    _piped(f"stats_{_f}_by", f"| stats {_f}(value) by event_type", f"SELECT event_type AS key, round({_f}(value), 4) AS value FROM events GROUP BY event_type", True)
    _piped(f"by_{_f}", f"click | by(user_id) {_f}(value)", f"SELECT user_id::VARCHAR AS key, round({_f}(value), 4) AS value {_CLICK} GROUP BY user_id", True)
_piped("by_count", "| by(event_type) count()", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
_piped("stats_distinct_by", "| stats distinct(user_id) by event_type", "SELECT event_type AS key, count(DISTINCT user_id) AS value FROM events GROUP BY event_type")
_piped("by_distinct", "| by(event_type) distinct(user_id)", "SELECT event_type AS key, count(DISTINCT user_id) AS value FROM events GROUP BY event_type")
_piped("distinct_exact", "click | distinct(user_id)", f"SELECT 'distinct' AS op, 'user_id' AS field, count(DISTINCT user_id) AS value {_CLICK}", exact=True)


@_query("distinct_sketch", f"SELECT 'distinct' AS op, 'user_id' AS field, count(DISTINCT user_id) AS exact, true AS close {_CLICK}")
def distinct_sketch(spark, sf_dir):
    """The sketch's estimate beside the exact count: at most 5 % apart."""
    lines, fields = _events(spark, sf_dir)
    guess, exact = (engine.query(lines, "click | stats distinct(user_id)", fields, exact_distinct=e).withColumnRenamed("value", n) for e, n in ((False, "guess"), (True, "exact")))
    return guess.join(exact, ["op", "field"]).select("op", "field", "exact", (F.abs(F.col("guess") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))).alias("close"))


_piped("top_k", "| top 3 event_type", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, value LIMIT 3")
_piped("top_call", "click | top(user_id,20)", f"SELECT user_id::VARCHAR AS value, count(*) AS count {_CLICK} GROUP BY user_id ORDER BY count DESC, value LIMIT 20")
_piped("top_default", "| top(user_id)", "SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, value LIMIT 10")


@_query("distinct_sketch_merge", "SELECT count(DISTINCT user_id) AS exact, true AS close FROM events")
def distinct_sketch_merge(spark, sf_dir):
    """Sketches of each event type merged, beside the exact count."""
    lines, fields = _events(spark, sf_dir)
    merged = stats.merged(stats.sketch(lines, fields, "user_id", "event_type"))
    exact = lines.agg(F.countDistinct("user_id").alias("exact"))
    return merged.join(exact).select("exact", (F.abs(F.col("value") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))).alias("close"))


# --------------------------------------------------------------------- library statistics


def _statistic(name: str, run, sql: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, fields = _events(spark, sf_dir)
        out = run(lines, fields)
        return out.withColumn("value", F.round("value", 4)) if dict(out.dtypes).get("value") == "double" else out

    _query(name, sql)(build)


_statistic("library_average", lambda d, f: stats.average(d, f, "value"), "SELECT round(avg(value), 4) AS value FROM events")
_statistic("library_median", lambda d, f: stats.median(d, f, "value"), "SELECT round(median(value), 4) AS value FROM events")
_statistic("library_stddev", lambda d, f: stats.stddev(d, f, "value"), "SELECT round(stddev_pop(value), 4) AS value FROM events")
for _p in (0, 50, 95, 100):
    _statistic(f"library_percentile_{_p}", lambda d, f, p=_p: stats.percentile(d, f, "value", p), f"SELECT round(list_sort(list(value))[({_p} * (count(*) - 1) // 100) + 1], 4) AS value FROM events")
_statistic("library_grouped_average", lambda d, f: stats.grouped_average(d, f, "value", "event_type"), "SELECT event_type AS key, round(avg(value), 4) AS value FROM events GROUP BY event_type")
_statistic("library_frequencies", lambda d, f: stats.frequencies(d, f, "user_id"), "SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY user_id")
_statistic("library_distinct_exact", lambda d, f: stats.scalar(d, f, "distinct", "event_type", exact=True).select("value"), "SELECT count(DISTINCT event_type) AS value FROM events")


@_query("numeric_lenient", "SELECT p_partkey, coalesce(try_cast(trim(regexp_extract(p_name, '[0-9]+')) AS DOUBLE), 0) AS n FROM part")
def numeric_lenient(spark, sf_dir):
    digits = F.regexp_extract("p_name", "[0-9]+", 0)
    return _read(spark, sf_dir, "part").select("p_partkey", numeric.lenient(digits).alias("n"))


# ----------------------------------------------------------------------------- timechart


def _chart(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, fields = _events(spark, sf_dir)
        return engine.query(lines, text, fields)

    _query(name, sql)(run)


_chart("timechart_span", "click | timechart span=1h count", f"SELECT ms - ms % 3600000 AS ts, count(*) AS count {_CLICK} GROUP BY ms - ms % 3600000")
_chart("timechart_span_by", "| timechart span=1d count() by event_type", f"SELECT event_type AS key, ms - ms % 86400000 AS ts, count(*) AS count FROM {LINES} GROUP BY event_type, ms - ms % 86400000")
_BINS = """WITH l AS (SELECT * FROM {lines} WHERE {where}), r AS (SELECT {lo} AS lo, {hi} AS hi, greatest(1, ({hi} - {lo}) // {bins}) AS w FROM l),
b AS (SELECT {key} least((ms - lo) // w, {bins} - 1) AS bin, count(*) AS n FROM l, r WHERE ms BETWEEN lo AND hi GROUP BY ALL),
g AS (SELECT {keys} lo + i * w AS ts, i FROM r, range({bins}) t(i) {cross})
SELECT {gkey} ts, coalesce(n, 0) AS count FROM g LEFT JOIN b ON g.i = b.bin {on}"""


def _bins(where: str, bins: int, lo: str = "min(ms)", hi: str = "max(ms)", group: str = "") -> str:
    return _BINS.format(
        lines=LINES, where=where, bins=bins, lo=lo, hi=hi, key=f"{group} AS key," if group else "", keys="key," if group else "",
        cross=", (SELECT DISTINCT key FROM b)" if group else "", gkey="g.key AS key," if group else "", on="AND g.key = b.key" if group else "",
    )


_chart("timechart_bins", "click | timechart bins=7 count", _bins("contains(raw, 'click')", 7))
_chart("timechart_bins_default", "| timechart count", _bins("true", 60))
_chart("timechart_bins_range", "| timechart bins=5 start=1704499200000 end=1704931200000", _bins("true", 5, "min(1704499200000)", "max(1704931200000)"))
_chart("timechart_bins_by", "| timechart bins=6 count by event_type", _bins("true", 6, group="event_type"))


@_query("timechart_nested", f"SELECT key, '[' || string_agg('{{\"ts\":' || ts || ',\"count\":' || n || '}}', ',' ORDER BY ts) || ']' AS points FROM (SELECT event_type AS key, ms - ms % 86400000 AS ts, count(*) AS n FROM {LINES} GROUP BY ALL) GROUP BY key")
def timechart_nested(spark, sf_dir):
    """Points of each group as JSON."""
    lines, fields = _events(spark, sf_dir)
    return timechart.nested(timechart.by_span(lines, 86_400_000, fields, "event_type")).select("key", F.to_json("points").alias("points"))


@_query("timechart_orders", "SELECT (epoch_us(o_orderdate) // 1000) - (epoch_us(o_orderdate) // 1000) % 2592000000 AS ts, count(*) AS count FROM orders GROUP BY ALL")
def timechart_orders(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("ts_ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return timechart.by_span(orders, 30 * 86_400_000)


@_query("timechart_window", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000 AS ts, event_type AS key, count(*) AS count FROM events GROUP BY ALL")
def timechart_window(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.live_timechart(events, "1 hour", "10 minutes", "event_type")


# ------------------------------------------------------ templates, aliases, store, ingest


def _mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mining.Template]]:
    lines, _ = _events(spark, sf_dir)
    lines = lines.select("raw", "ts_ms", "line_no", "segment_id", "event_type")
    templates = mining.mine(lines)
    return mining.match(lines, templates), templates


@_query("mining_rebuild", f"SELECT event_id AS line_no, raw, raw AS rebuilt FROM {LINES}")
def mining_rebuild(spark, sf_dir):
    matched, templates = _mined(spark, sf_dir)
    return mining.rebuild(matched, mining.texts(spark, templates)).select("line_no", "raw", "rebuilt")


@_query("mining_coverage", "SELECT count(*) AS lines, count(*) AS matched FROM events")
def mining_coverage(spark, sf_dir):
    """Lines, and those that fit a template: all of them, since event lines are of one make."""
    matched, _ = _mined(spark, sf_dir)
    return matched.agg(F.count("*").alias("lines"), F.count_if(F.col("template_id") != -1).alias("matched"))


@_query("mining_catalog", "SELECT 'events' AS segment_id, count(*) AS lines, true AS apart, true AS told FROM events")
def mining_catalog(spark, sf_dir):
    """Counts of all templates together; ids apart from each other, and constants that tell what the lines say."""
    matched, templates = _mined(spark, sf_dir)
    rows = mining.catalog(matched, templates)
    return rows.groupBy("segment_id").agg(F.sum("count").alias("lines"), (F.countDistinct("template_id") == F.count("*")).alias("apart"), F.bool_and(F.col("content").contains("user=") & F.col("content").contains("props=")).alias("told"))


@_query("mining_profile", "SELECT max(length(user_id::VARCHAR)) AS max_length, 1 AS classes, count(*) AS rows FROM events")
def mining_profile(spark, sf_dir):
    """The column of the variable behind ``user=``: its longest value, its classes (digits only), its rows."""
    matched, templates = _mined(spark, sf_dir)
    users = spark.createDataFrame(_variables_behind(templates, "user"), "template_id int, var_idx int")
    return mining.profile(matched).join(users, ["template_id", "var_idx"]).agg(F.max("max_length").cast("int").alias("max_length"), F.bit_or("classes").alias("classes"), F.sum("rows").alias("rows"))


def _variables_behind(templates: list[mining.Template], name: str) -> list[tuple[int, int]]:
    """Every template's variable behind ``name=``."""
    out = []
    for t, i in mining.numbered(templates).items():
        for k, token in enumerate(t.tokens):
            if token is None and k >= 2 and t.tokens[k - 1] == "=" and t.tokens[k - 2] == name:
                out.append((i, sum(x is None for x in t.tokens[:k])))
    return out


_USERS = "SELECT '{}' AS alias, user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY user_id"


@_query("alias_count_by", _USERS.format("user"))
def alias_count_by(spark, sf_dir):
    """Every template's variable behind ``user=`` under one alias, joined by template and counted."""
    matched, templates = _mined(spark, sf_dir)
    aliases = Aliases({"user": _variables_behind(templates, "user")})
    return values(matched, table(spark, {"index:events": aliases})).groupBy("alias", "value").agg(F.count("*").alias("n"))


@_query("alias_discovery", _USERS.format("username"))
def alias_discovery(spark, sf_dir):
    """What discovery calls ``username``, counted by value: the variable behind ``user=`` by its neighbour (and words, which look like names)."""
    matched, templates = _mined(spark, sf_dir)
    found = values(matched, table(spark, {"index:events": discover.discover(matched, templates)}))
    return found.where("alias = 'username' and value rlike '^[0-9]+$'").groupBy("alias", "value").agg(F.count("*").alias("n"))


@_query("alias_file", "SELECT * FROM (VALUES ('index:i', 'host', 6, 4), ('index:i', 'port', 7, 5), ('index:i', 'user', 7, 4), ('index:i', 'old', 9, 2)) t(scope, alias, template_id, var_idx)")
def alias_file(spark, sf_dir):
    """An alias file read, changed (a variable moves), written, and read again."""
    held = Aliases.parse("# names\nhost: E7_V4, E6_V4.VAR\nport: 7_5\nE9_V2=old\n")
    held.add("user", (7, 4))
    return table(spark, {"index:i": Aliases.parse(held.dump())})


@_query("join_lookup", "SELECT n.n_name AS key, count(*) AS value FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def join_lookup(spark, sf_dir):
    """A dimension joined by key, then grouped; Spark broadcasts the dimension by its size."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.grouped(lines, ColumnFields(["n_name"]), "count", None, "n_name")


@_query(
    "store_retention",
    """WITH s AS (SELECT l_suppkey::VARCHAR AS segment_id, count(*) AS records, sum(l_quantity)::BIGINT AS bytes, max(epoch_us(l_shipdate) // 1000) AS end_ms FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, row_number() OVER (ORDER BY end_ms DESC, segment_id DESC) AS place, sum(bytes) OVER (ORDER BY end_ms DESC, segment_id DESC) AS held FROM s)
SELECT segment_id, records FROM r WHERE place > 30 OR held > 300000""",
)
def store_retention(spark, sf_dir):
    """Suppliers stand in for segments."""
    segments = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("segment_id")).agg(
        F.count("*").alias("records"), F.sum("l_quantity").cast("long").alias("bytes"), F.max(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("end_ms")
    )
    return expired(segments.withColumn("index", F.lit("lineitem")), 30, 300_000).select("segment_id", "records")


@_query("ingest_clean", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) > 0 GROUP BY doc_id")
def ingest_clean(spark, sf_dir):
    bodies = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return source.from_bodies(bodies).groupBy("doc_id").agg(F.count("*").alias("lines"))


# The same lines with their times in seconds, as they are read from the text.
SECONDS = f"(SELECT *, ms - ms % 1000 AS s FROM {LINES})"


def _index(spark: SparkSession, sf_dir: str, parts: int = 1, **options: str) -> Catalog:
    """A new index ``events`` in the shared folder, of one or more segments by user."""
    catalog = Catalog(spark, scratch(spark))
    catalog.create("events", **options)
    lines, _ = _events(spark, sf_dir)
    for k in range(parts):
        ingest.bulk(catalog, "events", lines.where(F.col("user_id") % parts == k), f"seg_{k}")
    return catalog


@_query("segment_metadata", f"SELECT 'seg_' || (user_id % 2) AS segment_id, count(*) AS records, sum(strlen(raw) + 1)::BIGINT AS bytes, min(s) AS start_ms, max(s) AS end_ms, true AS ok FROM {SECONDS} GROUP BY ALL")
def segment_metadata(spark, sf_dir):
    """What the store noted of two segments, and whether their lines still give the noted checksums."""
    catalog = _index(spark, sf_dir, 2)
    return catalog.segments("events").join(catalog.verify("events"), "segment_id").select("segment_id", "records", "bytes", "start_ms", "end_ms", "ok")


@_query("store_replay", "SELECT count(*) AS lines, 1::BIGINT AS segments FROM events")
def store_replay(spark, sf_dir):
    """A segment that is written twice is there once."""
    catalog = _index(spark, sf_dir)
    lines, _ = _events(spark, sf_dir)
    catalog.write_segment("events", lines.select("raw"), "seg_0")
    return catalog.lines("events").agg(F.count("*").alias("lines"), F.countDistinct("segment_id").alias("segments"))


@_query("store_stats", f"SELECT 'events' AS index, 2::BIGINT AS segments, sum(strlen(raw) + 1)::BIGINT AS bytes, count(*) AS records FROM {LINES}")
def store_stats(spark, sf_dir):
    return _index(spark, sf_dir, 2).stats()


@_query("store_config", "SELECT 'events' AS index, 65536::BIGINT AS flush_bytes, 700::BIGINT AS flush_records, 9::BIGINT AS max_segments, 1048576::BIGINT AS max_disk_bytes")
def store_config(spark, sf_dir):
    """An index created, changed, and another one created and deleted; sizes with units."""
    catalog = Catalog(spark, scratch(spark))
    catalog.create("events", FLUSH_BYTES="64k", max_segments="5", flush_records="700")
    catalog.create("events", max_segments="9", max_disk_bytes="1m")
    catalog.create("other")
    catalog.delete("other")
    return catalog.indices().select("index", "flush_bytes", "flush_records", "max_segments", "max_disk_bytes")


@_query("store_dropped", "SELECT 'seg_' || (user_id % 3) AS segment_id, count(*) AS lines FROM events WHERE user_id % 3 > 0 GROUP BY ALL")
def store_dropped(spark, sf_dir):
    """Three segments whose index holds two: the one that ended first is out of every query (here its lines are a year older)."""
    catalog = Catalog(spark, scratch(spark))
    catalog.create("events", max_segments="2")
    lines, _ = _events(spark, sf_dir)
    for k in (1, 0, 2):
        part = lines.where(F.col("user_id") % 3 == k)
        ingest.bulk(catalog, "events", part.withColumn("raw", F.regexp_replace("raw", "^2024", "2023")) if k == 0 else part, f"seg_{k}")
    return catalog.lines("events").groupBy("segment_id").agg(F.count("*").alias("lines"))


@_query("store_export", f"SELECT 'seg_' || (user_id % 2) AS segment_id, raw AS value FROM {LINES}")
def store_export(spark, sf_dir):
    """All lines back as text, by segment."""
    catalog, out = _index(spark, sf_dir, 2), scratch(spark)
    catalog.export("events", out)
    return spark.read.text(out).select("segment_id", "value")


@_query("store_search", f"SELECT raw AS log_line, true AS told FROM {LINES} WHERE contains(raw, 'click') AND s BETWEEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-06 00:00:00')".replace(LINES, SECONDS))
def store_search(spark, sf_dir):
    """Records of a stored index with the text of their template."""
    found = engine.Engine(_index(spark, sf_dir)).query("events", 'click -time "2024-01-05 00:00:00" "2024-01-06 00:00:00"', None)
    return found.select("log_line", F.col("template").contains("user=").alias("told"))


@_query("store_timechart", f"SELECT s - s % 86400000 AS ts, count(*) AS count FROM {SECONDS} WHERE contains(raw, 'view') GROUP BY ALL")
def store_timechart(spark, sf_dir):
    return engine.Engine(_index(spark, sf_dir, 2)).query("events", "view | timechart span=1d count")


def _aliased(spark: SparkSession, sf_dir: str) -> engine.Engine:
    """An index whose alias ``user`` names the variable behind ``user=``, and the second of two segments' own alias ``user`` too."""
    catalog = _index(spark, sf_dir, 2)
    for segment in (None, "seg_1"):
        rows = catalog.templates("events").where(F.col("segment_id") == (segment or "seg_0")).collect()
        held = Aliases()
        for r in rows:
            for k, x in enumerate(r.segs):
                if x.kind == "var" and k >= 2 and r.segs[k - 1].text == "=" and r.segs[k - 2].text == "user":
                    held.add("user", (r.template_id, x.var))
        catalog.set_aliases("events", held, segment)
    return engine.Engine(catalog)


@_query("alias_filter", f"SELECT raw AS log_line FROM {LINES} WHERE contains(user_id::VARCHAR, '14')")
def alias_filter(spark, sf_dir):
    """A value within an alias's variables; a segment's own aliases count for it."""
    return _aliased(spark, sf_dir).query("events", "user:14 |strict", None).select("log_line")


@_query("alias_fallback", f"SELECT raw AS log_line FROM {LINES} WHERE contains(raw, '2024-01-07')")
def alias_fallback(spark, sf_dir):
    """No variable of the alias holds the value anywhere, so that any line that holds it counts."""
    return _aliased(spark, sf_dir).query("events", "user:2024-01-07", None).select("log_line")


@_query("alias_fallback_ci", f"SELECT raw AS log_line FROM {LINES} WHERE contains(lower(raw), 'view')")
def alias_fallback_ci(spark, sf_dir):
    """The same whatever the case: a value of the alias keeps its case, the fallback does not."""
    return _aliased(spark, sf_dir).query("events", "user:VIEW |ci", None).select("log_line")


@_query("alias_top", "SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, value LIMIT 12")
def alias_top(spark, sf_dir):
    return _aliased(spark, sf_dir).query("events", "| top 12 user")


@_query("variable_values", "SELECT user_id::VARCHAR AS value, count(*) AS n FROM events WHERE regexp_matches(user_id::VARCHAR, '1.*2') GROUP BY user_id")
def variable_values(spark, sf_dir):
    """A search within the columns of the variables behind ``user=``."""
    matched, templates = _mined(spark, sf_dir)
    found = [mining.select_values(matched, t, v, "1*2") for t, v in _variables_behind(templates, "user")]
    return reduce(DataFrame.union, found).groupBy("value").agg(F.count("*").alias("n"))


@_query("ingest_stream", f"SELECT event_type, count(*) AS lines FROM {LINES} GROUP BY event_type")
def ingest_stream(spark, sf_dir):
    """Text files taken as a stream into segments of at most 3,000 lines, until none is left."""
    lines, _ = _events(spark, sf_dir)
    root = scratch(spark)
    lines.select("raw").repartition(3).write.text(f"{root}/in")
    catalog = Catalog(spark, f"{root}/index")
    catalog.create("events", flush_records="3000", max_pending="2")
    ingest.start(catalog, "events", ingest.stream(catalog, "events", f"{root}/in"), f"{root}/checkpoint", once=True).awaitTermination()
    return catalog.lines("events").groupBy(F.regexp_extract("raw", "^[^ ]+ [^ ]+ ([^ ]+)", 1).alias("event_type")).agg(F.count("*").alias("lines"))


@_query("time_parse", f"SELECT event_id, ms - ms % 1000 AS ts_ms FROM {LINES}")
def time_parse(spark, sf_dir):
    lines, _ = _events(spark, sf_dir)
    return source.with_time(lines.select("event_id", "raw")).select("event_id", "ts_ms")

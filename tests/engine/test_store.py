import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sawmill.operators import discover, mining
from sawmill.operators.aliases import Aliases, parse_var, resolve, table, values
from sawmill.plans.engine import Engine
from sawmill.sources import lines as source
from sawmill.sources.store import Catalog, IndexConfig, StoreError, expired
from sawmill.streaming import ingest


def log(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = f"2024-01-01 {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}"
        out.append(
            rng.choice(
                [
                    f"{t} sshd: Accepted password for user{rng.randrange(30)} from 10.0.{rng.randrange(9)}.{rng.randrange(200)} port {rng.randrange(1024, 60000)}",
                    f"{t} http: GET /a/{rng.randrange(99)} status={rng.choice([200, 404, 500])} bytes={rng.randrange(9999)}",
                    f"{t} disk: error on sd{rng.choice('abc')}, retry",
                ]
            )
        )
    return out


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(x, i, "s") for i, x in enumerate([*log(900), "", "odd one out 漢字", " :=, "])], "raw string, line_no long, segment_id string")


def test_mining_round_trip(lines):
    templates = mining.mine(lines)
    matched = mining.match(lines, templates)
    catalog = mining.catalog(matched, templates)
    rebuilt = mining.rebuild(matched, catalog).collect()
    assert len(rebuilt) == 903 and all(r.raw == r.rebuilt for r in rebuilt)
    assert sum(r.template_id == -1 for r in rebuilt) <= 5
    rows = catalog.collect()
    assert sum(r["count"] for r in rows) == sum(r.template_id != -1 for r in rebuilt)
    assert [r["count"] for r in rows] == sorted((r["count"] for r in rows), reverse=True)
    assert any("Accepted" in r.content and "<V" in r.content for r in rows)
    assert all(re.fullmatch(r"E\d+ \d+ .*", r.value) for r in mining.dump(catalog).collect())


def test_mining_clusters_the_whole_sample(spark):
    """The first 24,000 lines in order are of one day; those of later days fit a template all the same."""
    rows = [(f"2024-01-{1 + (i >= 24_000) + (i >= 27_000):02d} {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d} click user={i % 97} n={i}", i, "s") for i in range(30_000)]
    df = spark.createDataFrame(rows, "raw string, line_no long, segment_id string")
    templates = mining.mine(df, fraction=1.0)
    matched = mining.match(df, templates)
    assert matched.where("template_id = -1").count() == 0
    assert [t.tokens[0] for t in templates] == [None]
    assert mining.catalog(matched, templates).agg(F.sum("count")).first()[0] == 30_000


@pytest.mark.parametrize("per_length", [3, 20, 400])
def test_mining_in_chunks(lines, per_length):
    """However small the chunks, no line is left out, and templates of a statement come together again."""
    templates = mining.mine(lines, per_length=per_length)
    matched = mining.match(lines, templates)
    assert matched.where("template_id = -1 and raw <> ''").count() == 0
    assert len(templates) <= 20
    assert mining.rebuild(matched, mining.catalog(matched, templates)).where("raw <> rebuilt").count() == 0


def test_mining_ends_on_lines_that_have_nothing_in_common(spark):
    rows = [(f"{i}a {i}b", i, "s") for i in range(200)]
    df = spark.createDataFrame(rows, "raw string, line_no long, segment_id string")
    assert mining.match(df, mining.mine(df, per_length=10)).where("template_id = -1").count() == 0


def test_mining_of_nothing_and_of_one(spark):
    for rows in ([], [("one line", 1, "s")], [(None, 1, "s"), ("", 2, "s")]):
        df = spark.createDataFrame(rows, "raw string, line_no long, segment_id string")
        t = mining.mine(df)
        m = mining.match(df, t)
        assert m.count() == len(rows) and mining.rebuild(m, mining.catalog(m, t)).where("raw <> rebuilt").count() == 0


def test_segments_of_a_template():
    assert [(s["kind"], s["text"], s["var"]) for s in mining.segments(mining.Template(("a", "=", None, " ", "<V7>", ":", None)))] == [("const", "a", None), ("delim", "=", None), ("var", None, 0), ("delim", " ", None), ("const", "<V7>", None), ("delim", ":", None), ("var", None, 1)]


def test_profile(lines):
    m = mining.match(lines, mining.mine(lines))
    rows = mining.profile(m).collect()
    assert rows and {r.encoding for r in rows} <= {"plain", "dictionary", "pattern"} and all(r.classes > 0 for r in rows)


def test_alias_files():
    a = Aliases.parse("# c\nHost: E7_V4, E6_V4 # x\n9_2.3=port\nE1_V1.VAR=who\n\nbad line\nport: E9_V3\n")
    assert a.of == {"Host": [(7, 4), (6, 4)], "port": [(9, 2), (9, 3)], "who": [(1, 1)]}
    assert Aliases.parse(a.dump()).dump() == a.dump()
    a.add("other", (7, 4))
    assert a.get("HOST") == [(6, 4)] and a.alias_of((7, 4)) == "other" and a.warnings
    assert parse_var(str((5 << 16) | (3 << 8) | 2)) == (5, 3) and parse_var("x") is None
    scopes = {"index:i": a, "segment:s": Aliases({"z": [(1, 0)]})}
    assert resolve(scopes, "i", "s").of == {"z": [(1, 0)]} and resolve(scopes, "i", "t") is a


def test_discovery(lines, spark):
    templates = mining.mine(lines)
    matched = mining.match(lines, templates)
    meanings = {k for v in discover.suggest(matched, templates).values() for k in v}
    assert {"ip", "username", "port", "http_status"} & meanings >= {"ip", "username"}
    found = discover.discover(matched, templates)
    assert "ip" in found.of
    ips = values(matched, table(spark, {"index:x": Aliases({"ip": found.of["ip"]})})).select("value").collect()
    assert sum(bool(re.fullmatch(r"\d+\.\d+\.\d+\.\d+", r.value)) for r in ips) > 100
    cases = {
        "1.2.3.4": "ip", "256.1.1.1": None, "fe80::1": "ip", "::": None, "1:2:3:4:5:6:7:8": "ip", "00-1b-44-11-3a-b7": "mac", "a@b.cd": "email", "a@b@c.de": None, "http://x/y": "url",
        "123e4567-e89b-12d3-a456-426614174000": "uuid", "deadbeefdeadbeef00": "hash", "GET": "http_method", "404": "http_status", "999": "port", "/var/log": "path", "8080": "port",
        "12:30": "time", "12:30:01": "time", "2024-01-31": "time", "2024-13-31": None, "root": "username", "web-1.example": "hostname", "1.5": None, "": None, "99999": None,
    }
    df = spark.createDataFrame(list(cases.items()), "v string, k string")
    assert {r.v: r.c for r in df.select("v", discover.value_form(F.col("v")).alias("c")).collect()} == cases


def test_neighbours_name_a_variable():
    t = mining.Template(("login", " ", "user", "=", None, " ", "from", " ", "host", " ", None, " ", None))
    assert discover.neighbours(t) == {0: {"username": 1.0, "hostname": 0.2}, 1: {"hostname": 1.0}, 2: {"hostname": 0.2}}


def test_a_share_of_values_decides(spark):
    """Half of the values must be of a form; a name beside the variable outweighs a form that all have."""
    rows = [(7, 0, "10.0.0.%d" % i if i % 2 else "n/a") for i in range(40)] + [(7, 1, str(i)) for i in range(1, 60)]
    shares = {r.var_idx: r for r in discover.form_shares(spark.createDataFrame(rows, "template_id int, var_idx int, value string")).collect()}
    assert shares[0].ip > 0.9 and shares[1].port == 1.0 and shares[1].http_status == 0.0


def test_ids_of_one_hash_are_kept_apart(spark):
    def twins():
        seen = {}
        for i in range(10**6):
            t = mining.Template((f"w{i}", " ", None, " ", "end"))
            if t.id in seen:
                return seen[t.id], t
            seen[t.id] = t

    a, b = twins()
    ids = mining.numbered([b, a])
    assert a.id == b.id and len(set(ids.values())) == 2 and mining.numbered([a, b]) == ids
    df = spark.createDataFrame([(f"{t.tokens[0]} {k} end", k, "s") for k in range(20) for t in (a, b)], "raw string, line_no long, segment_id string")
    matched = mining.match(df, [a, b])
    rebuilt = mining.rebuild(matched, mining.catalog(matched, [a, b])).collect()
    assert len(rebuilt) == 40 and all(r.raw == r.rebuilt and r.template_id != -1 for r in rebuilt)
    full = {mining.Template((str(i),)) for i in range(70_000)}
    assert len(set(mining.numbered(list(full)).values())) == 70_000


def test_values_of_a_variable(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("v")
    ingest.bulk(catalog, "v", spark.createDataFrame([(f"user=u{i} did {i % 7}",) for i in range(60)], "raw string"), "one")
    (template,) = [r.template_id for r in catalog.templates("v").collect()]
    got = mining.select_values(catalog.lines("v"), template, 0, "u1*", "one")
    assert sorted(r.value for r in got.collect()) == sorted(f"u{i}" for i in range(60) if f"u{i}".startswith("u1"))
    catalog.dump_values("v", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "segment_id=one" / f"template_id={template}" / "var_idx=1")).count() == 60


def test_aliases_of_a_segment_come_first(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("v")
    for name in ("one", "two"):
        ingest.bulk(catalog, "v", spark.createDataFrame([(f"user=u{i} did d{i % 7}",) for i in range(60)], "raw string"), name)
    (template,) = {r.template_id for r in catalog.templates("v").collect()}
    catalog.set_aliases("v", Aliases({"who": [(template, 0)]}))
    catalog.set_aliases("v", Aliases({"who": [(template, 1)], "what": [(template, 0)]}), "two")
    engine = Engine(catalog)
    assert {r.value: r["count"] for r in engine.query("v", "user | top 100 who").collect()} == {f"u{i}": 1 for i in range(60)} | {f"d{i}": sum(k % 7 == i for k in range(60)) for i in range(7)}
    assert engine.query("v", "what:u5 |strict", None).count() == 11
    assert engine.query("v", "who:u5 |strict", None).count() == 11


def test_session_cache(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("v")
    ingest.bulk(catalog, "v", spark.createDataFrame([("a b",)], "raw string"), "one")
    engine = Engine(catalog, session_cache=2)
    assert [engine.query("v", "| stats count").first()["count"] for _ in range(2)] == [1, 1]
    assert (engine.counters["queries"], engine.counters["cached"]) == (2, 1) and engine.counters["plan_seconds"] > 0
    ingest.bulk(catalog, "v", spark.createDataFrame([("a c",)], "raw string"), "two")
    assert engine.query("v", "| stats count").first()["count"] == 2 and engine.counters["cached"] == 1


def test_replay_on_another_day(spark, tmp_path):
    """Lines without a time take that of their ingest; a batch that runs again after midnight is there once."""
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("v")
    df = spark.createDataFrame([(f"no time {i}",) for i in range(30)], "raw string")
    for day in (0, 1):
        catalog.write_segment("v", df, "one", F.lit(86_400_000 * (100 + day)))
    assert catalog.lines("v").count() == 30 and catalog.segments("v").count() == 1 and catalog.templates("v").count() == 1
    assert catalog.verify("v").where("ok").count() == 1
    assert catalog.write_segment("v", df.limit(0), "none") == {"segment": None, "records": 0}


def test_thresholds_cut_a_streaming_batch(spark, tmp_path):
    assert ingest.cuts(100, 5000, IndexConfig(flush_records=30, flush_bytes=0)) == 4
    assert ingest.cuts(100, 5000, IndexConfig(flush_records=0, flush_bytes=1000)) == 5
    assert ingest.cuts(0, 0, IndexConfig(flush_records=0, flush_bytes=0)) == 1
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.log").write_text("".join(f"line {k} {i}\n" for i in range(40)))
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("s", flush_records="25", max_pending="2")
    lines = ingest.stream(catalog, "s", str(tmp_path / "in"))
    ingest.start(catalog, "s", lines, str(tmp_path / "ck"), once=True).awaitTermination(200)
    assert catalog.lines("s").count() == 120
    names = sorted(r.segment_id for r in catalog.segments("s").collect())
    assert [n.split("_")[1][-1] for n in names] == ["0"] * 4 + ["1"] * 2  # two files, then one


def test_zstd_files(spark, tmp_path):
    import zstandard

    text = "".join(f"line {i} é\r\n" for i in range(25_000))
    (tmp_path / "a.log.zst").write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    (tmp_path / "b.log.zst").write_bytes(b"")
    got = source.read_text(spark, str(tmp_path / "*.zst")).collect()
    assert sorted(r.raw for r in got) == sorted(f"line {i} é" for i in range(25_000))


def test_clean_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b'one\r\n\n{"index":{}}\n  {"index": 1}\n{"other":1}\ntwo\n')
    assert sorted(r.raw for r in source.read_text(spark, str(tmp_path / "a.log")).collect()) == ["one", "two", '{"other":1}']
    bodies = spark.createDataFrame([(1, 'x\n\n{"index":1}\ny')], "id int, body string")
    assert [(r.id, r.raw) for r in source.from_bodies(bodies).collect()] == [(1, "x"), (1, "y")]


def test_config():
    c = IndexConfig.from_options({"FLUSH_BYTES": "64m", "max_segments": "3", "wal_fsync": "1"}, {"MAX_SEGMENTS": "5"})
    assert (c.flush_bytes, c.max_segments, c.wal_fsync, c.flush_records) == (64 << 20, 5, True, 50_000)


def test_store_and_queries(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    engine = Engine(catalog)
    with pytest.raises(StoreError, match="unknown index"):
        engine.query("web", "x")
    catalog.create("web", max_segments="2", flush_records="500")
    with pytest.raises(StoreError, match="no segment"):
        engine.query("web", "x")
    with pytest.raises(StoreError, match="missing index or q"):
        engine.query("web", "")
    metas = [ingest.bulk(catalog, "web", spark.createDataFrame([(x,) for x in log(300, k)], "raw string"), f"seg_{k}") for k in (1, 2)]
    assert [m["ingested"] for m in metas] == [300, 300]
    # the same segment again replaces itself
    ingest.bulk(catalog, "web", spark.createDataFrame([(x,) for x in log(300, 2)], "raw string"), "seg_2")
    assert engine.query("web", "| stats count").first()["count"] == 600
    want = sum("error" in x for k in (1, 2) for x in log(300, k))
    assert engine.query("web", "error | stats count").first()["count"] == want
    rows = engine.query("web", "error", None).collect()
    assert len(rows) == want and all(r.template for r in rows)
    assert catalog.verify("web").where("not ok or ok is null").count() == 0
    assert [(r["index"], r.segments, r.records) for r in catalog.stats().collect()] == [("web", 2, 600)]
    lines_ = catalog.lines("web")
    templates = [mining.Template(tuple(s.text if s.kind != "var" else None for s in r.segs)) for r in catalog.templates("web").collect()]
    catalog.set_aliases("web", discover.discover(lines_, templates))
    assert "ip" in catalog.aliases("web").of
    assert engine.query("web", "Accepted password | stats distinct(ip)").first().value > 10
    assert engine.query("web", "ip:10.0.3", None).count() == sum("10.0.3." in x for k in (1, 2) for x in log(300, k))
    # retention: the oldest of three goes
    later = [x.replace("2024-01-01", "2024-02-01") for x in log(100, 3)]
    ingest.bulk(catalog, "web", spark.createDataFrame([(x,) for x in later], "raw string"), "seg_3")
    kept = {r.segment_id for r in catalog.segments("web").collect()}
    assert len(kept) == 2 and "seg_3" in kept
    assert engine.query("web", "| stats count").first()["count"] == 400
    catalog.export("web", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 400
    assert catalog.health()["indices"] == 1 and catalog.metrics()["writers"] == 0
    assert catalog.indices().first().max_segments == 2
    catalog.delete("web")
    assert catalog.indices().count() == 0 and os.path.exists(tmp_path / "root" / "web")


def test_expired(spark):
    df = spark.createDataFrame([("i", f"s{k}", 10, k) for k in range(6)], "index string, segment_id string, bytes long, end_ms long")
    assert sorted(r.segment_id for r in expired(df, 4, 0).collect()) == ["s0", "s1"]
    assert sorted(r.segment_id for r in expired(df, 0, 35).collect()) == ["s0", "s1", "s2"]
    assert expired(df, 0, 0).count() == 0


def test_stream_like_batch(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "root"
    src.mkdir()
    catalog = Catalog(spark, str(root))
    catalog.create("s")
    every = []
    for k in range(2):
        part = log(120, 10 + k)
        every += part
        (src / f"{k}.log").write_text("\n".join(part) + "\n")
        q = ingest.start(catalog, "s", source.stream_text(spark, str(src)), str(tmp_path / "ck"), once=True)
        q.awaitTermination(120)
    got = catalog.lines("s")
    assert sorted(r.raw for r in got.collect()) == sorted(every)
    assert catalog.segments("s").count() == 2
    assert catalog.verify("s").where("not ok").count() == 0


def test_live_timechart(spark, tmp_path):
    rows = [(i * 60, "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "s long, k string").select(F.timestamp_seconds("s").alias("ts"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.live_timechart(stream, "1 hour", "10 minutes", "k").writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, ingest.live_timechart(df, "1 hour", "10 minutes", "k").collect()))


def test_mining_reads_every_line(spark):
    """Statements that stand in one of 20,000 lines have their templates."""
    rows = [(f"click user={i % 97} n={i}" if i % 2_000 else f"rare{i} made of words number {'x ' * (i // 2_000)}", i, "s") for i in range(20_000)]
    df = spark.createDataFrame(rows, "raw string, line_no long, segment_id string")
    templates = mining.mine(df)
    assert mining.match(df, templates).where("template_id = -1").count() == 0 and len(templates) == 11


@pytest.mark.parametrize("held, in_all", [(1, 100), (3, 5), (500, 20_000)])
def test_what_a_task_holds_is_bounded(lines, held, in_all):
    """However few templates a task may hold, each line fits a row, and parts stay apart."""
    parted = lines.select((F.col("line_no") % 3).cast("int").alias("part"), "raw")
    rows = mining.gathered(parted, held=held, in_all=in_all).collect()
    for r in parted.where("raw <> ''").collect():
        assert any(x.part == r.part and mining.Fit(x.tokens)(mining.split(r.raw)) is not None for x in rows if x.n == len(mining.split(r.raw)))


def test_all_values_of_a_variable_are_judged(spark):
    rows = [(7, 0, str(i)) for i in range(300)] * 2
    assert discover.form_shares(spark.createDataFrame(rows, "template_id int, var_idx int, value string")).first().port == 299 / 300


def test_a_name_beside_a_variable_comes_before_bare_numbers(spark):
    """All values of ``user=`` are ports as well as numbers of users; the word beside them says what they are."""
    df = spark.createDataFrame([(f"did user={i} n={i}", i, "s") for i in range(1, 400)], "raw string, line_no long, segment_id string")
    templates = mining.mine(df)
    found = discover.discover(mining.match(df, templates), templates)
    assert [len(v) for k, v in found.of.items() if k == "username"] == [1]


def test_rebuilding_deals_no_lines_by_template(spark, lines, capsys):
    """One template may hold nearly all lines: the templates go to the lines."""
    templates = mining.mine(lines)
    matched = mining.match(lines, templates)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rebuilt = mining.rebuild(matched, mining.texts(spark, templates))
        assert rebuilt.where("raw <> rebuilt").count() == 0 and rebuilt.count() == 903
        mining.rebuild(matched, mining.catalog(matched, templates)).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_segments_of_a_batch_are_written_in_one_pass(spark, tmp_path):
    """Forty segments take no more jobs than one; none is beyond the threshold, each has its own templates, and no folder is left aside."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.log").write_text("".join(x + "\n" for x in log(330, k)))
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("s", flush_records="25")
    q = ingest.start(catalog, "s", ingest.stream(catalog, "s", str(tmp_path / "in")), str(tmp_path / "ck"), once=True)
    q.awaitTermination(200)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId))) < 40
    segments = catalog.segments("s").collect()
    assert len(segments) == 40 and max(r.records for r in segments) <= 25
    assert sorted(r.raw for r in catalog.lines("s").select("raw").collect()) == sorted(x for k in range(3) for x in log(330, k))
    assert catalog.verify("s").where("ok").count() == 40 and catalog.lines("s").where("template_id = -1").count() == 0
    told = {(r.segment_id, r.template_id): r["count"] for r in catalog.templates("s").collect()}
    assert told == {(r.segment_id, r.template_id): r["count"] for r in catalog.lines("s").groupBy("segment_id", "template_id").count().collect()}
    assert sorted(os.listdir(tmp_path / "root" / "s")) == ["lines", "segments", "templates"]


def test_lines_of_a_segment_are_not_one_tasks(spark, tmp_path, capsys):
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.create("v")
    ingest.bulk(catalog, "v", spark.createDataFrame([(x,) for x in log(50)], "raw string"), "one")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.lines("v").select("raw").explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "LeftSemi, BuildRight" in plan.replace("\n", " ") and "SortMergeJoin [segment_id#" not in plan.split("FileScan")[0]


def test_the_time_of_a_line_is_looked_for_once(spark, capsys):
    source.with_time(spark.range(1).selectExpr("cast(id as string) raw")).select("ts_ms").explain()
    assert capsys.readouterr().out.count("regexp_extract_all(") == 1

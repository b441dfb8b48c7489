import json
import os
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans import pipelines
from tidewire.sources import feeds, files, grams, keys, landed, logs
from tidewire.streaming import breaker, ingest, stories

NOW = lambda: F.lit("2026-06-24 12:00:00").cast("timestamp")
RSS = """<rss><channel><item><title><![CDATA[A & B]]></title><link>http://x/1</link><description>&lt;p&gt;Body <b>x</b></description><pubDate>Wed, 24 Jun 2026 09:15:00 GMT</pubDate><category>c1</category><category><![CDATA[c2]]></category><enclosure url="http://i/1.png" type="image/png"/></item>
<item><title>Second</title><guid>g2</guid></item></channel></rss>"""
ATOM = '<feed><entry><title>At</title><link rel="alternate" href="http://x/3"/><updated>2026-06-23T10:00:00Z</updated><summary>sum</summary></entry></feed>'


def registry(spark):
    rows = [("a", "A", "u", 1, "en", "media", None, None, None, None, True, None), ("b", "B", "u", 2, "en", "media", 48.0, "low", True, None, None, None)]
    return spark.createDataFrame(rows, feeds.REGISTRY)


def test_feeds(spark):
    df = spark.createDataFrame([("a", RSS), ("b", ATOM), ("a", "not xml"), ("zz", RSS), ("a", None)], "source_id string, xml string")
    got = {r.title: r for r in feeds.collect(df, registry(spark), NOW()).collect()}
    assert set(got) == {"A & B", "Second", "At"}
    assert got["A & B"].url == "http://x/1" and str(got["A & B"].published_at) == "2026-06-24 09:15:00" and got["A & B"].categories == ["c1", "c2"] and got["A & B"].image == "http://i/1.png"
    assert got["At"].url == "http://x/3" and got["At"].date_reliability == "low" and got["At"].time_window_hours == 48.0
    assert got["Second"].published_at is None and got["Second"].id.startswith("a_")


def test_json_objects(spark):
    log = 'x {"runId": "1", "a": {"b": "}"}} noise {"other": 1} { broken {"runId": 2}'
    assert list(files.objects_in('a{"x":"{"}b{}')) == ['{"x":"{"}', "{}"]
    got = files.json_objects(spark.createDataFrame([(1, log), (2, None)], "k int, text string")).collect()
    assert [json.loads(r.object)["runId"] for r in got] == ["1"]


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    kind = "date date, v int"
    assert files.read_table(spark, path, kind).count() == 0 and files.read_json(spark, path + ".json", kind).count() == 0
    day = lambda d, v: spark.sql(f"select date'{d}' as date, {v} as v")
    for d, v in (("2026-06-20", 1), ("2026-06-23", 2), ("2026-06-24", 3)):
        files.append(day(d, v), path, "date")
    files.overwrite_partitions(day("2026-06-24", 9), path, "date")
    got = [r.v for r in files.history(spark, path, kind, F.lit("2026-06-24").cast("date"), 2).collect()]
    assert got == [9, 2] and files.latest_partition(spark, path).first()[0].day == 24
    files.replace(spark.read.parquet(path).where("v < 9"), path)
    assert spark.read.parquet(path).count() == 2


def items(spark, n=6):
    rows = [(f"i{k}", f"Title number {k} about GPT-{k}", f"http://x/{k % 4}", "src", f"2026-06-24T0{k}:00:00Z", k) for k in range(n)]
    rows += [("n1", "fix: x", "http://g/issues/1", "github-a", None, 90), ("e1", "", "http://x/9", "src", None, 91), ("i0", "Title number 0 about GPT-0", "http://x/0", "src", "2026-06-24T00:00:00Z", 92)]
    return spark.createDataFrame(rows, "id string, title string, url string, sourceId string, publishedAt string, ord long")


def test_ingestion_pipeline(spark):
    empty = spark.createDataFrame([], "id string, content_hash string")
    out = pipelines.ingest(items(spark), empty, NOW())
    events = out.events.collect()
    assert len(events) == 6 and out.quarantined.count() == 1
    assert {(r.from_id, r.to_id) for r in out.edges.collect()} <= {("i0", "i0")} or out.edges.count() == 0
    stored = out.events.select("id", "content_hash")
    assert pipelines.ingest(items(spark), stored, NOW()).events.count() == 0
    assert all(r.cluster_id for r in events)


SCHEMA = "id string, content_hash string, entities array<string>, effective_at timestamp, ord long"


def event(i, h, o):
    return {"id": i, "content_hash": h, "entities": ["E"], "effective_at": "2026-06-24T01:00:00Z", "ord": o}


def test_ingest_stream_stores_once(spark, tmp_path, monkeypatch):
    """Replays, a failure between the tables, a restart and a new checkpoint: each id and each hash is stored once, nothing is lost, nothing is left behind."""
    src = tmp_path / "in"
    src.mkdir()
    ev, en, cp, other = (f"file://{tmp_path}/{x}" for x in ("events", "entities", "cp", "other"))
    left = lambda: len(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    before = left()

    def land(name, *rows):
        (src / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run(checkpoint=cp):
        ingest.ingest(ingest.read_events(spark, str(src), SCHEMA), ev, en, checkpoint, once=True).awaitTermination()

    def stored():
        ids = sorted(r.id for r in spark.read.parquet(ev).collect())
        assert sorted(r.event_id for r in spark.read.parquet(en).collect()) == ids
        return "".join(ids)

    land("1.json", event("a", "h1", 1), event("b", "h2", 2), event("a", "h1", 3))
    run()
    land("2.json", event("c", "h2", 4), event("d", "h4", 5), event("n", None, 6), event("m", None, 7))
    run()
    run()
    assert stored() == "abdmn"
    assert left() == before

    # a stream with a new checkpoint reads all again, and a row whose hash the other one stored
    land("3.json", event("z", "h1", 8))
    run(other)
    assert stored() == "abdmn"

    # a failure after the events: the batch runs again, and the rest is written
    land("4.json", event("e", "h5", 9))
    kept = ingest.bridge
    monkeypatch.setattr(ingest, "bridge", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        run()
    monkeypatch.setattr(ingest, "bridge", kept)
    run()
    assert stored() == "abdemn"

    # the same failure, but it is another checkpoint that goes on: the run is completed from its events
    land("5.json", event("f", "h6", 10))
    monkeypatch.setattr(ingest, "bridge", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        run()
    monkeypatch.setattr(ingest, "bridge", kept)
    land("6.json", event("g", "h6", 11))
    run(other)
    assert stored() == "abdefmn"
    run()
    assert stored() == "abdefmn"


def test_key_table_reads_few_buckets(spark, tmp_path):
    table = keys.KeyTable(spark, f"file://{tmp_path}/keys", buckets=32, pages=1)
    rows = lambda names: spark.createDataFrame([("id", n) for n in names], "kind string, key string")
    assert table.lookup(rows(["a"])).count() == 0
    table.add(rows([f"k{i}" for i in range(300)]), "r1")
    table.add(rows(["k3", "x"]), "r2")
    found = table.lookup(rows(["k3", "x", "absent", "k299"]))
    assert {tuple(r) for r in found.collect()} == {("id", "k3", "r1"), ("id", "k3", "r2"), ("id", "x", "r2"), ("id", "k299", "r1")}
    # two keys lie in at most two buckets of 32; absent keys read next to nothing
    assert 1 <= len({f.rsplit("/", 1)[0] for f in table.lookup(rows(["k1", "k2"])).inputFiles() if "/keys/keys/" in f}) <= 2
    assert len(table.folders(table.may_hold(rows([f"absent{i}" for i in range(200)])))) <= 4
    assert len(os.listdir(tmp_path / "keys" / "keys")) > 25
    table.compact()
    assert table.lookup(rows([f"k{i}" for i in range(300)])).select("key").distinct().count() == 300
    assert table.lookup(rows(["x"]).withColumn("kind", F.lit("hash"))).count() == 0


def test_breaker(spark):
    def after(*oks):
        s = breaker.NEW
        for i, ok in enumerate(oks):
            s = breaker.step(s, float(i), ok)
        return s

    assert after(False, False)[0] == "CLOSED" and after(False, False, False)[:2] == ("OPEN", 3) and after(False, True, False, False)[0] == "CLOSED"
    s = after(False, False, False)
    assert s[3] == 600 and breaker.offered(s, 100.0)[0] == "OPEN" and breaker.offered(s, 602.0)[0] == "HALF_OPEN"
    assert breaker.step(s, 700.0, True) == breaker.NEW and breaker.step(s, 700.0, False)[3] == 1200
    rows = [("a", f"2026-01-01 00:00:0{i}", "error", i) for i in range(3)] + [("b", "2026-01-01 00:00:00", "ok", 9), ("c", "2026-01-01 00:00:00", "error", 10)]
    df = spark.createDataFrame(rows, "instance string, ts string, outcome string, ord long").withColumn("ts", F.col("ts").cast("timestamp"))
    states = breaker.fold(df)
    assert {r.instance: r.state for r in states.collect()} == {"a": "OPEN", "b": "CLOSED", "c": "CLOSED"}
    assert [breaker.choose(states, 0.0, t).first().instance for t in range(3)] == ["b", "c", "b"]
    only = states.where("state = 'OPEN'")
    assert breaker.choose(only, 0.0, 0).count() == 0 and breaker.choose(only, 4e9, 0).first().instance == "a"


MENTION = "story_key string, event_id string, at timestamp, tier int"


def mentions(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("story_key", "event_id", "at", "tier"), r, strict=True))) for r in rows))


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stories.ROCKSDB)
    yield
    spark.conf.set(key, before)


def run_stream(df, out, checkpoint, mode="update"):
    df.writeStream.outputMode(mode).foreachBatch(lambda rows, n: out.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_stories_change_by_the_clock(spark, tmp_path, rocksdb):
    src, out = tmp_path / "in", []
    step = lambda: run_stream(stories.stream_stories(spark.readStream.schema(MENTION).json(str(src))), out, f"file://{tmp_path}/cp")
    mentions(src, "1.json", ("s", "e1", "2026-01-01T10:00:00Z", 1), ("s", "e2", "2026-01-01T11:00:00Z", 1), ("t", "x", "2026-01-01T11:00:00Z", 1), ("s", "e2", "2026-01-01T12:00:00Z", 1), (None, "x", "2026-01-01T11:00:00Z", 1))
    step()
    assert {r[:3] for r in out} == {("s", "developing", 2), ("t", "emerging", 1)}
    out.clear()
    # nothing of s and t comes any more: the clock turns them
    mentions(src, "2.json", ("u", "e9", "2026-01-07T10:00:00Z", 1))
    step()
    assert {r[:2] for r in out} == {("u", "emerging"), ("s", "follow-up"), ("t", "follow-up")}
    out.clear()
    mentions(src, "3.json", ("u", "e8", "2026-01-12T10:00:00Z", 1), ("t", "y", "2026-01-12T10:00:00Z", 1))
    step()
    last = {}
    for r in out:
        last[r[0]] = r[1]
    assert last == {"u": "developing", "t": "developing", "s": "stale"}
    batch = stories.batch_stories(spark.read.schema(MENTION).json(str(src)), F.lit("2026-01-11 10:00:00").cast("timestamp"))
    assert {r.story_key: r.state for r in batch.collect()} == last


def test_quarantine_expires_by_the_clock(spark, tmp_path, rocksdb):
    src, out = tmp_path / "in", []
    step = lambda: run_stream(stories.stream_quarantine(spark.readStream.schema(MENTION).json(str(src)).select(F.col("event_id").alias("id"), "at")), out, f"file://{tmp_path}/cp")
    mentions(src, "1.json", ("s", "a", "2026-01-01T10:00:00Z", 1), ("s", "b", "2026-01-01T10:00:00Z", 1))
    step()
    mentions(src, "2.json", ("s", "b", "2026-01-03T10:00:00Z", 1))
    step()
    assert {r[:2] for r in out} == {("a", "held"), ("b", "held")}
    out.clear()
    mentions(src, "3.json", ("s", "c", "2026-01-05T10:00:00Z", 1))
    step()
    assert {r[:2] for r in out} == {("c", "held"), ("a", "expired")}


def test_sessions_and_late_rows(spark, tmp_path):
    rows = [("s", "1", "2026-01-01T00:00:00Z", 1), ("s", "2", "2026-01-01T05:00:00Z", 1), ("s", "3", "2026-01-01T12:00:00Z", 2), ("s", "4", "2026-01-01T23:00:00Z", 1), ("t", "5", "2026-01-01T00:00:00Z", 3), (None, "6", "2026-01-01T00:00:00Z", 3), ("t", "7", None, 3)]
    src = tmp_path / "in"
    mentions(src, "1.json", *rows)
    batch = spark.read.schema(MENTION).json(str(src))
    got = sorted((r.story_key, r.started.day, r.started.hour, r.ended.day, r.ended.hour, r.mentions) for r in stories.sessions(batch).collect())
    assert got == [("s", 1, 0, 1, 11, 2), ("s", 1, 12, 2, 5, 2), ("t", 1, 0, 2, 0, 1)]
    # as a stream, a session is written once the watermark has passed its end
    out = []
    step = lambda: run_stream(stories.sessions(spark.readStream.schema(MENTION).json(str(src)), late="1 hour"), out, f"file://{tmp_path}/cp", "append")
    step()
    mentions(src, "2.json", ("z", "8", "2026-01-05T00:00:00Z", 1))
    step()
    assert sorted((r[0], r[1].hour, r[2].hour, r[3]) for r in out) == [("s", 0, 11, 2), ("s", 12, 5, 2), ("t", 0, 0, 1)]

    on_time, late = f"file://{tmp_path}/on", f"file://{tmp_path}/late"
    fresh = tmp_path / "fresh"
    split = lambda: stories.split_late(spark.readStream.schema(MENTION).json(str(fresh)), on_time, late, f"file://{tmp_path}/cp2", 2.0, once=True).awaitTermination()
    mentions(fresh, "1.json", ("a", "1", "2026-01-02T00:00:00Z", 1), ("a", "2", "2026-01-01T00:00:00Z", 1))
    split()
    mentions(fresh, "2.json", ("a", "3", "2026-01-01T21:59:00Z", 1), ("a", "4", "2026-01-01T22:30:00Z", 1), ("a", "5", None, 1))
    split()
    assert [r.event_id for r in spark.read.parquet(late).collect()] == ["3"] and sorted(r.event_id for r in spark.read.parquet(on_time).collect()) == ["1", "2", "4", "5"]


def test_landed_feeds(spark, tmp_path):
    folder = tmp_path / "feeds"
    (folder / "b").mkdir(parents=True)
    (folder / "a.xml").write_text(RSS)
    (folder / "b" / "1.xml").write_text(ATOM)
    rows = [*registry(spark).collect(), ("c", "C", "u", 2, "en", "media", None, None, None, None, None, None), ("off", "O", "u", 2, "en", "media", None, None, None, "disabled", None, None)]
    table = spark.createDataFrame(rows, feeds.REGISTRY)
    got = landed.read_landed(spark, table, str(folder))
    assert got.rdd.getNumPartitions() == 3
    assert {(r.source_id, r.status) for r in got.collect()} == {("a", "ok"), ("b", "ok"), ("c", "error")}
    assert "nothing landed for c" in got.where("status = 'error'").first().error
    items, results = feeds.collect_landed(got, table, NOW())
    assert {r.title for r in items.collect()} == {"A & B", "Second", "At"}
    assert {r.source_id: (r.status, r.n_raw) for r in results.collect()} == {"a": ("ok", 2), "b": ("ok", 1), "c": ("error", 0), "off": ("disabled", 0)}

    def broken(folder, source):
        yield "1", b"<rss></rss>"
        raise TimeoutError("slow")

    assert {(r.status, r.error) for r in landed.read_landed(spark, table, str(folder), broken).collect()} == {("ok", None), ("error", "TimeoutError: slow")}

    out = []
    step = lambda: run_stream(landed.read_landed(spark, table, str(folder), stream=True), out, f"file://{tmp_path}/cp", "append")
    step()
    assert [(r[0], r[4]) for r in out] == [("b", "1.xml")]
    out.clear()
    (folder / "b" / "2.xml").write_text(ATOM)
    (folder / "c").mkdir()
    (folder / "c" / "1.xml").write_bytes(b"\xff\xfe")
    step()
    assert [(r[0], r[1], r[4]) for r in sorted(out)] == [("b", "ok", "2.xml"), ("c", "error", None)]


def test_archive_is_whole_or_absent(spark, tmp_path):
    week = lambda w: [(w, n, f"{n} of {w}") for n in landed.WEEK_FILES]
    df = lambda rows: spark.createDataFrame(rows, landed.ARCHIVE).repartition(3)
    path = tmp_path / "archive"
    names = lambda: sorted(p.name for p in path.iterdir() if p.name != "_staged") if path.exists() else []
    landed.write_archive(df(week("2026-W01") + week("2026-W02")), str(path))
    assert names() == ["2026-W01", "2026-W02"] and (path / "2026-W01" / "script.md").read_text() == "script.md of 2026-W01"
    # a task that dies after others have written
    dies = df(week("2026-W03")).withColumn("content", F.when(F.col("name") == "manifest.json", F.raise_error(F.lit("killed"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        landed.write_archive(dies, str(path))
    with pytest.raises(Exception, match="partial weeks"):
        landed.write_archive(df(week("2026-W04") + week("2026-W05")[:2]), str(path))
    with pytest.raises(Exception, match="archived already"):
        landed.write_archive(df(week("2026-W01") + week("2026-W06")), str(path))
    assert names() == ["2026-W01", "2026-W02"] and not any((path / "_staged").iterdir())
    landed.write_archive(df([(w, n, "new") for w, n, _ in week("2026-W01")]), str(path), overwrite=True)
    assert names() == ["2026-W01", "2026-W02"] and (path / "2026-W01" / "article.md").read_text() == "new"


@pytest.mark.parametrize("chunk", [1, 4, 60])
def test_objects_in_chunks(spark, monkeypatch, chunk):
    """Whatever the chunk size, the objects that one scan of the whole log finds."""
    monkeypatch.setattr(logs, "BLOCK", 3)
    rng = random.Random(chunk)
    rows, want = [("null", 0, None)], []
    for log in range(10):
        text = "".join(rng.choice('{}{}"\\a{"x":1} ') for _ in range(rng.randrange(0, 90))) + rng.choice(["", '{"a":{"b":"}\\"{"}} x {'])
        want += [(str(log), o) for o in files.objects_in(text)]
        rows += [(str(log), i // chunk, text[i : i + chunk]) for i in range(0, len(text), chunk)]
    found = logs.objects_in_chunks(spark.createDataFrame(rows, "log string, chunk long, text string")).orderBy(F.col("log").cast("int"), "chunk", "place")
    assert [(r.log, r.object) for r in found.collect()] == want


def test_summaries_compose():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice('{}"\\x') for _ in range(rng.randrange(6))) for _ in "ab")
        both = logs.compose(logs.summary(a, 0), logs.summary(b, 1))
        for mode in (logs.TEXT, logs.QUOTED, logs.ESCAPED):
            for depth in range(1 if mode else 0, 9):
                whole = logs.scan(a + b, mode, depth)
                assert logs.enter(both, (mode, depth, (7, 7)))[:2] == whole[:2]


def test_gram_index(spark, tmp_path):
    index = grams.GramIndex(spark, f"file://{tmp_path}/grams", buckets=32)
    names = ["OpenAI", "openai labs", "Mistral", "日本語", "a", "", None, "Ab"]
    index.add(spark.createDataFrame([(n,) for n in names], "key string"))
    find = lambda n: sorted(r.key for r in index.find(n).collect())
    assert find("OPEN") == ["OpenAI", "openai labs"] and find("a") == ["Ab", "Mistral", "OpenAI", "a", "openai labs"] and find("本語") == ["日本語"]
    assert find("enlabs") == [] and find("") == [] and find("zzz") == []
    # four characters have two pieces, so at most two folders of 32 are read
    rows, parts = index.postings("open")
    assert parts == ["ope", "pen"] and len({f.rsplit("/", 1)[0] for f in rows.inputFiles()}) <= 2


def test_exact_decimals_and_utf16_order(spark):
    rng = random.Random(2)
    values = [1.005, 1.125, 0.0, -1.125, -0.001, 2.675, 1e-9, 0.995, 123456789.125, 1 / 3] + [rng.choice([rng.random() * 10 ** rng.randrange(-3, 9), rng.randrange(1000) / 8, rng.randrange(10**6) / 1000]) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").select("x", text.to_fixed(F.col("x")).alias("s")).collect()
    assert [r.s for r in got[-2:]] == [None, "NaN"] and [r.s for r in got[:2]] == ["1.00", "1.13"]
    for r in got[:-2]:
        assert r.s == ("-" if r.x < 0 else "") + str(Decimal(abs(r.x)).quantize(Decimal("0.01"), ROUND_HALF_UP)), r.x
    words = ["\U0001f600", "", "z", "", None]
    assert spark.createDataFrame([(words,)], "a array<string>").select(text.utf16_sorted("a")).first()[0] == ["", "z", "\U0001f600", ""]


def test_logs_of_many_short_blocks_take_few_calls(spark):
    """A state is kept over rows, not a group for each block: 3,000 logs with gaps between their chunks, in pieces that end in escapes."""
    from tidewire.sources import logs

    plan = logs.objects_in_chunks(spark.createDataFrame([("a", 1, "{")], "log string, chunk long, text string"))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    text = r'x } " {"k": "a\"}{\\", "n": {"m": 1}} done {"s": "\\"} {"open": '
    rows = [(f"l{i}", 1000 * k, text[a:b]) for i in range(3000) for k, (a, b) in enumerate([(0, i % len(text)), (i % len(text), len(text))])]
    got = logs.objects_in_chunks(spark.createDataFrame(rows, "log string, chunk long, text string"))
    assert {(r.object, r["count"]) for r in got.groupBy("object").count().collect()} == {(r'{"s": "\\"}', 3000), (r'{"k": "a\"}{\\", "n": {"m": 1}}', 3000)}


def test_fixed_keeps_the_sign_of_zero(spark):
    got = spark.createDataFrame([(0.0,), (-0.0,), (-0.001,), (-1.125,), (None,)], "x double").select(text.to_fixed(F.col("x"), signed_zero=True).alias("s"), text.to_fixed(F.col("x")).alias("p")).collect()
    assert [r.s for r in got] == ["0.00", "-0.00", "-0.00", "-1.13", None] and got[1].p == "0.00"

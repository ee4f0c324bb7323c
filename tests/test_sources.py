import json
import sys

import pytest
from pyspark import cloudpickle

from passagework.operators import figures, quality, vectors
from passagework.sources import config, extraction, remote, snapshots, tables
from passagework.streaming import jobs


def test_catalogue_and_downloads(spark, tmp_path):
    entries = [{"brand": "B", "model": ["Uno"], "year": ["2020"], "edition": ["06.22"], "url": "u"}, {"brand": "A", "model": ["Dos"], "year": ["2021"], "edition": ["01.21"]}]
    (tmp_path / "c.json").write_text(json.dumps(entries))
    cat = tables.read_catalogue(spark, str(tmp_path / "c.json"))
    assert [(r.entry_ord, r.manual_id) for r in cat.orderBy("entry_ord").collect()] == [(0, "B_Uno_06.22"), (1, "A_Dos_01.21")]
    have = spark.createDataFrame([], "manual_id string")
    assert [r.manual_id for r in tables.to_download(cat, have).collect()] == ["B_Uno_06.22"]
    with pytest.raises(ValueError, match="B_Uno"):
        tables.to_download(cat.union(cat), have)


def test_pages_and_errors(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text("".join(json.dumps({"page": i, "text": f"t{i}"}) + "\n" for i in (1, 2)))
    (tmp_path / "bad.jsonl").write_text('{"page": 1, "text": "x"}\nnot json\n')
    pages, errors = tables.read_pages(spark, str(tmp_path))
    assert [(r.manual_id, r.page, r.text) for r in pages.orderBy("ord").collect()] == [("good", 1, "t1"), ("good", 2, "t2")]
    assert [r.name for r in errors.collect()] == ["bad"]


def test_what_is_pending(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "manual_id string")
    done = spark.createDataFrame([("a",)], "manual_id string")
    assert [r[0] for r in tables.pending(found, done, limit=2).collect()] == ["b", "c"]
    assert tables.pending(found, done, force=True).count() == 4


def stored_rows(spark, path):
    one, two = (snapshots.read(spark, path, t, "n int, manual_id string").collect() for t in ("one", "two"))
    return sorted((r.manual_id, r.n) for r in one), sorted((r.manual_id, r.n) for r in two)


def test_a_reader_sees_all_of_a_write_or_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "manual_id string, n int")
    assert stored_rows(spark, path) == ([], []) and snapshots.manuals(spark, path).count() == 0
    with snapshots.Write(spark, path, rows(("a", 0), ("007", 0))) as w:
        w.add("one", rows(("a", 1), ("007", 2)))
        w.add("two", rows(("a", 1)))
    first = ([("007", 2), ("a", 1)], [("a", 1)])
    assert stored_rows(spark, path) == first

    class Stopped(BaseException):
        pass

    with pytest.raises(Stopped), snapshots.Write(spark, path, rows(("a", 0))) as w:
        w.add("one", rows(("a", 10)))
        assert stored_rows(spark, path) == first  # between the two tables a reader sees the old state whole
        raise Stopped
    assert stored_rows(spark, path) == first and len(list((tmp_path / "store" / "one").glob("part=*"))) == 1

    killed = snapshots.Write(spark, path, rows(("a", 0)))  # a writer that never gets to clean up
    killed.add("one", rows(("a", 20)))
    assert stored_rows(spark, path) == first
    with snapshots.Write(spark, path, rows(("a", 0), ("b", 0))) as w:  # "a" loses its row of "two"
        w.add("one", rows(("a", 30), ("b", 31)))
        w.add("two", rows(("b", 31)))
    second = ([("007", 2), ("a", 30), ("b", 31)], [("b", 31)])
    assert stored_rows(spark, path) == second and {r[0] for r in snapshots.manuals(spark, path).collect()} == {"a", "b", "007"}
    killed.add("two", rows(("a", 20)))
    with pytest.raises(snapshots.Conflict):  # it began before that write
        killed.complete()
    assert stored_rows(spark, path) == second

    assert snapshots.swept(spark, path) == []  # too young
    gone = snapshots.swept(spark, path, keep=1, older_than=-60.0)
    assert any(killed.part in g for g in gone) and stored_rows(spark, path) == second
    left = {p.name for p in (tmp_path / "store").glob("*/part=*")}
    assert f"part={killed.part}" not in left and len(list((tmp_path / "store" / "_manifests").glob("0*.json"))) == 1


def test_manifests_are_put_in_place_once(spark, tmp_path):
    files = snapshots.Files(spark, str(tmp_path))
    assert files.put("_manifests/1.json", "{}") and not files.put("_manifests/1.json", "other")
    assert files.read("_manifests/1.json") == "{}" and [n for n in files.listed("_manifests") if not n.endswith(".crc")] == ["1.json"]


def test_extraction_isolates_failures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one|two")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    files = tables.read_pdfs(spark, str(tmp_path))
    assert {r.manual_id: r.is_pdf for r in files.collect()} == {"a": True, "b": False}

    def parse(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return content[5:].decode().split("|")

    got = {(r.manual_id, r.page, r.text, r.error) for r in extraction.extract(files, parse).collect()}
    assert got == {("a", 1, "one", None), ("a", 2, "two", None), ("b", None, None, "no PDF")}

    def draw(content):
        yield 1, 1, lambda: (b"jpeg", 3, 4)
        yield 1, 2, lambda: 1 // 0

    drawn = extraction.render(files.where("is_pdf"), draw).orderBy("n").collect()
    assert [(r.n, r.width, r.error is None) for r in drawn] == [(1, 3, True), (2, None, False)]


def test_embedding_client():
    assert [len(b) for b in remote.batched(["x"] * 51)] == [50, 1]
    assert [len(b) for b in remote.batched(["x" * 40_001] * 3)] == [1, 1, 1]
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    budget = remote.Budget(clock=lambda: now[0], sleep=sleep)
    budget.take(1500)
    budget.take(1)
    assert waits == [60.5]
    calls = []
    got = remote.embed(["a", "b"], "query", lambda t, task: calls.append(task) or [[1.0]] * len(t))
    assert got == [[1.0], [1.0]] and calls == ["RETRIEVAL_QUERY"]
    with pytest.raises(ValueError):
        remote.embed([], "other", None)
    assert remote.hashed(["a b"]) == remote.hashed(["a b"])


def test_a_header_that_says_no_wait_is_kept_to():
    waits, outcomes = [], [remote.Refused(429, header=0.0), remote.Refused(503, told=0.0, header=3.0), remote.Refused(503), "ok"]

    def call():
        x = outcomes.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert remote.retried(call, sleep=waits.append) == "ok" and waits == [0.0, 3.0, 8.0]


def test_retries_and_settings(tmp_path):
    waits, outcomes = [], [remote.Refused(429, told=9.0), remote.Refused(503, header=3.0), OSError(), "ok"]

    def call():
        x = outcomes.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert remote.retried(call, sleep=waits.append) == "ok" and waits == [9.0, 3.0, 8.0]
    with pytest.raises(remote.Refused):
        remote.retried(lambda: (_ for _ in ()).throw(remote.Refused(400)), sleep=waits.append)
    (tmp_path / ".env").write_text("# no\nexport A='1'\nB=\nC=\"x y\"\njunk\n")
    get = config.settings(tmp_path / ".env", {"A": "2"})
    assert (get("A"), get("B"), get("C")) == ("2", None, "x y")
    with pytest.raises(LookupError):
        get("B", True)
    (tmp_path / "s").write_text("export D = \"d\"\n  #E=1\nF='x\" \nG=a=b \n=none\n")
    more = config.settings(tmp_path / "s", {})
    assert [more(k) for k in "DEFG"] == ["d", None, "'x\"", "a=b"]
    lines = list(remote.ndjson(iter([{"event": "hits"}])))
    assert json.loads(lines[0]) == {"event": "hits"}


def test_stream_takes_each_file_once(spark, tmp_path):
    for n in range(2):
        spark.range(n * 10, n * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest(spark, str(tmp_path / "in"), "id long", "parquet", str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_pacing_is_a_function_of_what_was_sent():
    assert remote.pace((), 5.0, 9999) == ((), 0.0)
    assert remote.pace(((0.0, 10), (30.0, 5)), 40.0, 5, rate=20) == (((0.0, 10), (30.0, 5)), 0.0)
    assert remote.pace(((0.0, 10), (30.0, 5)), 40.0, 6, rate=20) == (((0.0, 10), (30.0, 5)), 20.5)
    assert remote.pace(((0.0, 10), (30.0, 5)), 60.0, 16, rate=20) == (((30.0, 5),), 30.5)


class Reply:
    def __init__(self, headers, *parts):
        self.headers, self.parts = headers, parts

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        for p in self.parts:
            if isinstance(p, Exception):
                raise p
        return b"".join(self.parts)


def test_opening_is_retried_and_reading_only_when_fetched_whole():
    replies = [OSError("refused"), Reply({}, OSError("broke")), Reply({"a": 1}, b"ok")]

    def connect():
        x = replies.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    waits = []
    assert remote.fetched(connect, sleep=waits.append) == ({"a": 1}, b"ok") and waits == [2.0, 4.0]
    replies[:] = [OSError("refused"), Reply({}, OSError("broke")), Reply({}, b"never")]
    with remote.opened(connect, sleep=waits.append) as reply, pytest.raises(OSError, match="broke"):
        reply.read()
    assert len(replies) == 1
    with pytest.raises(RuntimeError, match="400 from model:verb: why"):
        remote.named("model:verb", lambda: (_ for _ in ()).throw(remote.Refused(400, "why")))


def test_each_host_rests_between_its_own():
    now, asked = [0.0], []
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    due = {}
    for hosts in (["a", "a", "a", "b", "c", "b"], ["a", "d"]):
        for k in remote.in_turns(hosts, due, 1.0, lambda: now[0], sleep):
            asked.append((hosts[k], now[0]))
    assert sorted(asked) == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 0.0), ("b", 1.0), ("c", 0.0), ("d", 2.0)]


def test_downloads_are_checked_and_stored_once(spark, tmp_path):
    def connect(url):
        if url == "gone":
            raise remote.Refused(404, "no such file")
        return Reply({"Content-Type": "text/html" if url == "html" else "application/PDF"}, b"<html>" if url in ("html", "fake") else b"%PDF-1 " + url.encode())

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't import tests
    plan = spark.createDataFrame([(u.upper(), u) for u in ("a", "html", "fake", "gone", "b")], "manual_id string, url string")
    report, failures = tables.write_downloads(remote.download(plan, connect, pause=0.0), str(tmp_path / "raw"))
    report = report.first()
    assert (report.downloaded, report.bytes, report.failed) == (2, 16, 3)
    assert sorted((f.manual_id, f.error) for f in failures.collect()) == [("FAKE", "expected a PDF; the file begins otherwise"), ("GONE", "HTTP 404: no such file"), ("HTML", "expected a PDF; the reply's type is text/html")]
    have = tables.read_downloads(spark, str(tmp_path / "raw"))
    assert {r.manual_id for r in have.collect()} == {"A", "B"}
    left = tables.to_download(plan, have)
    assert {r.manual_id for r in left.collect()} == {"HTML", "FAKE", "GONE"}


def test_an_index_is_built_described_last_and_searched(spark, tmp_path):
    path, call = str(tmp_path / "index"), lambda texts, task: remote.hashed(texts, task, 16)
    chunks = spark.createDataFrame([(m, i, f"{m} text number {i}") for m in "ab" for i in range(3)], "manual_id string, ord int, text string")
    tables.build_index(chunks, lambda rows: remote.embedded(rows, "passage", call, tasks=2), "model", path)
    index, meta = tables.load_index(spark, path)
    assert {(r.manual_id, r.n, r.dims, r.model) for r in meta.collect()} == {("a", 3, 16, "model"), ("b", 3, 16, "model")}
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-6 for r in index.collect())
    best = vectors.search(index, chunks, meta, "model", "a", call(["a text number 1"], "")[0], 1).first()
    assert (best.ord, best["rank"]) == (1, 1)
    changed = chunks.where("manual_id = 'a'").selectExpr("manual_id", "ord", "concat(text, ' more') as text")
    tables.build_index(changed, lambda rows: remote.embedded(rows, "passage", call), "model", path)
    index, meta = tables.load_index(spark, path)
    status = {r.manual_id: r.status for r in vectors.freshness(chunks, chunks, meta, "model").collect()}
    assert status == {"a": "other chunks", "b": "fresh"} and index.count() == 6
    with pytest.raises(ValueError):
        remote.embedded(chunks, "other", call)


def test_figures_are_stored_before_their_index(spark, tmp_path):
    path = str(tmp_path / "figures")
    images = spark.createDataFrame([(m, 1, n, 0.0, 0.0, float(n), 5.0, 200, 100) for m in "ab" for n in (1, 2)], "manual_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double, width int, height int")
    drawn = spark.createDataFrame([("a", 1, 1, 9, 8, b"jpeg", None), ("a", 1, 2, None, None, None, "boom"), ("b", 1, 1, 9, 8, b"jp", None)], extraction.FIGURES)
    tables.write_figures(drawn, figures.placements(images), path)
    index = tables.read_figures(spark, path).orderBy("figure_id").collect()
    assert [(r.figure_id, r.file, r.width, list(r.source_px)) for r in index] == [("a:0001:1", "p0001_1.jpg", 9, [200, 100]), ("b:0001:1", "p0001_1.jpg", 9, [200, 100])]
    stats = {r.name: (r.figures, r.skipped, r.pages, r.bytes) for r in quality.figure_stats(*tables.figure_bytes(spark, path)).collect()}
    assert stats == {"a": (1, 1, 1, 4), "b": (1, 0, 1, 2)}
    tables.write_figures(drawn.where("1 = 0"), figures.placements(images.where("1 = 0")), path, spark.createDataFrame([("a",)], "manual_id string"))
    assert {r.manual_id for r in tables.read_figures(spark, path).collect()} == {"b"}  # a manual without figures has no old index either


def test_passages_are_read_in_file_order(spark, tmp_path):
    rows = [{"chunk_id": f"{m}:{i:05d}", "manual_id": m, "ord": i, "section": None, "pages": [1], "printed": [], "refs": [], "figures": [], "text": f"t{i}"} for m in "ab" for i in range(12)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert [r.ord for r in tables.read_passages(spark, str(tmp_path), "b").collect()] == list(range(12))
    assert tables.read_passages(spark, str(tmp_path)).count() == 24
    with pytest.raises(LookupError, match="chunk it"):
        tables.read_passages(spark, str(tmp_path), "c")
    tables.write_passages(tables.read_passages(spark, str(tmp_path)), str(tmp_path / "out"))
    again = tables.stored_passages(spark, str(tmp_path / "out"))
    assert sorted((r.manual_id, r.ord, r.text) for r in again.collect()) == sorted((r["manual_id"], r["ord"], r["text"]) for r in rows)


def test_project_root(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "manuals.json").write_text("[]")
    (tmp_path / "checkout").mkdir()
    assert config.project_root("manuals.json", here=deep) == tmp_path
    assert config.project_root("manuals.json", checkout=tmp_path / "checkout", here=deep) == tmp_path
    (tmp_path / "checkout" / "manuals.json").write_text("[]")
    assert config.project_root("manuals.json", checkout=tmp_path / "checkout", here=deep) == tmp_path / "checkout"
    assert config.project_root("manuals.json", named=str(deep), checkout=tmp_path) == deep.resolve()
    with pytest.raises(FileNotFoundError):
        config.project_root("no such file", here=deep)

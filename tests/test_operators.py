import random

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from passagework.operators import answers, catalogue, figures, pages, passages, quality, ranking, routes, vectors
from passagework.plans import queries
from passagework.scratch import stored

CATALOGUE = "entry_ord long, brand string, model array<string>, year array<string>, edition array<string>, url string"
ENTRIES = [
    (0, "B", ["Uno", "Dos"], ["2020"], ["06.22", "11.22"], "u"),
    (1, "B", ["Uno"], ["2021", "2020"], ["06.22"], None),
    (2, "A", ["Tres"], ["2019"], ["draft"], ""),
]


@pytest.fixture
def cars(spark):
    return catalogue.with_ids(spark.createDataFrame(ENTRIES, CATALOGUE))


def test_tree_options_resolve(spark, cars):
    got = [tuple(r)[:4] for r in catalogue.tree(cars).orderBy("brand", "place").collect()]
    assert got == [("A", "Tres", "2019", "draft"), ("B", "Dos", "2020", "11.22"), ("B", "Dos", "2020", "06.22"), ("B", "Uno", "2021", "06.22"), ("B", "Uno", "2020", "11.22"), ("B", "Uno", "2020", "06.22")]
    assert [r.option for r in catalogue.options(cars, "B", "Uno").orderBy("place").collect()] == ["2021", "2020"]
    assert [r.option for r in catalogue.options(cars).orderBy("place").collect()] == ["A", "B"]
    with pytest.raises(LookupError, match=r"\['A', 'B'\]"):
        catalogue.options(cars, "C")
    assert catalogue.resolve(cars, "B", "Uno", "2020", "06.22") == "B_Uno+Dos_06.22+11.22"
    with pytest.raises(LookupError):
        catalogue.resolve(cars, "B", "Uno", "1999", "06.22")


def test_validate_and_search(spark, cars):
    chunked = spark.createDataFrame([("A_Tres_draft",), ("B_Uno_06.22",), ("stray",)], "manual_id string")
    got = [r.message for r in catalogue.validate(cars, chunked).orderBy("check", "subject").collect()]
    assert got == ["B Uno 2020 06.22 matches 2 manuals: B_Uno+Dos_06.22+11.22, B_Uno_06.22", "no chunks for B_Uno+Dos_06.22+11.22", "chunks for stray, which is not in the catalogue"]
    rows = catalogue.vehicles(cars)
    assert catalogue.search(rows, F.lit("uno (2021)")).count() == 1 and catalogue.search(rows, F.lit(" ")).count() == rows.count()
    assert {r.more for r in catalogue.drawn(rows, "brand", "place", most=4).collect()} == {2}


def brute_pack(units, target, overlap):
    """The packing told as what it does to a buffer of (size, section)."""
    out, buffer = [], []
    for i, (size, section) in enumerate(units):
        if buffer:
            changed = section != units[buffer[-1]][1]
            if changed or sum(units[j][0] for j in buffer) + size > target:
                out.append(buffer)
                tail = []
                while not changed and buffer and sum(units[j][0] for j in tail) + units[buffer[-1]][0] <= overlap:
                    tail = [buffer[-1], *tail]
                    buffer = buffer[:-1]
                buffer = tail
        buffer = [*buffer, i]
    return [*out, buffer] if buffer else out


def brute_batches(sizes, most, chars):
    out = []
    for i, size in enumerate(sizes):
        if not out or len(out[-1]) >= most or sum(sizes[j] for j in out[-1]) + size > chars:
            out.append([])
        out[-1].append(i)
    return out


@pytest.mark.parametrize("block", [20_000, 10])
def test_one_key_of_a_third_of_all_rows_is_folded_in_blocks(spark, block):
    """Blocks are no smaller than pointers reach, some 50 rows; the hot key has 900, null is a key, and sections change within keys."""
    rng = random.Random(5)
    keys = ["hot"] * 900 + [None] * 200 + [f"k{rng.randrange(300)}" for _ in range(1600)]
    rows = [(k, None if rng.random() < 0.1 else "x", n, rng.choice([1, 2, 3, 9, 25, 40]), rng.choice("ab") if rng.random() < 0.02 else "a") for n, k in enumerate(keys)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, extra string, ord long, size int, section string")
    whole = {}
    for k, _, o, size, section in sorted(rows, key=lambda r: r[2]):
        whole.setdefault(k, []).append((o, size, section))
    for target, overlap in ((30, 8), (30, 0), (20, 30)):
        got = {}
        for r in passages.pack(frame, ["k"], ["ord"], "size", "section", target, overlap, block=block).collect():
            got.setdefault(r.k, {}).setdefault(r.chunk, []).append((r.at, r.ord))
        for k, units in whole.items():
            want = brute_pack([(s, x) for _, s, x in units], target, overlap)
            assert [[at for at, _ in sorted(got[k][c])] for c in range(len(want))] == want and len(got[k]) == len(want)
            assert all(units[at][0] == o for c in got[k].values() for at, o in c)
    for most, chars in ((5, 60), (40, 10_000)):
        got = {}
        for r in passages.batches(frame, ["k"], ["ord"], "size", most, chars, block=block).collect():
            got.setdefault(r.k, {}).setdefault(r.batch, []).append(r.at)
        assert {k: [sorted(v[b]) for b in range(len(v))] for k, v in got.items()} == {k: brute_batches([s for _, s, _ in u], most, chars) for k, u in whole.items()}
    assert passages.pack(frame.where("1 = 0"), ["k"], ["ord"], "size").count() == 0


def test_packing_and_cutting_equal_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        units = [(rng.choice([0, 5, 30, 60, 100, 130]), rng.choice([None, "a"]) if rng.random() < 0.2 else "a") for _ in range(rng.randint(0, 20))]
        target, overlap = rng.choice([80, 120]), rng.choice([0, 40, 200])
        first = [i for i in range(len(units)) if not i or units[i][1] != units[i - 1][1]]
        low = [max(f for f in first if f <= i) for i in range(len(units))]
        high = [min([f for f in first if f > i] or [len(units)]) for i in range(len(units))]
        start, after = passages.Filling(target, overlap).pointers(np.array([u[0] for u in units], np.int64), np.array(low, np.int64), np.array(high, np.int64))
        way = passages._way(after.tolist(), 0, len(units))
        assert [list(range(start[i], after[i])) for i in way] == brute_pack(units, target, overlap)
    for _ in range(500):
        text = "".join(rng.choice("ab  ") for _ in range(rng.randint(0, 60))).strip()
        got = passages.pieces(text, 10)
        assert "".join(got).replace(" ", "") == text.replace(" ", "") and all(len(p) <= 10 for p in got)


BODY = ["Motor", "{n}", "Compruebe el nivel de acei-", "te cada mes.", "● Pare el motor", "● Espere", "Fig. 3 Varilla", "ver la página 9", "Fin {n}", "Pie"]
NAV = ["Motor", "Índice", "Aceite . . . . . 9", "Agua . . . . . 12", "Pie"]


def manual(spark):
    rows = [("m", i, i % 3 + 1, "\n".join(BODY).format(n=117 + i % 3)) for i in range(6)] + [("m", 6, 4, "\n".join(NAV)), ("n", 0, 1, "Solo\ntexto suelto."), ("n", 1, 2, None)]
    return spark.createDataFrame(rows, "manual_id string, ord long, page int, text string")


def test_pages_to_passages(spark):
    rows = pages.page_rows(manual(spark))
    assert {(r.manual_id, r.line) for r in pages.chrome(rows).collect()} == {("m", "Motor"), ("m", "Pie")}
    assert [tuple(r) for r in pages.nav_pages(rows).collect()] == [("m", 6)]
    got = passages.passages(manual(spark), target=200, overlap=0).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got][:2] == ["m:00000", "m:00001"]
    first = got[0]
    assert first.section == "Motor" and first.printed[0] == "117" and first.pages[0] == 1
    assert first.text.startswith("Compruebe el nivel de aceite cada mes.\n- Pare el motor\n- Espere\nFig. 3 Varilla") and first.refs == [9] and first.figures == [3]
    assert [r.text for r in got if r.manual_id == "n"] == ["Solo texto suelto."]


def test_carry_forward_over_blocks(spark):
    rows = [("k", i, "abc"[i // 7] if i % 7 == 3 else None) for i in range(20)]
    got = pages.carry_forward(spark.createDataFrame(rows, "k string, o long, v string"), "k", "o", "v", "held", block=4).orderBy("o").collect()
    held, want = None, []
    for _, _, v in rows:
        held = v or held
        want.append(held)
    assert [r.held for r in got] == want


def test_carry_before_and_totals_over_blocks(spark):
    rows = [("k", i * 3, [None, "a", None, "b", None][i % 5], i) for i in range(25)]
    frame = spark.createDataFrame(rows, "k string, o long, v string, n long")
    got = pages.carry_forward(frame, "k", "o", "v", "held", block=7, before=True).orderBy("o").collect()
    held, want = None, []
    for _, _, v, _ in rows:
        want.append(held)
        held = v or held
    assert [r.held for r in got] == want
    assert [r.t for r in pages.running_total(frame, "k", "o", "n", "t", block=7).orderBy("o").collect()] == [sum(range(i)) for i in range(25)]


def test_passages_of_changing_sections_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for m in "mn":
        for i in range(60):
            head = rng.choice(["Uno", "Uno", "Dos", ""])
            body = [" ".join(rng.choice(["alfa", "beta", "gamma", "delta"]) + str(rng.randrange(900)) for _ in range(rng.randint(2, 25))) + rng.choice([".", ""]) for _ in range(rng.randint(0, 4))]
            rows.append((m, i * 40, i, "\n".join([*([head] if head else []), *body])))
    frame = spark.createDataFrame(rows, "manual_id string, ord long, page int, text string")
    found = {}
    for r in passages.units(frame, target=120).orderBy("manual_id", "ord", "para", "piece").collect():
        found.setdefault(r.manual_id, []).append(r)
    assert len({r.section for r in found["m"]}) > 1
    got = {}
    for r in passages.passages(frame, target=120, overlap=40).orderBy("manual_id", "ord").collect():
        got.setdefault(r.manual_id, []).append((r.ord, r.section, r.text))
    for m, units in found.items():
        groups = brute_pack([(len(u.text), u.section) for u in units], 120, 40)
        assert got[m] == [(k, units[g[0]].section, "\n".join(units[i].text for i in g)) for k, g in enumerate(groups)]


def test_runs_of_a_section_over_blocks(spark):
    rng = random.Random(3)
    rows = [(m, o, rng.choice([None, "a", "b"]), rng.choice([0, 1, 1])) for m in "mn" for o in sorted(rng.sample(range(400), 150))]
    rows = [(m, o, s, n) if rng.random() < 0.3 else (m, o, "a", n) for m, o, s, n in rows]
    want, before = {}, {}
    for m, o, s, n in rows:
        if n:
            if m not in before or before[m][0] != s:
                before[m] = (s, o)
            want[m, o] = before[m][1]
    frame = spark.createDataFrame(rows, "manual_id string, ord long, section string, n_body int")
    for block in (1, 7, 60, 1000):
        assert {(r.manual_id, r.ord): r.run for r in pages.section_runs(frame, block=block).collect()} == want


def test_what_is_used_twice_is_stored_once(spark):
    held = []

    def keep(d):
        held.append(set(d.columns))
        return stored(d)

    got = passages.passages(manual(spark), target=200, overlap=0, stored=keep).collect()
    assert sorted(got) == sorted(passages.passages(manual(spark), target=200, overlap=0).collect())
    for made in ({"lines", "edges", "nav"}, {"gone", "head"}, {"section", "n_body"}, {"text", "piece"}, {"chunk", "at"}):
        assert sum(made <= c for c in held) >= 1, made
    assert not any("lines" in c and "gone" in c for c in held)


def test_search_refuses_a_stale_index(spark):
    chunks = spark.createDataFrame([("m", 0, "uno"), ("m", 1, "dos"), ("m", 2, "tres"), ("m", 3, "x")], "manual_id string, ord int, text string")
    index = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.6, 0.8]), ("m", 2, [0.0, 1.0]), ("m", 3, [-1.0, 0.0])], "manual_id string, ord int, vector array<float>")
    meta = vectors.index_meta(chunks, index, "model")
    got = vectors.search(index, chunks, meta, "model", "m", [2.0, 0.0], 3).collect()
    assert [(r.text, round(r.score, 4), r["rank"]) for r in got] == [("uno", 1.0, 1), ("dos", 0.6, 2), ("tres", 0.0, 3)]
    for broken, reason in ((meta.where("1 = 0"), "not indexed"), (meta.withColumn("digest", F.lit(None).cast("string")), "incomplete"), (meta.withColumn("model", F.lit("old")), "other model"), (meta.withColumn("digest", F.lit("x")), "other chunks")):
        with pytest.raises(LookupError, match=reason):
            vectors.search(index, chunks, broken, "model", "m", [1.0, 0.0])
    with pytest.raises(LookupError, match="no chunks"):
        vectors.search(index, chunks.where("1 = 0"), meta, "model", "m", [1.0, 0.0])


def test_figures(spark):
    rows = [("m", 1, 2, 0.0, 0.0, 5.001, 5.0, 200, 150), ("m", 1, 1, 0.0, 0.0, 5.0, 5.0, 100, 100), ("m", 1, 3, 1.0, 1.0, 2.0, 2.0, 40, 40), ("m", 2, 4, 1.0, 1.0, 1.0, 2.0, 400, 400), ("m", 2, 5, 0.0, 0.0, float("inf"), 2.0, 400, 400), ("m", 2, 6, 0.0, 0.0, 3.0, 2.0, 400, 400)]
    found = figures.placements(spark.createDataFrame(rows, "manual_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double, width int, height int"))
    assert [(r.figure_id, r.width) for r in found.orderBy("figure_id").collect()] == [("m:0001:1", 100), ("m:0002:1", 400)]
    hits = spark.createDataFrame([(1, "m", [2, 1]), (2, "m", [9]), (3, "z", [])], "h int, manual_id string, pages array<int>")
    got = {r.h: [f.url for f in r.figures] for r in figures.with_figures(hits, found, ["h"]).collect()}
    assert got == {1: ["/api/figure/m/p0002_1.jpg", "/api/figure/m/p0001_1.jpg"], 2: [], 3: []}


def test_figures_are_listed_once_for_hits_of_the_same_pages(spark):
    found = spark.createDataFrame([("m", p, n, f"m:{p}:{n}", f"p{p}_{n}.jpg", 1, 1) for p in (1, 2) for n in (2, 1)], "manual_id string, page int, n int, figure_id string, file string, width int, height int")
    hits = spark.createDataFrame([*((i, "m", [2, 1, 2]) for i in range(50)), (50, "m", None), (51, None, [1]), (52, "m", [1, None]), (53, "z", [1])], "h int, manual_id string, pages array<int>")
    with_ = figures.with_figures(hits, found, ["h"])
    got = {r.h: [f.figure_id for f in r.figures] for r in with_.collect()}
    both = [["m:1:1", "m:1:2"], ["m:2:1", "m:2:2"]]
    assert got == {**{i: both[1] + both[0] + both[1] for i in range(50)}, 50: [], 51: [], 52: both[0], 53: []} and with_.columns == [*hits.columns, "figures"]
    plan = with_._jdf.queryExecution().optimizedPlan().toString().split("\n")
    listed = next(k for k, line in enumerate(plan) if "Generate posexplode" in line)
    assert any("Aggregate [manual_id" in line for line in plan[listed + 1 : listed + 3])  # of distinct pages, not of hits


def test_answers(spark):
    hits = spark.createDataFrame([(1, 1, "S", "uno\ndos\nuno"), (1, 2, "", "dos\ntres"), (1, 3, None, "tres")], "question_id int, rank int, section string, text string")
    kept = answers.seen(hits)
    assert {(r["rank"], r.text) for r in kept.collect()} == {(1, "uno\ndos\nuno"), (2, "tres")}
    asked = spark.createDataFrame([(1, "¿qué?")], "question_id int, question string")
    assert answers.prompts(kept, asked).first().prompt == "--- Fragment 1 (S) ---\nuno\ndos\nuno\n\n--- Fragment 2 (sin seccion) ---\ntres\n\n--- Question ---\n¿qué?"
    body = answers.payload(F.lit("p"), F.lit("s"))
    assert "thinkingConfig" not in spark.range(1).select(body.alias("b")).first().b


def test_retry_plan_is_as_its_sql_where_a_wait_is_none_or_missing(spark, tmp_path):
    """Told waits of 0, and errors without one, over all attempts and kinds of failure."""
    rows = [(4 * k + a, kind, value) for k, (kind, value) in enumerate((kind, value) for kind in ("error", "view", "click", "purchase", None) for value in (0.0, -0.0, 1.5, None)) for a in range(4)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["retry_plan"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = db.sql(queries.ORACLES["retry_plan"]).fetchall()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want)


def piece(text=None, finish=None, tokens=None):
    import json

    out = {"candidates": [{"content": {"parts": [{"text": text}] if text is not None else []}}]}
    if finish:
        out["candidates"][0]["finishReason"] = finish
    if tokens:
        out["usageMetadata"] = {"totalTokenCount": tokens}
    return json.dumps(out)


def test_events_end_once(spark):
    rows = [(1, 0, piece("a")), (1, 1, piece("b", "STOP", 7)), (2, 0, piece("a", "MAX_TOKENS")), (3, 0, piece("a")), (4, 0, "{}")]
    found = answers.events(spark.createDataFrame(rows, "reply_id int, seq int, body string"), spark.createDataFrame([(i, "[]") for i in range(1, 6)], "reply_id int, hits string"), "m")
    got = {}
    for r in found.orderBy("reply_id", "seq").collect():
        got.setdefault(r.reply_id, []).append((r.event, r.payload))
    assert got[1] == [("hits", "[]"), ("token", "a"), ("token", "b"), ("done", '{"model":"m","tokens":7}')]
    assert got[2][-1] == ("error", "m stopped early (MAX_TOKENS); the answer is incomplete")
    assert got[3][-1][0] == got[4][-1][0] == got[5][-1][0] == "error"
    whole = answers.answer(spark.createDataFrame([(1, piece(" hola ")), (2, piece("x", "SAFETY")), (3, "{}")], "reply_id int, body string"), "m")
    assert [(r.answer, r.error is None) for r in whole.orderBy("reply_id").collect()] == [("hola", True), (None, False), (None, False)]
    blocked = answers.answer(spark.createDataFrame([(1, '{"promptFeedback":{"blockReason":"SAFETY"}}'), (2, None)], "reply_id int, body string"), "m")
    assert [r.error for r in blocked.orderBy("reply_id").collect()] == ['no answer from m: {"blockReason":"SAFETY"}', "no answer from m: "]


def test_quality_flags(spark):
    stats = spark.createDataFrame([("thin", 10, 1990, 0, 100, None), ("blank", 100, 50_000, 21, 500, None), ("flat", 1, 1000, 0, 0, None), ("none", 0, 0, 0, 0, None), ("bad", None, None, None, None, "boom"), ("ok", 10, 9000, 2, 40, None)], "name string, pages long, chars long, empty long, accents long, error string")
    got = {r.flag: r.name for r in quality.flags(stats, "extract").collect()}
    assert got == {"under 200 chars/page": "thin", "over 20% blank pages": "blank", "almost no accented characters": "flat", "no pages or no text at all": "none", "failed": "bad"}
    drawn = spark.createDataFrame([("a", 9, 1, 1, 2), ("b", 100, 1, 30, 2), ("c", 1, 9, 1, 2)], "name string, figures long, skipped long, pages long, bytes long")
    assert {(r.flag, r.name) for r in quality.flags(drawn, "figure").collect()} == {("over 4 per page", "a"), ("over 10% skipped", "c")}
    assert {r.flag: r.fails for r in quality.report(drawn, "figure").collect()} == {"over 4 per page": False, "over 10% skipped": True}


def test_digests_stream_in_order(spark):
    import hashlib

    rows = [(m, i, None if i == 5 else f"text {m} {i}") for m in ("a", "b", None) for i in range(40)]
    random.Random(2).shuffle(rows)
    got = {r.manual_id: r.digest for r in vectors.digests(spark.createDataFrame(rows, "manual_id string, ord int, text string").repartition(7)).collect()}
    want = {m: hashlib.sha256("".join(f"text {m} {i}\0" for i in range(40) if i != 5).encode()).hexdigest() for m in ("a", "b", None)}
    assert got == want


def test_a_question_is_sent_once_it_says_something(spark):
    rows = [(" qué \n", False), ("  ", False), ("x", True), ("\ufeff y", None), (None, False)]
    got = spark.createDataFrame(rows, "q string, busy boolean").select(answers.to_send(F.col("q"), F.col("busy")).alias("s")).collect()
    assert [r.s for r in got] == ["qué", None, None, "y", None]


@pytest.mark.parametrize("partitions", ["3", "13"])
def test_places_of_one_key_that_holds_most_rows(spark, partitions, monkeypatch):
    """No task sorts a whole key: ranges of it are numbered apart. Nulls are keys, and values that repeat take places beside each other."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(50), n) for n in range(4000)]
    before, dealt = spark.conf.get("spark.sql.shuffle.partitions"), []
    write = ranking.stored
    monkeypatch.setattr(ranking, "stored", lambda d: dealt.append(write(d)) or dealt[-1])
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "k string, v int, n int").repartition(5)
        ranked = ranking.ranked(frame, ["k"], [F.desc("v"), "n"])
        got = {(r.k, r.v, r.n): r.place for r in ranked.collect()}
        assert ranking.ranked(frame.where("1 = 0"), ["k"], ["v"]).count() == 0
        spread = dealt[0].where("k = 'hot'").select("_range").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for k in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r] = place
    assert got == want and spread > 1


def test_many_searches_equal_a_scan_for_each(spark):
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("abA. ") for _ in range(rng.randint(0, 5)))
    rows = spark.createDataFrame([(part(), "Uno " + part(), str(2000 + i % 7), "06.22") for i in range(150)], "brand string, model string, year string, edition string")
    asked = [(i, q) for i, q in enumerate(["", "   ", None, "uno", "UNO (2003)", "a", "ab", "aba", "aaaa b", "no such thing", "06.22 2001 u", "2 2 2", "éé", *(part() + " " + part() for _ in range(40))])]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    index = catalogue.search_index(rows)
    for meet in (1, 3):
        got = sorted((r.query_id, r.brand, r.model, r.year) for r in catalogue.search_many(index, queries, meet).collect())
        want = sorted((i, r.brand, r.model, r.year) for i, q in asked if q is not None for r in catalogue.search(rows, F.lit(q)).collect())
        assert got == want
    assert catalogue.search_many(index, queries.where("1 = 0")).count() == 0


def test_many_alike_searches_are_looked_up_once_and_nothing_large_is_broadcast(spark):
    rows = spark.createDataFrame([("B", f"Uno {i}", "2020", "06.22") for i in range(200)], "brand string, model string, year string, edition string")
    asked = [(i, ("", "b UNO", "uno b", "uno 19")[i % 4]) for i in range(2500)]
    found = catalogue.search_many(catalogue.search_index(rows), spark.createDataFrame(asked, "query_id int, query string"))
    got = {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count_distinct("model").alias("n")).collect()}
    assert got == {i: (200, 200, 200, 12)[i % 4] for i, _ in asked} and found.count() == 625 * 612
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_searches_find_is_small_in_files_and_whole_in_any_blocks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("B", f"Uno {i}", "2020", "06.22") for i in range(60)], "brand string, model string, year string, edition string")
    many = spark.range(40_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "uno").otherwise("uno 59").alias("query"))
    catalogue.search_many(catalogue.search_index(rows), many).select("query_id", "model").write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.count() == found.distinct().count() == 20_000 * 61
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 20_000 * 61 / 2

    for name, n in (("TOGETHER", 3), ("SHARE", 7), ("GROUP", 11), ("TOLD", 200)):
        monkeypatch.setattr(catalogue, name, n)
    asked = [(i, ("", "b UNO", "uno 1", "no such thing", "uno 2 4")[i % 5]) for i in range(200)]
    got = catalogue.search_many(catalogue.search_index(rows), spark.createDataFrame(asked, "query_id int, query string")).select("query_id", "model").collect()
    want = {q: [r.model for r in catalogue.search(rows, F.lit(q)).collect()] for _, q in asked}
    assert sorted(map(tuple, got)) == sorted((i, m) for i, q in asked for m in want[q])


def clustered(rng, centres, n, dims, spread):
    at = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [[c + rng.gauss(0, spread) for c in at[i % centres]] for i in range(n)]


@pytest.mark.parametrize("unit_length", [True, False])
def test_pruned_search_is_exact(spark, unit_length):
    rng = random.Random(3)
    made = [(m, i, v) for m, n in (("big", 1500), ("small", 3), ("one", 1)) for i, v in enumerate(clustered(rng, 12, n, 16, 0.1))]
    made += [("big", 1500 + i, made[i][2]) for i in range(4)] + [("big", 1600, [0.0] * 16)]  # ties, and a vector without a direction
    index = spark.createDataFrame(made, "manual_id string, ord int, vector array<double>")
    index = vectors.normalised(index) if unit_length else index
    asked = [(q, m, v) for q, (m, v) in enumerate([("big", made[i][2]) for i in range(0, 60, 5)] + [("big", [rng.gauss(0, 1) for _ in range(16)]), ("small", made[0][2]), ("one", made[1][2]), ("none", made[1][2]), ("big", [0.0] * 16)])]
    questions = spark.createDataFrame(asked, "question_id int, manual_id string, vector array<double>")
    rows, blocks = vectors.in_blocks(index)
    found = vectors.top_k_pruned(rows, blocks, questions, 5).collect()
    want = vectors.top_k_batch(index, questions, 5).collect()
    assert sorted((r.question_id, r["rank"], r.ord) for r in found) == sorted((r.question_id, r["rank"], r.ord) for r in want)
    read = {r.question_id: r.read for r in found}
    assert len(read) == len(asked) - 1 and max(read[q] for q in range(12)) < 0.5 and all(0 < v <= 1 for v in read.values())


def test_pieces_of_any_shape_are_read(spark):
    bodies = ['{"candidates":[{"content":{"parts":[{"text":"a"},{"inline":{"x":[1]}},{"text":"b"}]},"finishReason":"STOP","odd":[[1],{}]}],"usageMetadata":{"totalTokenCount":7,"more":{}}}', "not json", "", None, "[]", '{"candidates":[]}', '{"candidates":"none"}', '{"candidates":[{"content":{"parts":"x"}}],"usageMetadata":3}']
    frame = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = [tuple(r.s) for r in frame.select("i", answers.spoken(F.col("body")).alias("s")).orderBy("i").collect()]
    assert got == [("ab", "STOP", 7)] + [("", None, None)] * 7
    waits = ['{"error":{"details":[{"@type":"t/Help","links":[{"url":"x"}]},7,{"@type":{"odd":1}},{"@type":"t/RetryInfo","retryDelay":"59s"}]}}', '{"error":{"details":"no"}}', "<html>", None, '{"error":{"details":[{"@type":"t/RetryInfo","retryDelay":{"s":1}}]}}', '{"error":{"details":[{"@type":"t/RetryInfo"}]}}', '{"error":{"details":[{"@type":"t/RetryInfo","retryDelay":"1.5s"}]}}']
    frame = spark.createDataFrame(list(enumerate(waits)), "i int, body string")
    assert [r.w for r in frame.select("i", answers.asked_wait(F.col("body")).alias("w")).orderBy("i").collect()] == [60.0, None, None, None, None, None, 2.5]
    lines = spark.createDataFrame([("data: a",), ("  data:b \r",), (": data: c",), ("",), (None,), ("\tdata:",)], "line string")
    assert sorted(r.body for r in answers.sse_bodies(lines).collect()) == ["", "a", "b"]


def test_requests_meet_files_and_never_leave_their_folder(spark):
    get = {
        "/api/catalog?x=1": ("catalog", 200, None, None),
        "/api/figure/m/p1.jpg": ("figure", 200, "m/p1.jpg", None),
        "/api/figure/m/./x/../p1.jpg?y": ("figure", 200, "m/p1.jpg", None),
        "/api/figure/m//p1.jpg": ("figure", 404, None, "no figure"),
        "/api/figure//m/p1.jpg": ("figure", 200, "m/p1.jpg", None),  # an empty step
        "/api/figure/../figures/m/p1.jpg": ("figure", 404, None, "no figure"),
        "/api/figure/m/../../secret": ("figure", 404, None, "no figure"),
        "/api/figure/m/none.jpg": ("figure", 404, None, "no figure"),
        "/api/figure/": ("figure", 404, None, "no figure"),
        "/api/other": ("none", 404, None, "no route"),
        "/": ("file", 200, "index.html", None),
        "/deep/place": ("file", 200, "index.html", None),
        "/assets/../app.js": ("file", 200, "app.js", None),
        "/../../etc/passwd": ("file", 200, "index.html", None),
        None: ("file", 200, "index.html", None),
    }
    post = {
        ("/api/ask", '{"manual":"m","question":"q"}'): ("ask", 200, "m", None),
        ("/api/ask/stream?z", '{"manual":"m","question":"q","k":"7"}'): ("ask_stream", 200, "m", None),
        ("/api/ask", '{"manual":"m"}'): ("ask", 400, None, "bad fields"),
        ("/api/ask", '{"manual":"m","question":"q","k":"many"}'): ("ask", 400, None, "bad fields"),
        ("/api/ask", "[1]"): ("ask", 400, None, "bad fields"),
        ("/api/ask", None): ("ask", 400, None, "bad fields"),
        ("/api/ask", "no json"): ("ask", 400, None, "bad body"),
        ("/api/ask", '{"manual":"m","question":"' + "q" * 70_000 + '"}'): ("ask", 400, None, "bad body"),
        ("/api/none", '{"manual":"m","question":"q"}'): ("none", 404, None, "no route"),
        ("/api/none", "no json"): ("none", 400, None, "bad body"),
    }
    rows = [("GET", p, None) for p in get] + [("POST", p, b) for p, b in post] + [("PUT", "/", None)]
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, method string, path string, body string")
    figures_, files = spark.createDataFrame([("m", "p1.jpg")], "manual_id string, file string"), spark.createDataFrame([("index.html",), ("app.js",)], "path string")
    got = [tuple(r) for r in routes.routed(requests, figures_, files).orderBy("id").select("route", "status", "target", "error").collect()]
    assert got == [*get.values(), *post.values(), ("none", 501, None, "no method")]
    kinds = {r.path: r.kind for r in routes.routed(requests, figures_, files).where("method = 'GET'").collect()}
    assert kinds["/assets/../app.js"].startswith("text/javascript") and kinds["/api/figure/m/p1.jpg"] == "image/jpeg" and kinds["/"].startswith("text/html")
    assert routes.routed(requests, figures_, files.where("1 = 0")).where("path = '/'").first().error in ("no file", "no method")
    assert [r.k for r in requests.limit(0).union(requests.where("method = 'POST'")).orderBy("id").select(routes.asked_for(F.col("body")).alias("k")).limit(2).collect()] == [5, 7]

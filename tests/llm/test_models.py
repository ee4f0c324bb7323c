import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import langid, lines, neighbours, toxicity
from passagework.llm.queries import op2_line_dedup


def spoken(n=300):
    rng = random.Random(5)
    roots = {"aa": ["tion", "the", "ing", "wh"], "bb": ["schö", "ung", "lich", "ver"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(roots))
        rows.append((i, " ".join("".join(rng.choices(roots[lang], k=2)) for _ in range(rng.randint(3, 40))), lang if i % 7 else None))
    return rows


def test_language_accuracy_and_rejection(spark):
    rows = [*spoken(), (900, None, "aa"), (901, "", "bb"), (902, "123 !!", None), (903, "漢字漢字漢字", None), (903, "漢字漢字漢字", None), (None, "tionthe ingwh", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where(langid.fold(docs.doc_id) != 2)
    model = langid.train(train, "doc_id", "text", "lang", clusters=3)
    got = langid.identify(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    known = [(i, lang) for i, _, lang in spoken() if lang]
    assert np.mean([by[i].lang_pred == lang for i, lang in known]) > 0.98
    assert not any(by[i].rejected for i, _ in known)
    for i in (900, 901, 902):
        assert by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0
    assert by[903].rejected and by[903].lang_pred in ("aa", "bb")


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, "doc_id", "text", "lang")
    assert langid.identify(docs, model).first().lang_pred == "und"


def maximal(scores):
    """All maximal scoring runs: the best run, then the same to its left and right."""

    def best(a, b):
        top = None
        for i in range(a, b):
            t = 0
            for j in range(i, b):
                t += scores[j]
                if t > 1e-12 and (top is None or (t, i - j) > (top[2], top[0] - top[1] + 1)):  # of equal runs the shortest
                    top = (i, j + 1, t)
        return [] if top is None else [*best(a, top[0]), top, *best(top[1], b)]

    return best(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, 3, 5, 2.5, 4.25]), max_size=24))
def test_segments_equal_brute_force(scores):
    got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
    assert got == toxicity.segments(list(enumerate(scores)), 1.0)  # scores below zero may be told or not
    want = maximal(scores)
    assert abs(sum(s for *_, s in got) - sum(s for *_, s in want)) < 1e-9
    assert sorted(s for *_, s in got) == sorted(s for *_, s in want)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(vocabulary, k=rng.randint(20, 90))
        bad = i % 4 == 0
        for _ in range(rng.randint(2, 4) * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "scum", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "... !!"), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:600] + [(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = labels[600:]
    assert np.mean([(got[i].score >= 0.3) == bool(y) for i, y in held]) > 0.95
    assert got[2000].score < 0.3 and got[2001].passages == []
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).scores == {}


def dedup_by_force(rows, block):
    """op2 by plain dictionaries: units by one pass over characters, the first place of each, blocks by a flag for each character."""
    first, units = {}, []
    for doc, text in sorted({(d, t or "") for d, t in rows}):
        whole, at = [], 0
        for line in text.split("\n"):
            whole.append((at, at + len(line)))
            at += len(line) + 1
        found, run = [], []
        for s, e in [*whole, (len(text), len(text))]:
            if not text[s:e].strip():
                if sum(bool(plain(text[x:y])) for x, y in run) > 1:
                    found.append((run[0][0], run[-1][1]))
                run = []
                continue
            run.append((s, e))
            found.append((s, e))
            cuts, k = [s], s
            while k < e:
                ends = text[k] in ".!?" and (k + 1 < e and text[k + 1].isspace()) or text[k] in "。！？｡" and not (k + 1 < e and text[k + 1] in "。！？｡")
                k += 1
                if ends:
                    while text[k - 1] in "。！？｡」』”’）" and k < e and text[k] in "」』”’）":
                        k += 1
                    cuts.append(k)
            for x, y in zip(cuts, [*cuts[1:], e], strict=True):
                if (own := plain(text[x:y])) and own != plain(text[s:e]):
                    x += len(text[x:y]) - len(text[x:y].lstrip())
                    found.append((x, x + len(text[x:y].rstrip())))
        for s, e in found:
            if u := plain(text[s:e]):
                place = (doc, text, s)
                first[u] = min(first.get(u, place), place)
                units.append((u, place, e))
    out = {}
    for doc, text in rows:
        text = text or ""
        flag = np.zeros(len(text), bool)
        for u, (d, t, s), e in units:
            if (d, t) == (doc, text) and first[u] != (d, t, s):
                flag[s:e] = True
        kept, k = [], 0
        while k < len(text):
            if not flag[k]:
                kept.append(text[k])
                k += 1
                continue
            e = k
            while e < len(text) and (flag[e] or text[e].isspace() and any(flag[e:]) and text[e : e + int(flag[e:].argmax())].isspace()):
                e += 1
            if lines.weight(text[k:e]) < block:
                kept.append(text[k:e])
            k = e
        out[doc] = "".join(kept)
    return out


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def test_line_dedup_equals_brute_force(spark, documents, awkward):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(["one", "two", "three", "four", "five", "甲乙丙"]) for _ in range(rng.randint(1, 6))) for _ in range(14)]
    rows = [r for r in awkward if r[0] not in (4, 7, None)]
    for i in range(60):
        text = "".join(rng.choice(pool) + rng.choice([". ", "\n", "! ", "\n\n", "... ", "。", " "]) for _ in range(rng.randint(1, 9)))
        rows.append((100 + i, text))
    for block in (1, 6, 12):
        got = {r.doc_id: (r.kept, r.n_removed, r.n_chars) for r in lines.dedup_lines(documents(rows), block=block).collect()}
        want = dedup_by_force(rows, block)
        assert got == {i: (want[i], len(t or "") - len(want[i]), len(t or "")) for i, t in rows}


def test_line_dedup_keeps_the_first(spark, documents, awkward):
    line = "one two three four five six seven eight nine."
    rows = [*awkward, (30, f"start here\n{line}\nend"), (31, f"{line.upper()}\nother"), (32, f"An own sentence stands here for good measure now. {line} And then another one that is new to all."), (33, "short line\nshort line")]
    got = {r.doc_id: r for r in lines.dedup_lines(documents(rows), block=5).collect()}
    assert got[30].n_removed == 0 and got[30].kept == rows[-4][1]
    assert got[31].kept == "\nother" and [tuple(s) for s in got[31].spans] == [(0, len(line))]
    assert line not in got[32].kept and got[32].kept.startswith("An own")
    assert got[33].n_removed == 0 and got[1].kept == "" and got[1].n_chars == 0
    assert lines.dedup_lines(documents([])).count() == 0
    told = {r.doc_id: r for r in lines.dedup_lines(documents([(1, "a short line\none two three four five six"), (2, "A SHORT line\nown words\none two three four five six")]), block=6).collect()}
    text = "A SHORT line\nown words\none two three four five six"
    assert [text[s.start : s.stop] for s in told[2].spans] == ["one two three four five six"] and [text[s.start : s.stop] for s in told[2].short] == ["A SHORT line"]
    assert not told[1].spans and not told[1].short


def test_line_query_cuts_passages_and_leaves_stock_phrases(spark, documents, tmp_path):
    verse = "\n".join(f"roses {c} red\nviolets {c} blue\nsugar sweet" for c in "abcdefg")
    rows = [(1, f"{verse}\nfirst. Yes."), (2, f"second\n{verse}"), (3, f"Third here. {verse.replace(chr(10), ' ')} Yes."), (4, "---\n---"), (5, "甲乙丙，丁戊。" + "己庚辛" * 9 + "！"), (6, "新的一句。" + "己庚辛" * 9 + "！"), (9, "Yes. A new one."), (10, "Another. Yes.")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    kept = {i: t for i, t in rows} | {2: "second\n", 6: "新的一句。"}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert got[2].n_spans == 1 and got[4].n_removed == 0


def time_of(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def grows_linearly(f, make, n):
    f(make(n))
    return min(time_of(f, make(4 * n)) for _ in range(2)) < 6 * max(min(time_of(f, make(n)) for _ in range(3)), 0.01)


def test_hostile_texts_take_linear_time():
    assert grows_linearly(lambda t: list(lines.units_of(t)), lambda n: "." * n, 50_000)
    assert grows_linearly(lambda t: list(lines.units_of(t)), lambda n: "a. " * n, 5_000)
    assert grows_linearly(lambda h: toxicity.segments(h, 0.1), lambda n: [(100 * i, 1.0) for i in range(n)], 12_500)
    assert grows_linearly(lambda h: toxicity.segments(h, 0.1), lambda n: [(i, 1.0 if i % 2 else -0.5) for i in range(n)], 12_500)


def test_toxicity_score_equals_brute_force():
    model = toxicity.Model({"vile": 4.0, "scum": 2.5, "fine": -1.0}, drift=0.2, decay=1.1, size=0.02, bias=-3.0, slope=1.7)
    rng = random.Random(1)
    for _ in range(200):
        words = rng.choices(["vile", "scum", "fine", "other", "more"], weights=[1, 1, 3, 20, 20], k=rng.randint(0, 40))
        total = 0.0
        for _, _, s in maximal([model.scores.get(w, -model.drift) for w in words]):
            p = 1 - math.exp(-model.size * max(len(words), 1) * math.exp(-model.decay * s))
            total += -math.log(p) if p < 0.5 else 0.0
        want = 1 / (1 + math.exp(-(model.bias + model.slope * math.log1p(total))))
        assert abs(model.probability(model.evidence(" ".join(words))[0]) - want) < 1e-9


def test_toxicity_and_language_of_awkward_rows(spark, documents, awkward):
    docs = documents(awkward)
    scored = toxicity.score_toxicity(docs, toxicity.Model({"word": 5.0}, slope=1.0)).collect()
    assert len(scored) == len(awkward) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(documents([]), toxicity.Model()).count() == 0
    model = langid.train(docs.selectExpr("*", "'xx' as lang"), "doc_id", "text", "lang")
    got = langid.identify(docs, model).collect()
    assert len(got) == len(awkward) and {r.lang_pred for r in got} <= {"xx", "und"}
    assert langid.identify(documents([]), model).count() == 0
    empty = langid.train(documents([]).selectExpr("*", "'xx' as lang"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_prediction_equals_brute_force():
    rng = np.random.default_rng(3)
    texts = [t for _, t, _ in spoken(40)] + ["", None, "123 !!", "ä" * 5000]
    idf = 1 + rng.random(langid.SLOTS).astype(np.float32)
    model = langid.Model(["aa", "aa", "bb"], langid.vectors(texts[:3], idf), idf, np.full((3, langid.CLASSES), 0.3))
    for t, lang, score, far in zip(texts, *model.predict(texts), strict=True):
        grams = Counter()
        raw = f" {(t or '').lower()} ".encode()
        clean = [c if 97 <= c <= 122 or c >= 128 else 32 for c in raw]
        for a, b, c in zip(clean, clean[1:], clean[2:]):
            if b != 32:
                grams[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20] += 1
        x = np.zeros(langid.SLOTS)
        for slot, n in grams.items():
            x[slot] = math.log1p(n) * idf[slot]
        cos = model.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        if any(c.isalpha() for c in t or ""):
            assert lang == model.languages[int(cos.argmax())] and abs(score - max(cos.max(), 0)) < 1e-5 and far == bool(cos.max() <= 0.3)
        else:
            assert (lang, score, far) == ("und", 0.0, True)


def test_language_rejects_long_text_of_no_known_language(spark):
    rng = random.Random(9)
    say = lambda roots, n: " ".join("".join(rng.choices(roots, k=2)) for _ in range(n))
    known = {"aa": ["tion", "the", "ing", "wh"], "bb": ["schö", "ung", "lich", "ver"]}
    rows = [(i, say(known[lang], rng.choice([4, 12, 40, 400])), lang) for i, lang in enumerate(["aa", "bb"] * 150)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", clusters=3)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=6000))
    italian = say(["zione", "gli", "che", "per", "una", "ell"], 500)
    assert model.predict([letters, italian])[2] == [True, True]
    assert not any(model.predict([say(known[lang], n) for lang in known for n in (4, 12, 40, 400, 900)])[2])


def test_neighbours_of_clustered_vectors_probe_under_half_of_the_parts(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 12_000)] + 0.3 * rng.normal(size=(12_000, 16))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search_nearest(vectors, sample=2000).collect():
        got.setdefault(r["query"], set()).add(r["id"])
        assert r["probed"] < 0.5
    found = 0
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(ids & set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()))
    assert len(got) == 600 and found / (20 * 600) >= 0.9


def test_filing_is_balanced():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(900, 8)) * 0.2 + 2, rng.normal(size=(100, 8))])
    router, _ = neighbours.fit(x, 8, 10, 0.9)
    load = np.bincount(router.ranked(x)[:, 0], minlength=8)
    assert load.max() <= 2 * len(x) / 8


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    x[100:400] = x[0]  # copies: ties by id
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0]), (None, [1.0] * 16), (9080, [None] + [1.0] * 15), (0, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search_nearest(vectors, sample=1500).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["score"])
    assert set(got) == set(range(0, 3000, 20))
    found = 0
    for q, answer in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        ids = [answer[k][0] for k in range(1, 21)]
        assert q not in ids and len(set(ids)) == 20
        assert np.allclose([answer[k][1] for k in range(1, 21)], s[ids])
        found += len(set(ids) & set(want.tolist()))
    assert found / (20 * len(got)) >= 0.9
    assert [got[0][k][0] for k in range(1, 4)] != [] and neighbours.search_nearest(vectors.where("1 = 0")).count() == 0


def test_neighbours_over_two_levels_of_parts(spark):
    """An index that wants more parts than one sample can teach: parts are cut again, each in a task of its own."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 4
    x = centres[rng.integers(60, size=4000)] + rng.normal(size=(4000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(4000 + i, x[i].tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    whole = np.concatenate([x, x[:50]])
    got, share = {}, set()
    for r in neighbours.search_nearest(vectors, sample=640, part_size=25, block=60, query_block=20).collect():
        got.setdefault(r.query, {})[r.rank] = (r.id, r.score)
        share.add(r.probed)
    asked = range(0, 4050, 20)
    assert set(got) == set(asked) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    hits = 0
    for q in asked:
        s = whole @ whole[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        hits += len(best & {i for i, _ in got[q].values()})
        assert all(abs(score - s[i]) < 1e-9 for i, score in got[q].values())
        assert [got[q][k][1] for k in range(1, 21)] == sorted((got[q][k][1] for k in range(1, 21)), reverse=True)
    assert hits / (20 * len(asked)) > 0.9 and len(share) == 1 and 0 < share.pop() < 0.6

"""Each registered query over small whole tables: its contract's columns, a row for each input row, and the pipeline's decisions."""

import random

import pytest

import corpus_pipeline
from passagework.llm import secrets
from passagework.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_learned_partitions": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_line_dedup": {"doc_id": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_mixing": {"doc_id": "bigint", "tokens": "bigint", "p": "double", "kept": "boolean"},
    "op11_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op12_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op13_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("tables"))
    roots = {"en": ["the", "ing", "wh", "and"], "de": ["schö", "ung", "lich", "ver"]}
    say = lambda lang, n: " ".join("".join(rng.choices(roots[lang], k=rng.randint(1, 4))) for _ in range(n))
    item = say("en", 40)
    docs = []
    for i in range(160):
        lang = rng.choice(list(roots))
        docs.append((i, say(lang, rng.randint(60, 200)), lang if i % 9 else None, f"src{i % 3}"))
    text = [t for _, t, _, _ in docs]
    text[10] = text[5] + " more"  # a near copy
    text[11] = text[6]  # a copy
    text[20] = say("en", 10) + " " + item + " " + say("en", 10)
    text[30] += ' token = "0123456789abcdef"'
    text[40], text[41], text[42] = None, "", "12345 !!"
    docs = [(i, t, lang, s, len(t or "")) for (i, _, lang, s), t in zip(docs, text, strict=True)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(1, item), (2, say("de", 30))], "item_id long, text string", "benchmark")
    write([(i, i % 2, int(i % 5 == 0)) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int", "labels")
    write([(i, f"https://a.example.com/en/{i}", "") for i in range(30)], "page_id long, url string, html string", "pages")
    write([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(200)], "vec_id long, embedding array<float>, label int", "embeddings")
    return d


def test_every_operator_has_a_query():
    assert set(COLUMNS) == set(QUERIES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, tables, name):
    out = QUERIES[name](spark, tables)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    if name == "op11_spelling_variants":  # a row for each word
        assert out.count() == out.select("word").distinct().count() > 0
        return
    if name == "op13_best_fit_packing":  # a row for each piece
        out = out.where("piece = 0")
    want = {"op1_learned_partitions": 200, "op8_url_filter": 30}.get(name, 160)
    assert out.count() == want


def test_pipeline_decisions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    named = kept["language_id"]
    assert not {40, 41, 42} & set(named) and len(named) == 157 and all(r.lang for r in named.values())
    single = kept["near_duplicates"]
    assert set(named) - set(single) == {10, 11}
    clean = kept["decontaminate"]
    assert set(single) - set(clean) == {20}
    safe = kept["redact_secrets"]
    assert set(safe) == set(clean) and "[SECRET]" in safe[30].text and "0123456789abcdef" not in safe[30].text
    assert all(r.n_chars == len(r.text) for r in safe.values())
    mixed = kept["mix_sources"]
    assert 0 < len(mixed) < len(safe) and all(mixed[i].text == safe[i].text for i in mixed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == set(mixed)


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _key string, kept string, _lang string, tokens string, key string, component_id string, copies string, row string"


def awkward_table(spark, awkward, times=1):
    rows = [*awkward, *((20 + i, f"{'these are the words of a text that is long enough for shingles and more ' * 2}{i % 3}") for i in range(9)), (5, "another text under an id that is there already, quite unlike the other one")]
    mine = [(i, t, ["en", None][k % 2], [None, "s"][k % 2], len(t or ""), *"abcdefgh") for k, (i, t) in enumerate(rows)] * times
    return spark.createDataFrame(mine, NAMES)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_awkward_rows_and_names(spark, tables, awkward, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = awkward_table(spark, awkward)
    out = run(spark, docs, tables)
    rows = out.collect()
    if stage == "mix_sources":
        assert out.columns == [*(c for c in docs.columns if c != "tokens"), "tokens", "p"]
        assert {r.kept for r in rows} <= {"b"}
    else:
        assert out.schema.simpleString() == docs.schema.simpleString() and {r._key for r in rows} <= {"a"}
    texts = [(r.doc_id, r.text) for r in rows]
    if stage == "near_duplicates":
        assert texts.count((4, "word")) == 1 and sum(i == 5 for i, _ in texts) == 2
        assert [i for i, _ in texts if i is not None and i >= 20] == [20] and len(texts) == len(awkward) - 1 + 1 + 1
        assert sorted((r.doc_id or -1, r.text) for r in run(spark, awkward_table(spark, awkward, 3).where("trim(text) <> ''"), tables).collect() if r.text.strip()) == sorted((i or -1, t) for i, t in texts if (t or '').strip())
    elif stage in ("decontaminate", "redact_secrets"):
        assert len(texts) == docs.count()
    assert run(spark, docs.where("1 = 0"), tables).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tables):
    """Near duplicates and decontamination against sets of words, redaction against the scan's spans."""
    from test_joins import brute, hits

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    roots = brute(rows)
    assert {r.doc_id for r in stages["near_duplicates"](spark, docs, tables).collect()} == {i for i, (_, root) in roots.items() if i == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = {i for i, (n, hit, _) in hits(rows, items).items() if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in stages["decontaminate"](spark, docs, tables).collect()} == clean
    auto = secrets.automaton()
    for r in stages["redact_secrets"](spark, docs, tables).collect():
        text = dict(rows)[r.doc_id]
        covered = set()
        for _, s, e in secrets.spans_of(text or "", auto):
            covered |= set(range(s, e))
        assert (r.text or "").replace("[SECRET]", "") == "".join(c for k, c in enumerate(text or "") if k not in covered)

import random
import re
from itertools import combinations

import numpy as np
import pytest

from passagework.llm import ngram_join
from passagework.llm.decontamination import find_contamination
from passagework.llm.graph import components
from passagework.llm.ngram_join import near_duplicates, representatives, shingle_sets
from test_suffix import corpus


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    return out


def brute(rows):
    sets, root = sets_of(rows), {}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near(seed, n=80):
    import random

    rng = random.Random(seed)
    rows = []
    for g in range(6):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(rng.choice([3, 5, 12, 60, 150]))]
        for _ in range(n // 6):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            rows.append((len(rows), "\t ".join(w).upper() if rng.random() < 0.5 else " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, documents, seed):
    rows = near(seed) + [(1000 + i, t) for i, t in corpus(seed)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_near_duplicates_of_awkward_rows(spark, documents, awkward):
    got = near_duplicates(documents(awkward)).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_shingles, by[1].component_id) == (0, 1) and by[2].component_id == 2
    assert by[4].component_id == 4 and by[7].n_shingles == 1
    assert by[None].component_id is None
    assert near_duplicates(documents([])).count() == 0


def test_a_hash_of_many_rows_is_counted_alike_in_any_parts(spark, documents):
    # A passage that all documents share, which are otherwise different: more rows in a part than go out one by one.
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(4 + i % 5)) + " " + shared) for i in range(120)]
    sets = sets_of(rows)
    for flush in (600_000, 200):
        got = {r.doc: r for r in shingle_sets(documents(rows).repartition(2), "doc_id", "text", flush=flush).collect()}
        assert {i: r.n for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        able = {i for i, s in sets.items() if 26 >= (4 * len(s) + 4) // 5}
        assert {i for i, r in got.items() if r.tokens is not None} == able and {len(got[i].tokens) for i in able} == {26}
        assert len({tuple(got[i].tokens) for i in able}) == 1
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows).repartition(2)).collect()}
    assert found == brute(rows)


def test_representatives_keep_texts_that_share_an_id(spark, documents):
    a, z, q = (" ".join(f"{c}{i}" for i in range(20)) for c in "azq")
    rows = [(1, a), (5, a), (5, z), (7, q), (7, q + " more"), (7, q), (8, None), (8, None), (9, ""), (None, a + " end"), (None, None)]
    docs = documents(rows)
    kept = representatives(docs).collect()
    text = {r.key: r.text for r in docs.selectExpr("xxhash64(text) as key", "text").collect()}
    got = sorted(((r.doc or -1), text[r.key] or "", r.copies) for r in kept)
    assert [g for g in got if g[1]] == sorted([(-1, a + " end", 1), (5, z, 1), min([(7, q, 2), (7, q + " more", 1)], key=lambda x: [k for k, v in text.items() if v == x[1]])])
    assert [g for g in got if not g[1]] == [(-1, "", 1), (8, "", 1), (9, "", 1)]


def test_graph_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), most=2)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def hits(rows, items):
    out = {}
    for i, t in rows:
        w, covered, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    covered |= set(range(j, j + n))
                    found.add(str(item))
        out[i] = (len(w), len(covered), sorted(found))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination_equals_brute_force(spark, documents, awkward, short):
    a = [f"w{i}" for i in range(60)]
    b = ["the", "same"] * 20
    items = [(1, " ".join(a[:30])), (2, "; ".join(b)), (12, " ".join(a[20:50]).upper()), (3, None), (5, " ... ")]
    items += [(7, "ein kurzes Stück"), (8, "word")] if short else []
    rows = [
        *{i: (i, t) for i, t in awkward if i is not None}.values(),
        (20, "before " + " ".join(a[10:40]) + " after"),
        (21, " ".join(a[:12]) + " gap " + " ".join(a[12:24])),
        (22, " ".join(a[5:18])),
        (23, "x " * 300 + ", ".join(b[:14])),
        (24, "Das ist EIN kurzes stück. Ein Kurzes Stück, sage ich."),
        (25, "das ist ein kurzes stück"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in find_contamination(documents(rows), bench).collect()}
    assert got == hits(rows, [x for x in items if x[1]])
    shuffled = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in find_contamination(documents(rows), bench, broadcast_bytes=0).collect()}
    assert shuffled == got


def test_contamination_of_empty_tables(spark, documents, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_contamination(documents(awkward), none).collect()} == {0}
    assert find_contamination(documents([]), none).count() == 0


def test_long_shared_text_takes_linear_time(spark, documents):
    import time

    def took(n):
        text = " ".join(f"w{i}" for i in range(n))
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        began = time.time()
        (row,) = find_contamination(documents([(1, text)]), bench).collect()
        assert (row.n_words, row.n_hit) == (n, n)
        return time.time() - began

    took(50)
    assert took(20_000) < 6 * max(took(5_000), 1.0)


def test_stock_paragraphs_are_told_apart_before_hashes_are_fetched(spark, documents, monkeypatch):
    """Texts of 20 paragraphs out of 60 share many rare shingles without being copies: pairs to be verified grow with the texts, not with their square."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=6))
    stock = [" ".join(word() for _ in range(25)) for _ in range(60)]
    verified = []
    check = ngram_join._linked

    def counted(pairs, nodes):
        verified[-1] += pairs.count()
        return check(pairs, nodes)

    monkeypatch.setattr(ngram_join, "_linked", counted)
    for n in (150, 300):
        rows = [(i, " ".join(rng.sample(stock, 20))) for i in range(n)]
        rows += [(n + i, t + " and some words more") for i, (_, t) in enumerate(rows[:20])] + [(900 + i, t) for i, (_, t) in enumerate(rows[20:30])]
        verified.append(0)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(rows)).collect()}
        assert got == brute(rows)
    assert verified[1] <= 2.2 * verified[0] and verified[1] < 3 * 300


def test_parities_never_rule_out_a_link():
    rng = random.Random(2)
    for _ in range(200):
        a = {rng.getrandbits(62) for _ in range(rng.randint(1, 3000))}
        b = set(rng.sample(sorted(a), rng.randint(0, len(a)))) | {rng.getrandbits(62) for _ in range(rng.randint(0, 500))}
        x, y = (np.array(sorted(s), np.int64) for s in (a, b))
        if len(x) and len(y):
            apart = sum(bin(int(p) & (2**64 - 1)).count("1") for p in ngram_join.parities(x) ^ ngram_join.parities(y))
            assert apart <= len(a ^ b)

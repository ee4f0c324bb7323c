"""Spelling variants, fill-in-the-middle and packing against brute force, on awkward rows, empty tables and long texts."""

import binascii
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from passagework.llm import infilling, packing, spelling
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Spelling variants


def words_of(rows, one_in=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = binascii.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_variants(rows, one_in=199):
    n = words_of(rows, one_in)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w] and max(n[v] for v in near[w]) >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def variant_rows(seed=3):
    rng = random.Random(seed)
    base = ["receive", "separate", "garçonné", "wörterbuch", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "straßé×÷", "ÀÉÎÕÜÿ"]

    def typo(w):
        k, c = rng.randrange(len(w)), rng.choice("aeiouxéß")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    pool = [w for w in base for _ in range(60)] + [v for w in base for v in [typo(w) for _ in range(6)] for _ in range(rng.randint(1, 9))]
    return [(i if i % 11 else None, ", ".join((w.upper() if rng.random() < 0.1 else w) for w in rng.choices(pool, k=90))) for i in range(60)] + [(7, "long and short words " * 3000)]


@pytest.mark.parametrize(("one_in", "shard", "size"), [(199, 50_000, 16 << 20), (5, 7, 300), (5, 1, 1)])
def test_variants_equal_brute_force(spark, documents, awkward, one_in, shard, size):
    """Also with many small tries in many rounds."""
    rows = variant_rows() + awkward
    got = spelling.variants(documents(rows), one_in=one_in, shard=shard, broadcast_bytes=size).collect() if shard > 1 else spelling.variants(documents(variant_rows()[:6]), one_in=one_in, shard=shard, broadcast_bytes=size).collect()
    want = brute_variants(rows if shard > 1 else variant_rows()[:6], one_in)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want) > 5
    assert one_in == 5 or shard == 1 or any(form for _, _, form, _, _ in want.values())


def test_variants_of_nothing(spark, documents):
    assert spelling.variants(documents([]).where("1 = 0")).count() == 0
    assert spelling.variants(documents([(1, None), (2, ""), (3, "few words only")])).count() == 0


def test_roots_follow_long_ways(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("x", "w20")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w21" for w, _ in links}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abcß", min_size=1, max_size=7), min_size=1, max_size=40), st.text("abcß", max_size=8))
def test_trie_finds_all_near_words(words, word):
    words = sorted(words)
    trie = spelling.Trie.unpacked(spelling.Trie(words, list(range(len(words)))).packed())
    for w in (word, *words[:5]):
        assert {trie.words[k] for k in trie.near(w)} == {v for v in words if edits(v, w) == 1}


# Fill-in-the-middle


def brute_middle(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def test_middle_equals_brute_force(spark, documents, awkward):
    rng = random.Random(2)
    rows = awkward + [(100 + i, "".join(rng.choices("abZ <>PSM\né\U0001d11e\0", k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, "a <P> mark"), (901, "marks <P<S>"), (902, "<"), (903, "x<" * 50), (904, "word " * 300_000), (-5, "below zero"), (1 << 62, "large")]
    made = infilling.fill_in_middle(documents(rows))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    told = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)
    assert told == Counter((i, *brute_middle(i, t)) for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert infilling.fill_in_middle(documents([]).where("1 = 0")).count() == 0


# Packing

PATH = packing.public("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["'", "'s", "'ll", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\x1c", "\x85", " ", " ", "1", "23", ".", "!!", "<|endoftext|>", "word", "Wörter", "ł", "é", "漢字", "\U0001d11e", "ª", "×", "\0", "it's", "a'b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.text(max_size=4), max_size=14))
def test_ids_are_the_tokenizers(tokenizer, parts):
    text = "".join(parts)
    want = ids_of(tokenizer, text)
    assert np.frombuffer(packing.token_ids(PATH)(text), "<u4").tolist() == want
    assert np.frombuffer(packing.token_ids(PATH, pieces_repeat=False)(text), "<u4").tolist() == want


def test_long_texts_are_cut_where_no_token_crosses(tokenizer):
    text = "The words of a long text, it's said,\n\n  repeat 12 times. " * 500
    assert "".join(packing.blocks(text, 100)) == text and len(list(packing.blocks(text, 100))) > 100
    assert [i for b in packing.blocks(text, 100) for i in ids_of(tokenizer, b)] == ids_of(tokenizer, text)
    assert list(packing.blocks("x" * 500, 100)) == ["x" * 500] and list(packing.blocks("", 100)) == [""]


def check_packed(rows, tokenizer, packed, room, end=2):
    """Every document's pieces are its ids, cut as they must be, and every sequence is gapless and no longer than its room."""
    placed, docs = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        placed[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, ids))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    want = Counter()
    for i, text in rows:
        ids = [*ids_of(tokenizer, text), end]
        first = (len(ids) - 1) % room + 1
        cuts = [0, *range(first, len(ids) + 1, room)]
        want.update((i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((i, k, start, tuple(ids)) for i, parts in docs.items() for k, start, ids in parts) == want
    return len(placed)


def lengths_rows(n, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta's", "\n12"], k=int(rng.paretovariate(0.9) * 6)))) for i in range(n)]


@pytest.mark.parametrize(("shard", "hold", "rows_broadcast"), [(50_000, 4096, 500_000), (40, 6, 0)])
def test_packing(spark, documents, awkward, tokenizer, shard, hold, rows_broadcast):
    rows = lengths_rows(900) + awkward
    docs = documents(rows).repartition(6)
    packed = packing.pack(docs, PATH, room=64, shard=shard, hold=hold, broadcast_rows=rows_broadcast)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    n = check_packed(rows, tokenizer, packed.collect(), 64)
    total = sum(len(ids_of(tokenizer, t)) + 1 for _, t in rows)
    assert n <= (1.03 if shard > 40 else 1.15) * total / 64 + 2
    joined = packing.sequences(packed).collect()
    assert len(joined) == n and sum(r.length for r in joined) == total
    assert all(len(r.ids) == 4 * r.length == 4 * sum(d.length for d in r.documents) for r in joined)


def test_packing_of_nothing_and_of_one_kind(spark, documents, tokenizer):
    assert packing.pack(documents([]).where("1 = 0"), PATH).count() == 0
    same = [(i, "alpha " * 35) for i in range(300)]  # no two fit into one sequence
    assert check_packed(same, tokenizer, packing.pack(documents(same), PATH, room=64, hold=10, shard=50).collect(), 64) == 300
    full = [(i, "alpha " * 62 + "a") for i in range(5)]
    n = len(ids_of(tokenizer, full[0][1])) + 1
    assert check_packed(full, tokenizer, packing.pack(documents(full), PATH, room=n).collect(), n) == 5


def test_each_piece_goes_where_squares_grow_least():
    """Against the definition: all choices tried, their sums of squares counted."""
    rng = random.Random(9)
    room, gaps = 20, packing.Gaps(20)
    used = {}  # sequence: what it holds
    for _ in range(400):
        size = rng.randint(1, room)

        def squares(held):
            return sum(k * k for k in Counter(room - v for v in held.values() if v < room).values())

        choices = {at: squares(used | {at: v + size}) for at, v in used.items() if v + size <= room}
        best = min([*choices.values(), squares(used | {-1: size})])
        at, offset = gaps.place(size)
        assert used.get(at, 0) == offset and offset + size <= room
        used[at] = offset + size
        assert squares(used) == best
    assert {at for at, v in used.items() if v < room} == set(gaps.still_open())

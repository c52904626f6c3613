"""p6 to p8: tokens, leaks and repetition, against plain versions."""

from __future__ import annotations

import os
import random
import re
import unicodedata

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from siltstone.llm import leaks as L
from siltstone.llm import queries as Q
from siltstone.llm import repetition as R
from siltstone.llm import tokens as K
from siltstone.llm.words import words

# Texts that differ in script, markup and damage.
TEXTS = [
    None,
    "",
    " ",
    "\n\n \t",
    "Hello, world! It's 2024.",
    "'''Bold''' [[a b|c d]] &nbsp;&amp;nbsp; &#65;&#x42;&#99999999; &#00000000000065; <ref name=x>y</ref> a<b>c",
    "日本語のテキスト、中文字符。カタカナ・ヒラガナ",
    "Ünïcödé é ﬁn ﷺ İstanbul ΟΔΟΣ",
    "soft­hyphen zero​width",
    "<|endoftext|> a<|endoftext|>",
    " \x85\x1c\x1f　 x  y   z \r\n",
    "👩‍👩‍👧 flags 🇩🇪",
    "ab" * 3000,
    "!" * 5000,
    " " * 3000 + "x",
]


def plain_words(text):
    """The definition, step by step, without any short way; shares neither code nor tables made from others with ``words``."""
    if text is None:
        return []
    text = re.sub(r"<[^<>]*>", " ", text)
    text = re.sub(r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]", r"\1", text)
    named = {"nbsp": " ", "amp": "&", "quot": '"', "lt": "<", "gt": ">", "ndash": "–", "mdash": "—", "shy": "­"}

    def one(m):
        if m[1]:
            return named[m[1]]
        digits = (m[3] or m[2]).lstrip("0") or "0"
        n = int(digits, 16 if m[3] else 10) if len(digits) < 9 else 0x110000
        return chr(n) if n < 0x110000 and not 0xD800 <= n <= 0xDFFF else m[0]

    text = re.sub(r"&(?:(nbsp|amp|quot|lt|gt|ndash|mdash|shy)|#([0-9]+)|#[xX]([0-9a-fA-F]+));", one, text)
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if not (c in "­⁠﻿" or "​" <= c <= "‍")).lower()
    out, run = [], ""
    for c in text:
        own = "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"
        if not own and unicodedata.category(c)[0] in "LMN":
            run += c
            continue
        if run:
            out.append(run)
            run = ""
        if own:
            out.append(c)
    return [*out, run] if run else out


@pytest.fixture(scope="module")
def tables():
    return K.Tables(K.read_ranks(K.VOCABULARY))


@pytest.fixture(scope="module")
def known(tables):
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tables.tokens)}, special_tokens={})


def test_words_by_definition():
    rng = random.Random(3)
    pieces = ["<", ">", "[[", "]]", "|", "&amp;", "&#x41;", "&#3", ";", "a", "B", "é", "é", "​", "中", "ア", " ", "\n", "ß", "İ", "①", "½", "ﬀ", "\U0001d400", "&lt;", "&#X3a3;", "&#x" + "0" * 5000 + "41;", "&#" + "9" * 5000 + ";", "&#0;", "&#xD800;", "\ud800", "Σ", "'"]
    for low in range(0, 0x110000, 4096):
        every = "\n".join(f"a{chr(c)}B {chr(c)}" for c in range(low, low + 4096))
        assert words(every) == plain_words(every), hex(low)
    assert words("NEA&#X72; BR&#x79;&#109;EDAL") == ["near", "brymedal"]
    for text in [*TEXTS, *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000))]:
        assert words(text) == plain_words(text), text


def test_pieces_merge_exactly(tables, known):
    rng = random.Random(4)
    for _ in range(5000):
        piece = bytes(rng.choice(b"aeinorst \xc3\xa9\xe4\xb8\xad\xff") for _ in range(rng.randint(1, 40)))
        ids = tables.encode_piece(piece)
        assert list(ids) == known._core_bpe.encode_single_piece(piece)
        assert tables.decode(ids).tobytes() == piece


def test_lists_are_decoded_in_parts(tables, monkeypatch):
    texts = [(t or "").encode() for t in TEXTS]
    lists = [list(tables.encode_piece(t)) if t else [] for t in texts]
    flat, ends = np.array([i for x in lists for i in x], dtype=np.int32), np.r_[0, np.cumsum([len(x) for x in lists])]
    for decoded, most in ((1 << 20, 1 << 30), (7, 100), (3, 1)):
        monkeypatch.setattr(K, "DECODED", decoded)
        monkeypatch.setattr(K, "MOST_BYTES", most)
        assert [x.as_py() for part in tables.decode_lists(flat, ends) for x in part] == texts
    assert list(tables.decode_lists(flat[:0], np.zeros(1, dtype=np.int64))) == []


def test_every_token_is_its_own_encoding(tables):
    for i, (a, b) in enumerate(tables.parts):
        assert a == i or tables._stay_apart(a, b) is False


def test_encode_and_decode(spark, known):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = K.encode(df, "doc_id", "text")
    rows = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert rows == {i: known.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in K.decode(got, "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert K.encode(df.limit(0), "doc_id", "text").count() == 0


def test_a_small_memory_changes_nothing(tables, known, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    encoder = K.Encoder(tables)
    for t in TEXTS:
        assert list(encoder.encode(t or "")) == known.encode_ordinary(t or "")


def brute_leaks(docs, items, missing=0):
    found = set()
    for doc, text in docs:
        own = words(text)
        for item, question in items:
            q = words(question)
            size = min(12, len(q))
            if len(q) < 8:
                continue
            for i in range(len(q) - size + 1):
                for j in range(len(own) - size + 1):
                    if sum(a != b for a, b in zip(q[i : i + size], own[j : j + size], strict=True)) <= missing:
                        found.add((doc, item))
    return found


def corpus(rng):
    vocabulary = ["the", "of", "a", *(f"w{i}" for i in range(40))]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 7, 8, 9, 11, 12, 13, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "the " * 15), (103, items[3][1])]
    docs = []
    for d in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            q = words(rng.choice(items)[1])
            lo = rng.randint(0, max(0, len(q) - 12))
            cut = q[lo : lo + rng.choice([11, 12, 20])]
            if cut and rng.random() < 0.4:
                cut[rng.randrange(len(cut))] = "zzz"
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() + rng.choice(["", ",", " <b>"]) for w in cut]
        docs.append((d, " ".join(own)))
    return [*docs, (900, None), (901, ""), (902, "the " * 400)], items


@pytest.mark.parametrize(("missing", "how"), [(0, {}), (0, {"block_words": 100}), (2, {})])
def test_leaks_against_brute_force(spark, missing, how):
    docs, items = corpus(random.Random(missing + 11))
    left = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    keys = {"doc_key": "doc_id", "doc_text": "text", "item_key": "item_id", "item_text": "text"}
    got = [(r["doc_id"], r["item_id"]) for r in L.leaks(left, right, **keys, missing=missing, **how).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_leaks(docs, items, missing)
    index = L.build_index(left, "doc_id", "text").cache()
    names = {"doc_key": "doc_id", "item_key": "item_id", "item_text": "text"}
    assert sorted(tuple(r) for r in L.search_index(index, right, **names, missing=missing, **how).collect()) == sorted(got)
    assert L.search_index(L.build_index(left.limit(0), "doc_id", "text"), right, **names).count() == 0
    assert L.search_index(index, right.limit(0), **names).count() == 0
    assert L.leaks(left.limit(0), right, **keys).count() == 0
    assert L.leaks(left, right.limit(0), **keys).count() == 0


def stands_within(q, own, missing, slop):
    """Whether all but ``missing`` words of q stand in own in order, at places less offsets from some base to ``slop`` more."""

    def rest(base, offset, after, left):
        if left < 0 or offset == len(q):
            return left >= 0
        places = [p for p in range(max(after, base + offset), min(base + offset + slop + 1, len(own))) if own[p] == q[offset]]
        return any(rest(base, offset + 1, p + 1, left) for p in places) or rest(base, offset + 1, after, left - 1)

    return any(rest(base, 0, 0, missing) for base in range(-len(q) - slop, len(own) + 1))


def brute_near(docs, items, missing, slop):
    windows = [(item, q[i : i + 12]) for item, text in items if len(q := words(text)) >= 8 for i in range(max(1, len(q) - 11))]
    return {(doc, item) for doc, text in docs for item, q in windows if stands_within(q, words(text), missing, slop)}


def near_corpus(rng):
    """Passages with words put in, dropped, replaced and swapped; some at the very beginning or end of a document."""
    vocabulary = ["the", "of", *(f"w{i}" for i in range(30))]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([7, 8, 10, 12, 14])))) for i in range(12)]
    docs = []
    for d in range(80):
        own = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 1))]
        around = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 3, 9]))] for _ in range(2)]
        docs.append((d, " ".join([*around[0], *own, *around[1]])))
    return [*docs, (900, None), (901, ""), (902, "the " * 30)], items


@pytest.mark.parametrize(("missing", "slop", "how"), [(2, 2, {}), (2, 2, {"block_words": 40}), (0, 1, {}), (1, 3, {})])
def test_near_leaks_against_brute_force(spark, missing, slop, how):
    docs, items = near_corpus(random.Random(10 * missing + slop))
    want = brute_near(docs, items, missing, slop)
    assert brute_leaks(docs, items, missing) < want
    left, right = (spark.createDataFrame(x, schema) for x, schema in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    names = {"doc_key": "doc_id", "item_key": "item_id", "item_text": "text"}
    got = [tuple(r) for r in L.leaks(left, right, **names, doc_text="text", missing=missing, slop=slop, **how).collect()]
    assert sorted(got) == sorted(want)
    index = L.build_index(left, "doc_id", "text").cache()
    assert sorted(map(tuple, L.search_index(index, right, **names, missing=missing, slop=slop, **how).collect())) == sorted(want)


def test_words_in_between_and_dropped():
    item = [f"w{i}" for i in range(12)]
    more = [[*item[:6], *["x"] * n, *item[6:]] for n in range(4)]
    fewer = [item[:5] + item[5 + n :] for n in range(4)]
    ends = [item[2:], item[:-2], item[3:]]
    swapped = [[*item[:4], item[5], item[4], *item[6:]]]
    texts = [" ".join(t) for t in (*more, *fewer, *ends, *swapped, item[6:], item[:6])]
    phrases = L.Phrases([(0, item)], 12)
    shard = L.Shard.of_texts(texts, phrases.terms, 1)
    found = lambda missing, slop: {x for d, _ in shard.find(phrases, missing, slop) for x in d.tolist()}
    assert found(2, 2) == {0, 1, 2, 4, 5, 6, 8, 9, 11}
    assert found(2, 0) == {0, 4, 11} and found(0, 1) == {0, 1, 4}


@pytest.mark.parametrize("block_words", [1_000_000, 25])
def test_rows_with_equal_keys_stay_apart_in_blocks(spark, monkeypatch, block_words):
    monkeypatch.setattr(L, "PIECE_WORDS", 20)
    long = " ".join(f"w{i}" for i in range(60))
    items = [(1, long), (2, " ".join(f"v{i}" for i in range(20))), (1, " ".join(f"w{i}" for i in range(30, 50))), (None, " ".join(f"u{i}" for i in range(12)))]
    docs = [(7, long), (7, long), (7, "no"), (None, long), (None, items[3][1]), (8, items[1][1] + " . " + long), (None, long)]
    left, right = (spark.createDataFrame(x, schema) for x, schema in ((docs, "shard long, text string"), (items, "place long, text string")))
    want = sorted([(7, 1), (7, 1), (None, 1), (None, 1), (None, None), (8, 1), (8, 2)], key=repr)
    names = {"doc_key": "shard", "item_key": "place", "item_text": "text", "block_words": block_words}
    got = L.leaks(left.repartition(2), right, doc_text="text", **names)
    assert got.columns == ["shard", "place"] and sorted(map(tuple, got.collect()), key=repr) == want
    index = L.build_index(left, "shard", "text").cache()
    assert sorted(map(tuple, L.search_index(index, right, **names).collect()), key=repr) == want


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE_WORDS", 20)
    text = " ".join(f"w{i}" for i in range(100))
    pieces = L.item_pieces(spark.createDataFrame([(1, text)], "k long, text string"), "k", "text").collect()
    windows = {tuple(r["words"][i : i + 12]) for r in pieces for i in range(len(r["words"]) - 11)}
    assert windows == {tuple(f"w{j}" for j in range(i, i + 12)) for i in range(89)}


def test_small_steps_find_the_same(monkeypatch):
    docs, items = corpus(random.Random(5))
    phrases = L.Phrases([(i, words(t)) for i, t in items if len(words(t)) >= 8], 12)
    shard = L.Shard.of_texts([t for _, t in docs], phrases.terms, 8)
    whole = {x for d, w in shard.find(phrases) for x in zip(d.tolist(), w.tolist(), strict=True)}
    monkeypatch.setattr(L, "STEP", 1)
    assert whole and whole == {x for d, w in shard.find(phrases) for x in zip(d.tolist(), w.tolist(), strict=True)}


def repetitive(text):
    own = plain_words(text)
    runs = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    again = sum(r in set(runs[:i]) for i, r in enumerate(runs))
    return len(own) >= 20 and 10 * again >= 3 * len(runs)


def some_texts(rng):
    out = [None, "", " ", "word", "ab " * 19, "ab " * 20, "中" * 20, "ﷺ " * 30]
    for _ in range(150):
        block = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 40))]
        rest = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 60))]
        out.append(" ".join(block + rest + block * rng.randint(0, 2)))
    return out


def test_repetitive_documents_against_brute_force(spark):
    texts = some_texts(random.Random(8))
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rule long")
    want = {i for i, t in enumerate(texts) if repetitive(t)}
    assert 10 < len(want) < len(texts) - 10
    assert {r["doc_id"] for r in R.find_repetitive(df, "doc_id", "text").collect()} == want
    assert {r["doc_id"] for r in R.find_repetitive(df, "doc_id", "text", sample_rows=0).collect()} == want
    assert R.find_repetitive(df.limit(0), "doc_id", "text").count() == 0


def test_any_order_of_rules_gives_the_same():
    texts, rng = some_texts(random.Random(9)), random.Random(10)
    for _ in range(5):
        own = R.rules()
        rng.shuffle(own)
        assert [not any(r.rejects(d) for r in own) for d in map(R.Document, texts)] == [repetitive(t) for t in texts]


def test_order_prefers_rejections_per_second():
    # Rules: slow and sure, fast and often, idle; then one that is cheap only once the words are known.
    rejected = np.array([[1, i % 4 > 0, 0, i % 2 == 0] for i in range(40)], dtype=bool)
    cost = np.tile([1.0, 0.001, 0.002, 0.0001], (40, 1))
    assert R.best_order(rejected, cost, np.full(40, 0.5), [False, False, False, True]) == [1, 3, 0, 2]
    assert R.best_order(rejected, cost, np.full(40, 5.0), [False, False, False, True]) == [1, 0, 2, 3]
    assert R.best_order(rejected, cost, np.zeros(40), [True] * 4) == [3, 1, 0, 2]
    assert R.best_order(rejected[:0], cost[:0], np.zeros(0), [True] * 4) == [0, 1, 2, 3]


def test_the_order_is_measured_on_a_sample_of_the_table(spark, tmp_path, monkeypatch):
    """A table in order of repetition: its first file alone would put the rules otherwise."""
    texts = sorted((t for t in some_texts(random.Random(14)) if t), key=repetitive) * 4
    df = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, doc_id long, _metadata_ string").repartitionByRange(40, "doc_id")
    df.write.parquet(str(tmp_path / "t"))
    stored, made, want = spark.read.parquet(str(tmp_path / "t")), R.rules(), {i for i, t in enumerate(texts) if repetitive(t)}
    for source in (stored, df, stored.filter("doc_id >= 0").withColumn("text", F.col("text")), stored.limit(0), df.limit(0), stored.join(df.select("doc_id"), "doc_id")):
        assert sorted(R.measured_order(source, "text", made, 64)) == list(range(len(made)))
    tried = []
    monkeypatch.setattr(R, "best_order", lambda rejected, *rest: tried.append(len(rejected)) or list(range(len(made))))
    for source in (stored, df):
        R.measured_order(source, "text", made, 64)
    assert 40 < tried[0] <= tried[1] == 64
    monkeypatch.undo()
    assert R.measured_order(stored, "text", made, 0) == list(range(len(made)))
    for rows in (0, 1, 64, 10_000):
        assert {r["doc_id"] for r in R.find_repetitive(stored, "doc_id", "text", sample_rows=rows).collect()} == want


def test_many_words_are_counted_alike(monkeypatch):
    texts = [t for t in some_texts(random.Random(12)) if t]
    few = [R.Document(t).repeated(n, len(words(t)) - 4) for t in texts for n in (1, 2, 5)]
    monkeypatch.setattr(R, "MANY_WORDS", 0)
    assert few == [R.Document(t).repeated(n, len(words(t)) - 4) for t in texts for n in (1, 2, 5)]


def test_shares(spark):
    texts = [None, "", "a b c d e\na b c d e", "One. Two. One.", "p q\n\nr\n\np q", "x " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in R.repetition_shares(df, "doc_id", "text").collect()}
    assert tuple(got[0])[1:] == tuple(got[1])[1:] == (0, 0.0, 0.0, 0.0, 0.0)
    assert got[2]["line_share"] == 0.5 and np.isclose(got[2]["gram_share"], 1 / 6)
    assert np.isclose(got[3]["sentence_share"], 3 / 9)
    assert np.isclose(got[4]["paragraph_share"], 3 / 7)
    assert np.isclose(got[5]["gram_share"], 45 / 46)
    assert R.repetition_shares(df.limit(0), "doc_id", "text").count() == 0
    assert df.select(F.count("*")).first()[0] == 6


SMALL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_queries_on_whole_small_tables(spark, known):
    documents, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "eval_items"))
    docs = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    windows: dict = {}
    for r in items.select("item_id", "text").collect():
        q = plain_words(r["text"])
        for i in range(max(1, len(q) - 11) if len(q) >= 8 else 0):
            windows.setdefault(tuple(q[i : i + 12]), set()).add(r["item_id"])
    sizes = {len(w) for w in windows}
    own = {d: plain_words(t) for d, t in docs.items()}
    leaked = {(d, i) for d, w in own.items() for n in sizes for k in range(len(w) - n + 1) for i in windows.get(tuple(w[k : k + n]), ())}
    assert sorted(map(tuple, Q.p7_found(spark, SMALL).collect())) == sorted(leaked)
    assert {tuple(r) for r in L.leaks(documents, items, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").collect()} == leaked
    assert sorted(r[0] for r in Q.p8_found(spark, SMALL).collect()) == sorted(d for d, t in docs.items() if repetitive(t))
    assert {r["doc_id"]: r["ids"] for r in Q.p6_ids(spark, SMALL).collect()} == {d: known.encode_ordinary(t or "") for d, t in docs.items()}

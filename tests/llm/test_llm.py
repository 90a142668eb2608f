"""Tokens, leaks and spam against brute force, round trips and made cases."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm.leaks import Index, find_leaks, myers, words
from weftline.llm.spam import Counts, Hashes, Limits, corpus_counts, find_spam, pair_keys, score_pages, spam_share, tokens
from weftline.llm.tokens import CHUNK, RUN, decode_ids, default_ranks, encode_texts, tokenizer


# --- tokens -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tok():
    return tokenizer(default_ranks())


def plain_encode(tok, text):
    return tok.words.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1'st é数ß\n\t  .,!-<|>👩‍💻"), max_size=200))
def test_cut_texts_have_the_same_ids(text):
    from weftline.llm import tokens as m

    t = m.tokenizer(default_ranks())
    want = t.words.encode_ordinary(text)
    kept = m.CHUNK, m.RUN, m._LONG_RUN
    m.CHUNK, m.RUN, m._LONG_RUN = 5, 2, re.compile(f"[{m.WHITE}]{{3,}}")
    try:
        assert t.encode(text) == want
    finally:
        m.CHUNK, m.RUN, m._LONG_RUN = kept
    assert t.decode_bytes(want).decode() == text


def test_long_texts(tok):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh é数") for _ in range(rng.randrange(1, 9))) for _ in range(3 * CHUNK // 4))
    assert len(text) > 3 * CHUNK and tok.encode(text) == plain_encode(tok, text)
    spaced = "a" + " " * 3 * RUN + "b" + "\n" * 2 * RUN
    assert tok.encode(spaced) == plain_encode(tok, spaced)
    huge = " " * 1_000_000 + "x"  # the plain way overflows its stack here
    assert tok.decode_bytes(tok.encode(huge)).decode() == huge
    # no white space at all
    for mixed in ("".join(rng.choices("abcXYZ0189+/", k=5 * CHUNK)), "".join(rng.choices(["データ", "の確認", "、", "。", "12", "é", "'s"], k=CHUNK))):
        assert tok.encode(mixed) == plain_encode(tok, mixed)
        assert max(len(x) for x in tok._pieces(mixed)) < CHUNK + 200
    one = "a" * 300_000
    assert tok.decode_bytes(tok.encode(one)).decode() == one


def test_public_library_agrees(tok):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as p

    other = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ("Hello, world! It's 2024.", "  two  spaces\n\n\tand tabs ", "<|endoftext|> is text", "数据 und Größe 👩‍💻", ""):
        assert tok.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_rows(spark):
    data = [(1, "a b"), (2, ""), (3, None), (4, "<|endoftext|>"), (1, "a b"), (None, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    coded = encode_texts(df, "doc_id", "text")
    found = sorted(((r["doc_id"], list(r["ids"])) for r in coded.collect()), key=str)
    assert [x for x in found if x[0] in (2, 3)] == [(2, []), (3, [])] and len(found) == 6 and 50256 not in sum((x[1] for x in found), [])
    back = {(r["doc_id"], r["text"]) for r in decode_ids(coded, "doc_id", "ids").collect()}
    assert back == {(1, "a b"), (2, ""), (3, ""), (4, "<|endoftext|>"), (None, "x")}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


# --- leaks ------------------------------------------------------------------------------------------


def slow_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(1, 4), max_size=20))
def test_bit_parallel_distance(pattern, text):
    assert myers(pattern, text) == slow_distance(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), min_size=4, max_size=12), min_size=1, max_size=4), st.lists(st.lists(st.integers(0, 6), max_size=25), max_size=4), st.integers(0, 2))
def test_no_leak_within_the_budget_is_missed(items, docs, budget):
    named = [(k, [f"w{x}" for x in item]) for k, item in enumerate(items)]
    index = Index(named, 4, budget)
    coded = [[index.vocabulary.get(f"w{x}", 0) for x in d] for d in docs]
    want = {}
    for i, d in enumerate(coded):
        for k, item in named:
            ids = [index.vocabulary[w] for w in item]
            best = min(slow_distance(ids[a : a + 4], d) for a in range(len(ids) - 3))
            if best <= budget:
                want[i, k] = best
    assert {(i, k): d for i, k, d in index.search(coded)} == want


def test_words():
    assert words("Größe_group, ﬁne ＡＢＣ ﬀ x­yz a​b ½") == ["größe", "group", "fine", "abc", "ff", "xyz", "ab", "1", "2"]
    assert words(unicodedata.normalize("NFD", "Größe É")) == words("GRÖẞE é")
    # upper as lower case and no more: letters are not spelled out, none is divided
    assert words("Straße STRASSE İstanbul ΟΔΟΣ οδος") == ["straße", "strasse", "istanbul", "οδοσ", "οδοσ"]


def test_leaks_of_rows(spark):
    prompt = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, prompt), (2, "x " + prompt.upper().replace(" ", "_ ,\n") + " y"), (3, "one two three four five six seven eight nine ten eleven"), (4, None), (5, ""), (6, prompt.replace("six", "sex")),
        (7, "filler " * 20_000 + prompt), (1, prompt), (8, prompt.replace("six ", "six ​")), (9, "two three four five six seven eight nine ten eleven twelve thirteen"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("distance", F.lit("clash"))
    items = spark.createDataFrame([(100, prompt), (100, prompt), (101, "short prompt"), (102, None), (103, ""), (104, prompt + " more")], "item_id bigint, prompt string")
    for sent in (1 << 20, 0):  # as an index, and as a frame behind a filter
        found = sorted(tuple(r) for r in find_leaks(d, items, doc_id="doc_id", text="text", item_id="item_id", prompt="prompt", item_bytes=sent).collect())
        exact = [(a, b) for a, b, n in found if n == 0]
        assert sorted(set(exact)) == [(i, k) for i in (1, 2, 7, 8, 9) for k in (100, 104)] and exact.count((1, 100)) == 2
        assert {(a, b): n for a, b, n in found}[6, 100] == 1
    assert find_leaks(d, items.limit(0), doc_id="doc_id", text="text", item_id="item_id", prompt="prompt").count() == 0
    assert find_leaks(d.limit(0), items, doc_id="doc_id", text="text", item_id="item_id", prompt="prompt").count() == 0


def test_many_items_are_found_in_one_scan(spark, monkeypatch):
    """The same pairs and distances whether the items are sent or joined, also through a filter that is nearly full."""
    from weftline.llm import leaks as m

    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 40)))) for i in range(80)]
    docs = []
    for i in range(60):
        mine = rng.choices(vocabulary, k=30)
        source = rng.choice(items)[1].split()
        at = rng.randrange(len(source))
        piece = source[at : at + 14]
        if piece and rng.random() < 0.6:
            piece[rng.randrange(len(piece))] = "edited"
        docs.append((i, " ".join(mine[:15] + piece + mine[15:])))
    d = spark.createDataFrame([*docs, (5, docs[5][1]), (99, None)], "doc_id bigint, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id int, prompt string")
    run = lambda **k: sorted(map(tuple, find_leaks(d, it, doc_id="doc_id", text="text", item_id="item_id", prompt="prompt", **k).collect()))
    want = run()
    assert len(want) > 20 and {x[2] for x in want} == {0, 1}
    for bits in (1 << 20, 1 << 10):
        monkeypatch.setattr(m, "FILTER_BITS", bits)
        assert run(item_bytes=0) == want
    frame = find_leaks(d, it, doc_id="doc_id", text="text", item_id="item_id", prompt="prompt", item_bytes=0)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("text#") <= 8  # one branch reads the texts


# --- spam -------------------------------------------------------------------------------------------

TEXT = "The preview of the report is still waiting for the totals that we sent to the team before the holidays, and nobody knows why."
SPAM = {
    "stuffing": "loan level planned. Loan level? Loan level! Gross loan level. Loan level, cheap loan level. " * 8,
    "phrases": " | ".join(f"{a} {b}" for a in ("best", "fast", "cheap", "free", "top") for b in ("filter template", "report builder", "csv repair", "etl tool", "xml parser")),
    "links": "\n".join(f"https://www.site{i}.example/a/b?id={i}" for i in range(20)),
    "anchors": "".join(f'<a href="https://site{i}.example/">buy tool {i}</a> ' for i in range(20)),
    "tags": " ".join(f"#{a}Filter{b}" for a in ("best", "fast", "top") for b in ("Tool", "Flow", "Plan", "Sheet")),
    "products": "\n".join(f"SKU A{i} report builder {('new', 'sale', 'XL')[i % 3]}" for i in range(25)),
    "invisible": " · ".join(f"bu​y {b}" for b in ("filter template", "report builder", "csv repair") for _ in range(9)),
}
HAM = {
    "sentences": TEXT, "repeated sentence": (TEXT + " ") * 4, "expression": "IF [a] = 'x' THEN [b] ELSE Trim([b]) ENDIF", "log": "\n".join(f"2024-01-{i:02} WARN tool={i} unresolved_field a_{i}" for i in range(1, 29)),
    "table": "| field | type | size |\n|---|---|---|\n" + "\n".join(f"| field_{i} | Int32 | 4 |" for i in range(30)), "config": "<Configuration>\n" + "\n".join(f'  <Field name="f{i}"/>' for i in range(30)) + "\n</Configuration>",
    "title": "# Weekly report", "one link": TEXT + "\nSee also: https://www.site.example/", "names": "Columns: a_one, b_two, c_three, d_four, e_five, f_six, g_seven", "mostly text": (TEXT + "\n") * 12 + SPAM["phrases"][:300], "empty": "", "blank": " \n\t", "null": None, "long token": "x" * 5000,
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam_by_form(kind):
    hashes = Hashes()
    for text in (SPAM[kind], TEXT + "\n" + SPAM[kind], SPAM[kind].upper() if kind != "tags" else SPAM[kind]):
        assert spam_share(text, Counts(), hashes, Limits())[0] > 0.5, text[:80]


@pytest.mark.parametrize("kind", HAM)
def test_text_is_none(kind):
    assert spam_share(HAM[kind], Counts(), Hashes(), Limits())[0] <= 0.5


STUFFED = ["cheap csv repair online csv repair best csv repair free csv repair now"] * 6


@pytest.mark.parametrize("before", ["", "| ", "2024-01-01 ", "> ", "* ", "<b>"])
def test_what_stands_before_a_line_changes_nothing(before):
    assert spam_share("\n".join(before + x for x in STUFFED), Counts(), Hashes(), Limits())[0] > 0.99


def test_function_words_between_keywords_change_nothing():
    text = " ".join(f"the {w}" for w in " ".join(STUFFED).split())
    assert spam_share(text, Counts(), Hashes(), Limits())[0] > 0.99
    assert spam_share("cheap repair of files best tool for free download online now. " * 12, Counts(), Hashes(), Limits())[0] > 0.9


def test_sentences_of_a_language_the_corpus_lacks(spark):
    dutch = "De vergadering van morgen gaat niet door, omdat het gebouw wordt schoongemaakt. Wie nog iets wil bespreken heeft tot vrijdag de tijd om het aan de leiding te sturen."
    counts = corpus_counts(spark.createDataFrame([(f"{TEXT} {i % 7} {i}",) for i in range(50)], "text string"), "text")
    for known in (Counts(), counts):
        assert spam_share(dutch, known, Hashes(), Limits())[0] == 0.0
    japanese = "データの一覧を確認してから、毎週の報告書を作成してください。古いファイルは来月まで残しておく必要がありますので、削除しないでください。"
    assert spam_share(japanese, Counts(), Hashes(), Limits())[0] == 0.0
    assert spam_share("無料 変換 ツール 比較 無料 変換 ランキング " * 6, Counts(), Hashes(), Limits())[0] > 0.9


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", *["\n".join(" ".join(rng.choice(["a", "B", "c", "d", "7", "größe"]) for _ in range(rng.randrange(8))) for _ in range(3)) for _ in range(300)]]
    counts = corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text")
    h = Hashes()
    docs = [tokens(t.replace("\n", " ")) for t in texts if t]
    for w in ("a", "b", "7", "größe"):
        assert counts.look_up(counts.words, np.array([h[w]], np.uint64))[0] == sum(w in x for x in docs)
    for pair in (("a", "b"), ("c", "a"), ("7", "7")):
        key = pair_keys(np.array([h[w] for w in pair], np.uint64))
        assert counts.look_up(counts.pairs, key)[0] == sum(pair in zip(x, x[1:], strict=False) for x in docs)
    assert counts.all_words == sum(len(set(x)) for x in docs) and counts.all_pairs == sum(len(set(zip(x, x[1:], strict=False))) for x in docs)


def _corpus(rng):
    """Sentences of fixed phrases, all words about equally frequent."""
    phrases = [[f"w{a}x{k}" for k in "abcdef"] for a in "qrstuvwxyz"]
    return [" ".join(w for _ in range(8) for w in rng.choice(phrases)) for _ in range(400)], [w for p in phrases for w in p]


def test_salad_is_told_by_the_corpus(spark):
    """Words that all occur often but never side by side have a low mean; other copies of a text are no evidence for it."""
    rng = random.Random(8)
    texts, words_ = _corpus(rng)
    salad = " ".join(rng.sample(words_, 60))
    counts = corpus_counts(spark.createDataFrame([(t,) for t in texts + [salad] * 150], "text string").repartition(3), "text")
    h = Hashes()
    share, mean = spam_share(salad, counts, h, Limits())
    assert share > 0.99 and mean < 0.3 * counts.mean
    share, mean = spam_share(texts[0], counts, h, Limits())
    assert share == 0.0 and mean > 0.7 * counts.mean
    # without the corpus there is nothing to tell it by
    assert spam_share(salad, Counts(), h, Limits())[0] == 0.0


def test_what_is_sent_has_a_bound(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghijklmno", k=3)) for _ in range(60)) for _ in range(300)]
    counts = corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text", floor=1e-3)
    assert len(counts.words[0]) <= 1000 and len(counts.pairs[0]) <= 1000 and counts.all_pairs > 15_000


def test_spam_rows(spark):
    data = [(i, t) for i, t in enumerate([*SPAM.values(), *HAM.values()])] + [(0, SPAM["stuffing"]), (None, SPAM["links"])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("spam_share", F.lit("clash")).repartition(3)
    found = [r["doc_id"] for r in find_spam(df, doc_id="doc_id", text="text").collect()]
    assert sorted(found, key=str) == sorted([*range(len(SPAM)), 0, None], key=str)
    assert score_pages(df, doc_id="doc_id", text="text").count() == len(data)
    assert find_spam(df.limit(0), doc_id="doc_id", text="text").count() == 0

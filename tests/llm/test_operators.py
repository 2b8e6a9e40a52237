"""Each operator against brute force, a round trip or held-out rows, and on empty tables, nulls, ties, long texts and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import exact_dedup, hnsw, html_text, jaccard_join, packing, pieces, quality, shingles, toxicity, url_filter, wavelet, word_bpe

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "one", "a\tb  c\n", "a b c ", "日本 😀 x́", "\x00\x01", "long " * 30_000, "<|endoftext|> A", "▁x  y", "a b c"]


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


NAMES = ["".join(c) for c in itertools.product(["ba", "ke", "ti", "mo", "su"], ["ran", "len", "dis", "fot"], ["", "a", "es", "ing", "ot"], ["n", "rt", "l", "sh"])]


def words(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(NAMES[rng.randrange(size)] for _ in range(n))


# 1


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path(pieces.MODEL))


def test_pieces_equal_the_library(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rng = random.Random(2)
    letters = " ▁\nabcdething.,'\"()0123ÉéñßαΣ日本😀\x00́=-_/\\"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * k for k in range(40)] + ["=" * k for k in range(60)]
    coded = [np.frombuffer(model.encode(t), "<i4") for t in texts]
    assert [c.tolist() for c in coded] == [lib.encode(t, add_eos=True) for t in texts]
    assert model.decode(np.concatenate(coded), np.cumsum([len(c) for c in coded])) == [lib.decode(c.tolist()) for c in coded]
    some = [[rng.randrange(32_000) for _ in range(rng.randrange(5))] for _ in range(300)]
    assert model.decode(np.array([i for r in some for i in r]), np.cumsum([len(r) for r in some])) == [lib.decode(r) for r in some]


def test_small_tables_give_the_same_ids(model):
    small = pieces.PieceModel(public_tokenizers.path(pieces.MODEL), words=5)
    text = words(1, 300) + " and, then. "
    assert small.encode(text) == model.encode(text)


def test_pieces_in_spark(spark):
    df = table(spark, ODD).withColumn("ids", F.lit("clash"))
    rows = pieces.decode(pieces.encode(df)).orderBy("doc_id").collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert [r["ids"] for r in rows] == [lib.encode(t or "", add_eos=True) for t in ODD]
    assert pieces.encode(df.limit(0)).count() == 0
    both = pieces.round_trip(df.drop("ids")).orderBy("doc_id").collect()
    assert [(r["ids"], r["decoded"]) for r in both] == [(r["ids"], r["decoded"]) for r in rows]


# 2


def toxic_rows():
    rng = random.Random(3)
    plain = [words(k, 60) for k in range(200)]
    bad = [words(1000 + k, 40) + " " + rng.choice(["blorfish", "grumptic"]) + " " + words(2000 + k, 20) for k in range(80)]
    return plain, bad


def test_toxicity_learns_and_tolerates_disguise():
    plain, bad = toxic_rows()
    m = toxicity.fit(plain[:150] + bad[:60], [0] * 150 + [1] * 60)
    assert (m.scores(bad[60:]) >= 0.3).all() and (m.scores(plain[150:]) < 0.3).all()
    cut, spelt, filled, none, empty = m.scores(["baran blor fish tilen", "b l o r f i s h", "baran blorxfish", "baran tilen", ""])
    assert spelt >= 0.3 and cut > none and filled > none and 0 <= empty < 0.3


def test_pieces_of_long_texts_lose_no_window():
    m = toxicity.ToxicityModel(np.random.default_rng(2).normal(size=toxicity.LETTERS**3).astype(np.float32), 0.0, 0.3, 0.0)
    for text in (words(3, 4000), words(4, 900).replace(" ", ". "), "x" * 9000, "", "a b c d " * 900):
        cut = list(toxicity.pieces(text, 1000))
        assert all(len(c) <= 1000 for c in cut) and (text == "" or set("".join(cut)) == set(text))
        whole, parts = toxicity.Windows([text]), toxicity.Windows(cut)
        assert set(whole.strings(np.arange(len(whole.text)))) <= set(parts.strings(np.arange(len(parts.text)))) or " " not in text or "a b" in text
    many = [words(k, 200) for k in range(40)] + [words(77, 3000)]
    assert m.scores(many) == pytest.approx([float(m.scores([t])[0]) for t in many])


def test_window_values_are_those_of_all_triples():
    weight = np.random.default_rng(0).normal(size=toxicity.LETTERS**3).astype(np.float32)
    texts = ["Abc abcd-e, éa. i d i o t so\nx y", "", "q" * 60 + " end", " . ", "日本 a\u0301b"]
    windows = toxicity.Windows(texts)
    values = windows.values(weight, 0.5)
    for a, b, got in zip(windows.begin, windows.end, values, strict=True):
        s = windows.codes[a:b].astype(int)
        sums, size = 0.0, 0.0
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                sums += weight[(s[i] * 64 + s[j]) * 64 + s[k]] * toxicity.DECAY ** (k - i + 1)
                size += toxicity.DECAY ** (2 * (k - i + 1))
        assert got == pytest.approx(sums / max(size, 1e-9) ** 0.5 + 0.5, abs=1e-3)
        codes, w = toxicity.vector(s.astype(np.uint8).tobytes())
        assert got == pytest.approx(float(weight[codes] @ w) + 0.5, abs=1e-3)

    def word(*parts):
        return bytes([0, *(x for p in parts for c in [*(toxicity._CODE[ord(x)] for x in p), 0] for x in [int(c)])])

    got = [w for w, t in zip(windows.strings(np.arange(len(values))), windows.text, strict=True) if t == 0]
    assert set(got) == {word("abc"), word("abcde"), word("éa"), word("idiot"), word("so"), word("x"), word("y"), word("abc", "abcde"), word("abcde", "éa"), word("idiot", "so"), word("x", "y")}
    assert {int(t) for t in windows.text} == {0, 2, 4} and (windows.end - windows.begin <= toxicity.WINDOW + 2).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_toxicity_on_held_out_labels(spark):
    """Every held-out text with a word that marks labelled toxic texts is found, and hardly any other."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.with_score(docs.select("doc_id", "text"), toxicity.learn(docs, labels)).where(toxicity.held_out()).join(labels, "doc_id").collect()
    found = [r["doc_id"] for r in rows if r["score"] >= toxicity.THRESHOLD]
    insult = {r["doc_id"] for r in rows if r["toxic"] and any(w in r["text"].lower().split() for w in ("idiot", "moron", "stupid", "trash"))}
    assert len(insult) > 5 and insult <= set(found)
    assert sum(not r["toxic"] for r in rows if r["doc_id"] in found) <= 2


def test_toxicity_with_one_class_or_nothing(spark):
    assert toxicity.fit(["a b"], [0]).scores(["a b"])[0] < 0.3
    blank = toxicity.fit([], [])
    rows = toxicity.with_score(table(spark, ODD).withColumn("score", F.lit(1)), blank).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows}) == 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(table(spark, ODD), labels).slope == 0.0


def test_toxicity_learns_beside_a_long_row_and_in_long_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"row {i}") for i in range(40)], "doc_id long, text string").where(~toxicity.held_out())
    first = docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").first()[0]
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.lit("z" * 5000)).otherwise(F.col("text")))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    for label in (0, 1):
        labels = docs.select("doc_id", F.when(F.col("doc_id") == first, label).otherwise(F.col("doc_id") % 2).cast("int").alias("toxic"))
        toxicity.learn(long, labels, chars=2000)
        texts, toxic = seen.pop()
        assert len(texts) == docs.count() - 1 and set(toxic) == {0, 1}


# 3


def test_content_sort_against_brute_force(spark):
    rng = random.Random(5)
    texts = [rng.choice(["a b", "a  b", "a\tb", "c", None, "", "x " * 50]) for _ in range(400)] + [f"alone {k}" for k in range(50)]
    df = table(spark, texts).unionByName(spark.createDataFrame([(None, "c", "en", "s", 1), (7, texts[7], "en", "s", 1)], DOCS)).withColumn("kept", F.lit(0))
    import re

    rows = exact_dedup.content_sort(df).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
    assert len(rows) == len(texts) + 2
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        assert r["group_size"] == len(groups[norm]) and r["keep_id"] == min(i for i in groups[norm] if i is not None)
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    assert sum(r["kept"] for r in rows) == len(groups)
    assert exact_dedup.content_sort(df.limit(0)).count() == 0


# 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><header>Site</header>
<div class="sidebar-2"><p>side words here</p></div><div class="story-{0}"><article><h1>Head &amp; shoulders</h1><p>First   para<br>graph with text number {0}.<p>Second &copy; one is <b>bold</b>.</p>
<div class="ad"><p>Buy now</p></div><ul><li>item one<li>item two</ul></article></div><div class="comments"><p>A reader says no</p></div><form><p>Search</p></form><footer>&copy; 2020</footer></body></html>"""


def test_html_text(spark):
    want = "Head & shoulders\nFirst para graph with text number {0}.\nSecond © one is bold.\nitem one\nitem two"
    pages = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i)) for i in range(6)] + [(6, None, None), (7, "http://h0.org/", ""), (8, "http://h0.org/x", "<p>no container <b>here"), (9, "u", "a < b && c <"), (10, "http://h1.org/", "<div><nav>only menu</nav></div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert all(got[i] == want.format(i) for i in range(6))
    assert got[6] == "" and got[7] == "" and got[8] == "no container here" and got[9].startswith("a < b && c") and got[10] == ""
    assert html_text.extract(df.limit(0)).count() == 0


def test_consensus_overrules_a_page():
    found = html_text.Page("<body><div class=main><p>short</p></div><div class=other><p>a much longer text that wins on its own page</p></div></body>")
    assert html_text.own_path(found)[0] == "/body/div.other"
    assert html_text.text_at(found, ["/nothere", "/body/div.main"]) == "short"


def test_deep_nesting_costs_no_more_than_its_depth():
    n = 6000
    page = html_text.Page("<body>" + "<div>x " * n + "</div>" * n)
    assert html_text.text_at(page, html_text.covering(page, [html_text.own_path(page)[0]])) == "\n".join(["x"] * n)
    assert sum(map(len, page.path)) < 500 * n and len(set(page.path)) == n + 1


class SecondParser(HTMLParser):
    """The article of a page by the standard library's parser: an independent and plain reading for pages with one article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], ""

    def flush(self):
        tags = [t for t, _ in self.open]
        if "article" in tags and not any(bad for _, bad in self.open) and (text := " ".join(self.now.split())):
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag in html_text.BLOCKS or tag in ("script", "style"):
            self.flush()
            bad = tag in html_text.BOILERPLATE_TAGS or tag in ("script", "style") or any(v and html_text.BOILERPLATE.search(v) for k, v in attrs if k in ("class", "id", "role"))
            if tag not in html_text.EMPTY:
                self.open.append((tag, bad))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS or tag in ("script", "style"):
            self.flush()
            if tag in [t for t, _ in self.open]:
                while self.open.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        self.now += data


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_registered_html_query_against_a_second_parser(spark):
    got = {r["page_id"]: r for r in html_text.op4_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        parser = SecondParser()
        parser.feed(page["html"])
        parser.close()
        assert got[page["page_id"]]["text"] == "\n".join(parser.blocks) and got[page["page_id"]]["n_chars"] == len("\n".join(parser.blocks))


def test_no_part_of_an_article_is_left_out(spark):
    long = "a long paragraph of the text " * 20
    parts = ["Title here", "The lead of it", long.strip(), "Second section with some words"]
    split = "<body><div class=top>Chrome</div><article><h1>{}</h1><p>{}</p><div class=body><p>{}</p></div><section id=b><p>{}</p></section></article><footer>f</footer></body>"
    stray = "<body><div class=story><p>A stray line</p></div><div class=text><p>" + long + "</p></div></body>"
    usual = "<body><div class=story><article><p>" + long + "</p></article></div></body>"
    pages = [(i, f"http://h.org/{i}", usual) for i in range(3)] + [(3, "http://h.org/3", split.format(*parts)), (4, "http://h.org/4", stray), (5, "http://g.org/5", split.format(*parts))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == long.strip() and got[3] == got[5] == "\n".join(parts) and got[4] == "A stray line\n" + long.strip()


# 5


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_url_filter(spark):
    rng = random.Random(1)
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['a.', 'WWW.', ''])}{rng.choice(['example.org', 'x.com', 'y.net', 'notorg'])}{rng.choice(['', '/es/1', '/en/12', '/fr/3', '/de/4?q=/x', '#z', '?a'])}" for _ in range(300)]
    urls += [None, "", "nothing", "://", "a://b://c/d", "http://ORG/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule[0] + rule[1])
        assert rows[i]["verdict"] == rule[2] if rule else rows[i]["verdict"] in ("allow", "block")
    assert rows[0]["score"] is not None
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id >= 300")).collect() if r["rule"] is None} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_scores_are_exact_over_whole_urls(spark):
    rng = random.Random(3)
    kept = [f"http://x.com/fr/{rng.randrange(10**9):x}?kind=green" for _ in range(60)]
    cut = [f"http://x.com/de/{rng.randrange(10**9):x}?kind=casino#top" for _ in range(60)]
    other = ["http://y.net/1?kind=green", "HTTP://Y.net/1?kind=casino#top", "nothing", "😀"]
    n, seen = url_filter.ORDER, {}

    def grams(t):
        t = chr(url_filter.START) * (n - 1) + t
        return [t[i : i + n] for i in range(len(t) - n + 1)]

    for v, texts in (("allow", kept), ("block", cut)):
        for g in itertools.chain(*map(grams, texts)):
            for k in range(n):
                seen.setdefault((v, g[n - 1 - k : n - 1]), {}).setdefault(g[-1], 0)
                seen[v, g[n - 1 - k : n - 1]][g[-1]] += 1

    def likelihood(v, t):
        total = 0.0
        for g in grams(t):
            p = 1 / 256
            for k in range(n):
                if c := seen.get((v, g[n - 1 - k : n - 1])):
                    p = (c.get(g[-1], 0) + len(c) * p) / (sum(c.values()) + len(c))
            total += np.log(p)
        return total

    labelled = spark.createDataFrame([(t, "allow") for t in kept] + [(t, "block") for t in cut], "text string, verdict string")
    texts = spark.createDataFrame([(t,) for t in [*kept[:5], *cut[:5], *other, ""]], "text string")
    got = {r["text"]: r["score"] for r in url_filter.text_scores(texts, url_filter._counts(labelled)).collect()}
    assert set(got) == {*kept[:5], *cut[:5], *other}
    assert all(abs(got[t] - (likelihood("allow", t) - likelihood("block", t)) / len(t)) < 1e-7 for t in got)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(kept + cut + other[:2])], "page_id long, url string")
    judged = {r["page_id"]: r["score"] for r in url_filter.judge(df).collect()}
    assert judged[120] > judged[121]  # host and path are the same


# 6


def brute_components(texts, ids):
    def shingle(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingle(t) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    low = {}
    for i in range(len(sets)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [(len(s), low[root(i)]) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(9)
    texts = []
    for base in range(25):
        w = words(base, rng.randrange(3, 120)).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(w)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                copy[rng.randrange(len(copy))] = "Edit" + str(rng.randrange(5))
            texts.append(" ".join(copy))
    return texts + [None, "", " \n", "one", "ONE", "one two three four", "One two\tthree four", *ODD]


def test_jaccard_join_against_all_pairs(spark):
    texts = near_texts()
    ids = [3 * i + 5 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df).collect()}
    assert [rows[i] for i in ids] == brute_components(texts, ids)
    assert jaccard_join.near_copies(df.limit(0)).count() == 0


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 60, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    parent = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            for j in range(i):
                if jaccard_join.linked(sets[i], sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert jaccard_join.links(sets) == parent


def test_jaccard_join_compares_all_sets_of_a_large_place(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEETING", 10)
    stem, texts = words(70, 84), []
    for pair in range(40):
        shared = words(100 + pair, 5)
        texts += [f"{stem} {shared} {words(200 + 2 * pair + k, 7)}" for k in (0, 1)]
    texts += [f"{stem} {words(900, 12)} x{k}" for k in range(30)]  # a group of its own
    ids = list(range(len(texts)))
    want = brute_components(texts, ids)
    assert len({c for _, c in want}) == 41
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    assert [got[i] for i in ids] == want


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    monkeypatch.setattr(jaccard_join, "PAIRS", 50)
    rng = np.random.default_rng(5)
    one, two = ([np.unique(np.minimum(rng.zipf(1.2, 60), 4000)).astype(np.uint64) for _ in range(n)] for n in (30, 41))
    assert (jaccard_join.overlaps(one, two) == [[len(np.intersect1d(x, y)) for y in two] for x in one]).all()


def test_shingles_count_words_as_stated():
    got = shingles.shingle_sets(["a b c d e f", "A  B\tc d e f", "a b", "", " ", "a b c d e a b c d e a b c d e", "é É"])
    assert [len(s) for s in got] == [2, 2, 1, 0, 0, 5, 1] and (got[0] == got[1]).all() and (got[2] != got[6]).all()


def test_rows_without_an_id_are_linked_and_bridge(spark):
    w = words(5, 60).split()
    near = [" ".join([*w[:k], "edit", *w[k + 1 :]]) for k in (0, 59)]  # each links to w, but not to one another
    rows = [(5, near[0]), (None, " ".join(w)), (9, near[1]), (None, words(6, 30)), (None, words(6, 30)), (7, words(8, 30)), (7, words(8, 30))]
    want = [c for _, c in brute_components([t for _, t in rows], [i if i is not None else 1 << 40 for i, _ in rows])]
    got = jaccard_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(5, 5), (7, 7), (7, 7), (9, 5)] and want[0] == want[2]
    assert sorted([r["component_id"] for r in got if r["doc_id"] is None], key=str) == [5, None, None]


@pytest.mark.parametrize("meeting,common", [(1500, 65536), (20, 65536), (4, 0)])
def test_no_link_is_lost_under_a_shared_template(spark, monkeypatch, meeting, common):
    """Pairs that only differ from all others by a few words, in places that every text takes part in. Without the step over smallest hashes nothing is found by luck."""
    monkeypatch.setattr(jaccard_join, "MEETING", meeting)
    monkeypatch.setattr(jaccard_join, "_settling", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_join.common_shingles, "__defaults__", (common,)) if common else monkeypatch.setattr(jaccard_join, "common_shingles", lambda classes: np.zeros(0, np.uint64))
    stem, texts = words(70, 84), []
    for pair in range(30):
        shared = words(100 + pair, 5)
        texts += [f"{stem} {shared} {words(200 + 2 * pair + k, 7)}" for k in (0, 1)]
    ids = list(range(len(texts)))
    want = brute_components(texts, ids)
    assert len({c for _, c in want}) == 30
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    assert [got[i] for i in ids] == want


def test_a_long_chain_of_near_copies_is_one_group(spark):
    base = words(31, 400).split()
    texts = [" ".join(base[k * 3 : k * 3 + 120]) for k in range(90)]
    ids = list(range(90))
    random.Random(4).shuffle(ids)
    got = jaccard_join.near_copies(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


# 7


def test_hnsw_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[100:130] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 50 = 0")
    got = {}
    for r in hnsw.nearest(asked, hnsw.index(df, shard=400)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = total = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(1500), key=lambda i: (-round(s[i], 9), i))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(want) & {i for i, _ in got[q].values()}), total + 5
        assert all(abs(s[i] - x) < 1e-9 for i, x in got[q].values())
    assert hit / total >= 0.9 and 2000 not in got and 2001 not in got
    assert [i for i, _ in (got[0][k] for k in range(1, 6))] == [100, 101, 102, 103, 104]
    assert hnsw.nearest(asked.limit(0), hnsw.index(df, shard=400)).count() == 0 and hnsw.index(df.limit(0)).count() == 0


# 8


def test_pack_fills_sequences():
    rng = np.random.default_rng(2)
    for lengths in (np.minimum(100, rng.geometric(0.05, 3000)), np.full(7, 60), np.array([100, 1]), np.zeros(0, int)):
        number, offset = packing.pack(lengths, 100)
        if len(lengths):
            total = np.bincount(number, lengths)
            assert total.max() <= 100 and sorted(set(number.tolist())) == list(range(number.max() + 1))
            for b in range(number.max() + 1):
                at = sorted((offset[i], lengths[i]) for i in np.flatnonzero(number == b))
                assert [o for o, _ in at] == np.cumsum([0, *[n for _, n in at]])[:-1].tolist()
    assert packing.pack(rng.integers(1, 60, 3000), 100)[0].max() + 1 <= 1.02 * np.ceil(3000 * 30 / 100)


def test_pack_prefers_two_that_fit():
    number, _ = packing.pack(np.array([60, 30, 20, 20]), 100)
    assert number.max() == 1 and sorted(np.bincount(number, [60, 30, 20, 20]).tolist()) == [30, 100]


def fewest(lengths, room):
    """The fewest sequences that hold lengths, by trying all ways."""
    best = len(lengths)

    def place(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for k in {b: i for i, b in enumerate(bins)}.values():
            if bins[k] + left[0] <= room:
                place(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]])
        place(left[1:], [*bins, left[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def test_packing_is_near_the_fewest_sequences():
    rng = random.Random(6)
    more = 0
    for _ in range(60):
        lengths = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 10))]
        number, _ = packing.pack(np.array(lengths), 40)
        more += len(set(number.tolist())) - fewest(lengths, 40)
        assert all(sum(x for x, n in zip(lengths, number, strict=True) if n == b) <= 40 for b in set(number.tolist()))
    assert more <= 2


def test_repeated_rows_go_to_several_groups(spark):
    df = table(spark, ["same text"] * 300).withColumn("doc_id", F.lit(7).cast("long"))
    for parts in (1, 2, 8):
        rows = packing.packed(df.repartition(parts), group=50).collect()
        groups = Counter(r["sequence_id"] >> 32 for r in rows)
        assert len(rows) == 300 and len(groups) == 6 and max(groups.values()) < 100


def test_long_texts_make_no_larger_groups(spark):
    rows = packing.packed(table(spark, [words(n, 3000) for n in range(30)]), room=64, group=100).collect()
    full = [r for r in rows if r["length"] == 64]
    assert len(full) > 2000 and len({r["sequence_id"] for r in full}) == len(full) and all(r["offset"] == 0 for r in full)
    rest = [r for r in rows if r["length"] < 64]
    assert len(rest) <= 30 and not {r["sequence_id"] for r in rest} & {r["sequence_id"] for r in full}


def test_packed_documents(spark):
    texts = [*ODD, words(1, 9000)]
    t = Tokenizer.from_file(word_bpe.default_path())
    rows = packing.packed(table(spark, texts)).collect()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["length"] == len(part)
    assert packing.packed(table(spark, texts).limit(0)).count() == 0


def test_word_encoder_equals_the_library():
    e, t = word_bpe.WordEncoder(word_bpe.default_path(), words=50), Tokenizer.from_file(word_bpe.default_path())
    rng = random.Random(1)
    letters = "aAéÉßñ '’.,!$%1²½×<|>\n\t\xa0\x85'sST́Σİµª"
    texts = [x or "" for x in ODD if len(x or "") < 1000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert all(np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)


# 9


@pytest.mark.parametrize("size,kinds", [(0, 1), (1, 1), (3000, 40), (20_000, 5000), (5000, 70_000)])
def test_token_store(size, kinds):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.zipf(1.3, size), kinds).astype(np.uint32)
    docs, lengths, store = wavelet.from_file(wavelet.to_file([4, None], np.array([size, 0]), ids))
    assert docs == [4, None] and lengths.tolist() == [size, 0] and (store.ids() == ids).all()
    for i in rng.integers(0, size, 40).tolist() if size else []:
        t = int(ids[i])
        k = int((ids[:i] == t).sum())
        assert store.access(i) == t and store.count(t, i) == k and store.locate(t, k) == i and store.count(t) == (ids == t).sum()
    assert store.count(99_999_999) == 0
    with pytest.raises(IndexError):
        store.locate(99_999_999, 0)


def test_wavelet_files(spark):
    df = table(spark, ODD, 10).unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5)], DOCS))
    files = wavelet.encode_files(df, shard=50).cache()
    rows = wavelet.with_global_start(wavelet.read_files(files), files).collect()
    t = Tokenizer.from_file(word_bpe.default_path())
    start = 0
    for doc, text in [(None, "no id"), *((10 + i, x) for i, x in enumerate(ODD))]:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        (r,) = (r for r in rows if r["doc_id"] == doc)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.encode_files(df.limit(0)).count() == 0


def test_real_files_one_a_shard(spark, tmp_path):
    df = table(spark, [words(k, 30) for k in range(40)])
    folder = f"file://{tmp_path}/files"
    sizes = wavelet.write_files(wavelet.encode_files(df, shard=200), folder)
    names = sorted(os.listdir(f"{tmp_path}/files"))
    assert len(names) == sizes.count() > 3 and all(n.startswith("part-") for n in names)
    rows = wavelet.with_global_start(wavelet.read_files(wavelet.found_files(spark, folder)), sizes).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist() and len(rows) == 40


# 10


def brute_kneser_ney(train):
    """Interpolated modified Kneser-Ney with plain dictionaries: a function from a text to its perplexity."""
    n = quality.ORDER

    def grams(t):
        s = [quality.START] * (n - 1) + quality.symbols(t).tolist() + [quality.END]
        return [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]

    tables = {n: {}}
    for t in train:
        for g in grams(t):
            tables[n][g] = tables[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    rates, contexts = {}, {}
    for k, c in tables.items():
        t = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        rates[k] = [0] + [min(max(i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else 0.5, 0.05), 0.95 * i) for i in (1, 2, 3)]
        contexts[k] = {}
        for g, v in c.items():
            total, left = contexts[k].get(g[:-1], (0, 0.0))
            contexts[k][g[:-1]] = total + v, left + rates[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / quality.ALPHABET
        k = len(g)
        if g[:-1] not in contexts[k]:
            return p(g[1:])
        total, left = contexts[k][g[:-1]]
        v = tables[k].get(g, 0)
        return (v - rates[k][min(v, 3)] if v else 0) / total + left / total * p(g[1:])

    return lambda t: float(np.exp(-np.mean([np.log(p(g)) for g in grams(t)])))


def test_perplexities_against_brute_force(spark):
    rng = random.Random(8)
    train = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    test = train[:5] + ["zzz", "aé日", "a" * 700, "b"]
    counts = quality.count_grams(table(spark, train).select("text"))
    docs = table(spark, test).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_whole"))
    got = {r["_id"]: r["perplexity"] for r in quality.scores(docs, quality.model_rows(counts)).collect()}
    want = brute_kneser_ney(train)
    assert all(got[i] == pytest.approx(want(t), rel=1e-6) for i, t in enumerate(test))


def test_packed_requests_come_back():
    r = np.random.default_rng(0)
    for docs in (1, 7, 1900):
        both = np.unique((r.integers(0, 900, 5000) ** 3 << 11) | r.integers(0, docs, 5000))
        n = r.integers(1, 256, len(both))
        names = np.zeros(-(-docs // 8), np.uint8).tobytes() + np.arange(docs).astype("<i8").tobytes() * 2
        count, parts = quality._unpack(quality._pack(docs, names, both >> 11, both & 2047, n))
        assert count == docs and (np.repeat(parts[3], parts[4]) == both >> 11).all() and (parts[5] == (both & 2047)).all() and (parts[6] == n).all()


def test_quality_keeps_clean_rows(spark):
    clean, junk = [words(k, 80) for k in range(120)], ["#%$ " * 60, "QQQQ!!" * 40]
    df = table(spark, clean + junk + [None, ""]).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(df, labels).collect()}
    assert not got[120]["kept"] and not got[121]["kept"] and got[122]["kept"] and got[122]["perplexity"] is None
    assert sum(got[i]["kept"] for i in range(120)) >= 118
    assert all(r["kept"] for r in quality.judged(df, labels.limit(0)).collect()) and quality.judged(df.limit(0), labels).count() == 0


# all of them

CLASHES = "_whole _id _hash _lang _i _h _own _n _salt _nth _head _norm _point _keep _size _sha _ruled _host _paths _of host path _hot_sha _hot_id _hot_size c0 text_ lang_".split()
OPERATORS = {
    "pieces": lambda d, labels: pieces.decode(pieces.encode(d)),
    "round_trip": lambda d, labels: pieces.round_trip(d),
    "toxicity": lambda d, labels: toxicity.with_score(d, toxicity.fit([], [])),
    "exact_dedup": lambda d, labels: exact_dedup.content_sort(d),
    "html_text": lambda d, labels: html_text.extract(d, "text", "url", "found"),
    "url_filter": lambda d, labels: url_filter.judge(d),
    "quality": lambda d, labels: quality.judged(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("trusted", [0, 40])
def test_columns_with_clashing_names_come_back_unchanged(spark, name, trusted):
    if trusted and name != "quality":
        pytest.skip("only the quality model is trained here")
    df = table(spark, [words(k, 20) for k in range(60)]).withColumn("url", F.concat(F.lit("http://x.net/"), "doc_id"))
    replaced = {"url_filter": {"host", "path"}}.get(name, set())
    clashes = [c for c in CLASHES if c not in replaced]
    df = df.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clashes))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(trusted)], "doc_id long, quality int, toxic int")
    rows = OPERATORS[name](df, labels).collect()
    assert len(rows) == 60
    for r in rows:
        assert all(r[c] == f"{c}{r['doc_id']}" for c in clashes)


def test_operators_that_return_rows_of_their_own_take_clashing_columns(spark):
    df = table(spark, [words(k, 20) for k in range(20)])
    wide = df.select("*", *(F.lit("x").alias(c) for c in [*CLASHES, "_class", "_token", "_group", "part", "shard", "salt", "piece", "start", "file"]))
    assert {(r[0], r[1], r[2]) for r in jaccard_join.near_copies(wide).collect()} == {(r[0], r[1], r[2]) for r in jaccard_join.near_copies(df).collect()}
    assert packing.packed(wide).count() == 20
    assert wavelet.read_files(wavelet.encode_files(wide)).count() == 20
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    more = vectors.select("*", *(F.lit("x").alias(c) for c in ("id", "v", "d", "shard", "salt", "rows", "graph")))
    assert hnsw.nearest(more, hnsw.index(more)).count() == 45


def test_very_long_texts_of_one_character_are_judged(spark):
    """More entries of one n-gram in a chunk than 16 bits hold."""
    n = 17_500_000
    keys, place = quality.grams(["a" * n])
    different, times = np.unique(keys, return_counts=True)
    several = -(-times // 255)
    body = quality._pack(1, bytes(17), np.repeat(different, several), np.zeros(int(several.sum()), np.int64), np.full(int(several.sum()), 1))
    docs, parts = quality._unpack(body)
    assert docs == 1 and parts[3].tolist() == different.tolist() and parts[4].tolist() == several.tolist()
    assert len(place) == n + 1 and len(parts[5]) == int(several.sum()) and not parts[5].any()


def test_near_copies_with_repeated_ids_go_row_by_row(spark):
    text, other, third = words(1, 60), words(2, 60), words(3, 60)
    rows = [(3, text), (7, text + " more"), (7, other), (7, third), (None, text + " again"), (None, words(4, 60)), (7, None), (7, ""), (9, other), (12, third), (12, third), (1, words(5, 60)), (1, words(5, 60)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _digest", "1 as _n")
    got = jaccard_join.drop_near_copies(df)
    assert got.columns == df.columns
    want = [(3, text), (7, other), (7, third), (None, words(4, 60)), (7, None), (7, ""), (1, words(5, 60)), (4, None)]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert jaccard_join.drop_near_copies(df.limit(0)).count() == 0


def test_all_insults_are_learned_and_few_clean_texts_accused(spark):
    """Held out on sf0.1: over 0.78 of the labelled toxic texts at 0.3 (round 1: 0.73) and at most 2 % of the others; every insult that toxic texts share is known by itself."""
    where = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{where}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{where}/labels.parquet"))
    held = docs.join(labels, "doc_id").where(toxicity.held_out()).collect()
    score = model.scores([r["text"] or "" for r in held])
    found = sum(s >= 0.3 for s, r in zip(score, held, strict=True) if r["toxic"])
    accused = sum(s >= 0.3 for s, r in zip(score, held, strict=True) if not r["toxic"])
    assert found >= 0.78 * sum(r["toxic"] for r in held) and accused <= 0.02 * sum(not r["toxic"] for r in held)
    insults = "idiot disgusting trash worthless loser stupid pathetic clown scum moron".split()
    assert model.scores([f"The {w} of it." for w in insults]).min() > 0.3
    assert model.scores(["", "The and of.", "Von."]).max() < 0.1


def test_window_hashes_tell_windows():
    rng = random.Random(2)
    windows = toxicity.Windows([" ".join("".join(rng.choices("abé", k=rng.randint(1, 30))) for _ in range(400)), "ab ab. ab b a"])
    strings, hashes = windows.strings(np.arange(len(windows.begin))), windows.hashes().tolist()
    assert len(set(strings)) == len(set(hashes)) == len(set(zip(strings, hashes, strict=True))) > 300


def test_evident_windows_are_those_that_toxic_texts_share():
    texts = [f"{words(n, 30)} flurpish {words(n + 500, 5)}" if n % 8 == 0 else words(n, 36) for n in range(400)]
    y = np.arange(400) % 8 == 0
    found = set(toxicity.Bags(texts).evident(y, ~y))
    assert toxicity.Windows(["flurpish"]).strings(np.arange(1))[0] in found
    own = [w for w in found if len(w) == len("flurpish") + 2]
    assert len(own) == 1 and not toxicity.Bags(texts).evident(np.roll(y, 3), ~np.roll(y, 3))


def test_words_of_classes_drop_nothing_of_an_article():
    page = (
        '<body><div class="side">menu text</div><article><div class="post-header"><h1>Title of it</h1></div><p class="legal">A legal matter.</p><p class="side">Side by side.</p>'
        '<section id="search"><p>How we search.</p></section><p class="related">Related work.</p><div class="tracking alerts"><p>Tracking birds.</p></div><div class="ad">Buy now</div>'
        '<div class="share-bar">Share it</div><div role="navigation">Go on</div><section id="comments"><p>A reader says.</p></section><aside>Aside</aside></article><div class="legal">Terms</div></body>'
    )
    kept = [b.text() for b in html_text.Page(page).blocks if not b.boilerplate and b.text()]
    assert kept == ["Title of it", "A legal matter.", "Side by side.", "How we search.", "Related work.", "Tracking birds."]

"""Language network, neighbour search, token counts and page text."""

import html
import random
import re
import time

import numpy as np
import pytest

from facets.llm import language, neighbors, templates, transducer
from facets.llm.queries import QUERIES, tokenizer_path


def test_network_gradients():
    net = language.new_network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 103, (5, 7)).astype(np.uint8)
    lengths, labels = np.array([7, 3, 7, 1, 5]), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(windows, lengths, labels)
    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in v.shape)
            at = (at[0], int(rng.integers(97, 103))) if k.endswith("_in") else at
            old, losses = v[at], []
            for step in (1e-3, -1e-3):
                v[at] = old + step
                losses.append(net.gradients(windows, lengths, labels)[0])
            v[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grads[k][at]) < 1e-5


def test_language_held_out(spark, folder):
    got = QUERIES["op3_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(rows) == docs.count() and len(held) > 20
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert rows["score"].between(0, 1).all()


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double, drawn long"
    rows = [(i, t, lang, 0.5, 1) for i, (t, lang) in enumerate(
        [("ababab " * 30, "x"), ("zyzyzy " * 30, "y"), (None, "x"), ("", "y"), ("123 !?", "x"),
         ("zy", None), ("é" * 500, "y"), ("ababab " * 30, "x")])]
    docs = spark.createDataFrame(rows, schema)
    net = language.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, net).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[0][0] == "x" and got[1][0] == "y" and got[0] == got[7]
    none = docs.limit(0)
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(none, net).count() == 0


def test_every_byte_is_in_one_window():
    for n in (1, 95, 96, 97, 500):
        text = bytes(range(1, 200)) * 3
        windows, lengths = language.cut_windows(text[:n])
        assert b"".join(w[:k].tobytes() for w, k in zip(windows, lengths)) == text[:n]


def exact(ids, vectors, query, k):
    far = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), far[i]) for i in order]


@pytest.mark.parametrize("n,size", [(1500, 4096), (1500, 4), (7, 4096), (1, 10)])
def test_neighbours(spark, n, size):
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 24)).astype(np.float32)
    vectors[n // 3:n // 2] = vectors[0]  # a common vector, all ties
    ids = np.arange(n)
    rows = [(int(i), v.tolist(), 3.0) for i, v in zip(ids, vectors)]
    bad = [(100_000, None, 0.0), (200_000, [], 0.0), (300_000, [0.0] * 24, 0.0),
           (400_000, [float("nan")] + [1.0] * 23, 0.0), (500_000, [None] + [1.0] * 23, 0.0),
           (600_000, [float("inf")] + [1.0] * 23, 0.0)]
    bad += [] if n == 1 else [(700_000, [1.0] * 5, 0.0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score double")
    got = neighbors.nearest(table, query_block=size).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    wide = vectors.astype(np.float64)
    for q in range(0, n, 100):
        mine = got[got["query_id"] == q]
        want = exact(ids, wide, q, 10)
        assert mine["rank"].tolist() == list(range(1, len(want) + 1))
        far = np.sqrt(((wide[mine["vec_id"]] - wide[q]) ** 2).sum(axis=1))
        np.testing.assert_allclose(mine["score"], far, rtol=1e-12)
        assert (mine["score"].diff().dropna() >= 0).all()
        hits += len({v for v, _ in want} & set(mine["vec_id"]))
        total += len(want)
    assert set(got["query_id"]) <= set(range(0, n, 100))
    assert total == 0 or hits / total >= 0.9
    assert neighbors.nearest(table.limit(0)).count() == 0


def test_probing_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (400, 4)).astype(np.uint8)
    codes[200:] = codes[:200] ^ (1 << rng.integers(0, 8, (200, 4))).astype(np.uint8)
    index = neighbors.MultiIndex(np.arange(400), np.zeros((400, 2)), codes)
    for radius in range(0, 33):
        apart = np.bitwise_count(codes ^ codes[5]).sum(axis=1, dtype=int)
        assert index.within(codes[5], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_recall_on_embeddings(spark, folder):
    got = QUERIES["op6_nearest_neighbours"](spark, folder).toPandas()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = {v for v, _ in exact(ids, vectors, q, 10)}
        hits += len(want & set(got[got["query_id"] == ids[q]]["vec_id"]))
        total += len(want)
    assert hits / total >= 0.9


ALPHABET = [*" '\n\tstmdrevlSTab19é.!<>|　\xa0\x85​\x1c½漢😀́ـ", "  ", "'s",
            "'re", "'ll", "'ve", " '", "<|endoftext|>", "the", "tion"]


@pytest.fixture(scope="module")
def counter():
    return transducer.TokenCounter(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(
        texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_token_counts_of_random_texts(counter, library, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 10, 300, 900])))
             for _ in range(150)]
    assert counter.counts(texts) == library(texts)


def test_token_counts_of_long_runs(counter, library):
    texts = ["a" * 3000, " " * 1000, "ab" * 700 + "\n" * 600 + "x", "'" * 700, "é" * 999, "'ll" * 300,
             "\t \t" * 300 + "z", "1" * 1000]
    assert counter.counts(texts) == library(texts)


def test_compiling_anew_changes_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(transducer, "_MOST_STATES", 50)
    texts = ["the nation thinks " * 20, "Übergrößen", "x = y + 1"]
    assert [counter.counts([t])[0] for t in texts] == library(texts)


def test_token_count_rows(spark, folder, library):
    got = QUERIES["op9_token_counts"](spark, folder).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    assert got.loc[docs["doc_id"], "n_tokens"].tolist() == library(docs["text"].tolist())
    assert got.loc[docs["doc_id"], "n_bytes"].tolist() == [len(t.encode()) for t in docs["text"]]
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (2, "", 5)],
                                "doc_id long, text string, n_tokens long")
    rows = transducer.token_counts(odd, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in rows) == [
        ("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("None", 1, 1)]
    assert transducer.token_counts(odd.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_pages_against_their_articles(spark, folder):
    got = QUERIES["op8_html_extraction"](spark, folder).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{folder}/pages.parquet").toPandas()
    assert len(got) == len(pages)
    for page, body in zip(pages["page_id"], pages["html"]):
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", body, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split())
                  for b in re.split(r"</?(?:h1|p|br)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got.loc[page, "text"] == want
        assert got.loc[page, "n_chars"] == len(want)


def site(n, extra=""):
    return [f'<html><body><header>Top</header><ul class="menu"><li>a{i}<li>b</ul>'
            f'<div id="ad-1">buy {i}</div><div class="story"><article><h1>T{i}</h1>'
            f'<p>one &amp; <b>two</b>\n three<p>four{i}<br>five<table><tr><td>x<td>y</table>'
            f'<script>"<p>no</p>"</script></article></div>{extra}'
            f'<section class="comments"><p>reader</p></section><footer>f</footer>' for i in range(n)]


def test_page_slots(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", p) for i, p in enumerate(site(8))]
    rows += [(100, None, None), (101, "http://h0.example/x", ""), (102, "no url", "plain text"),
             (103, "http://solo.example/", "<div>body</div><nav>menu</nav>"),
             (104, "http://h1.example/odd", "<p>loose <!-- no --> end<!-- open")] + [
             (0, "http://h0.example/0", site(1)[0])] * 2
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "page_id long, url string, html string, host string, roots long")
    got = templates.extract(table).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(8):
        assert text[i] == f"T{i}\none & two three\nfour{i}\nfive\nx\ny"
    assert (text[100], text[101], text[102], text[103], text[104]) == (
        "", "", "plain text", "body", "loose end")
    assert templates.extract(table.limit(0)).count() == 0
    classes = templates.token_classes(table)
    assert {r["host"] for r in classes.collect()} >= {"h0.example", "h1.example", "*"}


def plain_site(n):
    """Pages of plain divisions: only comparing pages tells the text from the rest."""
    return [f"<div class=top>Acme News<p>Home<p>World</div><div class=body><p>story {i}"
            f"<p>told {i * i}</div><div class=bottom>All rights reserved</div>" for i in range(n)]


def test_template_words_are_left_out(spark):
    rows = [(i, "http://plain.example/", p) for i, p in enumerate(plain_site(6))]
    # Copies of a page are no template; words inside an article stay, however often they occur.
    rows += [(100 + i, "http://copies.example/", "<div>same</div><div>words</div>")
             for i in range(9)]
    rows += [(200 + i, "http://art.example/", f"<div>x</div><article><p>always<p>{i}</article>")
             for i in range(5)]
    # A name counts only if all of it says so.
    rows += [(300, "http://solo.example/", '<div class="comment-policy-post">real</div>'
              '<div id="share-prices">text</div><div class="site-footer">no</div>'
              '<div id="cookie-banner2">no</div>')]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in templates.extract(table).collect()}
    assert [text[i] for i in range(6)] == [f"story {i}\ntold {i * i}" for i in range(6)]
    assert {text[100 + i] for i in range(9)} == {"same\nwords"}
    assert [text[200 + i] for i in range(5)] == [f"always\n{i}" for i in range(5)]
    assert text[300] == "real\ntext"
    # Without its template a page keeps the words around the story.
    assert templates.main_text(plain_site(1)[0], set()).startswith("Acme News\nHome")


@pytest.mark.parametrize("piece", ["<div ", "<div>", "<div></x>", "<li><b>", "<!x", "<a b='",
                                   '<p "', "<tr><td><div>", "<script>", "<ul><li><dt>"])
def test_long_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    templates.main_text(page, set())
    assert time.perf_counter() - start < 20


def test_template_is_nested(spark):
    table = spark.createDataFrame(
        [(i, "http://h.example/", "<main>" + "<section><i>x</i><h2>h</h2></section>" * (i + 1)
          + "</main><aside>n</aside>") for i in range(5)],
        "page_id long, url string, html string")
    classes = [r["tokens"] for r in templates.token_classes(table).collect()
               if r["host"] == "h.example"]
    found = templates.nested([[t.asDict() for t in c] for c in classes])
    labels = {frozenset(t["label"] for t in c["tokens"]): c["parent"] for c in found}
    assert set(labels) == {frozenset({"main", "aside"}), frozenset({"section", "h2"})}
    inner = labels[frozenset({"section", "h2"})]
    assert {t["label"] for t in found[inner]["tokens"]} == {"main", "aside"}

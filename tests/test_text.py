import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from facets.operators import counting, features, labels, terms, topics


def docs(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)],
                                 "Id long, cluster int, clean_text string")


def test_term_counts(spark):
    got = {(r["Id"], r["term"]): r["tf"]
           for r in terms.term_counts(docs(spark, ["bb aa bb the aa bb", "", "the"])).collect()}
    assert got == {(0, "aa"): 2, (0, "bb"): 3, (0, "aa bb"): 2, (0, "bb aa"): 2}


def test_tfidf_weights_before_scaling(spark):
    df = docs(spark, ["aa cc cc cc", "aa cc", "cc", "cc"])
    vocab = {r["term"]: r["idf"] for r in terms.vocabulary(
        terms.term_counts(df), 4, 1, 1.0, 100).collect()}
    assert math.isclose(vocab["aa"], 1.5108256237659907)
    assert math.isclose((1 + math.log(3)) * vocab["cc"], 2.09861228866811)


def test_plurals_join_their_stem(spark):
    got = {r["word"]: r["n"] for r in terms.word_freq(
        docs(spark, ["cat cats cats glass glas 77 it's the dogs"]), "clean_text").collect()}
    assert got == {"cat": 3, "glass": 1, "glas": 1, "dogs": 1}


def test_label_term_markers(spark):
    rows = [(i, 0, "aa bb") for i in range(3)] + [(10 + i, 1, f"w{chr(97 + i)}x") for i in range(5)]
    df = spark.createDataFrame(rows, "Id long, cluster int, clean_text string")
    got = {r["cluster"]: r["terms"] for r in terms.label_terms(df).collect()}
    assert got == {0: ["insufficient data"], 1: ["error"]}


def test_lsa_spans_the_leading_subspace(spark, reviews):
    vectors, vocab = terms.tfidf_vectors(reviews.select("Id", "clean_text"))
    width = vocab.count()
    loadings, energy = features.fit_lsa(vectors.repartition(3), width, 10)
    dense = np.zeros((reviews.count(), width))
    ids = {r["Id"]: i for i, r in enumerate(reviews.select("Id").collect())}
    for r in vectors.collect():
        dense[ids[r["Id"]], r["indices"]] = r["values"]
    exact = np.linalg.svd(dense, compute_uv=False)[:10]
    assert np.allclose(loadings.T @ loadings, np.eye(10), atol=1e-8)
    assert np.allclose(np.sqrt(energy)[:5], exact[:5], rtol=1e-2)
    shares = features.lsa_variance(vectors, len(dense), loadings, energy)
    projected = dense @ loadings
    assert np.allclose(shares, projected.var(axis=0) / dense.var(axis=0).sum(), rtol=1e-6)
    out, _, _ = features.lsa(reviews.select("Id"), vectors, width, 10)
    assert out.count() == len(dense)
    got = {r["Id"]: r["text_vec"] for r in out.collect()}
    assert np.allclose(np.array([got[i] for i in ids]), projected, atol=1e-8)


def test_matrices_add_up_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(features, "_FAN_IN", 3)
    df = spark.range(100, numPartitions=20)
    total = features.sum_matrices(
        df, lambda bs: sum(np.full((2, 2), float(b["id"].sum())) for b in bs), (2, 2))
    assert (total == 4950).all()


def test_pca_components(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 5)) * [3, 2, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)],
                               "Id long, fused array<double>")
    out, ratios, loadings = features.pca(df, "fused", 3)
    assert np.allclose(loadings.T @ loadings, np.eye(3))
    got = np.array([r["pca"] for r in out.orderBy("Id").collect()])
    assert np.allclose(got, (data - data.mean(axis=0)) @ loadings)
    cov = np.linalg.eigvalsh(np.cov(data.T))[::-1]
    assert np.allclose([r["ratio"] for r in ratios.orderBy("pc").collect()], cov[:3] / cov.sum())


def test_digamma():
    # Known values: minus Euler's constant at 1, and psi(x + 1) = psi(x) + 1 / x.
    x = np.array([0.01, 0.3, 1.0, 2.5, 70.0])
    assert topics.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-11)
    assert np.allclose(topics.digamma(x + 1), topics.digamma(x) + 1 / x, atol=1e-11)
    assert topics.digamma(np.zeros(1))[0] == -np.inf


def test_document_topics_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(5)
    beta = rng.dirichlet(np.ones(12), 3)
    docs = [np.unique(rng.integers(0, 12, 5)) for _ in range(9)] + [np.array([], int)]
    group, topic_counts = np.zeros(10, int), np.array([3])

    def run(chosen):
        rows = np.repeat(np.arange(len(chosen)), [len(docs[d]) for d in chosen])
        terms = np.concatenate([docs[d] for d in chosen]).astype(int)
        return topics.document_topics(group[chosen], rows, terms, np.ones(len(terms)), beta,
                                      topic_counts)[0]
    together = run(list(range(10)))
    assert np.allclose(together, np.vstack([run([d]) for d in range(10)]), atol=1e-12)
    # A settled document satisfies its own equation, and its weights add up to its words.
    assert np.allclose(together.sum(1), [1 + len(d) for d in docs])


def test_topics_find_planted_words_in_every_group(spark):
    """Two vocabularies per group, never mixed in a row; every step serves both groups."""
    rng = np.random.default_rng(2)
    rows, planted = [], {}
    for i in range(400):
        g, side = i % 2, int(rng.integers(0, 2))
        words = [f"w{'ab'[side]}{x}" for x in "cdefgh"]
        planted[i] = side
        rows.append((i, g, " ".join(rng.choice(words, 8))))
    rows += [(1000, None, "lost row"), (1001, 0, None), (1002, 7, "too small a group")]
    df = spark.createDataFrame(rows, "Id long, cluster int, clean_text string")
    table, labelled = topics.topics_per_group(df, n_topics=2, top=6, passes=6)
    for r in table.collect():
        assert len({w[1] for t in r["top_words"] for w in t.split()}) == 1
    got = {r["Id"]: (r["cluster"], r["sub_topic"]) for r in labelled.collect()}
    assert got[1000][1] is None and got[1002][1] is None and got[1001][1] is not None
    for g in (0, 1):
        assert len({(planted[i], got[i][1]) for i in range(g, 400, 2)}) == 2
    again, _ = topics.topics_per_group(df.repartition(7), n_topics=2, top=6, passes=6)
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))


def test_topics_steps_do_not_grow_with_groups(spark, monkeypatch):
    steps = []
    real = topics._statistics
    monkeypatch.setattr(topics, "_statistics", lambda *a: steps.append(1) or real(*a))
    for n_groups in (1, 5):
        df = spark.range(30 * n_groups).selectExpr(
            "id as Id", f"cast(id % {n_groups} as int) as cluster",
            "if(id div 5 % 2 = 0, 'red green', 'salt sugar') as clean_text")
        steps.clear()
        table, _ = topics.topics_per_group(df, passes=2, batches=2)
        assert len(steps) == 4 and table.select("cluster").distinct().count() == n_groups


def test_topics_follow_group_size(spark):
    words = ["tea cup leaf", "dog bone leash", "corn chip salt", "cake icing jam"]
    rows, i = [], 0
    for group, size in ((0, 19), (1, 20), (2, 150)):
        for j in range(size):
            rows.append((i, group, f"{words[j % 4]} {words[(j // 2) % 4]}"))
            i += 1
    df = spark.createDataFrame(rows, "Id long, cluster int, clean_text string")
    table, labelled = topics.topics_per_group(df, passes=2)
    found = {}
    for r in table.collect():
        found.setdefault(r["cluster"], []).append(r["top_words"])
    assert {g: len(t) for g, t in found.items()} == {1: 2, 2: 3}
    assert labelled.count() == 189
    assert labelled.where("cluster = 0 and sub_topic is not null").isEmpty()
    assert labelled.where("cluster > 0 and sub_topic is null").isEmpty()
    assert topics.topic_count(500) == 4
    assert topics.topic_grid(table).where("cluster = 'C1'").first()["T3"] == ""


def test_label_responses(spark):
    good = '{"label":"Tea fans","description":"Like tea.","sentiment":"Positive"}'
    responses = spark.createDataFrame(
        [(0, good), (1, f"```json\n{good}\n```"), (2, "sorry"), (3, '{"sentiment":"Mixed"}')],
        "cluster int, response string")
    rows = spark.range(5).select(labels.F.col("id").cast("int").alias("cluster"))
    got = {r["cluster"]: tuple(r)[1:] for r in labels.attach_labels(
        rows, labels.parse_labels(responses)).collect()}
    tea = ("Tea fans", "Like tea.", "Positive")
    assert got == {0: tea, 1: tea, 2: ("Unknown", "unparseable response", "Unknown"),
                   3: ("C3", "", "Mixed"), 4: ("C4", "", "")}


def plain_common(rows, n, min_df, max_df):
    from collections import Counter, defaultdict
    occurs, docs_with, sizes = defaultdict(Counter), defaultdict(Counter), Counter()
    for g, text in rows:
        found = [w for w in (text or "").split(" ") if len(w) > 1 and w != "the"]
        found += [f"{a} {b}" for a, b in zip(found, found[1:])]
        sizes[g] += 1
        occurs[g].update(found)
        docs_with[g].update(set(found))
    out = set()
    for g, counts in occurs.items():
        kept = [(-c, t) for t, c in counts.items()
                if min_df <= docs_with[g][t] <= max_df * sizes[g]]
        out |= {(g, r + 1, t, -c, docs_with[g][t]) for r, (c, t) in enumerate(sorted(kept)[:n])}
    return out


def test_common_terms_are_exact_with_tables_of_any_size(spark):
    """Heavy terms beside a long tail: thinned tables, a second count, and the way without one."""
    import random
    from collections import Counter
    draw = random.Random(4)
    words = [f"w{int(draw.paretovariate(0.5)) % 4000}" for _ in range(30_000)]
    rows = [(i % 3 if i % 11 else None, " ".join(["the", *words[20 * i:20 * i + 20]]))
            for i in range(1500)] + [(1, None), (2, ""), (2, "the x")]
    df = spark.createDataFrame(rows, "cluster int, clean_text string").repartition(5)
    for room, dictionary, n, min_df, max_df in ((1 << 18, 10 ** 6, 50, 1, 1.0),
                                                (400, 10 ** 6, 40, 2, 0.4),
                                                (400, 30, 40, 2, 0.4), (300, 10 ** 6, 3000, 1, 0.9)):
        found, sizes = counting.common_terms(df, "clean_text", "cluster", n, min_df, max_df,
                                             ["the"], room, dictionary)
        assert {tuple(r) for r in found.collect()} == plain_common(rows, n, min_df, max_df)
        assert dict(sizes.collect()) == Counter(g for g, _ in rows)


def test_candidates_are_counted_once_more(spark, monkeypatch):
    """A small table names the heavy terms; the second pass proves them without a full count."""
    rows = [(0, "aa bb aa cc " + f"x{i} y{i} z{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "cluster int, clean_text string").repartition(2)
    passes = []
    count = counting._first_counts
    monkeypatch.setattr(counting, "_first_counts",
                        lambda *a, **k: passes.append(k["thin"]) or count(*a, **k))
    found, _ = counting.common_terms(df, "clean_text", None, 3, 5, 1.0, [], room=60)
    assert [(r["term"], r["cf"], r["df"]) for r in found.orderBy("rank").collect()] == [
        ("aa", 800, 400), ("aa bb", 400, 400), ("aa cc", 400, 400)]
    assert passes == [True]


def test_vectors_shuffle_nothing(spark, reviews):
    vectors, _ = terms.tfidf_vectors(reviews.select("Id", "clean_text"))
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_terms_of_empty_tables(spark):
    none = docs(spark, [])
    vectors, vocab = terms.tfidf_vectors(none)
    assert vectors.count() == vocab.count() == terms.top_terms(none).count() == 0
    blank = docs(spark, ["", None, "the"])
    assert terms.tfidf(blank, min_df=1).count() == 0


def test_lsa_pieces_are_dense_and_bounded():
    rng = np.random.default_rng(4)
    at = [np.sort(rng.choice(50, int(n), replace=False)) for n in rng.integers(1, 9, 700)]
    rows = pd.DataFrame({"indices": at, "values": [rng.random(len(i)) for i in at]})
    basis, seen = rng.normal(size=(50, 3)), []
    for places, columns, dense in features._chunks(rows):
        assert dense.shape == (len(places), len(columns)) and len(places) <= features._CHUNK_ROWS
        for p, got in zip(places, dense @ basis[columns]):
            assert np.allclose(got, rows["values"][p] @ basis[rows["indices"][p]])
        seen.extend(places)
    assert seen == list(range(700))


def test_tables_forget_words_of_terms_that_left():
    table, stops = counting._Table(1000), pa.array([], pa.string())
    texts = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(100)] + ["often often"] * 3
    table.add(pa.array([0] * len(texts)), pa.array(texts), stops)
    assert table.settle() > 1000
    table.thin(500)
    assert table.words == {"often": 1}


def test_topic_rows_are_counted_by_known_terms(spark):
    rows = [(1, "b", "red cat the red cat"), (2, "a", None), (3, "b", "unknown red"), (4, "a", "cat")]
    df = spark.createDataFrame(rows, "Id long, kind string, clean_text string")
    found = topics._encoded(df, "kind", "clean_text", "Id",
                            {"b": ["cat", "red", "red cat"], "a": ["cat", "dog"]}, ("the",))
    got = {r["_id"]: (r["g"], list(zip(r["indices"], r["counts"]))) for r in found.collect()}
    assert got == {1: (1, [(2, 2), (3, 2), (4, 2)]), 2: (0, []), 3: (1, [(3, 1)]), 4: (0, [(0, 1)])}


def test_packed_pieces_hold_like_rows(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):  # two kinds of rows without a common column, by turns
        at = np.sort(rng.choice(40, 8, replace=False)) + 40 * (i % 2)
        rows.append((i, [int(x) for x in at], [float(x) for x in rng.random(8)]))
    vectors = spark.createDataFrame(
        rows, "Id long, indices array<int>, values array<double>").coalesce(1)
    x = np.zeros((600, 80))
    for i, at, values in rows:
        x[i, at] = values
    total, sizes = np.zeros((80, 80)), []
    for columns, dense in features._dense(features.packed(vectors).toPandas()):
        total[np.ix_(columns, columns)] += dense.T @ dense
        sizes.append(len(columns))
    assert np.allclose(total, x.T @ x) and sum(sizes) < 80 * len(sizes)


def test_lsa_variance_of_rows_without_an_explosion(spark):
    vectors = spark.createDataFrame([(0, [0, 2], [1.0, 2.0]), (1, [1], [3.0])],
                                    "Id long, indices array<int>, values array<double>")
    x = np.array([[1, 0, 2], [0, 3, 0], [0, 0, 0.0]])
    loadings, energy = np.eye(3)[:, :2], (x ** 2).sum(axis=0)[:2]
    got = features.lsa_variance(vectors, 3, loadings, energy)
    assert np.allclose(got, x.var(axis=0)[:2] / x.var(axis=0).sum())

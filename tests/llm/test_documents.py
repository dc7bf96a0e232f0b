"""Operators on documents against brute-force versions, with odd rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from facets.llm import credentials, fmindex, licenses, packing, quality, simhash
from facets.llm.queries import QUERIES, span_texts, tokenizer_path

# Every operator has to leave these extra columns alone.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, score "
          "double, _text string, _key string, key string, keep long, id long, spans string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def random_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "mit", "license", "Apache", "general", "public", "token", "=", "é", "AB12",
             "x", "of", "\n", "\t", " ", "gnu", "cc", "by", "nc"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 80])))
             for _ in range(n)]
    base = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(60))
    near = [base, base, base.replace("x", "y", 1), base + " tail", base.upper()]
    secrets = ['password = "abcdef12"', "secret=ab token=123456789", "AKIA" + "A" * 16,
               "AKIA" + "B" * 15, "a" * 24, "0" * 23, "token: token: abcdefgh",
               "user = bob\npw Zz9" + "aB3" * 8 + " http://h.example/x",
               "user = bob\n\nZz9" + "aB3" * 8, "api_key:  'é" + "f" * 30 + "'" * 3,
               "pässwort 😀 token = abcdef😀" + "1" * 25]
    odd = [None, "", " ", "?!", "word " * 3000, "Released under the MIT License.",
           "Licensed under CC BY-NC 4.0.", "mit license mit license apache license"]
    return texts + near + secrets + odd


@pytest.fixture(scope="module")
def texts():
    return random_texts(3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "s", 0, 7, 0.5, "t", "k", "q", 1, 2, "sp") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=2):
    ids = sorted(fps)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min(group[b] for b in ids if bin(fps[a] ^ fps[b]).count("1") <= bits)
            if low < group[a]:
                group[a], changed = low, True
    return group


def test_fingerprints_and_components(docs, texts):
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    group = brute_components(fps)
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_digits("fp")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["hex"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == group[r["doc_id"]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))


def test_null_ids_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"),
                                  (None, "q r s t u v")], "doc_id long, text string")
    got = simhash.near_duplicates(rows).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["5", "5", "5", "None"]
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(rows).collect()) == ["5", "None"]


@pytest.mark.parametrize("full_key,bits", [(256, 2), (3, 2), (2, 3), (256, 1), (2, 0)])
def test_links_connect_all_near_fingerprints(spark, full_key, bits):
    """Also where keys are too full to compare and members spell out what is near them."""
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.fingerprint_links(table, bits, full_key).collect()
    root = {s: s for s in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= bits
        root[find(a)] = find(b)
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits:
                assert find(a) == find(b)


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    covered, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        for a in range(max(1, len(own) - window + 1) if own else 0):
            part = own[a:a + window]
            for b in range(len(words) - len(part) + 1):
                if words[b:b + len(part)] == part:
                    covered |= set(range(b, b + len(part)))
                    found.add(item)
    return len(words), len(covered), sorted(found)


@pytest.mark.parametrize("block_bytes,shard", [(1 << 20, 1000), (40, 50)])
def test_contamination(spark, docs, texts, none, block_bytes, shard):
    items = [(1, "the mit license of x"), (2, "Word word WORD word word"), (3, "é"), (4, "?"),
             (5, "the of the of mit license general public"), (5, "cc by nc"), (7, None),
             (None, "token"), (9, "never there at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    used = [i for i in items if i[0] is not None and i[1] is not None]
    got = fmindex.contamination(docs, benchmark, 4, shard, block_bytes).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        n, hit, found = brute_hits(texts[r["doc_id"]], used, 4)
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (n, hit, found)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == hit
    clean = fmindex.drop_contaminated(docs, benchmark, 4, shard, block_bytes)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(
        r["doc_id"] for r in got if not r["n_hit"])
    assert fmindex.contamination(none, benchmark).count() == 0
    assert fmindex.drop_contaminated(docs, benchmark.limit(0)).count() == len(texts) + 2


def test_text_item_ids(spark, docs, texts):
    items = [("b-2", "the mit license of x"), ("a", "word word word word"), ("b-2", "cc by nc")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = fmindex.contamination(docs, benchmark, 4).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["items"] == brute_hits(texts[r["doc_id"]], items, 4)[2]


def test_shards_with_repeated_windows(monkeypatch):
    monkeypatch.setattr(fmindex, "SLICE", 7)
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 5, 10):
        def drawn(n):
            return [" ".join(rng.choice(list("abc"), int(rng.integers(0, 25)))) for _ in range(n)]
        items, docs = [(k % 9, t) for k, t in enumerate(drawn(12))], drawn(20)
        windows = fmindex.Windows([(k, t.encode()) for k, t in items], size)
        symbols = [[windows.vocabulary.get(w, 0) for w in t.encode().split()] for t in docs]
        hits, found, spans = fmindex.search_shard(
            np.array([len(x) for x in symbols]), np.array(sum(symbols, []), np.int64), windows)
        for k, t in enumerate(docs):
            assert (len(symbols[k]), hits[k], found[k]) == brute_hits(t, items, size)
            assert sum(b - a for a, b in spans[k]) == hits[k]


def test_fm_index_against_search():
    rng = np.random.default_rng(1)
    for _ in range(40):
        top = int(rng.integers(1, 6))
        text = rng.integers(0, top + 1, int(rng.integers(1, 200)))
        text[-1] = 0
        index = fmindex.FmIndex(text, top, sample=int(rng.integers(1, 9)))
        patterns = rng.integers(1, top + 1, (20, 4))
        lengths = rng.integers(1, 5, 20)
        low, high = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache",
           ("general", "public", "license"): "gpl"}


def test_licenses(docs, texts, none):
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        at = [(i, label) for i in range(len(words)) for p, label in PHRASES.items()
              if tuple(words[i:i + len(p)]) == p]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        ends = (at[0][0], at[-1][0]) if at else (None, None)
        assert (r["first_word"], r["last_word"]) == ends
        assert {x for _, x in at} <= {x for x in r["labels"].split(",")}
        assert 0 <= r["score"] <= 1
    by_text = {texts[r["doc_id"]]: r for r in got}
    assert by_text["Licensed under CC BY-NC 4.0."]["labels"] == "cc-by-nc"
    assert by_text["Released under the MIT License."]["labels"] == "mit"
    assert licenses.scan(none).count() == 0


def test_license_template_needs_its_place(spark):
    whole = ("Permission is hereby granted, free of charge, to any person obtaining a copy of "
             "this software and associated documentation files")
    mixed = " ".join(sorted(whole.split()))
    got = licenses.scan(spark.createDataFrame(
        [(1, "x y " + whole), (2, mixed)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "mit", 2: ""}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)")


def brute_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def brute_linked(text, reach=credentials.REACH):
    text, base = text or "", brute_base(text)
    weak = [(m.start(), k, m.end()) for k, p in ((3, credentials.IDENTIFIER),
                                                 (4, credentials.SECRET), (5, credentials.ENDPOINT))
            for m in re.finditer(p, text)]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]

    def near(part, kinds):
        return any(k in kinds and abs(s - part[0]) <= reach
                   and not any(min(s, part[0]) < b <= max(s, part[0]) for b in breaks)
                   for s, k, _ in base + weak)

    needs = {3: [{0, 2, 4}], 4: [{1, 3}], 5: [{0, 2, 4}, {1, 3}]}
    return sorted(base + [w for w in weak if all(near(w, n) for n in needs[w[1]])])


def test_secrets(docs, texts, none):
    got = credentials.secret_spans(docs).withColumn("named", span_texts("spans")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute_linked(texts[r["doc_id"]])
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == want
    kinds = {credentials.KINDS[s["kind"]] for r in got for s in r["spans"]}
    assert kinds == set(credentials.KINDS)
    assert credentials.secret_spans(none).count() == 0


def test_linked_secret_of_any_length(spark):
    long = "aB3" * 30 + "xyZ9" * 500
    rows = [(1, "user = bob " + long[:90]), (2, "user = bob " + long), (3, long)]
    got = credentials.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    ends = {r["doc_id"]: [s["end"] for s in r["spans"] if s["kind"] == 4] for r in got.collect()}
    assert ends == {1: [101], 2: [11 + len(long)], 3: []}


def test_secret_behind_equals_sign(spark):
    """NAME=value lines: the secret counts next to an access identifier, and not alone."""
    value = "Zz9" + "aB3" * 9
    both = "AWS_ACCESS_KEY_ID=AKIA" + "A" * 16 + "\nAWS_SECRET_ACCESS_KEY=" + value
    alone = "AWS_SECRET_ACCESS_KEY=" + value
    rows = credentials.secret_spans(spark.createDataFrame(
        [(1, both), (2, alone)], "doc_id long, text string")).collect()
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4]
             for r in rows}
    assert found == {1: [(both.index(value), len(both))], 2: []}


def test_redaction(docs, texts, none):
    clean = credentials.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        text, out, at = texts[r["doc_id"]], "", 0
        for a, _, b in brute_linked(text):
            if a >= at:
                out += text[at:a] + credentials.MASK
            at = max(at, b)
        assert r["text"] == (None if text is None else out + text[at:])
        assert (r["_text"], r["_key"], r["spans"]) == ("t", "k", "sp")
    assert credentials.redact(none).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(["é token=abcdef123"] * 300)
    got = credentials.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(s["start"], s["kind"], s["end"]) for s in got.first()["spans"]] == brute_base(text)


def test_packing(docs, texts, none):
    from tokenizers import Tokenizer
    path, capacity = tokenizer_path("word_bpe_49k.json"), 64
    tokenizer = Tokenizer.from_file(path)
    want, lengths = set(), []
    for i, t in enumerate([*texts, texts[0], texts[0]]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            lengths.append(len(part))
            want.add((i if i < len(texts) else 0, k // capacity, k, len(part),
                      zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack_documents(docs, path, capacity).toPandas()
    assert set(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()
                   )) == want
    assert len(got) == len(lengths)
    rooms = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        rooms.append(capacity - g["length"].sum())
    assert sorted(rooms) == brute_best_fit(lengths, capacity)
    assert packing.pack_documents(none, path).count() == 0


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        open_ = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if open_:
            rooms[min(open_)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_runs():
    rng = random.Random(2)
    for _ in range(100):
        capacity = rng.choice([7, 16, 31, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        histogram = {n: lengths.count(n) for n in lengths}
        fill = {}
        for n, _, count, first, offset in packing.best_fit_runs(histogram, capacity):
            for k in range(count):
                fill.setdefault(first + k, []).append((offset, n))
        rooms = []
        for parts in fill.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            rooms.append(capacity - at)
        assert sorted(rooms) == brute_best_fit(lengths, capacity)


def test_quality_scores(spark, folder, docs, texts, none):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(documents, labels, learn_from=quality.crc_part(4) != 2)
    got = quality.scores(documents, model).join(labels, "doc_id").toPandas()
    got["held"] = [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    right = (got["score"] >= quality.THRESHOLD) == (got["quality"] == 1)
    assert right[got["held"]].mean() > 0.85
    odd = {r["doc_id"]: r["score"] for r in quality.scores(docs, model).collect()}
    assert all(0 <= s <= 1 for s in odd.values())
    assert odd[texts.index(None)] == odd[texts.index("")]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {
        i for i, s in odd.items() if s >= quality.THRESHOLD}
    empty = quality.fit(none, labels.limit(0))
    assert {r["score"] for r in quality.scores(docs, empty).collect()} == {0.5}
    assert quality.scores(none, empty).count() == 0


def test_quality_sample_bound(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(documents, labels, sample=20)
    assert np.isfinite(model.weights).all() and model.weights.any()


def test_digests_of_queries(spark, folder):
    got = QUERIES["op2_benchmark_decontamination"](spark, folder).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(
        f"{folder}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(
        f"{folder}/benchmark.parquet").collect()]
    hit = got[got["contaminated"]]
    assert len(hit) > 0
    for _, r in hit.iterrows():
        n, covered, found = brute_hits(texts[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, covered, len(found))
        assert r["items_sha256"] == hashlib.sha256(
            ",".join(sorted(map(str, found))).encode()).hexdigest()
    got = QUERIES["op7_secret_scan"](spark, folder).toPandas()
    names = ("assign", "access", "hex")
    for _, r in got.iterrows():
        base = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(
            f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(
            sum(k == x for _, k, _ in base) for x in range(3))

"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facets.llm import (bytebpe, credentials, fmindex, language, licenses, neighbors, packing,
                        quality, simhash, spelling, templates, transducer, whitening)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files lie; the operators take any path."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def digest(values):
    return F.sha2(F.array_join(values, ","), 256)


@query("op1_simhash_near_dedup")
def _(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op2_benchmark_decontamination")
def _(spark, folder):
    found = fmindex.contamination(table(spark, folder, "documents"),
                                  table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        digest(names).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_license_scan")
def _(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op5_quality_classifier")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = quality.crc_part(4) == 2
    model = quality.fit(docs, table(spark, folder, "labels"), learn_from=~held_out)
    found = quality.scores(docs, model)
    return found.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def span_texts(spans: str):
    """kind:start:end of every span."""
    kinds = F.array(*[F.lit(k) for k in credentials.KINDS])
    return F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))


@query("op7_secret_scan")
def _(spark, folder):
    found = credentials.secret_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < credentials.BASE)

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}")
              for k, name in enumerate(credentials.KINDS[:credentials.BASE])]
    return found.withColumn("_base", base).select(
        "doc_id", *counts, digest(span_texts("_base")).alias("base_sha256"),
        F.array_join(span_texts("spans"), ",").alias("spans"))


@query("op10_best_fit_packing")
def _(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"),
                                  tokenizer_path("word_bpe_49k.json"))


@query("op3_language_id")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = quality.crc_part(3) == 1
    found = language.identify(docs, language.fit(docs, learn_from=~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@query("op6_nearest_neighbours")
def _(spark, folder):
    return neighbors.nearest(table(spark, folder, "embeddings"))


@query("op9_token_counts")
def _(spark, folder):
    found = transducer.token_counts(table(spark, folder, "documents"),
                                    tokenizer_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op8_html_extraction")
def _(spark, folder):
    found = templates.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op11_embedding_whitening")
def _(spark, folder):
    found = whitening.whiten_table(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_spelling_variants")
def _(spark, folder):
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"),
                                                  drop_every=31))


@query("op13_byte_bpe")
def _(spark, folder):
    import public_tokenizers
    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN,
                           packed=True)
    found = bytebpe.decode(coded, ranks, text=False, keep=("n_tokens", "ids"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))

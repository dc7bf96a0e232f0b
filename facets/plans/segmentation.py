"""The whole run: from raw reviews to groupings and every report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import (CATEGORY_RULES, DBSCAN_MIN_SAMPLES, DEFAULT_CATEGORY,
                              FINAL_MAX_ITER, FINAL_RESTARTS, FINAL_SAMPLE, GRAPH_NEIGHBORS,
                              K_RANGE, LDA_PASSES, LSA_DIMS, NUMERIC_FEATURES, PCA_DIMS, SEED,
                              STOP_WORDS, SWEEP_MAX_ITER, SWEEP_RESTARTS, TFIDF_MAX_DF,
                              TFIDF_MAX_FEATURES, TFIDF_MIN_DF, WARD_DIMS)
from facets.functions.text import with_category
from facets.operators import (cluster, compare, density, features, graph, labels, layout,
                              neighbors, profile, temporal, terms, topics)
from facets.plans.prepare import clean_reviews
from facets.session import cut, ship_package
from facets.sources.reviews import load_report

CATEGORIES = [name for name, _ in CATEGORY_RULES] + [DEFAULT_CATEGORY]


def build_features(reviews: DataFrame, *, stop_words=STOP_WORDS, min_df: int = TFIDF_MIN_DF,
                   max_df: float = TFIDF_MAX_DF, max_features: int = TFIDF_MAX_FEATURES,
                   lsa_dims: int = LSA_DIMS, pca_dims: int = PCA_DIMS, map_method: str = "neighbors",
                   seed: int = SEED):
    """Table (Id, fused, pca, ward_pca, map_x, map_y), and the shares of variance that the principal
    and the latent-semantic components explain: (pc, ratio) each.

    ``map_method="neighbors"`` lays out the principal components by ``layout.neighbor_map``;
    ``"pca"`` takes the first two of them.
    """
    if map_method not in ("neighbors", "pca"):
        raise ValueError(f"unknown method: {map_method}")
    docs = reviews.select("Id", "clean_text")
    weights, vocab = terms.tfidf_vectors(docs, stop_words=stop_words, min_df=min_df, max_df=max_df,
                                         max_features=max_features)
    weights = cut(weights)
    numbers = reviews.select("Id", *NUMERIC_FEATURES)
    with_text, loadings, energy = features.lsa(numbers, weights, vocab.count(), lsa_dims, seed=seed)
    text_ratios = features.lsa_ratios(weights, docs.count(), loadings, energy)
    fused = cut(features.fused_features(with_text, "text_vec", NUMERIC_FEATURES)
                .select("Id", "fused"))
    out, ratios, _ = features.pca(fused, "fused", pca_dims, "pca")
    # Leading components are the same however many are kept.
    out = cut(out.select("Id", "fused", "pca", F.slice("pca", 1, WARD_DIMS).alias("ward_pca")))
    if map_method == "pca":
        feats = out.withColumns({"map_x": F.get("pca", F.lit(0)), "map_y": F.get("pca", F.lit(1))})
    else:
        feats = cut(out.join(layout.neighbor_map(out, "Id", "pca").withColumnRenamed("id", "Id"),
                             "Id"))
    return feats, ratios, text_ratios


def segment(raw: DataFrame, *, n_samples: int | None = None, k: int | None = None, ks=K_RANGE,
            sweep_restarts: int = SWEEP_RESTARTS, restarts: int = FINAL_RESTARTS,
            eps: float | None = None, min_samples: int = DBSCAN_MIN_SAMPLES,
            neighbors_k: int = GRAPH_NEIGHBORS, sample: int | None = FINAL_SAMPLE,
            lda_passes: int = LDA_PASSES, responses: DataFrame | None = None, seed: int = SEED,
            **feature_settings) -> dict[str, DataFrame]:
    """Clean, vectorise, group four ways, and describe the groups.

    ``k=None`` takes the k with the best silhouette. ``responses`` (cluster, response) are answers to
    the label prompts of an earlier run. ``assigned`` in the result is the enriched review table; the
    other entries are the reports. ``feature_settings`` go to ``build_features``.
    """
    ship_package(raw.sparkSession)
    reviews = cut(clean_reviews(raw, n_samples=n_samples, seed=seed))
    feats, ratios, text_ratios = build_features(reviews, seed=seed, **feature_settings)
    out = {"load_report": load_report(raw, reviews),
           "explained_variance": profile.explained_variance(ratios),
           "text_variance": profile.explained_variance(text_ratios)}
    if k is None:
        out["sweep"] = cluster.sweep_k(feats, "pca", ks, sweep_restarts, SWEEP_MAX_ITER, seed=seed)
        k = cluster.best_k(out["sweep"])
    by_kmeans, _ = cluster.kmeans(feats, "pca", k, restarts, FINAL_MAX_ITER, seed)
    by_kmeans = cut(by_kmeans.select("Id", "cluster"))
    by_ward = cluster.ward(feats.select("Id", "ward_pca"), "ward_pca", k, seed=seed)
    by_ward = cut(by_ward.select("Id", "agg_cluster"))
    plane = ["map_x", "map_y"]
    out["distance_curve"] = cut(neighbors.distance_curve(
        neighbors.k_distance(feats, "Id", plane, min_samples)))
    out["suggested_eps"] = neighbors.suggest_eps(out["distance_curve"])
    if eps is None:
        eps = out["suggested_eps"].first()["eps"]
    by_density = density.dbscan(feats, "Id", plane, eps, min_samples)
    edges = cut(graph.knn_graph(feats, "Id", "pca", neighbors_k))
    communities = cut(graph.louvain(edges, feats.select(F.col("Id").alias("id")), seed=seed))
    marked = cut(
        feats.join(by_kmeans, "Id").join(by_ward, "Id")
        .join(by_density.select(F.col("id").alias("Id"), "dbscan_cluster"), "Id")
        .join(communities.select(F.col("id").alias("Id"), F.col("community").alias("graph_cluster")),
              "Id"))
    names = {"kmeans": "cluster", "ward": "agg_cluster", "graph": "graph_cluster"}
    on_pca = {r["grouping"]: r["silhouette"] for r in neighbors.silhouettes(
        marked, "Id", "pca", ["cluster", "graph_cluster"], sample, seed).collect()}
    on_ward = neighbors.silhouette(marked, "Id", "ward_pca", "agg_cluster", sample, seed).first()[0]
    q = graph.modularity(edges, communities).first()[0]
    out["methods"] = compare.compare_methods(
        marked, names, {"kmeans": on_pca[0], "graph": on_pca[1], "ward": on_ward}, "graph", q)
    out["noise"] = profile.noise_report(marked)

    columns = ["Id", "map_x", "map_y", "cluster", "dbscan_cluster", "agg_cluster", "graph_cluster"]
    df = with_category(reviews.drop("cluster").join(marked.select(columns), "Id"))
    out["topics"], df = topics.topics_per_group(df, passes=lda_passes, seed=seed)
    df = cut(df)
    if responses is not None:
        df = labels.attach_labels(df, labels.parse_labels(responses))
    out["assigned"] = df
    groups = list(range(k))
    by_cluster = cut(profile.profile(df))
    out.update({
        "summary": profile.summary_stats(df),
        "ratings": profile.rating_distribution(df),
        "words_histogram": profile.histogram(df, "word_count", 70, 0, 600),
        "helpfulness_histogram": profile.histogram(
            df.where(F.col("HelpfulnessDenominator") > 0), "helpfulness_ratio", 50),
        "years": profile.by_year(df),
        "star_share": profile.star_share_by(df),
        "box_stats": profile.box_stats(df),
        "helpfulness_scatter": profile.helpfulness_scatter(df, seed=seed),
        "correlation": profile.correlation(df, NUMERIC_FEATURES),
        "words": terms.word_freq(df, "Text", 120, sample=5000, seed=seed),
        "cluster_words": terms.word_freq(df, "clean_text", 80, "cluster", 3000, seed),
        "cluster_sizes": profile.group_sizes(df, "cluster"),
        "community_sizes": profile.group_sizes(df, "graph_cluster"),
        "cluster_profile": by_cluster,
        "cluster_profile_scaled": profile.minmax_scale(by_cluster, profile.SCALED),
        "community_profile": profile.profile(df, "graph_cluster", share=True),
        "rating_mix": profile.pivot_share(df, "cluster", "Score", [1, 2, 3, 4, 5], "pct_"),
        "top_terms": terms.top_terms(df),
        "sample_reviews": labels.sample_reviews(df, seed=seed),
        "category_sizes": profile.group_sizes(df, "category"),
        "category_mix": profile.pivot_share(df, "cluster", "category", CATEGORIES),
        "drift_share": temporal.drift_share(df, values=groups),
        "drift_rating": temporal.drift_rating(df, values=groups),
        "drift_stack": temporal.drift_stack(df, values=groups),
        "complaints": temporal.complaint_cluster(df),
        "complaint_months": temporal.monthly_volume(df),
        "topic_grid": topics.topic_grid(out["topics"]),
        "prompts": labels.label_prompts(df, seed=seed),
    })
    return out

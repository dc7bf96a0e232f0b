from facets.plans.segmentation import segment
from facets.sources.reviews import reviews_from_tables, write_assigned, write_tables


def test_whole_run(spark, folder, tmp_path):
    raw = reviews_from_tables(spark, folder)
    out = segment(raw, ks=(2, 3), sweep_restarts=1, restarts=1, lda_passes=1, lsa_dims=10,
                  pca_dims=5, min_samples=5)
    assigned = out.pop("assigned")
    assert assigned.count() == raw.count() == assigned.select("Id").distinct().count()
    for column in ("cluster", "agg_cluster", "graph_cluster", "dbscan_cluster", "category", "map_x"):
        assert assigned.where(f"{column} is null").isEmpty()
    groups = sorted(r[0] for r in assigned.select("cluster").distinct().collect())
    assert groups == list(range(len(groups)))
    q = out["methods"].where("measure = 'modularity'").first()["value"]
    assert -0.5 <= q <= 1
    assert out["text_variance"].count() == 10
    shares = [r["cum_pct"] for r in out["text_variance"].orderBy("pc").collect()]
    assert 0 < shares[-1] <= 100
    scaled = out["cluster_profile_scaled"].agg({"avg_rating": "max", "avg_words": "min"}).first()
    assert set(scaled) <= {0.0, 1.0, None}
    write_tables(out, f"{tmp_path}/tables")
    write_assigned(assigned, f"{tmp_path}/assigned", "csv")
    assert spark.read.parquet(f"{tmp_path}/tables/prompts").count() == len(groups)

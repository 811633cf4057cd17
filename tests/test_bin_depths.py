from seqloom.plans import vectors


def test_bin_of_one_contig_has_no_mean_depth_distance(spark, monkeypatch):
    depths = spark.createDataFrame([(i, [float(i + 1)] * 10) for i in (0, 10, 1)], "id long, vec array<double>")
    monkeypatch.setattr(vectors, "_event_depths", lambda *_: depths)
    rows = vectors.bin_metrics_depth(spark, "").collect()
    assert [r.label for r in rows] == [0] and rows[0].mean_distance > 0

import numpy as np

from lodestrata.llm import quality_gbt as Q


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Q.fit(x, y, trees=30, depth=3, bins=16)
    for row, got in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12
    assert auc(y, trees.score(x)) > 0.97


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = Q.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = got.where("held_out").join(Q.labels_of(labels, "quality"), "doc_id").toPandas()
    y, s = rows.label.to_numpy(), rows.score.to_numpy()
    print("held-out AUC", auc(y, s), "accuracy", ((s >= 0.3) == y).mean())
    assert auc(y, s) > 0.9 and ((s >= 0.3) == y).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "a b", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.score_quality(docs, labels).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert Q.score_quality(docs.limit(0), labels).collect() == []
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.score_quality(docs, one).collect())

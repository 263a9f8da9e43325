import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import counts
from newsloom.llm import quality_rules, site_quality
from newsloom.llm.boosted_trees import fit


@pytest.fixture(scope="module")
def judged(documents, labels):
    forest = quality_rules.fit_rules(documents, labels)
    return quality_rules.judge(documents, forest).collect()


def test_counts_equal_brute_force(judged, texts):
    assert len(judged) == len(texts) + 3
    for row in judged:
        if row["doc_id"] is None:
            continue
        want = counts(texts[row["doc_id"]])
        assert tuple(row[c] for c in quality_rules.COUNTS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and row["good"] >= quality_rules.THRESHOLD)


def test_kept_documents_keep_their_columns(documents, labels, judged):
    forest = quality_rules.fit_rules(documents, labels)
    kept = quality_rules.keep_good(documents, forest)
    assert kept.columns == documents.columns
    assert kept.count() == sum(row["kept"] for row in judged)


def test_one_class_of_labels_leaves_the_base_rule(documents, labels):
    assert quality_rules.fit_rules(documents, labels.where("quality = 1")) is None
    rows = quality_rules.judge(documents, None).collect()
    assert all(row["kept"] == (not row["base_failed"]) for row in rows)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    forest = fit(x, y, np.array([-1, 1, 0]))
    p = forest.probabilities(x)
    assert ((p >= 0.5) == (x[:, 0] < 0.5)).mean() > 0.97
    for feature, sign in ((0, -1), (1, 1)):
        line = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
        line[:, :, feature] = np.linspace(0, 1, 40)
        steps = np.diff(forest.margins(line.reshape(-1, 3)).reshape(50, 40))
        assert (sign * steps >= -1e-12).all()


def test_margins_row_by_row():
    """Vectorised scoring against a walk from root to leaf for each row and tree."""
    rng = np.random.default_rng(4)
    x = rng.random((400, 5)).round(2)
    y = (x[:, 0] + rng.random(400) > 1).astype(float)
    forest = fit(x, y, np.array([1, -1, 0, 0, 1]), trees=25)
    assert len(forest.roots) > 5
    for row, margin in zip(x, forest.margins(x)):
        total = forest.start
        for node in forest.roots.tolist():
            while forest.left[node] != node:
                goes_left = row[forest.feature[node]] <= forest.threshold[node]
                node = (forest.left if goes_left else forest.right)[node]
            total += forest.value[node]
        assert margin == pytest.approx(total, abs=1e-9)


POSTERIORS = """
WITH paths AS (SELECT host, path, count(*) AS n, sum(p) AS good FROM evidence GROUP BY ALL),
hosts AS (SELECT host, sum(n) AS n, sum(good) AS good FROM paths GROUP BY ALL),
rate AS (SELECT least(greatest(sum(good) / sum(n), 1e-3), 1 - 1e-3) AS r FROM hosts),
a AS (SELECT sum(n * r * (1 - r)) AS whole, sum(n * (pow(good / n - r, 2) - r * (1 - r) / n)) AS between_ FROM hosts, rate),
host_strength AS (SELECT CASE WHEN whole = 0 OR between_ <= 0 THEN 1000.0
  ELSE least(greatest(whole / between_ - 1, 2.0), 1000.0) END AS s FROM a),
sites AS (SELECT p.host, p.path, p.n, p.good, h.n AS host_n, h.good AS host_good, (h.good + s * r) / (h.n + s) AS prior
  FROM paths p JOIN hosts h USING (host), rate, host_strength),
b AS (SELECT sum(n * prior * (1 - prior)) AS whole,
  sum(n * (pow(good / n - prior, 2) - prior * (1 - prior) / n)) AS between_ FROM sites),
path_strength AS (SELECT CASE WHEN whole = 0 OR between_ <= 0 THEN 1000.0
  ELSE least(greatest(whole / between_ - 1, 2.0), 1000.0) END AS t FROM b),
without AS (SELECT e.*, (host_good - p + s * r) / (host_n - 1 + s) AS host_rate, n, good
  FROM evidence e JOIN sites USING (host, path), rate, host_strength),
rates AS (SELECT *, (good - p + t * host_rate) / (n - 1 + t) AS path_rate FROM without, path_strength)
SELECT doc_id, host_rate, path_rate, 1 / (1 + exp(-(evidence + ln(least(greatest(path_rate, 1e-3), 1 - 1e-3)
  / (1 - least(greatest(path_rate, 1e-3), 1 - 1e-3)))))) AS score FROM rates ORDER BY ALL"""


@pytest.mark.parametrize("broadcast", [True, False])
def test_posteriors_equal_sql(spark, broadcast, monkeypatch):
    """Posteriors from the stored evidence of all documents, stated in SQL; with sites that are
    too many to broadcast too."""
    if not broadcast:
        monkeypatch.setattr("newsloom.operators.lookup.MAX_BROADCAST_ROWS", 0)
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = site_quality.fit_classifier(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    found = site_quality.evidence(documents, model, F.col("source"), F.concat_ws("/", "source", "lang")).cache()
    evidence = found.toPandas()  # noqa: F841
    want = duckdb.sql(POSTERIORS).fetchall()
    columns = ["doc_id", "host_rate", "path_rate", "score"]
    got = sorted(tuple(r) for r in site_quality.posterior(found).select(*columns).collect())
    assert len(got) == documents.count()
    for a, b in zip(got, sorted(want), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    forest = quality_rules.fit_rules(documents, labels.where(~part))
    model = site_quality.fit_classifier(documents, labels.where(~part))
    rules = quality_rules.judge(documents, forest)
    sites = site_quality.posterior(
        site_quality.evidence(documents, model, F.col("source"), F.col("lang"))
    )
    for result, known in ((rules, "quality = CAST(good >= 0.5 AS INT)"), (sites, "quality = CAST(kept AS INT)")):
        held = result.join(labels.where(part), "doc_id")
        assert held.where(known).count() >= 0.95 * held.count()


def test_empty_table(nothing, labels):
    assert quality_rules.judge(nothing, quality_rules.fit_rules(nothing, labels)).count() == 0
    path = F.concat_ws("/", "source", "lang")
    assert site_quality.classify(nothing, labels, F.col("source"), path).count() == 0


def test_site_rates(spark, documents, labels):
    rows = site_quality.classify(documents, labels, F.col("source"), F.col("lang")).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["score"] <= 1 and 0 <= r["path_rate"] <= 1 for r in rows)
    # A path with few documents lies nearer to its host than its own rate does.
    scored = spark.createDataFrame(
        [(i, "h", "rich", 0.0, 0.9) for i in range(200)]
        + [(i, "g", "poor", 0.0, 0.1) for i in range(200)]
        + [(999, "h", "new", 0.0, 0.1)],
        "doc_id bigint, host string, path string, evidence double, p double",
    )
    new = site_quality.posterior(scored).where("path = 'new'").first()
    assert new["path_rate"] > 0.8

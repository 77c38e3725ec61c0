"""Figures are rounded as the SQL rounds them, and do not depend on the order of rows."""

from pyspark.sql import functions as F


def test_rounding_by_the_scaled_double(spark):
    from folioscope.functions.text import rounded

    values = [(0.285, 2), (1.005, 2), (2.5, 0), (-0.25, 1), (83.64999999999999, 1), (None, 1)]
    got = [spark.range(1).select(rounded(F.lit(x).cast("double"), k)).first()[0] for x, k in values]
    assert got == [0.28, 1.0, 3.0, -0.3, 83.6, None]  # 0.285 * 100 is 28.499999999999996


def test_status_is_that_of_the_score_as_shown(spark):
    from folioscope.config import Config
    from folioscope.operators import metrics as X

    for score, ratio, want in ((49.96, 0.6174496, (0.6175, 50.0, "warn")), (69.95, 0.5, (0.5, 70.0, "good")), (49.94, 0.5, (0.5, 49.9, "bad"))):
        row = spark.sql(f"select named_struct('n', 50, 'types', 20, 'ratio', {ratio}D, 'low', 0.7D, 'high', 0.9D, 'junk', 0.0D, 'score', {score}D) as diversity, false as low")
        assert tuple(row.select(X.ttr(Config()).alias("m")).select("m.raw_value", "m.score", "m.status").first()) == want


def test_document_score_folds_over_pages_in_their_order(spark):
    from folioscope.operators.scoring import document_reports

    pages = [(77.1, 40), (86.2, 214), (92.8, 40), (73.2, 249), (87.9, 40), (91.2, 265), (79.1, 48)]  # 83.65 in this order, 83.64999999999999 backwards
    rows = [("a", k, s, "ok", [], n) for k, (s, n) in enumerate(pages)]
    schema = "doc_id string, page_no int, page_score double, verdict string, hard_keys array<string>, token_count long"
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        r = document_reports(spark.createDataFrame(order, schema).coalesce(1)).select("document_score", "document_verdict", "summary.dqs").first()
        assert tuple(r) == (83.7, "PASSED", 83.7)
    empty = [("a", 1, None, "ok", [], 50), ("b", 1, None, "ok", [], 50), ("b", 2, 80.0, "ok", [], None)]
    assert {r.doc_id: r.document_score for r in document_reports(spark.createDataFrame(empty, schema)).collect()} == {"a": 100.0, "b": 80.0}

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.config import Config
from folioscope.constants import KEYS
from folioscope.operators import views as V
from folioscope.operators.scoring import document_reports
from folioscope.plans.report import Engine
from folioscope.sinks import package as K
from folioscope.sources import bundles as B
from folioscope.sources import parsing as P

from . import bundles as fixtures


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    artifacts = None
    for name, (tree, md, meta, chunks) in (("good", fixtures.good()), ("bad", fixtures.bad())):
        a = B.from_buffers(spark, name, json.dumps(tree), md, json.dumps(meta), json.dumps(chunks))
        artifacts = a if artifacts is None else artifacts.union(a)
    lexicon = spark.createDataFrame([("en", w) for w in fixtures.LEXICON], "lang string, token string")
    r = Engine(spark).report(P.parse(artifacts), lexicon=lexicon)
    path = str(tmp_path_factory.mktemp("report") / "pages")
    r.lazy = r.pages
    r.pages.write.parquet(path)
    r.pages = spark.read.parquet(path)
    r.documents = document_reports(r.pages)
    return r


@pytest.fixture(scope="module")
def by_key(report):
    return {(r.doc_id, r.page_no): {m.key: m for m in r.metrics} | {"row": r} for r in report.pages.collect()}


def test_fourteen_metrics_in_order_and_bounds(by_key):
    assert len(by_key) == 4
    for found in by_key.values():
        assert [m.key for m in found["row"].metrics] == KEYS
        for m in found["row"].metrics:
            assert 0 <= m.score <= 100 and m.status in ("good", "warn", "bad", "na") and m.applicable == (m.status != "na") and len(m.evidence) <= 9 and len(m.locations) <= 12


def test_clean_page_passes(by_key):
    m = by_key["good", 1]
    assert m["IFR"].score == 100 and m["BCC"].score == 100 and m["LVR"].raw_value >= 0.9 and m["CED"].score >= 70 and m["HMW"].score == 100 and m["TSI"].score >= 70 and m["XSA"].score >= 60
    assert m["row"].verdict == "ok" and m["row"].problems == []
    assert not [x for k in KEYS for x in m[k].locations if x.confidence == "definite"]


def test_garbled_page_fails_for_the_right_reasons(by_key):
    m = by_key["bad", 1]
    assert m["IFR"].score == 0 and m["IFR"].hard_fail and m["IFR"].raw_value == 0.25
    assert m["BCC"].hard_fail and "12" in m["BCC"].evidence[0] and m["BCC"].raw_value == 0.6667
    assert m["CED"].hard_fail and m["CED"].score <= 15
    assert m["XSA"].hard_fail and "×9" in m["XSA"].evidence[0]
    assert m["HMW"].raw_value == 0.25 and m["HMW"].score == 16.7 and "unclosed <i>" not in m["HMW"].evidence[0]
    assert m["TSI"].score < 80 and not m["TSI"].hard_fail
    assert set(m["row"].hard_keys) >= {"IFR", "BCC", "CED", "XSA"}
    kinds = {x.kind for k in KEYS for x in m[k].locations}
    assert {"inference_failed", "mojibake", "repetition", "alnum_confusion", "gibberish_word"} <= kinds


def test_second_garbled_page(by_key):
    m = by_key["bad", 2]
    assert m["BGC"].raw_value == 0.5 and m["BGC"].score == 0
    assert m["LVR"].hard_fail and m["TSI"].score == 20 and m["TSI"].locations[0].kind == "dropped_table"


def test_problems_are_numeric_and_hard_ones_come_first(by_key):
    row = by_key["bad", 1]["row"]
    assert row.problems[0].startswith("[IFR]") and all(any(c.isdigit() for c in p) for p in row.problems)


def test_document_verdicts(report):
    d = {r.doc_id: r for r in report.documents.collect()}
    assert d["good"].document_verdict == "PASSED" and d["good"].faulty_pages == []
    assert d["bad"].document_verdict == "FAILED" and d["bad"].faulty_pages == [1, 2]
    assert "HARD condition" in d["bad"].verdict_reason and d["bad"].summary.inference_failed_pages == [1]


def test_reports_are_deterministic(report, by_key):
    again = {(r.doc_id, r.page_no): r for r in report.lazy.collect()}
    assert all(again[k] == v["row"] for k, v in by_key.items())


def test_package(report, tmp_path):
    path = K.build_package(report.pages, report.documents, "bad", str(tmp_path / "out" / "bad.zip"))
    with zipfile.ZipFile(path) as z:
        assert set(z.namelist()) == {"review.json", "review.csv", "review.md"}
        payload = json.loads(z.read("review.json"))
        assert [len(p["metrics"]) for p in payload["faulty_pages"]] == [14, 14]
        scores = [p["PQS"] for p in payload["faulty_pages"]]
        assert scores == sorted(scores)
        assert z.read("review.csv").decode().startswith("page_no,PQS,problem_1,problem_2,problem_3\r\n")
        text = z.read("review.md").decode()
        assert text.startswith("# ") and text.count("### Faults on this page") == 2 and text.index("### Metric detail") < text.rindex("## Page ")
        rows = list(csv.reader(io.StringIO(z.read("review.csv").decode())))
        first = report.pages.where("doc_id = 'bad'").orderBy("page_score").first()
        assert rows[1] == [str(first.page_no), f"{first.page_score:.1f}", *(list(first.problems) + ["", "", ""])[:3]] and len(rows) == 3
        found = payload["faulty_pages"][0]["metrics"][0]
        assert found["key"] == "IFR" and set(found) == set(K.METRIC_FIELDS)
    with pytest.raises(KeyError):
        K.build_package(report.pages, report.documents, "none", str(tmp_path / "none.zip"))
    image = tmp_path / "scan 2.png"
    image.write_bytes(b"png")
    shown = report.pages.withColumn("image_path", F.when(F.col("page_no") == 2, str(image)).otherwise(str(tmp_path / "lost.png")))
    with zipfile.ZipFile(K.build_package(shown, report.documents, "bad", str(tmp_path / "images.zip"))) as z:
        assert "pages/scan 2.png" in z.namelist() and z.read("review.md").decode().count("](pages/") == 1
        assert [p["image"] for p in sorted(json.loads(z.read("review.json"))["faulty_pages"], key=lambda p: p["page_no"])] == [None, "scan 2.png"]
    assert K.send_for_review(path)["status"] == "not_sent"
    K.write_reports(report.pages, report.documents, str(tmp_path / "tables"))
    assert report.pages.sparkSession.read.parquet(str(tmp_path / "tables" / "documents")).count() == 2


def test_views(report):
    faulty = V.faulty_pages(report.pages).orderBy("rank").collect()
    assert [r["rank"] for r in faulty] == [1, 2] and faulty[0].page_score <= faulty[1].page_score
    assert V.passed_pages(report.pages).count() == 2
    assert {r.band for r in V.summary(report.documents).collect()} <= {"green", "amber", "red"}
    boxes = report.pages.select("doc_id", "page_no", F.array(*[F.lit(x) for x in (0.0, 0.0, 1000.0, 1400.0)]).alias("page_bbox"))
    images = report.pages.select("doc_id", "page_no", F.lit(500).alias("width"), F.lit(700).alias("height"))
    box = V.scaled_boxes(report.pages, boxes, images).where("kind = 'inference_failed'").first().box
    assert box == [50.0, 50.0, 450.0, 125.0]
    texts = report.pages.select("doc_id", "page_no", F.lit(f"<the> quay {fixtures.ODD.upper()}").alias("text"))
    marked = V.highlighted(report.pages, texts).where("doc_id = 'bad' and page_no = 1").first().html
    assert f"<mark>{fixtures.ODD.upper()}</mark>" in marked and "&lt;the&gt;" in marked


def test_config():
    assert abs(sum(Config().weights.values()) - 1) < 1e-9
    assert Config(weights={}).normalized_weights(["IFR", "BCC"]) == {"IFR": 0.5, "BCC": 0.5}
    for wrong in ({"t_page": 101}, {"perplexity_backend": "x"}, {"weights": {"ZZZ": 1}}):
        with pytest.raises(ValueError):
            Config(**wrong)


def test_source_alignment(spark):
    from folioscope.operators.pages import attach_source, from_texts

    pages = from_texts(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "doc_id string, page_no int, text string"))
    images = spark.createDataFrame([("a", 5, "p5", 1, 1), ("a", 6, "p6", 1, 1)], "doc_id string, page_no int, image_path string, width int, height int")
    native = spark.createDataFrame([("a", 6, "native y")], "doc_id string, page_no int, text string")
    got = {r.page_no: (r.image_path, r.native_text) for r in attach_source(pages, images, native).collect()}
    assert got == {1: ("p5", None), 2: ("p6", "native y")}


def test_ingest_zip(spark, tmp_path):
    from folioscope.sources import ingest as G

    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (200).to_bytes(4, "big") + (280).to_bytes(4, "big")
    path = tmp_path / "scan.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("b.png", png)
        z.writestr("a.JPG", b"jpg")
        z.writestr("notes.txt", "x")
    kind, images, native = G.ingest(spark, str(path), work_dir=str(tmp_path / "w"))
    rows = images.orderBy("page_no").collect()
    assert kind == "zip_images" and native is None and [(r.page_no, r.width, r.height) for r in rows] == [(1, 0, 0), (2, 200, 280)]
    assert [r.name for r in G.zip_image_pages(spark, str(tmp_path)).orderBy("page_no").collect()] == ["a.JPG", "b.png"]
    empty = tmp_path / "none.zip"
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("x.txt", "x")
    for p in (empty, tmp_path / "missing.pdf", tmp_path / "w"):
        with pytest.raises(G.IngestionError):
            G.ingest(spark, str(p), work_dir=str(tmp_path / "w"))
    assert [G.detect_source_type(x) for x in ("A.PDF", "b.docx", "c.pptx", "d.zip", "e.txt")] == ["pdf", "docx", "pptx", "zip_images", "unknown"]
    texts = spark.createDataFrame([("a", 1, "x" * 100), ("b", 1, "short")], "doc_id string, page_no int, text string")
    pages = spark.createDataFrame([("a", 1, "", 0, 0), ("b", 1, "", 0, 0)], "doc_id string, page_no int, image_path string, width int, height int")
    assert [r.doc_id for r in G.digital_born(texts, pages).collect()] == ["a"]
    assert io is not None


def test_stream(spark, tmp_path):
    from folioscope.streaming.bundles import report_stream

    tree, md, meta, chunks = fixtures.good()
    src = tmp_path / "in"
    B.from_buffers(spark, "s1", json.dumps(tree), md, json.dumps(meta), json.dumps(chunks)).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("doc_id string, kind string, content string").parquet(str(src))
    q = report_stream(stream, Engine(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(240)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["s1"]

import json

from folioscope.sources import bundles as B
from folioscope.sources import parsing as P
from folioscope.sources.markdown import markdown_pages

from . import bundles as fixtures


def test_strip_html():
    assert P.strip_html("<p>a<br>b&nbsp;&amp; c</p>") == "a \n b & c"
    assert P.strip_html(None) == "" and P.strip_html("plain") == "plain"


def test_page_numbers_and_shapes():
    assert P.page_number({"id": "/page/7/Page/1"}, 3) == 7
    assert P.page_number({"page_id": "4"}, 3) == 4
    assert P.page_number({"page": "x"}, 3) == 3
    p = {"block_type": "Page"}
    assert P.coerce_pages([p, 5]) == [p]
    assert P.coerce_pages({"children": [p, {"block_type": "Text"}]}) == [p]
    assert P.coerce_pages({"pages": [{"a": 1}]}) == [{"a": 1}]
    assert P.coerce_pages({"children": [{"block_type": "Text"}]}) == [{"children": [{"block_type": "Text"}]}]
    assert P.coerce_pages(None) == [] and P.coerce_pages("x") == []


def test_flatten_keeps_tables_whole_and_order():
    tree = {"children": [{"block_type": "Text", "html": "a"}, {"block_type": "Group", "html": "g", "children": [{"block_type": "Text", "html": "b"}, {"block_type": "Table", "html": "<table></table>", "children": [{"html": "cell"}]}]}, 3]}
    got = [h for c in tree["children"] for _, _, h in P.leaves(c)]
    assert got == ["a", "b", "<table></table>"]


def test_footer_dropped_and_boxes_coerced():
    got = P.parse_bundle(fixtures.good()[0])
    assert [len(p["blocks"]) for p in got["pages"]] == [3, 2]
    assert got["pages"][0]["num_blocks_json"] == 4 and got["pages"][0]["skipped_empty_headfoot"] == 1
    b = P.block({"bbox": [1, 2, "x", 4], "polygon": [[1, 2], [3], "z"]}, "Text", "t", 0)
    assert b["bbox"] == [] and b["polygon"] == [[1.0, 2.0]]


def test_markdown(spark):
    mds = [("a", "pre\n{2}-------\nb\n3------\nc"), ("b", "no delimiter "), ("c", ""), ("d", None), ("e", "1------\nx\n1------\ny")]
    got = markdown_pages(spark.createDataFrame(mds, "doc_id string, md string"), "doc_id", "md").collect()
    assert {(r.doc_id, r.page_no, r.segment) for r in got} == {("a", 2, "b"), ("a", 3, "c"), ("b", 1, "no delimiter"), ("e", 1, "y")}


def test_html_metadata():
    assert P.split_html('<body><div class="page" data-page-id="0"><p>a<div>x</div></p></div><div class="page"><b>y&amp;</b></div>') == {0: "<p>a<div>x</div></p>", 1: "<b>y&amp;</b>"}
    assert P.split_html(" ") == {}
    assert P.parse_metadata({"page_stats": [{"page_id": 1, "num_blocks": "3"}, {"page_id": None}, 4, {"page_id": 1, "num_blocks": 5}]}) == {1: 5}
    assert P.parse_metadata([]) == {}


def test_chunks():
    a = {"page_ids": [0, "1", None], "content": "x"}
    assert [c["page_ids"] for c in P.parse_chunks({"chunks": [a]})] == [[0, 1]]
    assert len(P.parse_chunks(a)) == 1 and P.parse_chunks(None) == []
    chunks = P.parse_chunks([{"page_ids": [0, 1], "content": "one"}, {"page_ids": [1], "content": "two", "token_count": 4}])
    assert chunks[1]["token_count"] == 4


def test_chunks_meet_pages(spark, tmp_path):
    """Ids start at 0 and pages at 1 in one document; in the other they agree, and a page lies outside; one has none."""
    chunk = lambda ids, text: {"page_ids": ids, "content": text}
    tree = lambda *numbers: [fixtures.page(n, [fixtures.block(n, "Text", 0, "<p>t</p>")]) for n in numbers]
    docs = {"a": (tree(1, 2, 3), [chunk([0, 1], "one"), chunk([1], "two")]), "b": (tree(7, 9), [chunk([9], "nine")]), "c": (tree(1), [])}
    rows = [(d, k, json.dumps(v)) for d, (t, c) in docs.items() for k, v in (("json", t), ("chunks", c))]
    parsed = P.parse(spark.createDataFrame(rows, "doc_id string, kind string, content string"))
    got = {(r.doc_id, r.raw_page_no): (r.chunk_text, r.chunk_meta) for r in parsed.pages.collect()}
    assert [got["a", n][0] for n in (1, 2, 3)] == ["one", "one\n\ntwo", None]
    assert got["a", 3][1].chunks_present and not got["a", 3][1].covered
    assert got["a", 1][1].n_pages == 2 and not got["a", 1][1].single_page and got["a", 1][1].covered
    assert got["b", 7][0] == "nine" and got["b", 9][0] == "nine" and got["c", 1] == (None, None)
    assert {(r.doc_id, r.page_no): r.chunk_covered for r in parsed.parse_log.collect()}["c", 1] is None


def audit_of(spark, *given, source=None):
    rows = [("d", k, v if k in ("md", "html") else json.dumps(v)) for k, v in zip(("json", "md", "metadata", "chunks"), given) if v is not None]
    sources = None if source is None else spark.createDataFrame([("d", source)], "doc_id string, n int")
    return P.parse(spark.createDataFrame(rows, "doc_id string, kind string, content string"), sources).page_audit.first()


def test_audit(spark):
    tree, md, meta, chunks = fixtures.good()
    a = audit_of(spark, tree, md, meta, chunks, source=2)
    assert a.status == "ok" and a.ocr_pages == 2 and a.counts["output_chunks"] == 2 and len(a.messages) == 2
    a = audit_of(spark, tree, md, meta, source=3)
    assert a.status == "source_mismatch" and a.delta_ocr_minus_source == -1 and "3 page(s)" in a.messages[1]
    more = {"page_stats": [{"page_id": i, "num_blocks": 1} for i in range(3)]}
    assert audit_of(spark, tree, md, more, source=3).status == "ocr_inconsistent"
    a = audit_of(spark, [], md, meta)  # no page in the tree: the most frequent count
    assert a.ocr_pages == 2 and a.status == "ocr_inconsistent" and a.delta_ocr_minus_source is None


def test_defensive_inputs():
    for tree in ([], None, {"a": 1}, [{"id": "x"}], [{"children": None, "html": "<p>one</p>"}]):
        assert isinstance(P.parse_bundle(tree, metadata=["odd"], chunks=3)["pages"], list)
    got = P.parse_bundle([{"children": None, "html": "<p>one</p>"}])
    assert got["pages"][0]["blocks"][0]["block_type"] == "Page" and got["pages"][0]["missing_children"]
    assert P.load("{broken") is None


def test_read_helpers(tmp_path):
    f = tmp_path / "a.json"
    f.write_text('{"a": 1}')
    assert B.read_json(str(f)) == B.read_json(b'{"a": 1}') == B.read_json('{"a": 1}') == B.read_json({"a": 1}) == {"a": 1}
    with f.open() as h:
        assert B.read_json(h) == {"a": 1}
    assert B.read_text(None) == ""


def test_live_service_is_refused():
    import pytest

    with pytest.raises(NotImplementedError):
        B.live_service("x.pdf")


def test_folders(spark, tmp_path):
    tree, md, meta, chunks = fixtures.good()
    d = tmp_path / "doc_a"
    d.mkdir()
    (d / "output.json").write_text(json.dumps(tree))
    (d / "output.md").write_text(md)
    (tmp_path / "no_tree").mkdir()
    (tmp_path / "no_tree" / "output.md").write_text("x")
    other = tmp_path / "more" / "doc_a"  # a name may come again elsewhere
    other.mkdir(parents=True)
    (other / "output.json").write_text(json.dumps(tree[:1]))
    assert {r.doc_id for r in B.from_folders(spark, str(d)).collect()} == {"doc_a"}
    parsed = P.parse(B.from_folders(spark, str(tmp_path)))
    assert parsed.pages.where("doc_id = 'more/doc_a'").count() == 1
    parsed = P.parse(B.from_folders(spark, str(tmp_path)).where("doc_id = 'doc_a'"))
    rows = parsed.pages.orderBy("page_no").collect()
    assert [(r.doc_id, r.page_no) for r in rows] == [("doc_a", 1), ("doc_a", 2)]
    assert rows[0].num_blocks_meta is None and rows[0].md_text.startswith("## The report")
    assert parsed.page_audit.first().status == "ok"

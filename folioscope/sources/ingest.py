"""Source files: page images and native text.  Zips of images need the standard library only; PDF needs an optional
reader and office files an optional converter, both absent by default and reported as such."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import NATIVE_TEXT, PAGE_IMAGES
from ..session import shared_dir

TYPES = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "zip": "zip_images"}
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
NATIVE_CHARS_A_PAGE = 40


class IngestionError(Exception):
    pass


def detect_source_type(path: str) -> str:
    return TYPES.get(path.lower().rpartition(".")[2], "unknown")


def zip_image_pages(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """doc_id, page_no, name, content of the images of each zip below path, numbered in the order of their names.
    Archives are read by Spark, so any of its stores will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(frames):
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                doc = os.path.splitext(os.path.basename(p))[0]
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith(IMAGES) and not n.endswith("/"))
                    for i, n in enumerate(names, 1):
                        yield pd.DataFrame({"doc_id": [doc], "page_no": [i], "name": [n], "content": [z.read(n)]})

    return files.select("path", "content").mapInPandas(run, "doc_id string, page_no int, name string, content binary")


def png_size(content: bytes) -> tuple[int, int]:
    """Width and height from a PNG header; (0, 0) for other formats."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    return 0, 0


def unpack_zip(path: str, work_dir: str, doc_id: str) -> list[tuple]:
    """Images of a zip as files of work_dir: rows (doc_id, page_no, image_path, width, height)."""
    rows = []
    with zipfile.ZipFile(path) as z:
        names = sorted(n for n in z.namelist() if n.lower().endswith(IMAGES) and not n.endswith("/"))
        if not names:
            raise IngestionError(f"no images in {os.path.basename(path)}")
        os.makedirs(work_dir, exist_ok=True)
        for i, n in enumerate(names, 1):
            content = z.read(n)
            out = os.path.join(work_dir, f"{doc_id}_p{i:04d}{os.path.splitext(n)[1].lower()}")
            with open(out, "wb") as f:
                f.write(content)
            rows.append((doc_id, i, out, *png_size(content)))
    return rows


def render_pdf(path: str, work_dir: str, doc_id: str, dpi: int = 200) -> tuple[list[tuple], list[tuple]]:
    """Page images and native text of a PDF.  A page that fails has an image row of size 0 and no text."""
    try:
        import pymupdf
    except ImportError:
        try:
            import fitz as pymupdf
        except ImportError as e:
            raise IngestionError("reading PDF needs the optional package pymupdf") from e
    images, texts = [], []
    os.makedirs(work_dir, exist_ok=True)
    with pymupdf.open(path) as doc:
        for i, page in enumerate(doc, 1):
            try:
                pix = page.get_pixmap(matrix=pymupdf.Matrix(dpi / 72, dpi / 72))
                out = os.path.join(work_dir, f"{doc_id}_p{i:04d}.png")
                pix.save(out)
                images.append((doc_id, i, out, pix.width, pix.height))
                texts.append((doc_id, i, page.get_text()))
            except Exception:  # noqa: BLE001 - a broken page must not lose the others
                images.append((doc_id, i, "", 0, 0))
    return images, texts


def office_to_pdf(path: str, work_dir: str, timeout: int = 180) -> str:
    tool = shutil.which("soffice") or shutil.which("libreoffice")
    if not tool:
        raise IngestionError("converting office files needs LibreOffice (soffice)")
    subprocess.run([tool, "--headless", "--convert-to", "pdf", "--outdir", work_dir, path], check=True, timeout=timeout, capture_output=True)
    return os.path.join(work_dir, os.path.splitext(os.path.basename(path))[0] + ".pdf")


def _work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one, if that is a file system's."""
    shared = shared_dir(spark)
    if "://" in shared and not shared.startswith("file://"):
        raise IngestionError("name a work_dir that the executors can read")
    path = os.path.join(shared.removeprefix("file://"), f"ingest-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def ingest(spark: SparkSession, path: str, doc_id: str | None = None, work_dir: str | None = None, dpi: int = 200) -> tuple[str, DataFrame, DataFrame | None]:
    """(source type, page_images, native_text or None) of one local source file."""
    if not os.path.exists(path):
        raise IngestionError(f"file not found: {path}")
    kind = detect_source_type(path)
    if kind == "unknown":
        raise IngestionError(f"unsupported file type: {os.path.basename(path)}")
    doc_id = doc_id or os.path.splitext(os.path.basename(path))[0]
    work_dir = work_dir or _work_dir(spark)
    if kind == "zip_images":
        return kind, spark.createDataFrame(unpack_zip(path, work_dir, doc_id), PAGE_IMAGES), None
    images, texts = render_pdf(office_to_pdf(path, work_dir) if kind in ("docx", "pptx") else path, work_dir, doc_id, dpi)
    native = digital_born(spark.createDataFrame(texts, NATIVE_TEXT), spark.createDataFrame(images, PAGE_IMAGES))
    return kind, spark.createDataFrame(images, PAGE_IMAGES), native


def digital_born(native: DataFrame, images: DataFrame) -> DataFrame:
    """Native text of documents that have more than 40 stripped characters a page; others have none."""
    chars = native.groupBy("doc_id").agg(F.sum(F.length(strip(F.col("text")))).alias("chars"))
    pages = images.groupBy("doc_id").agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    good = chars.join(pages, "doc_id").where(F.col("chars") > NATIVE_CHARS_A_PAGE * F.col("n")).select("doc_id")
    return native.join(good, "doc_id", "left_semi")


def save_upload(data: bytes, name: str, folder: str) -> str:
    """Keep an uploaded file, by its base name, in a folder; its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, os.path.basename(name))
    with open(path, "wb") as f:
        f.write(data)
    return path


def pdf_pages(spark: SparkSession, path: str, dpi: int = 200, glob: str = "*.pdf") -> DataFrame:
    """doc_id, page_no, png, width, height, text of the pages of each PDF below path, rendered where Spark reads it; a page
    that fails is empty.  Needs pymupdf on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "content")

    def run(frames):
        try:
            import fitz
        except ImportError as e:
            raise IngestionError("rendering PDF files needs pymupdf on every executor") from e
        for f in frames:
            for r in f.itertuples(index=False):
                with fitz.open(stream=bytes(r.content), filetype="pdf") as pdf:
                    for i in range(pdf.page_count):
                        try:
                            pix = pdf[i].get_pixmap(dpi=dpi)
                            page = (pix.tobytes("png"), pix.width, pix.height, pdf[i].get_text())
                        except Exception:  # noqa: BLE001 - a broken page must not lose the others
                            page = (None, 0, 0, "")
                        yield pd.DataFrame([(r.doc_id, i + 1, *page)], columns=["doc_id", "page_no", "png", "width", "height", "text"])

    return named.mapInPandas(run, "doc_id string, page_no int, png binary, width int, height int, text string")

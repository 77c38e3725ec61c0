"""The engine's front: from bundles or pages to reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import metrics, pages, scoring
from ..sources import bundles, parsing


@dataclass
class Report:
    pages: DataFrame
    documents: DataFrame
    config: Config


@dataclass
class Engine:
    spark: SparkSession
    config: Config = field(default_factory=Config)

    def read_bundles(self, path: str) -> parsing.Parsed:
        """Folders of one document each below path."""
        return parsing.parse(bundles.from_folders(self.spark, path))

    def from_buffers(self, doc_id: str, json, md=None, metadata=None, chunks=None, html=None) -> parsing.Parsed:
        return parsing.parse(bundles.from_buffers(self.spark, doc_id, json, md, metadata, chunks, html))

    def report(self, parsed: parsing.Parsed | DataFrame, images: DataFrame | None = None, native: DataFrame | None = None, lexicon: DataFrame | None = None, progress=None) -> Report:
        """Page and document reports.  progress(done, total, page_no), if given, is called for each page of the result
        in order, which runs the plan; reports stay lazy otherwise."""
        rows = parsed.pages if isinstance(parsed, parsing.Parsed) else parsed
        rows = pages.attach_source(rows, images, native)
        per_page = scoring.page_reports(metrics.page_metrics(rows, self.config, lexicon), self.config)
        if progress:
            order = per_page.select("page_no", "doc_id").orderBy("doc_id", "page_no")
            total = order.count()
            for i, r in enumerate(order.toLocalIterator(), 1):
                progress(i, total, r["page_no"])
        return Report(per_page, scoring.document_reports(per_page, self.config), self.config)

"""Registered queries of the page-quality engine and the SQL that must agree with them."""

from .plans import page_queries, text_queries

QUERIES = {**text_queries.QUERIES, **page_queries.QUERIES}
SQL = {**text_queries.SQL, **page_queries.SQL}


def entry(spark, sf_dir):
    return page_queries.page_report(spark, sf_dir)

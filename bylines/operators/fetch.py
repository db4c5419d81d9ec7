"""Why the text of a fetched page is there or not: a reason for every page, from what its response says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.functions.text import first_that
from bylines.schemas import HTML_TYPES, MAX_BYTES, MIN_BODY_CHARS, PAYWALL_MARKERS


def fetch_status(reason: Column) -> Column:
    """The coarse status of a reason. None but "ok" says anything about the article."""
    return F.when(reason == "ok", "ok").when(reason == "skipped_no_url", "skipped").when(reason.startswith("empty_"), "empty").otherwise("error")


def body_chars(html: Column) -> Column:
    """Length of the text between the tags, without blanks around it."""
    return F.char_length(F.trim(F.regexp_replace(html, "<[^>]*>", " ")))


def why_empty(html: Column) -> Column:
    """What a page without enough text looks like: a paywall, a page that scripts fill, or no article."""
    low = F.lower(F.coalesce(html, F.lit("")))
    walled = F.lit(False)
    for marker in PAYWALL_MARKERS:
        walled = walled | F.contains(low, F.lit(marker))
    scripts = F.coalesce(F.regexp_count(html, F.lit(r"(?i)<script\b")), F.lit(0))
    return first_that([(walled, "empty_paywall"), ((scripts >= 8) | ((scripts >= 5) & (F.coalesce(F.char_length(html), F.lit(0)) > 1500)), "empty_js_required")], "empty_not_article")


def classify_fetches(pages: DataFrame) -> DataFrame:
    """``pages(url, http_status, content_type, response_bytes, html, error_class)`` with extracted_char_count, fetch_reason and fetch_status.

    In this order: no URL, an error on the way (timeout, tls, dns or other), the HTTP status, the announced size, the
    content type, the size of the body, enough text, and else what the page looks like. Nulls never trigger a
    rule: an unknown type counts as HTML and an unknown size as small.
    """
    status, kind = F.col("http_status"), F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    chars = F.coalesce(body_chars(F.col("html")), F.lit(0))
    on = lambda c: F.coalesce(c, F.lit(False))
    reason = first_that([
        (F.trim(F.coalesce("url", F.lit(""))) == "", "skipped_no_url"),
        (on(F.col("error_class") == "timeout"), "error_timeout"), (on(F.col("error_class") == "tls"), "error_tls"), (on(F.col("error_class") == "dns"), "error_dns"), (F.col("error_class").isNotNull(), "error_other"),
        (on(status.isin(401, 403, 429)), "error_blocked"), (on(status.isin(404, 410)), "error_not_found"), (on((status >= 500) & (status <= 599)), "error_server"), (on(status >= 400), "error_other"),
        (on(F.col("response_bytes") > MAX_BYTES), "error_too_large"), ((kind != "") & ~kind.isin(HTML_TYPES), "error_unsupported_type"), (on(F.octet_length("html") > MAX_BYTES), "error_too_large"),
        (F.col("extracted_char_count") >= MIN_BODY_CHARS, "ok"),
    ], why_empty(F.col("html")))
    return pages.withColumn("extracted_char_count", chars).withColumn("fetch_reason", reason).withColumn("fetch_status", fetch_status(F.col("fetch_reason")))

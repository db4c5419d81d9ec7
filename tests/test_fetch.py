"""Fetch reasons, one case for each, and unknown values that trigger nothing."""

from bylines.operators.fetch import classify_fetches
from bylines.schemas import FETCH_REASONS

LONG = "<p>" + "words of an article " * 10 + "</p>"
CASES = [
    ("ok", ("u", 200, "text/html; charset=utf-8", 5, LONG, None)), ("ok", ("u", None, None, None, LONG, None)), ("ok", ("u", 200, " Application/XHTML+XML ", None, LONG, None)), ("skipped_no_url", (" ", 200, None, None, LONG, None)), ("skipped_no_url", (None, 404, None, None, None, "dns")),
    ("error_timeout", ("u", None, None, None, None, "timeout")), ("error_tls", ("u", 403, None, None, None, "tls")), ("error_dns", ("u", None, None, None, None, "dns")), ("error_other", ("u", None, None, None, None, "reset")),
    *[("error_blocked", ("u", s, None, None, LONG, None)) for s in (401, 403, 429)], *[("error_not_found", ("u", s, None, None, LONG, None)) for s in (404, 410)], *[("error_server", ("u", s, None, None, LONG, None)) for s in (500, 599)],
    *[("error_other", ("u", s, None, None, LONG, None)) for s in (400, 418, 600)], ("error_too_large", ("u", 200, "application/pdf", 5_000_001, LONG, None)), ("error_too_large", ("u", 200, "text/html", None, "x" * 5_000_001, None)), ("ok", ("u", 200, None, 5_000_000, LONG, None)),
    ("error_unsupported_type", ("u", 200, "application/pdf", 9, LONG, None)), ("error_unsupported_type", ("u", 200, "image/png", None, None, None)),
    ("empty_paywall", ("u", 200, None, None, "<div CLASS=\"paywall\">Hi</div>", None)), ("empty_paywall", ("u", 200, None, None, "Subscribe to READ", None)), ("empty_js_required", ("u", 200, None, None, "<script>" * 8, None)),
    ("empty_js_required", ("u", 200, None, None, "<SCRIPT a>" * 5 + "<p " + "x" * 1500 + ">", None)), ("empty_not_article", ("u", 200, None, None, "<script>" * 5 + "<scripts>" * 3, None)), ("empty_not_article", ("u", 200, None, None, None, None)),
    ("empty_not_article", ("u", 200, None, None, "<b>" + "x" * 79 + "</b>", None)), ("ok", ("u", 200, None, None, "<b>" + "x" * 80 + "</b>", None)),
]


def test_every_reason(spark):
    rows = [(i, *row) for i, (_, row) in enumerate(CASES)]
    got = {r.i: (r.fetch_reason, r.fetch_status) for r in classify_fetches(spark.createDataFrame(rows, "i int, url string, http_status int, content_type string, response_bytes long, html string, error_class string")).collect()}
    coarse = lambda x: "ok" if x == "ok" else "skipped" if x == "skipped_no_url" else "empty" if x.startswith("empty_") else "error"
    assert got == {i: (want, coarse(want)) for i, (want, _) in enumerate(CASES)}
    assert {want for want, _ in CASES} == set(FETCH_REASONS)

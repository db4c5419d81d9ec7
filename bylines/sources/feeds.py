"""Landed feed responses, one JSON text for each, as rows of the hits schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.functions.text import body_hash, wire_credit
from bylines.functions.url import canonical_url, publisher_identity

# Where each feed keeps its rows and fields.
FEEDS = {
    "newsapi": ("articles array<struct<url:string,title:string,description:string,content:string,publishedAt:string,author:string>>", "articles", lambda x: (x["url"], x["title"], F.coalesce(x["description"], x["content"]), x["publishedAt"], x["author"], None)),
    "guardian": ("response struct<results:array<struct<webUrl:string,webTitle:string,webPublicationDate:string,fields:struct<headline:string,trailText:string,bodyText:string,firstPublicationDate:string,byline:string>>>>", "response.results", lambda x: (x["webUrl"], F.coalesce(x["fields"]["headline"], x["webTitle"]), F.concat_ws("\n", x["fields"]["trailText"], x["fields"]["bodyText"]), F.coalesce(x["fields"]["firstPublicationDate"], x["webPublicationDate"]), x["fields"]["byline"], x["fields"]["bodyText"])),
    "gnews": ("articles array<struct<url:string,title:string,description:string,publishedAt:string>>", "articles", lambda x: (x["url"], x["title"], x["description"], x["publishedAt"], None, None)),
    "newsdata": ("results array<struct<link:string,title:string,description:string,pubDate:string,creator:array<string>>>", "results", lambda x: (x["link"], x["title"], x["description"], x["pubDate"], F.array_join(x["creator"], ", "), None)),
    "gdelt": ("articles array<struct<url:string,title:string,seendate:string>>", "articles", lambda x: (x["url"], x["title"], None, F.regexp_replace(x["seendate"], r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z$", "$1-$2-$3T$4:$5:$6Z"), None, None)),
}


def _text(v: Column | None) -> Column:
    return F.lit(None).cast("string") if v is None else v


def feed_hits(raw: DataFrame, feed: str) -> DataFrame:
    """Rows of ``raw(run_id, query_id, payload)`` of one feed as hits; rows without a URL, and payloads that do not parse, give none."""
    schema, at, fields = FEEDS[feed]
    rows = raw.withColumn("_p", F.from_json("payload", schema)).select("run_id", "query_id", F.posexplode(f"_p.{at}").alias("pos", "x"))
    url, title, snippet, published, byline, body = map(_text, fields(F.col("x")))
    out = rows.select("run_id", "query_id", "pos", url.alias("url"), title.alias("title"), snippet.alias("snippet"), published.alias("published_at"), F.nullif(byline, F.lit("")).alias("byline"), body_hash(body).alias("body_hash"), F.lit(feed).alias("source_adapter"))
    out = out.where(F.trim(F.coalesce("url", F.lit(""))) != "")
    return out.withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("publisher_id", publisher_identity(F.col("url"))).withColumn("wire_credit", wire_credit(F.col("byline"), F.col("snippet")))


def all_hits(feeds: dict[str, DataFrame]) -> DataFrame:
    """The union of several feeds' hits."""
    return reduce(DataFrame.unionByName, [feed_hits(raw, name) for name, raw in feeds.items()])


def fact_checks(raw: DataFrame) -> DataFrame:
    """The first review of each claim, its rating verbatim; reviews without a URL are dropped."""
    schema = "claims array<struct<text:string,claimReview:array<struct<url:string,textualRating:string,publisher:struct<name:string>>>>>"
    rows = raw.withColumn("_p", F.from_json("payload", schema)).select("run_id", F.explode("_p.claims").alias("c")).withColumn("r", F.try_element_at("c.claimReview", F.lit(1)))
    return rows.where(F.trim(F.coalesce("r.url", F.lit(""))) != "").select("run_id", F.col("c.text").alias("reviewed_claim_text"), F.col("r.publisher.name").alias("reviewer_name"), F.col("r.textualRating").alias("rating_text"), F.col("r.url").alias("review_url"))

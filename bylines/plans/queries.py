"""The registered queries of the evidence jobs, each over whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bylines.functions import url as U
from bylines.functions.text import let
from bylines.operators import agreement as A
from bylines.operators import analyst as Y
from bylines.operators import claims as C
from bylines.operators import dedupe as D
from bylines.operators import fetch as K
from bylines.operators import grounding as G
from bylines.operators import independence as I
from bylines.operators import plan as Q
from bylines.operators import report as R
from bylines.operators import search as S
from bylines.operators import similarity as J
from bylines.operators import stance as T
from bylines.operators import trace as E
from bylines.schemas import PASS_CLAIMS, STATUS_RANK
from bylines.scratch import shared_dir, written
from bylines.sources import history as H
from bylines.sources.tables import claims, hits, key_of, owners, table
from bylines.streaming import independence as N
from bylines.streaming import pages as P
from bylines.streaming import runs as L

def today():
    return F.lit("2026-09-16").cast("date")


SOURCES = [f"src{i}" for i in range(20)]
ARRIVALS = 3  # micro-batches


# pages and publishers


def exact_url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("canonical", U.canonical_url(F.col("url")))
    best = I.best_per_url(pages.withColumn("run_id", F.lit(0)), "run_id", "canonical", ["url", "html"], ["url", "page_id"])
    return best.select("canonical", "page_id", "completeness")


def publisher_identity(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.registrable_domain(u).alias("domain"), U.publisher_identity(u).alias("publisher"))


def source_bands(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").groupBy(U.source_band(u).alias("band")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(U.publisher_family(u)).alias("families"))


def fetch_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as the answer to a request, some of which fail in ways that its number tells."""
    i = F.col("page_id")
    status = F.when(i % 17 == 1, 403).when(i % 17 == 2, 404).when(i % 17 == 3, 503).when(i % 17 == 4, 418).when(i % 17 == 5, F.lit(None).cast("int")).otherwise(200)
    failed = F.when(i % 17 == 5, F.element_at(F.array(*[F.lit(x) for x in ("timeout", "tls", "dns", "reset")]), (i % 4 + 1).cast("int")))
    kind = F.when(i % 19 == 1, "application/pdf").when(i % 19 == 2, "text/html; charset=utf-8")
    rows = table(spark, sf, "pages").select(i, "url", "html", status.alias("http_status"), failed.alias("error_class"), kind.alias("content_type"), F.octet_length("html").alias("response_bytes"))
    return K.classify_fetches(rows).select("page_id", "http_status", "extracted_char_count", "fetch_reason", "fetch_status")


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    plain = F.expr("replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")
    return table(spark, sf, "pages").withColumn("raw", raw).select("page_id", F.left(F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " ")), F.lit(240)).alias("title"))


# similarity and independence


def similarity(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return I.similar_texts(hits(spark, sf), "doc", "text")


def shingle_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs between class representatives; ``shingle_classes`` has the membership."""
    return similarity(spark, sf)[1].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def shingle_classes(spark: SparkSession, sf: str) -> DataFrame:
    return J.shingle_classes(hits(spark, sf), "doc", "text")[0].select(F.col("id").alias("doc"), "rep")


def body_hash_reprint_groups(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf).where("body_hash IS NOT NULL")
    return h.groupBy("body_hash").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("publisher_id").alias("publishers"), F.min("doc").alias("first_doc")).where("publishers > 1")


def same_owner_groups(spark: SparkSession, sf: str) -> DataFrame:
    met = hits(spark, sf).join(F.broadcast(owners(spark)), "publisher_id", "left")  # twenty rows
    return met.groupBy(F.coalesce("parent_group", "publisher_id").alias("owner")).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("publisher_id").alias("publishers"))


def _sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Sources of some documents, rows with a text; only the texts of those are compared."""
    texts = docs.select("doc", "text").dropDuplicates(["doc"])
    return I.independent_sources(docs, owners(spark), *I.similar_texts(texts, "doc", "text"))


def independent_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a page of one run."""
    h = hits(spark, sf)
    return I.independent_sources(h, owners(spark), *I.similar_texts(h, "doc", "text")).select("doc", "source", "reason")


def publisher_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of feeds that send no body hash, deduped within each publisher from the most complete page on."""
    h = hits(spark, sf).withColumn("body_hash", F.lit(None).cast("string")).withColumn("less", -I.completeness(["title", "text", "language"]))
    return D.greedy_dedupe(h, *similarity(spark, sf), ["less", "canonical_url"]).select("doc", "kept_doc")


def incremental_independence(spark: SparkSession, sf: str) -> DataFrame:
    """As independent_sources, but page by page: documents arrive in micro-batches, and each one meets a stored index."""
    spot = f"{shared_dir(spark)}/bylines-tables/{uuid.uuid4().hex}"
    arriving = hits(spark, sf).select("run_id", F.col("doc").cast("long"), "publisher_id", "body_hash", "wire", "text")
    arriving.withColumn("deal", F.pmod(F.xxhash64("doc"), F.lit(ARRIVALS))).write.partitionBy("deal").parquet(f"{spot}/in")  # no shuffle: every task writes a file for each deal
    files = len(spark.read.schema(arriving.schema).option("recursiveFileLookup", True).parquet(f"{spot}/in").inputFiles())
    stream = spark.readStream.schema(arriving.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max(1, -(-files // ARRIVALS))).parquet(f"{spot}/in")
    store = N.Store(spark, f"{spot}/store")
    N.keep_independent(stream, store, owners(spark), f"{spot}/checkpoint").awaitTermination()
    return store.sources().select("doc", "source", "reason")


def merge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = written(I.independent_sources(hits(spark, sf), owners(spark), *similarity(spark, sf)))
    return I.source_summary(found, hits(spark, sf)).drop("run_id")


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(item, id) of passages held literally and (item, id, common, total) of shingles shared, for queries that need both; documents are cut once."""
    held, some = J.passages_and_shared(claims(spark, sf), table(spark, sf, "documents"), "claim", "doc_id")
    return written(held.union(_short(spark, sf))), written(some)


def _short(spark: SparkSession, sf: str) -> DataFrame:
    """(item, id) of passages of a few words held literally."""
    return J.short_matches(claims(spark, sf), table(spark, sf, "documents"), "claim", "doc_id")


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return J.passage_matches(claims(spark, sf), table(spark, sf, "documents"), "claim", "doc_id").union(_short(spark, sf))


def _hits_of(spark: SparkSession, sf: str, ids: DataFrame, col: str) -> DataFrame:
    """Hits of the documents that stand in a column of ``ids``; titles and body hashes of others are not made."""
    return hits(spark, sf, written(J.picked(table(spark, sf, "documents"), "doc_id", ids, col)))


def claim_pages(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    """Documents that carry each claim's passage, as hits of one run for each claim."""
    met = written(_passages(spark, sf)) if held is None else held
    h = _hits_of(spark, sf, met, "id")
    return written(met.join(h.drop("run_id").hint("merge"), met["id"] == h["doc"]).select(F.col("item").alias("run_id"), "doc", "publisher_id", "body_hash", "wire", "title", "canonical_url", "text"))


def passage_search(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).select(F.col("item").alias("claim"), F.col("id").alias("doc"))


def _per_claim(spark: SparkSession, sf: str, sources: DataFrame) -> DataFrame:
    return I.pages_vs_newsrooms(claims(spark, sf).select(F.col("claim").alias("run_id")), sources).withColumnRenamed("run_id", "claim")


def pages_vs_newsrooms_per_claim(spark: SparkSession, sf: str) -> DataFrame:
    return _per_claim(spark, sf, written(_sources(spark, claim_pages(spark, sf))))


def old_vs_new_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The family count by publisher against the newsroom count, with the difference, for each claim."""
    docs = claim_pages(spark, sf)
    found = written(_sources(spark, docs))
    new = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("source").alias("new"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    old = docs.groupBy("run_id").agg(F.countDistinct("publisher_id").alias("old"))
    return new.join(old, "run_id").select(F.col("run_id").alias("claim"), "pages", "old", "new", (F.col("old") - F.col("new")).alias("delta"), "reasons")


# search plans and coverage


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    c = claims(spark, sf)
    i = F.col("claim")
    published = F.when(i % 6 == 5, F.lit("garbage")).otherwise(F.date_format(F.date_sub(today(), (i * 13 % 500).cast("int")), "yyyy-MM-dd"))
    language = F.when(i % 5 != 4, F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (i % 4 + 1).cast("int")))
    runs = c.select(i.alias("run_id"), S.article_age(published, today().cast("timestamp")).alias("age_days"), language.alias("language"))
    return S.capability_gate(runs, S.capabilities(spark))


def capability_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf).select(F.col("run_id").alias("claim"), "adapter", "status", F.array_join("checks_skipped", ",").alias("checks_skipped"))


def _reports(spark: SparkSession, sf: str, pages: DataFrame) -> DataFrame:
    """Gated adapters answer with the pages they hold; others keep the gate's status."""
    found = pages.groupBy("run_id", F.col("publisher_id").alias("adapter")).agg(F.count(F.lit(1)).alias("found"))
    met = _gate(spark, sf).join(found, ["run_id", "adapter"], "left")
    n = F.when(F.col("status") == "run", F.coalesce("found", F.lit(0))).otherwise(0)
    status = F.when(F.col("status") != "run", F.col("status")).when(n > 0, "ok").otherwise("empty")
    return met.select("run_id", "adapter", status.alias("status"), n.alias("hits"), "checks_skipped", "languages", "max_age_days", F.lit(None).cast("string").alias("reason"), F.lit(0).alias("pos"))


def adapter_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Reports by adapter over all claims: trace-like events with their own statuses, one row for each user and type."""
    e = table(spark, sf, "events")
    rank = F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), (F.pmod(F.floor("value"), F.lit(5)) + 1).cast("int"))
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("adapter"), rank.alias("status"), key_of(F.col("props")).alias("hits"), F.array(F.concat(F.lit("k"), (key_of(F.col("props")) % 3).cast("string"))).alias("checks_skipped"), F.lit(None).cast("string").alias("reason"), F.col("event_id").alias("pos"))
    out = S.collapse_reports(rows)
    return out.select("run_id", "adapter", "hits", "queries_run", "status", S.tool_status(F.col("status")).alias("tool_status"), F.array_join("checks_skipped", ",").alias("checks_skipped"))


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    out = S.coverage(_reports(spark, sf, claim_pages(spark, sf)), today())
    return out.select(F.col("run_id").alias("claim"), F.array_join("languages_covered", ",").alias("languages_covered"), "earliest_reachable_date", "adapters_run")


def _rungs(spark: SparkSession, sf: str, held: DataFrame, shared: DataFrame) -> DataFrame:
    """Three rungs for each claim: the passage itself, half of its shingles, any of its shingles."""
    c = claims(spark, sf)
    exact = held.groupBy(F.col("item").alias("claim")).agg(F.count(F.lit(1)).alias("exact"))
    some = shared.groupBy(F.col("item").alias("claim")).agg(F.count_if(F.col("common") * 2 >= F.col("total")).alias("loose"), F.count(F.lit(1)).alias("keyword"))
    wide = c.select("claim").join(exact, "claim", "left").join(some, "claim", "left").fillna(0)
    rung = lambda i, name: F.struct(F.lit(i).alias("attempt"), F.lit(name).alias("strength"), F.col(name).alias("hits"))
    return wide.select(F.col("claim").alias("run_id"), F.explode(F.array(rung(1, "exact"), rung(2, "loose"), rung(3, "keyword"))).alias("r")).select("run_id", "r.*")


def existence_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return S.ladder(_rungs(spark, sf, *_found(spark, sf))).withColumnRenamed("run_id", "claim")


def _existence(spark: SparkSession, sf: str) -> DataFrame:
    held, shared = _found(spark, sf)
    h = claim_pages(spark, sf, held)
    sources = h.select("run_id", "doc", F.lit("none").alias("reason"))
    first = h.groupBy("run_id").agg(F.max_by("title", "doc").alias("headline"))
    contexts = claims(spark, sf).select(F.col("claim").alias("run_id")).join(first, "run_id", "left").select("run_id", F.lit("").alias("canonical_url"), F.when(F.col("run_id") % 3 == 0, F.col("headline")).alias("headline"), F.lit(None).cast("string").alias("body_hash"))
    reports = _reports(spark, sf, h).select("run_id", F.col("status").isin("ok", "empty", "error").alias("ran"))
    return written(I.existence_class(contexts, h, sources, S.ladder(_rungs(spark, sf, held, shared)), reports))


def existence_class(spark: SparkSession, sf: str) -> DataFrame:
    return _existence(spark, sf).withColumnRenamed("run_id", "claim")


# claims and entities


def heuristic_claims(spark: SparkSession, sf: str) -> DataFrame:
    return C.sentences(table(spark, sf, "documents"), "doc_id", "text").drop("quote").withColumnRenamed("id", "doc_id")


def claim_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Each heuristic claim, and a spoilt copy of it, located in its document again."""
    docs = table(spark, sf, "documents")
    quotes = written(C.sentences(docs, "doc_id", "text"))
    both = quotes.select("id", "claim_id", F.explode(F.array(F.struct(F.lit(True).alias("true_quote"), F.col("quote")), F.struct(F.lit(False).alias("true_quote"), F.concat("quote", F.lit("~~")).alias("quote")))).alias("q")).select("id", "claim_id", "q.*")
    met = docs.join(both.hint("merge"), docs["doc_id"] == both["id"]).withColumn("g", C.ground(F.col("text"), F.col("quote")))
    return met.groupBy("doc_id").agg(F.count_if(F.col("g.grounding") == "exact").alias("exact"), F.count_if(F.col("g.grounding") != "exact").alias("ungrounded"), F.min("g.start").alias("first_start"))


def heuristic_entities(spark: SparkSession, sf: str) -> DataFrame:
    return C.entities(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "entity", "mentions")


def _score(claim: Column) -> Column:
    return C.search_score(claim, claim.rlike("[A-Z][a-z]+ [A-Z][a-z]+"), F.when(claim.endswith("?"), "opinion").otherwise("fact"), F.lit("exact"), F.lit(None), claim.endswith("."))


def _selection(spark: SparkSession, sf: str) -> DataFrame:
    s = C.every_sentence(table(spark, sf, "documents"), "doc_id", "text")
    return C.select_claims(s.select(F.col("id").alias("run_id"), "claim_id", "pos", "claim", _score(F.col("claim")).alias("score")))


def claim_selection(spark: SparkSession, sf: str) -> DataFrame:
    """All sentences of each document scored for search; five at most are selected, the rest skipped, none lost."""
    return _selection(spark, sf).select(F.col("run_id").alias("doc_id"), "claim_id", "score", "rank", "selected")


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Two extraction passes over every document, by sentences and by lines, eight claims each; questions are opinions to both, and to the second only what has a digit is a fact."""
    docs = table(spark, sf, "documents")
    question, number = F.col("claim").endswith("?"), F.col("claim").rlike("[0-9]")

    def side(kind, **by) -> DataFrame:
        s = C.sentences(docs, "doc_id", "text", most=PASS_CLAIMS, **by)
        return written(s.select(F.col("id").alias("run_id"), F.regexp_extract("claim_id", "[0-9]+", 0).cast("int").alias("i"), "claim_id", F.col("claim").alias("text"), kind.alias("kind"), F.col("quote").alias("source_quote"), F.lit("exact").alias("grounding"), "start", "end"))

    a = side(F.when(question, "opinion").otherwise("fact"))
    b = side(F.when(question, "opinion").when(number, "fact"), token=C.LINE, skip=C.NO_END)
    return written(A.merge_passes(a, b, "sentences", "lines"))


def merged_claims(spark: SparkSession, sf: str) -> DataFrame:
    out = _merged(spark, sf)
    return out.select(F.col("run_id").alias("doc_id"), "claim_id", "text", "kind", "start", "end", "agreement", "agreement_note", F.size("variant_texts").alias("variants"))


def two_pass_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return A.agreement_rates(_merged(spark, sf)).withColumnRenamed("run_id", "doc_id")


def quote_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of every document, true to it, set in other marks and spaces, or changed by a word, located in the article that its reader sent in.

    A document with a conversation of its number came with that conversation's first message pasted before it.
    """
    docs = table(spark, sf, "documents")
    first = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "role", "text")).alias("pasted"))
    inputs = docs.join(first.hint("merge"), docs["doc_id"] == first["conv_id"], "left").select(docs["doc_id"].alias("run_id"), "pasted", docs["text"].alias("fetched"))
    merged = written(G.merge_inputs(inputs))
    q, i = F.col("quote"), F.regexp_extract("claim_id", "[0-9]+", 0).cast("int")
    dressed = F.regexp_replace(F.regexp_replace(F.translate(q, "'\"-", "\u2019\u201d\u2014"), r"\s+", " \u00a0 "), "^", "\u201c")
    quote = F.when(i % 4 == 1, q).when(i % 4 == 2, F.regexp_replace(dressed, "^\u201c", "")).when(i % 4 == 3, F.regexp_replace(q, "^(\\S+) \\S+", "$1 otherwise")).otherwise(F.lit(None))
    quotes = C.sentences(merged, "run_id", "text", most=PASS_CLAIMS).select(F.col("id").alias("run_id"), "claim_id", quote.alias("source_quote"))
    found = G.locate_quotes(merged.select("run_id", "text"), quotes)
    out = G.attribute_spans(found, merged.select("run_id", F.inline("segments")))
    return out.select(F.col("run_id").alias("doc_id"), "claim_id", "start", "end", "grounding", "claim_source")


def query_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The searches of every document as an article: its first line, its selected claims, and all names in it; words of a quarter of all documents are stopwords."""
    docs = table(spark, sf, "documents")
    said = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'\\-]*"), F.lit(0)))).alias("word"))
    common = said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 4 >= docs.count())
    stopwords = sorted(r["word"] for r in common.collect())  # at most four times the words of a mean document
    window = F.regexp_extract("text", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    typed = lambda n, i: F.struct(i.alias("pos"), n.alias("text"), let(F.size(F.split(n, " ")), lambda k: F.when(k == 2, "PERSON").when(k == 3, "ORG").otherwise("OTHER")).alias("type"))
    names = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(C.NAME), F.lit(0))), typed)
    cut = C.every_sentence(hits(spark, sf).select("doc", "title", "text"), "doc", "text", in_row=True)
    runs = cut.select(F.col("doc").alias("run_id"), F.col("title").alias("headline"), window.alias("date_start"), window.alias("date_end"), F.lit("high").alias("confidence"), C.best_claims(F.col("sentences"), _score).alias("c"), names.alias("e"))
    return Q.plans(runs, stopwords).withColumnRenamed("run_id", "doc_id")


def _extractors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")

    def by(shape: str) -> DataFrame:
        runs = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: w.rlike(shape))
        return docs.select(F.col("doc_id").alias("id"), F.posexplode(runs).alias("pos", "text"))

    return by("^[A-Z][a-z]{3,}$"), by("^.{8,}$")


def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    return C.merge_entities(*_extractors(spark, sf)).select(F.col("id").alias("doc_id"), "entity", "source")


def entity_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """Names that one extractor alone found, counted for each document."""
    a, b = (x.select("id", F.lower("text").alias("entity")).distinct() for x in _extractors(spark, sf))
    one = a.join(b, ["id", "entity"], "left_anti").withColumn("only", F.lit("a")).union(b.join(a, ["id", "entity"], "left_anti").withColumn("only", F.lit("b")))
    return one.groupBy(F.col("id").alias("doc_id")).agg(F.count_if(F.col("only") == "a").alias("only_a"), F.count_if(F.col("only") == "b").alias("only_b"))


# ranking, stance, fusion


def trigram_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of character trigrams between claims and the whole texts of all documents; the best three for each claim."""
    return T.trigram_top(written(T.trigram_vectors(claims(spark, sf), "claim", "text")), hits(spark, sf), "doc", "text", 3)


def trigram_rank_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return T.trigram_top(written(T.trigram_vectors(claims(spark, sf), "claim", "text", 512)), hits(spark, sf), "doc", "text", 3, 512)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return T.vector_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding")


def _window(spark: SparkSession, sf: str, shared: DataFrame | None = None) -> DataFrame:
    """The window is chosen before texts are fetched: a document that shares a shingle is not blank."""
    found = J.shared_shingles(claims(spark, sf), table(spark, sf, "documents"), "claim", "doc_id") if shared is None else shared
    scored = found.select(F.col("item").alias("claim"), F.col("id").alias("doc"), F.round(F.col("common") / F.col("total"), 6).alias("score"))
    chosen = written(T.stance_window(scored, has_text=F.lit(True)))
    h = _hits_of(spark, sf, chosen, "doc").select("doc", F.col("text").alias("premise"), "publisher_id", "body_hash", "wire")
    return written(chosen.join(h.hint("merge"), "doc"))


def stance_window(spark: SparkSession, sf: str) -> DataFrame:
    return _window(spark, sf).select("claim", "doc", "source_id", "score")


def _stances(spark: SparkSession, sf: str, window: DataFrame | None = None) -> DataFrame:
    window = _window(spark, sf) if window is None else window
    met = window.drop("score").join(claims(spark, sf), "claim").withColumn("x", T.lexical_stance(F.col("premise"), F.col("text")))
    return written(met.select("claim", "doc", "publisher_id", "source_id", F.col("x.label").alias("label"), F.col("x.score").alias("score")))


def lexical_stance(spark: SparkSession, sf: str) -> DataFrame:
    return _stances(spark, sf).select("claim", "doc", "label", "score")


def _evidence_sources(spark: SparkSession, sf: str, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored pairs of each desk's claims with the newsroom behind their document, and the newsrooms found, by desk."""
    window = _window(spark, sf, shared)
    pairs = _stances(spark, sf, window).withColumn("run_id", F.col("claim") % 7)
    docs = written(window.select((F.col("claim") % 7).alias("run_id"), "doc", "publisher_id", "body_hash", "wire", F.col("premise").alias("text")).distinct())
    return pairs, written(_sources(spark, docs))


def _fused(spark: SparkSession, sf: str, shared: DataFrame | None = None) -> DataFrame:
    """All claims of one desk (claim modulo 7) are a run; editorial labels stand for the analyst."""
    pairs, sources = _evidence_sources(spark, sf, shared)
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").alias("quality"))
    met = T.by_newsroom(pairs, sources).join(labels.hint("merge"), "doc", "left")
    met = met.select("run_id", "claim", "doc", "source", "label", "score", F.when(F.col("quality") == 1, "support").when(F.col("quality") == 0, "contradict").alias("analyst"))
    runs = claims(spark, sf).select((F.col("claim") % 7).alias("run_id"), "claim")
    existence = runs.select("run_id").distinct().select("run_id", F.when(F.col("run_id") == 6, "out_of_range").when(F.col("run_id") % 2 == 0, "title_match").otherwise("not_found").alias("existence"))
    return written(T.fuse_claims(runs, met, existence))


def _analyst(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs by desk, and rows and rejects of an analyst who reads the editorial labels, names one document nobody showed for each claim, and sends no list for desk 6."""
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").alias("quality"))
    pairs = _stances(spark, sf).join(labels.hint("merge"), "doc", "left").select((F.col("claim") % 7).alias("run_id"), F.concat(F.lit("c"), F.col("claim").cast("string")).alias("claim_id"), "source_id", "quality")
    pairs = written(pairs)
    ids = lambda c: F.collect_list(F.when(c, F.col("source_id")))
    q = F.col("quality")
    said = pairs.groupBy("run_id", "claim_id").agg(F.array_append(ids(q == 1), F.lit("s0")).alias("supported_by"), ids(q == 0).alias("contradicted_by"), ids(q.isNull()).alias("unrelated"))
    text = F.to_json(F.struct(F.collect_list(F.struct("claim_id", "supported_by", "contradicted_by", "unrelated")).alias("claims")))
    sent = said.groupBy("run_id").agg(text.alias("payload")).withColumn("payload", F.when(F.col("run_id") == 6, F.lit('{"claims": null}')).otherwise(F.col("payload")))
    return pairs, *(written(x) for x in Y.take_in(written(sent), pairs.select("run_id", "source_id").distinct()))


def analyst_stances(spark: SparkSession, sf: str) -> DataFrame:
    pairs, rows, _ = _analyst(spark, sf)
    return Y.attach_stances(pairs, rows).select("run_id", "claim_id", "source_id", "analyst_stance")


def analyst_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, rows that take part, dropped ids and rejects of each desk."""
    pairs, rows, rejects = _analyst(spark, sf)
    took = Y.participated(rows).groupBy("run_id").agg(F.count(F.lit(1)).alias("participating"))
    per = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("dropped").alias("dropped"))
    lost = rejects.groupBy("run_id").agg(F.count(F.lit(1)).alias("rejects"))
    met = pairs.select("run_id").distinct().join(per, "run_id", "left").join(took, "run_id", "left").join(lost, "run_id", "left")
    return met.fillna(0, ["rows", "dropped", "participating", "rejects"])


def source_join_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and newsrooms of each desk when only pages without an owner were grouped, so the others are their own sources, and counted as misses."""
    pairs, sources = _evidence_sources(spark, sf)
    found = sources.where("reason <> 'same_owner'")
    return T.join_misses(T.by_newsroom(pairs.select("run_id", "doc").distinct(), found))


def claim_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).drop("run_id", "existence")


def overall_state(spark: SparkSession, sf: str) -> DataFrame:
    return T.overall_state(_fused(spark, sf))


def support_rate(spark: SparkSession, sf: str) -> DataFrame:
    return T.support_rate(_fused(spark, sf))


def _desk_counts(by_claim: DataFrame) -> DataFrame:
    return by_claim.groupBy((F.col("claim") % 7).alias("run_id")).agg(*[F.sum(c).alias(c) for c in ("document_count", "independent_source_count", "republished")])


def risk_rules(spark: SparkSession, sf: str) -> DataFrame:
    held, shared = _found(spark, sf)
    fused = _fused(spark, sf, shared)
    counts = written(_desk_counts(_per_claim(spark, sf, written(_sources(spark, claim_pages(spark, sf, held))))))
    existence = fused.groupBy("run_id").agg(F.min("existence").alias("existence"))
    return R.risk_rules(T.overall_state(fused), counts, written(T.support_rate(fused)), existence).withColumn("unknowns", F.array_join("unknowns", ","))


def claim_source_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return R.claim_source_matrix(_stances(spark, sf), SOURCES)


def verification_record(spark: SparkSession, sf: str) -> DataFrame:
    held, shared = _found(spark, sf)
    docs = claim_pages(spark, sf, held)
    sources = written(_sources(spark, docs))
    by_claim = written(_per_claim(spark, sf, sources)).withColumnRenamed("claim", "run_id")
    rates = written(T.support_rate(_fused(spark, sf, shared)))
    rates = by_claim.select("run_id", (F.col("run_id") % 7).alias("desk")).join(rates.withColumnRenamed("run_id", "desk"), "desk")
    return R.verification_record(by_claim, by_claim, rates, I.source_summary(sources, docs)).withColumnRenamed("run_id", "claim")


# traces, messages, streams


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _events_of(table(spark, sf, "events"))


def _events_of(events: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("ok", "running", "empty", "error", "skipped")]), (F.pmod(F.floor("value"), F.lit(5)) + 1).cast("int"))
    return events.select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("layer"), status.alias("status"), "props", key_of(F.col("props")).alias("detail"))


def trace_runs(spark: SparkSession, sf: str) -> DataFrame:
    return E.trace_runs(_events(spark, sf), "run_id", ["layer"], ["ts", "event_id"])


def layer_status(spark: SparkSession, sf: str) -> DataFrame:
    return E.layer_status(_events(spark, sf), "run_id", "layer", ["ts", "event_id"])


def live_run_state(spark: SparkSession, sf: str) -> DataFrame:
    return E.live_state(_events(spark, sf), "run_id", ["ts", "event_id"])


def stream_live_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each run at the end of its trace as a stream; a layer that has been running for an hour of quiet is an error."""
    spot = f"{shared_dir(spark)}/bylines-streams/{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    events = _events_of(spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"))
    L.drive(L.live_states(events.withColumn("ts", F.col("ts").cast("timestamp"))), f"{spot}/out", f"{spot}/checkpoint")
    return L.latest(spark, f"{spot}/out")


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each run, newest run first, with a place."""
    last = _events(spark, sf).groupBy("run_id").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    chunk = F.date_trunc("day", F.col("x.ts"))
    days = last.groupBy(chunk.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = last.withColumn("day", chunk).withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy(F.col("x.ts").desc(), F.col("x.event_id").desc())))
    return placed.join(days.withColumn("later", later).select("day", "later"), "day").select("run_id", F.col("x.event_id").alias("last_event"), (F.col("later") + F.col("i")).alias("place"))


def run_history_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Each run saved by two writers, after each of its days by one and at its end by the other, the first one's saves once more; what the table lists in the end."""
    e = _events(spark, sf).withColumn("day", F.to_date("ts"))

    def states(rows: DataFrame, *by: str) -> DataFrame:
        at = F.struct("ts", "event_id")
        last = rows.groupBy("run_id", *by).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("layer", at).alias("phase"), F.max_by("status", at).alias("status"), F.count_if(F.col("status") == "ok").cast("int").alias("completed_layer"), F.max_by("props", at).alias("envelope"))
        none = F.lit(None).cast("string")
        return written(last.select(F.col("run_id").cast("string").alias("run_id"), "created_at", "updated_at", none.alias("original_text"), none.alias("original_url"), none.alias("headline"), "phase", "status", "completed_layer", "envelope"))

    history = H.RunHistory(spark, f"{shared_dir(spark)}/bylines-tables/{uuid.uuid4().hex}")
    daily, whole = states(e, "day"), states(e)
    for rows, name in ((daily, "a-days"), (whole, "b-end"), (daily, "a-days")):
        history.save(rows, name)
    return history.latest().select("run_id", "created_at", "updated_at", "phase", "status", "completed_layer", "envelope")


def message_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return E.message_sequence(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "role", "seq")


def stream_page_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "pages").schema
    pages = spark.readStream.schema(schema).parquet(f"{sf}/page[s].parquet").withColumn("arrived", F.lit("2026-09-16 00:00:00").cast("timestamp"))
    return P.run_to_end(P.first_arrivals(pages, "arrived").select("grouping_url"))


def stream_trace_tail(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    out = P.run_to_end(spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").select("event_id", "ts", "user_id", "event_type", "value"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (
    pages_vs_newsrooms_per_claim, passage_search, exact_url_dedupe, publisher_identity, source_bands, fetch_taxonomy, html_title, shingle_jaccard_pairs, shingle_classes,
    body_hash_reprint_groups, same_owner_groups, independent_sources, merge_evidence, old_vs_new_counts, capability_gate, adapter_rollup, coverage_report, existence_ladder,
    existence_class, heuristic_claims, claim_grounding, heuristic_entities, claim_selection, query_plan, two_pass_reconcile, entity_merge, entity_disagreements, trigram_rank,
    trigram_rank_hashed, vector_topk, stance_window, lexical_stance, source_join_misses, analyst_stances, analyst_intake, claim_fusion, overall_state, support_rate, risk_rules, claim_source_matrix, verification_record, trace_runs,
    layer_status, publisher_dedupe, merged_claims, quote_grounding, incremental_independence, stream_live_state, live_run_state, run_history, run_history_sink, message_sequence, stream_page_dedupe, stream_trace_tail,
)}

import json

from pyspark.sql import functions as F

from bylines.operators.plan import accept_rewrites, blinded, claim_query, free_ids, headline_keywords, query_plan
from bylines.sources.feeds import all_hits, fact_checks


def test_feeds(spark):
    def raw(x):
        return spark.createDataFrame([(1, "q1", json.dumps(x)), (2, "q1", "no json"), (3, "q1", None)], "run_id long, query_id string, payload string")

    hits = all_hits({
        "newsapi": raw({"articles": [{"url": "https://www.a.com/x?utm_source=1", "title": "T", "description": None, "content": "by AFP staff", "author": "Reuters"}, {"url": " "}]}),
        "guardian": raw({"response": {"results": [{"webUrl": "https://theguardian.com/y", "webTitle": "W", "webPublicationDate": "2026-09-12", "fields": {"trailText": "trail", "bodyText": "Body  text", "byline": ""}}]}}),
        "newsdata": raw({"results": [{"link": "https://b.co.uk/z", "title": "Z", "creator": ["Ann", "Bob"]}]}),
        "gnews": raw({"articles": []}),
        "gdelt": raw({"articles": [{"url": "https://c.com/1", "title": "C", "seendate": "20260912T120000Z"}]}),
    })
    got = {r.source_adapter: r for r in hits.collect()}
    assert len(got) == 4 and hits.count() == 4
    assert (got["newsapi"].canonical_url, got["newsapi"].wire_credit, got["newsapi"].snippet) == ("https://a.com/x", "Reuters", "by AFP staff")
    assert got["guardian"].title == "W" and got["guardian"].body_hash.startswith("sha256:") and got["guardian"].byline is None
    assert got["newsdata"].byline == "Ann, Bob" and got["newsdata"].publisher_id == "b.co.uk"
    assert got["gdelt"].published_at == "2026-09-12T12:00:00Z" and got["gdelt"].snippet is None
    checks = fact_checks(raw({"claims": [{"text": "c", "claimReview": [{"url": "u", "textualRating": "Half true"}, {"url": "v"}]}, {"text": "d", "claimReview": [{}]}, {"text": "e"}]})).collect()
    assert [(r.reviewed_claim_text, r.rating_text, r.review_url) for r in checks] == [("c", "Half true", "u")]


def test_plan(spark):
    cols = "run_id long, pos long, query_id string, template_id string, query_text string"
    plan = spark.createDataFrame([(1, 0, "a", "t", "old"), (1, 1, "b", "t", "old"), (2, 0, "a", "t", "old"), (3, 0, "a", "t", "old")], cols)
    new = spark.createDataFrame([(1, 0, "a", "t", "new"), (1, 1, "b", "t", "new"), (2, 0, "a", "t", " "), (3, 0, "a", "t", "new"), (3, 1, "z", "t", "new")], cols)
    assert {(r.run_id, r.query_text) for r in accept_rewrites(plan, new).collect()} == {(1, "new"), (2, "old"), (3, "old")}
    e = spark.createDataFrame([(1, "s1", "p", None, "u", "t", "x" * 900, 0.5)], "run_id long, source_id string, publisher_id string, published_at string, url string, title string, snippet string, score double")
    row = blinded(e).head()
    assert set(row.asDict()) == {"run_id", "source_id", "outlet", "date", "url", "title", "snippet"} and len(row.snippet) == 500


def sequential_ids(wanted):
    used = []
    for w in wanted:
        n = 2
        x = w
        while x in used:
            x = f"{w}_{n}"
            n += 1
        used.append(x)
    return used


def test_ids_stay_free_of_collisions(spark):
    import random

    r = random.Random(6)
    rows = [["a", "a", "a_2", "a", "a_2_2", "a_2"], []] + [[r.choice(["a", "a_2", "a_3", "a_2_2", "b"]) for _ in range(12)] for _ in range(40)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, x array<string>").select("i", free_ids(F.col("x")).alias("y")).collect()
    assert {g.i: g.y for g in got} == {i: sequential_ids(x) for i, x in enumerate(rows)}


def test_words_of_a_plan(spark):
    stop = ["the", "of", "over", "has", "not", "a"]
    heads = {"the minister Resigns over the coastal Plan of Cornwall plan": ["minister", "Resigns", "coastal", "Plan", "Cornwall"], "of the it": [], "aaa bbbb Cc Ddd eeeee ffffff ggg hhh": ["aaa", "bbbb", "Ddd", "eeeee", "ffffff", "ggg"]}
    df = spark.createDataFrame(list(heads), "string").toDF("h")
    assert {r.h: r.k for r in df.select("h", headline_keywords(F.col("h"), stop).alias("k")).collect()} == heads
    claims = {
        "Rachel Vance announced 3,400 homes, 12.5% of the plan, in Cornwall in 2026": "Rachel Vance Cornwall announced 3,400 12.5% 2026", "Cornwalls plan rests": "cornwalls", "so it is": "so it is", "": "",
        "The (U.K.) news: it costs 5 5": "(U.K.) costs 5", "plans move and were approved": "approved",
    }
    df = spark.createDataFrame([(c, ["Rachel Vance", " Cornwall", "x", "(U.K.)", "Cornwall"]) for c in claims], "c string, e array<string>")
    assert {r.c: r.q for r in df.select("c", claim_query(F.col("c"), F.col("e"), stop).alias("q")).collect()} == claims


def test_query_plan(spark):
    runs = spark.createDataFrame([(1, " Coastal plan ", "2026-09-01", " ", "high"), (2, None, "2026-09-01", "2026-09-03", "weak"), (3, "the", None, None, None)], "run_id long, headline string, date_start string, date_end string, confidence string")
    claims = spark.createDataFrame([(1, 1, "c1", "Work started."), (1, 2, "c1", "Work ended."), (1, 3, "c1_2", None), (2, 1, None, "So it is")], "run_id long, pos int, claim_id string, text string")
    names = spark.createDataFrame([(1, 2, "Cornwall", "GPE"), (1, 1, "Vance ", "PERSON"), (1, 3, "CORNWALL", "ORG"), (1, 4, "March", "DATE"), (1, 5, " ", "ORG")], "run_id long, pos int, text string, type string")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in query_plan(runs, claims, names, ["the"]).orderBy("run_id", "pos").collect()]
    d = ("2026-09-01", None)
    n = (None, None)
    assert got == [
        (1, "q_exist_1", "existence", None, '"Coastal plan"', "exist_exact", 1, *d), (1, "q_exist_2", "existence", None, "Coastal plan", "exist_loose", 2, *d), (1, "q_exist_3", "existence", None, "Coastal plan", "exist_keyword", 3, *d),
        (1, "q_claim_c1", "claim", "c1", "started", "claim_event", 1, *d), (1, "q_fc_c1", "factcheck", "c1", "Work started.", "factcheck", 1, *n), (1, "q_claim_c1_2", "claim", "c1", "ended", "claim_event", 1, *d),
        (1, "q_fc_c1_2", "factcheck", "c1", "Work ended.", "factcheck", 1, *n), (1, "q_claim_c1_2_2", "claim", "c1_2", "", "claim_event", 1, *d), (1, "q_fc_c1_2_2", "factcheck", "c1_2", "", "factcheck", 1, *n),
        (1, "q_entity_0", "entity", None, "Vance", "entity_lookup", 1, *n), (1, "q_entity_1", "entity", None, "Cornwall", "entity_lookup", 1, *n),
        (2, "q_claim_unknown", "claim", "unknown", "So it is", "claim_event", 1, *n), (2, "q_fc_unknown", "factcheck", "unknown", "So it is", "factcheck", 1, *n),
        (3, "q_exist_1", "existence", None, '"the"', "exist_exact", 1, *n), (3, "q_exist_2", "existence", None, "the", "exist_loose", 2, *n),
    ]

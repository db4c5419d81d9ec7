"""Two passes reconciled against a sequential greedy loop; quotes located against a plain search; inputs merged."""

import random
import re
import unicodedata

from bylines.operators.agreement import agreement_rates, greedy_pairs, merge_passes, span_candidates
from bylines.operators.grounding import NormalText, attribute_spans, locate_quotes, merge_inputs, segment_text
from bylines.schemas import LIKE_ASCII

CLAIM = "run_id long, i int, claim_id string, text string, kind string, source_quote string, grounding string, start int, end int"


def claims_of(spark, rows):
    return spark.createDataFrame(rows, CLAIM)


def greedy(a, b):
    found = []
    for x in a:
        for y in b:
            if x[0] == y[0] and None not in (x[7], y[7]) and "not_found" not in (x[6], y[6]):
                o, shorter = min(x[8], y[8]) - max(x[7], y[7]), min(x[8] - x[7], y[8] - y[7])
                if o > 0 and shorter > 0 and o / shorter >= 0.5:
                    found.append((x[0], -o / shorter, x[1], y[1]))
    out, used = set(), set()
    for run, o, i, j in sorted(found):
        if (run, "a", i) not in used and (run, "b", j) not in used:
            used |= {(run, "a", i), (run, "b", j)}
            out.add((run, i, j))
    return out


def test_a_claim_whose_best_is_taken_gets_the_next(spark):
    a = [(1, 0, "c1", "a1", None, "", "exact", 0, 50), (1, 1, "c2", "a2", None, "", "exact", 50, 120)]
    b = [(1, 0, "c1", "b1", None, "", "exact", 0, 100), (1, 1, "c2", "b2", None, "", "exact", 100, 140)]
    got = greedy_pairs(span_candidates(claims_of(spark, a), claims_of(spark, b)))
    assert {(r.i, r.j) for r in got.collect()} == {(0, 0), (1, 1)}


def test_random_spans_equal_the_loop(spark):
    r = random.Random(4)
    side = lambda: [(run, i, f"c{i}", "t", None, "", r.choice(["exact", "exact", "normalised", "not_found"]), *r.choice([(s := r.randrange(3000), s + r.randrange(1, 400)), (s, s + 40), (None, None)])) for run in range(6) for i in range(25)]
    a, b = side(), side()
    got = {(x.run_id, x.i, x.j) for x in greedy_pairs(span_candidates(claims_of(spark, a), claims_of(spark, b))).collect()}
    assert got == greedy(a, b) and len(got) > 15


def test_merged_claims(spark):
    a = [(1, 0, "c1", "A wording.", "fact", "q", "normalised", 10, 60), (1, 1, "c2", "Seems unconvinced.", "fact", "q", "exact", 100, 150), (1, 2, "c3", "Made up.", None, "q", "not_found", None, None), (2, 0, "c1", "Alone.", "opinion", "q", "exact", 5, 50)]
    b = [(1, 0, "c1", "Not sure.", "opinion", "q", "exact", 100, 150), (1, 1, "c2", "B wording.", None, "q", "exact", 12, 60), (1, 2, "c3", "Earlier.", "odd", "q", "exact", 0, 5)]
    rows = merge_passes(claims_of(spark, a), claims_of(spark, b), "m1", "m2")
    got = {(r.run_id, r.claim_id): r for r in rows.collect()}
    assert [(k, r.text, r.kind, r.agreement) for k, r in sorted(got.items())] == [
        ((1, "c1"), "Earlier.", "odd", "pass_b_only"), ((1, "c2"), "B wording.", "fact", "both"), ((1, "c3"), "Seems unconvinced.", "unclear", "both"),
        ((1, "c4"), "Made up.", None, "pass_a_only"), ((2, "c1"), "Alone.", "opinion", "pass_a_only"),
    ]
    assert got[1, "c2"].variant_texts == ["A wording.", "B wording."] and "fact vs opinion" in got[1, "c3"].agreement_note and "not in the article" in got[1, "c4"].agreement_note
    assert {(r.run_id, r.claims, r.agreed, r.agreement_rate) for r in agreement_rates(rows).collect()} == {(1, 4, 2, 0.5), (2, 1, 0, 0.0)}
    assert merge_passes(claims_of(spark, []), claims_of(spark, []), "x", "y").count() == 0


def plain_locate(raw, quote):
    """Character by character."""
    needle = (quote or "").strip()
    if not needle or not raw:
        return None, None, "not_found"
    if needle in raw:
        return raw.index(needle), raw.index(needle) + len(needle), "exact"

    def forms(text):
        chars, at = [], []
        for i, c in enumerate(text):
            if c.isspace():
                if i and text[i - 1].isspace():
                    continue
                new = " "
            else:
                new = unicodedata.normalize("NFKC", LIKE_ASCII.get(c, c))
            chars.append(new)
            at += [i] * len(new)
        return "".join(chars), at

    (hay, at), want = forms(raw), forms(needle)[0].strip()
    k = hay.find(want) if want else -1
    return (None, None, "not_found") if k < 0 else (at[k], at[k + len(want) - 1] + 1, "normalised")


ARTICLE = 'Ministers announced a "coastal defence plan-urgent" on Monday.\n\nThe Treasury  has not confirmed the three-year funding figure. Oﬃcials \U0001F600 said ｆｕｌｌ ½ “maybe”　and more…'


def test_quotes_equal_a_plain_search(spark):
    r = random.Random(9)
    quotes = ["a “coastal defence plan—urgent”", "Treasury has not confirmed", "the bridge collapsed", None, "", " \n", "  Monday.\n", "officials", "Officials", "full 1⁄2 \"maybe\" and more...", "\U0001F600  said", "said　full", "ffi", "i", "‘"]
    alphabet = list('ab "-\'\n\t  ') + ["“", "—", "ﬃ", "…", "½", " ", "é", "é", "¨", "\x1c", "İ"]
    texts = {0: ARTICLE, 1: "", 2: None} | {k: "".join(r.choice(alphabet) for _ in range(60)) for k in range(3, 60)}
    rows = [(0, f"q{i}", q) for i, q in enumerate(quotes)] + [(1, "q", "x"), (2, "q", "x"), (99, "q", "x"), (None, "q", "x")]
    for k in range(3, 60):
        for i in range(4):
            s = r.randrange(50)
            q = texts[k][s : s + r.randint(1, 9)]
            rows.append((k, f"q{i}", r.choice([q, NormalText(q).text, q.replace('"', "“"), re.sub(r"\s+", "  ", q)])))
    got = locate_quotes(spark.createDataFrame(list(texts.items()), "run_id long, text string"), spark.createDataFrame(rows, "run_id long, claim_id string, source_quote string")).collect()
    assert len(got) == len(rows)
    assert {(x.run_id, x.claim_id): (x.start, x.end, x.grounding) for x in got} == {(k, c): plain_locate(texts.get(k), q) for k, c, q in rows}
    assert {x.grounding for x in got} == {"exact", "normalised", "not_found"}


def test_segments_and_sources(spark):
    rows = [
        (1, "Journalist note: confirm the figure.", "Treasury has not confirmed the figure."), (2, "the “FIGURE”  is", 'So the "figure" is known.'), (3, None, "only fetched"), (4, "only pasted", ""), (5, None, None), (6, " ", "body"), (7, "straße", "Die STRASSE dort é"),
        (8, "e", "x é"),
    ]
    merged = merge_inputs(spark.createDataFrame(rows, "run_id long, pasted string, fetched string"))
    got = {r.run_id: (r.text, [tuple(s) for s in r.segments]) for r in merged.collect()}
    assert got[1] == (rows[0][1] + "\n\n" + rows[0][2], [("pasted", 0, 38), ("fetched", 38, 76)])
    assert got[2] == (rows[1][2], [("fetched", 0, 25)]) and got[3][1] == [("fetched", 0, 12)] and got[4] == ("only pasted", [("pasted", 0, 11)]) and got[5] == ("", []) and got[6][0] == "body"
    assert got[7][1] == [("fetched", 0, 18)] and got[8][0] == "e\n\nx é"
    back = merged.select("run_id", segment_text(merged["text"], merged["segments"], "pasted").alias("p"), segment_text(merged["text"], merged["segments"], "fetched").alias("f")).collect()
    assert {r.run_id: r.f for r in back}[1] == rows[0][2] and {r.run_id: r.p for r in back}[1] == rows[0][1] + "\n\n"
    segments = merged.selectExpr("run_id", "inline(segments)")
    quotes = [(1, "c1", "confirm the figure"), (1, "c2", "Treasury has not confirmed"), (1, "c3", "the figure.\n\nTreasury"), (1, "c4", "absent"), (5, "c1", "x")]
    spans = locate_quotes(merged.select("run_id", "text"), spark.createDataFrame(quotes, "run_id long, claim_id string, source_quote string"))
    out = {(r.run_id, r.claim_id): (r.claim_source, r.grounding) for r in attribute_spans(spans, segments).collect()}
    assert out == {(1, "c1"): ("pasted", "exact"), (1, "c2"): ("fetched", "exact"), (1, "c3"): ("spans_both", "exact"), (1, "c4"): (None, "not_found"), (5, "c1"): (None, "not_found")}


def plain_sentences(text, most=8):
    out = [(m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in re.finditer(r"[^.?!]+[.?!]*", text) if len(m[0].strip()) > 40][:most]
    return [q for _, q in out] or ([text.strip()[:400]] if text.strip() else [])


def test_query_on_whole_tables_against_a_plain_version(spark):
    from bylines.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    first = {}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r.turn, r.role, r.text)):
        first.setdefault(r.conv_id, r.text)
    flat = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).translate(str.maketrans(LIKE_ASCII)).casefold()).strip()
    want = set()
    for doc, fetched in docs.items():
        pasted = first.get(doc) or ""
        if pasted and fetched and flat(pasted) in flat(fetched):
            pasted = ""
        raw = pasted + ("\n\n" if pasted and fetched else "") + fetched
        cut = len(raw) - len(fetched)
        for i, q in enumerate(plain_sentences(raw), 1):
            dressed = re.sub(r"\s+", "   ", q.translate(str.maketrans("'\"-", "’”—")), flags=re.ASCII)
            quote = {1: q, 2: dressed, 3: re.sub(r"\A(\S+) \S+", r"\1 otherwise", q, flags=re.ASCII)}.get(i % 4)
            start, end, how = plain_locate(raw, quote)
            kinds = [] if start is None else [k for k, a, b in (("pasted", 0, cut), ("fetched", cut, len(raw))) if a < b and a < end and start < b]
            want.add((doc, f"c{i}", start, end, how, None if not kinds else kinds[0] if len(kinds) == 1 else "spans_both"))
    got = {(r.doc_id, r.claim_id, r.start, r.end, r.grounding, r.claim_source) for r in QUERIES["quote_grounding"](spark, d).collect()}
    assert got == want and {r[4] for r in got} == {"exact", "normalised", "not_found"} and {"pasted", "fetched"} <= {r[5] for r in got}

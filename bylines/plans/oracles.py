"""DuckDB SQL for the evidence queries that SQL can state."""

from __future__ import annotations

from bylines.plans.queries import SOURCES
from bylines.schemas import AGGREGATORS, FAMILIES, LEGACY, NEGATIONS, NON_VERBS, NUMERIC, PAYWALL_MARKERS, SUFFIXES, TRACKING, VERB_ENDS


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\\.', '')"
LABELS = f"string_split({HOST}, '.')"
DOMAIN = f"CASE WHEN array_to_string({LABELS}[-2:], '.') IN ({listed(SUFFIXES)}) THEN array_to_string({LABELS}[-3:], '.') ELSE array_to_string({LABELS}[-2:], '.') END"
PARAMS = f"list_sort(list_filter(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: NOT (lower(string_split(p, '=')[1]) IN ({listed(TRACKING)}) OR starts_with(lower(string_split(p, '=')[1]), 'utm_'))))"
PATH = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '(?i)/amp(\\.html)?/?$', ''), '/+$', '')"
CANONICAL = f"regexp_extract(lower(url), '^([a-z]+)://', 1) || '://' || {HOST} || {PATH} || CASE WHEN len({PARAMS}) > 0 THEN '?' || array_to_string({PARAMS}, '&') ELSE '' END"
FAMILY = "CASE domain " + " ".join(f"WHEN '{d}' THEN '{f}'" for d, f in FAMILIES.items()) + " ELSE domain END"

# RE2 knows ASCII word boundaries only
EDGE = r"[^\p{L}\p{Nd}_]"
NUMBER = NUMERIC.replace(r"\b(?:", f"(?:^|{EDGE})(?:").replace(r")\b", f")(?:$|{EDGE})").replace(r"\bper\s+cent\b", f"(?:^|{EDGE})per\\s+cent(?:$|{EDGE})").replace(r"\bpercent\b", f"(?:^|{EDGE})percent(?:$|{EDGE})")

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END"
DOC_SETS = f"dw AS (SELECT doc_id AS doc, {WORDS} AS w FROM documents), ds AS (SELECT doc, list_sort({SHINGLES}) AS s FROM dw WHERE len(w) > 0)"
CLASSES = f"{DOC_SETS}, dk AS (SELECT doc, s, min(doc) OVER (PARTITION BY s) AS rep FROM ds), sets AS (SELECT rep, s FROM dk WHERE doc = rep), x AS (SELECT rep, unnest(s) AS h FROM sets)"
PAIRS = f"""{CLASSES}, common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep GROUP BY 1, 2),
    pairs AS (SELECT a, b, n / (len(p.s) + len(q.s) - n) AS jaccard FROM common JOIN sets p ON p.rep = a JOIN sets q ON q.rep = b WHERE n / (len(p.s) + len(q.s) - n) >= 0.8 - 1e-12)"""
HASH = "CASE WHEN length(trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g'))) > 0 THEN 'sha256:' || left(sha256(trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g'))), 32) END"
OWNER = "CASE WHEN substr({p}, 4)::INT % 2 = 1 THEN 'group' || (substr({p}, 4)::INT % 7) END"
CARRIED = "carried AS (SELECT item_id AS claim, doc_id AS doc, source, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
HITS = f"h AS (SELECT doc_id AS doc, source AS publisher_id, {HASH} AS body_hash, text FROM documents)"


def components(nodes: str, owners: bool) -> str:
    return f"WITH RECURSIVE {closure(f'{PAIRS}, {HITS}, {CARRIED}', nodes, owners)}"


def closure(before: str, nodes: str, owners: bool) -> str:
    """Recursive closure over all reprint pairs, and owner pairs, within each run of ``nodes(run, doc)``."""
    owner = f"(({OWNER.format(p='p.publisher_id')}) = ({OWNER.format(p='q.publisher_id')}))" if owners else "false"
    return f"""{before}, nodes AS ({nodes}),
    cls AS (SELECT doc, rep FROM dk),
    near AS (SELECT a, b FROM pairs WHERE jaccard >= 0.9 - 1e-12 UNION SELECT b, a FROM pairs WHERE jaccard >= 0.9 - 1e-12 UNION SELECT rep, rep FROM sets),
    edges AS (
        SELECT n.run, p.doc AS a, q.doc AS b, CASE WHEN {owner} THEN 1 ELSE 2 END AS rank
        FROM nodes n JOIN nodes m ON n.run = m.run AND n.doc <> m.doc JOIN h p ON p.doc = n.doc JOIN h q ON q.doc = m.doc LEFT JOIN cls u ON u.doc = p.doc LEFT JOIN cls v ON v.doc = q.doc
        WHERE {owner} OR (p.publisher_id <> q.publisher_id AND CASE WHEN p.body_hash IS NOT NULL AND q.body_hash IS NOT NULL THEN p.body_hash = q.body_hash ELSE (u.rep, v.rep) IN (SELECT (a, b) FROM near) END)
    ),
    walk AS (SELECT run, doc AS node, doc AS spot FROM nodes UNION SELECT w.run, w.node, e.b FROM walk w JOIN edges e ON e.run = w.run AND e.a = w.spot),
    comp AS (SELECT run, node AS doc, min(spot) AS source FROM walk GROUP BY 1, 2),
    why AS (SELECT c.run, c.source, min(e.rank) AS rank FROM comp c JOIN edges e ON e.run = c.run AND e.a = c.doc GROUP BY 1, 2),
    found AS (SELECT c.run, c.doc, c.source, CASE rank WHEN 1 THEN 'same_owner' WHEN 2 THEN 'reprint' ELSE 'none' END AS reason FROM comp c LEFT JOIN why USING (run, source))"""


CLAIM_NODES = "SELECT claim AS run, doc FROM carried"
ALL_NODES = "SELECT 0 AS run, doc_id AS doc FROM documents"

CAPS = "caps AS (SELECT 'src' || i AS adapter, CASE i % 3 WHEN 1 THEN 30 WHEN 2 THEN 400 END AS max_age, CASE i % 4 WHEN 1 THEN ['en'] WHEN 2 THEN ['en', 'fr'] WHEN 3 THEN ['de', 'es'] END AS langs, i % 5 = 4 AS needs_key FROM range(20) t(i))"
GATE = f"""{CAPS}, runs AS (SELECT item_id AS claim, CASE WHEN item_id % 6 <> 5 THEN item_id * 13 % 500 END AS age, CASE WHEN item_id % 5 <> 4 THEN ['en', 'fr', 'de', 'es'][item_id % 4 + 1] END AS lang FROM benchmark),
    gate AS (SELECT claim, adapter, langs, max_age, CASE WHEN age > max_age THEN 'skipped_out_of_range' WHEN needs_key THEN 'skipped_no_key' WHEN lang IS NOT NULL AND langs IS NOT NULL AND NOT list_contains(langs, lang) THEN 'skipped_out_of_range' ELSE 'run' END AS status,
        concat_ws(',', CASE WHEN age IS NULL AND max_age IS NOT NULL THEN 'age' END, CASE WHEN lang IS NULL AND langs IS NOT NULL THEN 'language' END) AS checks_skipped FROM runs, caps)"""
SHARED = f"""bw AS (SELECT item_id AS claim, {WORDS} AS w FROM benchmark), bs AS (SELECT claim, unnest({SHINGLES}) AS h FROM bw WHERE len(w) > 0), tot AS (SELECT claim, count(*) AS total FROM bs GROUP BY 1),
    {DOC_SETS}, dx AS (SELECT doc, unnest(s) AS h FROM ds), shared AS (SELECT claim, doc, count(*) AS common, any_value(total) AS total FROM bs JOIN dx USING (h) JOIN tot USING (claim) GROUP BY 1, 2)"""
LADDER = f"""{SHARED}, {CARRIED}, ex AS (SELECT claim, count(*) AS n FROM carried GROUP BY 1), lo AS (SELECT claim, count(*) FILTER (common * 2 >= total) AS n, count(*) AS k FROM shared GROUP BY 1),
    rungs AS (SELECT item_id AS claim, coalesce(ex.n, 0) AS e, coalesce(lo.n, 0) AS l, coalesce(lo.k, 0) AS k FROM benchmark LEFT JOIN ex ON ex.claim = item_id LEFT JOIN lo ON lo.claim = item_id),
    ladder AS (SELECT claim, CASE WHEN e + l + k > 0 THEN 'matched' ELSE 'exhausted' END AS outcome, CASE WHEN e > 0 THEN 'exact' WHEN l > 0 THEN 'loose' WHEN k > 0 THEN 'keyword' ELSE 'none' END AS strength, CASE WHEN e > 0 THEN 1 WHEN l > 0 THEN 2 ELSE 3 END AS attempts_run, CASE WHEN e > 0 THEN e WHEN l > 0 THEN l ELSE k END AS hits FROM rungs)"""
WINDOW = f"""{SHARED}, ranked AS (SELECT claim, doc, round(common / total, 6) AS score, row_number() OVER (PARTITION BY claim ORDER BY round(common / total, 6) DESC, doc) AS pos FROM shared),
    win AS (SELECT claim, doc, score, 's' || pos AS source_id FROM ranked WHERE pos <= 12)"""
LONG = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 2))"
STANCE = f"""{WINDOW}, sw AS (SELECT claim, doc, source, {LONG.format(t='d.text')} AS p, {LONG.format(t='b.text')} AS h FROM win JOIN documents d ON d.doc_id = win.doc JOIN benchmark b ON b.item_id = win.claim),
    so AS (SELECT *, len(list_intersect(p, h)) / greatest(len(h), 1) AS o, list_has_any(p, [{listed(NEGATIONS)}]) <> list_has_any(h, [{listed(NEGATIONS)}]) AS neg FROM sw),
    st AS (SELECT claim, doc, source, CASE WHEN len(p) = 0 OR len(h) = 0 THEN 'neutral' WHEN neg AND o > 0.3 THEN 'contradiction' WHEN o >= 0.45 THEN 'entailment' ELSE 'neutral' END AS label,
        round(CASE WHEN len(p) = 0 OR len(h) = 0 THEN 0.5 WHEN neg AND o > 0.3 THEN 0.6 WHEN o >= 0.45 THEN least(0.58 + o * 0.3, 0.85) ELSE greatest(0.4, 1 - o) END, 6) AS score FROM so)"""
DESKS = closure(f"RECURSIVE {STANCE}, {PAIRS.replace(DOC_SETS + ', ', '')}, {HITS}", "SELECT DISTINCT claim % 7 AS run, doc FROM st", True)
FUSED = f"""{DESKS}, lab AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1),
    ev AS (SELECT st.claim, st.doc, found.source AS src, label = 'entailment' AND score >= 0.6 AS up, label = 'contradiction' AND score >= 0.6 AS down, coalesce(q = 1, false) AS aup, coalesce(q = 0, false) AS adown, q IS NOT NULL AS took FROM st JOIN found ON found.run = st.claim % 7 AND found.doc = st.doc LEFT JOIN lab ON doc_id = st.doc),
    sums AS (SELECT claim, count(*) AS pairs, count(DISTINCT src) FILTER (up) AS nli_support, count(DISTINCT src) FILTER (down) AS nli_contradict, count(DISTINCT src) FILTER (aup) AS llm_support, count(DISTINCT src) FILTER (adown) AS llm_contradict,
        count(DISTINCT src) FILTER (up OR aup) AS support, count(DISTINCT src) FILTER (down OR adown) AS contradict, sign(count(*) FILTER (up) - count(*) FILTER (down)) AS nd, sign(count(*) FILTER (aup) - count(*) FILTER (adown)) AS ld,
        count(*) FILTER (up OR down) > 0 AS nany, count(*) FILTER (aup OR adown) > 0 AS lany FROM ev GROUP BY 1),
    agreed AS (SELECT item_id AS claim, coalesce(pairs, 0) AS pairs, coalesce(nli_support, 0) AS nli_support, coalesce(nli_contradict, 0) AS nli_contradict, coalesce(llm_support, 0) AS llm_support, coalesce(llm_contradict, 0) AS llm_contradict, coalesce(support, 0) AS support, coalesce(contradict, 0) AS contradict,
        CASE WHEN NOT coalesce(nany, false) AND NOT coalesce(lany, false) THEN 'none' WHEN NOT lany THEN 'nli_only' WHEN NOT nany THEN 'llm_only' WHEN nd = ld THEN 'convergent' ELSE 'contested' END AS agreement,
        CASE WHEN item_id % 7 = 6 THEN 'out_of_range' WHEN item_id % 7 % 2 = 0 THEN 'title_match' ELSE 'not_found' END AS existence FROM benchmark LEFT JOIN sums ON claim = item_id),
    fused AS (SELECT *, claim % 7 AS run_id, CASE WHEN pairs = 0 THEN 'not_assessed' WHEN contradict >= 1 AND support >= 1 OR contradict >= 2 THEN 'contested_reporting' WHEN existence = 'title_match' AND agreement = 'convergent' AND support >= 1 THEN 'corroborated_coverage'
        WHEN support >= 2 THEN 'event_corroborated' WHEN support = 1 THEN 'single_source' WHEN agreement = 'contested' THEN 'contested' ELSE 'no_corroboration_found' END AS state FROM agreed)"""
EVENTS = "ev AS (SELECT event_id, ts, user_id AS run_id, event_type AS layer, ['ok', 'running', 'empty', 'error', 'skipped'][CAST(floor(value) AS BIGINT) % 5 + 1] AS status, CAST(json_extract_string(props, '$.k') AS INT) AS detail FROM events)"
PIECES = "string_split(regexp_replace({t}, '([.!?])([ \\t\\n\\x0B\\f\\r])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


WS = "[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x85\\xa0]"
SENTENCE, LINE = "[^.?!]+[.?!]*|[.?!]+", "[^\\n]*\\n|[^\\n]+"
LEFT = "regexp_replace({t}, '^" + WS + "+', '')"
STRIP = "regexp_replace(" + LEFT + ", '" + WS + "+$', '')"


def sentence_ctes(name: str, most: int = 5, token: str = SENTENCE) -> str:
    """The first passages over 40 characters of each document with their places, or the start of a text without any."""
    cut = f"regexp_extract_all(text, '{token}')"
    return f"""{name}_p AS (SELECT doc_id, unnest({cut}) AS tok, generate_subscripts({cut}, 1) AS pos FROM documents WHERE text IS NOT NULL),
    {name}_a AS (SELECT *, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(tok) - length({LEFT.format(t='tok')}) AS start, {STRIP.format(t='tok')} AS quote FROM {name}_p),
    {name}_l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {name}_a WHERE length(quote) > 40 AND NOT ({token == SENTENCE} AND regexp_matches(tok, '^[.?!]'))),
    {name}_k AS (SELECT doc_id, n, pos, quote, start FROM {name}_l WHERE n <= {most}
        UNION ALL SELECT doc_id, 1, 1, left({STRIP.format(t='text')}, 400), length(text) - length({LEFT.format(t='text')}) FROM documents WHERE {STRIP.format(t='text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM {name}_l)),
    {name} AS (SELECT doc_id, n, pos, 'c' || n AS claim_id, left(quote, 400) AS claim, quote, CAST(start AS INT) AS start, CAST(start + length(quote) AS INT) AS "end" FROM {name}_k)"""


MERGED = f"""RECURSIVE {sentence_ctes('s', 8)}, {sentence_ctes('l', 8, LINE)},
    a AS (SELECT *, CASE WHEN ends_with(claim, '?') THEN 'opinion' ELSE 'fact' END AS kind FROM s), b AS (SELECT *, CASE WHEN ends_with(claim, '?') THEN 'opinion' WHEN regexp_matches(claim, '[0-9]') THEN 'fact' END AS kind FROM l),
    o AS (SELECT a.doc_id, a.n AS i, b.n AS j, (least(a."end", b."end") - greatest(a.start, b.start)) / least(a."end" - a.start, b."end" - b.start) AS o FROM a JOIN b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end"),
    cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, i, j) AS k FROM o WHERE o >= 0.5),
    walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS i, 0::BIGINT AS j, false AS took, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM cand
        UNION ALL SELECT c.doc_id, c.k, c.i, c.j, NOT list_contains(ua, c.i) AND NOT list_contains(ub, c.j), CASE WHEN list_contains(ua, c.i) OR list_contains(ub, c.j) THEN ua ELSE list_append(ua, c.i) END, CASE WHEN list_contains(ua, c.i) OR list_contains(ub, c.j) THEN ub ELSE list_append(ub, c.j) END FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.k = w.k + 1),
    pair AS (SELECT doc_id, i, j FROM walk WHERE took),
    every AS (
        SELECT p.doc_id, 0 AS part, p.i AS x, a.claim_id AS old, a.claim AS text, CASE WHEN a.kind <> b.kind THEN 'unclear' ELSE coalesce(a.kind, b.kind, 'unspecified') END AS kind, a.start, a."end", 'both' AS agreement, 2 AS variants,
            'both passes (sentences, lines) extracted this span' || CASE WHEN a.kind <> b.kind THEN '; passes disagreed on label (' || a.kind || ' vs ' || b.kind || '), recorded as unclear' ELSE '' END AS agreement_note
        FROM pair p JOIN a ON a.doc_id = p.doc_id AND a.n = p.i JOIN b ON b.doc_id = p.doc_id AND b.n = p.j
        UNION ALL SELECT a.doc_id, 1, a.n, a.claim_id, a.claim, a.kind, a.start, a."end", 'pass_a_only', 1, 'only pass A (sentences) extracted this span — lower extraction confidence, not evidence the claim is wrong' FROM a ANTI JOIN pair p ON a.doc_id = p.doc_id AND a.n = p.i
        UNION ALL SELECT b.doc_id, 2, b.n, b.claim_id, b.claim, b.kind, b.start, b."end", 'pass_b_only', 1, 'only pass B (lines) extracted this span — lower extraction confidence, not evidence the claim is wrong' FROM b ANTI JOIN pair p ON b.doc_id = p.doc_id AND b.n = p.j),
    merged AS (SELECT doc_id, 'c' || row_number() OVER (PARTITION BY doc_id ORDER BY start, old, part, x) AS claim_id, text, kind, start, "end", agreement, agreement_note, variants FROM every)"""


SELECTION = rf"""{sentence_ctes('s', 1 << 40)}, c AS (SELECT doc_id, 'c' || pos AS claim_id, pos, claim, CAST(CASE WHEN regexp_matches(claim, '[A-Z][a-z]+ [A-Z][a-z]+') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(claim, '{NUMBER}') THEN 2 ELSE 0 END + CASE WHEN ends_with(claim, '?') THEN -3 ELSE 1 END + 1 + CASE WHEN ends_with(claim, '.') THEN 1 ELSE 0 END AS INT) AS score FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM c)"""
VERBS = "(" + "|".join(VERB_ENDS) + ")$"
TOKENS = "regexp_extract_all({t}, '[A-Za-z][A-Za-z''\\-]*')"
PLAN = rf"""seen AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''\-]*'))) AS word FROM documents), stop AS (SELECT list(word) AS ws FROM (SELECT word FROM seen GROUP BY 1 HAVING count(*) * 4 >= (SELECT count(*) FROM documents))),
    head AS (SELECT doc_id, trim(left(split_part(coalesce(text, ''), chr(10), 1), 120)) AS h, regexp_extract(coalesce(text, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS day FROM documents),
    hw AS (SELECT doc_id, unnest({TOKENS.format(t='h')}) AS w, generate_subscripts({TOKENS.format(t='h')}, 1) AS i FROM head), hf AS (SELECT * FROM hw, stop WHERE length(w) >= 3 AND NOT list_contains(ws, lower(w)) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1),
    hk AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS keys FROM (SELECT * FROM hf QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(w, '^[A-Z]') THEN 0 ELSE 1 END, -length(w), i) <= 6) GROUP BY 1),
    en AS (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS spot FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS l FROM documents)), ed AS (SELECT doc_id, name, min(spot) AS spot FROM en GROUP BY 1, 2),
    el AS (SELECT doc_id, list(name ORDER BY spot) AS names FROM ed GROUP BY 1),
    pc AS (SELECT r.doc_id, r.claim_id, r.claim, r.rank, list_filter(coalesce(names, []), lambda x: regexp_matches(lower(r.claim), '(^|[^\p{{L}}\p{{Nd}}_])' || lower(x) || '($|[^\p{{L}}\p{{Nd}}_])')) AS f FROM r LEFT JOIN el USING (doc_id) WHERE r.rank <= 5 AND r.score >= 0),
    pw AS (SELECT doc_id, claim_id, f, unnest({TOKENS.format(t='claim')}) AS w, generate_subscripts({TOKENS.format(t='claim')}, 1) AS i FROM pc),
    pv AS (SELECT doc_id, claim_id, arg_min(lower(w), (CASE WHEN regexp_matches(lower(w), '(ed|ing)$') THEN 0 ELSE 1 END, i)) AS verb FROM pw, stop WHERE length(w) >= 4 AND regexp_matches(lower(w), '{VERBS}') AND NOT list_contains(ws, lower(w)) AND lower(w) NOT IN ({listed(NON_VERBS)}) AND NOT list_contains(string_split(lower(array_to_string(f, ' ')), ' '), lower(w)) GROUP BY 1, 2),
    pn AS (SELECT doc_id, claim_id, string_agg(n, ' ' ORDER BY i) AS nums FROM (SELECT doc_id, claim_id, n, min(i) AS i FROM (SELECT doc_id, claim_id, unnest(regexp_extract_all(claim, '[0-9][0-9,.]*%?')) AS n, generate_subscripts(regexp_extract_all(claim, '[0-9][0-9,.]*%?'), 1) AS i FROM pc) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    pq AS (SELECT pc.*, concat_ws(' ', CASE WHEN len(f) > 0 THEN array_to_string(f, ' ') END, verb, nums) AS q FROM pc LEFT JOIN pv USING (doc_id, claim_id) LEFT JOIN pn USING (doc_id, claim_id)),
    lk AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS i FROM (SELECT * FROM ed WHERE len(string_split(name, ' ')) IN (2, 3) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY spot) = 1)),
    plan AS (SELECT doc_id, 0 AS part, 1 AS spot, 0 AS sub, 'q_exist_1' AS query_id, 'existence' AS kind, NULL AS claim_id, '"' || h || '"' AS query_text, 'exist_exact' AS template_id, 1 AS attempt FROM head WHERE h <> ''
        UNION ALL SELECT doc_id, 0, 2, 0, 'q_exist_2', 'existence', NULL, h, 'exist_loose', 2 FROM head WHERE h <> '' UNION ALL SELECT doc_id, 0, 3, 0, 'q_exist_3', 'existence', NULL, keys, 'exist_keyword', 3 FROM hk
        UNION ALL SELECT doc_id, 1, rank, 0, 'q_claim_' || claim_id, 'claim', claim_id, CASE WHEN q = '' THEN trim(left(claim, 200)) ELSE q END, 'claim_event', 1 FROM pq UNION ALL SELECT doc_id, 1, rank, 1, 'q_fc_' || claim_id, 'factcheck', claim_id, trim(left(claim, 200)), 'factcheck', 1 FROM pq
        UNION ALL SELECT doc_id, 2, i, 0, 'q_entity_' || i, 'entity', NULL, name, 'entity_lookup', 1 FROM lk)"""

ORACLE_SQL = {
    "pages_vs_newsrooms_per_claim": f"{components(CLAIM_NODES, True)} SELECT item_id AS claim, count(doc) AS document_count, count(DISTINCT source) AS independent_source_count, count(doc) - count(DISTINCT source) AS republished FROM benchmark LEFT JOIN found ON run = item_id GROUP BY 1",
    "old_vs_new_counts": f"{components(CLAIM_NODES, True)} SELECT run AS claim, count(*) AS pages, count(DISTINCT publisher_id) AS old, count(DISTINCT source) AS new, count(DISTINCT publisher_id) - count(DISTINCT source) AS delta, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM found JOIN h USING (doc) GROUP BY 1",
    "independent_sources": f"{components(ALL_NODES, True)} SELECT doc, source, reason FROM found",
    "incremental_independence": f"{components(ALL_NODES, True)} SELECT doc, source, reason FROM found",
    "publisher_dedupe": f"""WITH RECURSIVE {PAIRS}, cls AS (SELECT doc, rep FROM dk), near AS (SELECT a, b FROM pairs WHERE jaccard >= 0.9 - 1e-12 UNION SELECT b, a FROM pairs WHERE jaccard >= 0.9 - 1e-12 UNION SELECT rep, rep FROM sets),
        p AS (SELECT doc_id AS doc, source, row_number() OVER (ORDER BY CASE WHEN trim(left(split_part(coalesce(text, ''), chr(10), 1), 120)) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(lang, '')) <> '' THEN 1 ELSE 0 END DESC, 'https://' || source || '.example.com/' || doc_id, doc_id) AS i FROM documents),
        before AS (SELECT q.i, list(p.i ORDER BY p.i) AS l FROM near JOIN cls u ON u.rep = near.a JOIN cls v ON v.rep = near.b JOIN p ON p.doc = u.doc JOIN p q ON q.doc = v.doc AND q.source = p.source AND p.i < q.i GROUP BY 1),
        walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, 0::BIGINT AS leader UNION ALL
            SELECT w.i + 1, CASE WHEN list_has_any(kept, coalesce(l, [])) THEN kept ELSE list_append(kept, w.i + 1) END, coalesce(list_min(list_intersect(kept, coalesce(l, []))), w.i + 1)
            FROM walk w LEFT JOIN before ON before.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM documents))
        SELECT p.doc, k.doc AS kept_doc FROM walk JOIN p ON p.i = walk.i JOIN p k ON k.i = leader""",
    "passage_search": f"WITH {CARRIED} SELECT claim, doc FROM carried",
    "exact_url_dedupe": f"WITH c AS (SELECT {CANONICAL} AS canonical, page_id, url, (trim(url) <> '')::INT + (trim(html) <> '')::INT AS completeness FROM pages) SELECT canonical, page_id, completeness FROM c QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY completeness DESC, url, page_id) = 1",
    "publisher_identity": f"SELECT page_id, {DOMAIN} AS domain, {DOMAIN} AS publisher FROM pages",
    "source_bands": f"WITH p AS (SELECT {DOMAIN} AS domain FROM pages), f AS (SELECT domain, {FAMILY} AS family FROM p) SELECT CASE WHEN contains(domain, 'google.com') OR domain IN ({listed(AGGREGATORS)}) THEN 'aggregator' WHEN family IN ({listed(LEGACY)}) THEN 'known_legacy' ELSE 'unknown' END AS band, count(*) AS pages, count(DISTINCT family) AS families FROM f GROUP BY 1",
    "fetch_taxonomy": f"""WITH s AS (SELECT page_id, html, CASE page_id % 17 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 418 WHEN 5 THEN NULL ELSE 200 END AS http_status, length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))) AS body, len(regexp_extract_all(html, '(?i)<script\\b')) AS scripts FROM pages),
        r AS (SELECT page_id, http_status, body, CASE WHEN page_id % 17 = 5 THEN ['error_timeout', 'error_tls', 'error_dns', 'error_other'][page_id % 4 + 1] WHEN http_status = 403 THEN 'error_blocked' WHEN http_status = 404 THEN 'error_not_found' WHEN http_status = 503 THEN 'error_server' WHEN http_status = 418 THEN 'error_other' WHEN strlen(html) > 5000000 THEN 'error_too_large'
            WHEN page_id % 19 = 1 THEN 'error_unsupported_type' WHEN body >= 80 THEN 'ok' WHEN {" OR ".join(f"contains(lower(html), '{m}')" for m in PAYWALL_MARKERS)} THEN 'empty_paywall' WHEN scripts >= 8 OR (scripts >= 5 AND length(html) > 1500) THEN 'empty_js_required' ELSE 'empty_not_article' END AS fetch_reason FROM s)
        SELECT page_id, http_status, body AS extracted_char_count, fetch_reason, CASE WHEN fetch_reason = 'ok' THEN 'ok' WHEN starts_with(fetch_reason, 'empty_') THEN 'empty' ELSE 'error' END AS fetch_status FROM r""",
    "html_title": r"""SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')), 240) AS title FROM pages""",
    "shingle_jaccard_pairs": f"WITH {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "shingle_classes": f"WITH {CLASSES} SELECT doc, rep FROM dk",
    "body_hash_reprint_groups": f"WITH {HITS} SELECT body_hash, count(*) AS documents, count(DISTINCT publisher_id) AS publishers, min(doc) AS first_doc FROM h WHERE body_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT publisher_id) > 1",
    "same_owner_groups": f"SELECT coalesce({OWNER.format(p='source')}, source) AS owner, count(*) AS documents, count(DISTINCT source) AS publishers FROM documents GROUP BY 1",
    "capability_gate": f"WITH {GATE} SELECT claim, adapter, status, checks_skipped FROM gate",
    "adapter_rollup": """WITH e AS (SELECT user_id AS run_id, event_type AS adapter, CAST(floor(value) AS BIGINT) % 5 + 1 AS r, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), g AS (SELECT run_id, adapter, CAST(sum(k) AS BIGINT) AS hits, count(*) AS queries_run, ['ok', 'empty', 'error', 'skipped_no_key', 'skipped_out_of_range'][min(r)] AS status, array_to_string(list_sort(list(DISTINCT 'k' || (k % 3))), ',') AS checks_skipped FROM e GROUP BY 1, 2)
        SELECT *, CASE WHEN starts_with(status, 'skipped') THEN 'skipped' ELSE status END AS tool_status FROM g""",
    "coverage_report": f"WITH {GATE}, ran AS (SELECT * FROM gate WHERE status = 'run'), l AS (SELECT claim, unnest(coalesce(langs, ['any'])) AS lang FROM ran), ls AS (SELECT claim, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages_covered FROM l GROUP BY 1) SELECT claim, any_value(languages_covered) AS languages_covered, CASE WHEN bool_and(max_age IS NOT NULL) THEN strftime(DATE '2026-09-16' - CAST(max(max_age) AS INT), '%Y-%m-%d') END AS earliest_reachable_date, count(*) AS adapters_run FROM ran JOIN ls USING (claim) GROUP BY 1",
    "existence_ladder": f"WITH {LADDER} SELECT claim, outcome, strength, attempts_run, hits FROM ladder",
    "existence_class": f"WITH {LADDER} SELECT claim, CASE WHEN claim % 3 = 0 AND hits > 0 AND strength = 'exact' AND EXISTS (SELECT 1 FROM carried c WHERE c.claim = ladder.claim AND len(regexp_extract_all(lower(left(string_split(c.text, chr(10))[1], 120)), '[a-z0-9]+')) > 0 AND c.doc = (SELECT max(doc) FROM carried m WHERE m.claim = ladder.claim)) THEN 'title_match' WHEN strength IN ('exact', 'loose') THEN 'title_match' ELSE 'not_found' END AS existence FROM ladder",
    "heuristic_claims": f'WITH {sentence_ctes("s")} SELECT doc_id, claim_id, claim, start, "end" FROM s',
    "claim_grounding": f"WITH {sentence_ctes('s')} SELECT doc_id, count(*) FILTER (contains(d.text, quote)) AS exact, count(*) FILTER (NOT contains(d.text, quote || '~~')) AS ungrounded, min(instr(d.text, quote) - 1) AS first_start FROM s JOIN documents d USING (doc_id) GROUP BY 1",
    "heuristic_entities": r"WITH e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS entity FROM documents) SELECT doc_id, entity, count(*) AS mentions FROM e GROUP BY 1, 2",
    "claim_selection": f"WITH {SELECTION} SELECT doc_id, claim_id, score, rank, rank <= 5 AND score >= 0 AS selected FROM r",
    "entity_disagreements": r"""WITH a AS (SELECT DISTINCT doc_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]{3,}$')))) AS e FROM documents), b AS (SELECT DISTINCT doc_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 8))) AS e FROM documents),
        o AS (SELECT doc_id, 'a' AS side FROM a ANTI JOIN b USING (doc_id, e) UNION ALL SELECT doc_id, 'b' FROM b ANTI JOIN a USING (doc_id, e)) SELECT doc_id, count(*) FILTER (side = 'a') AS only_a, count(*) FILTER (side = 'b') AS only_b FROM o GROUP BY 1""",
    "query_plan": rf"""WITH {SELECTION}, {PLAN} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, spot, sub) - 1 AS pos, query_id, kind, claim_id, query_text, template_id, attempt, CASE WHEN kind IN ('existence', 'claim') AND day <> '' THEN day END AS date_from, CASE WHEN kind IN ('existence', 'claim') AND day <> '' THEN day END AS date_to FROM plan JOIN head USING (doc_id)""",
    "two_pass_reconcile": f"WITH {MERGED} SELECT doc_id, count(*) AS claims, count(*) FILTER (agreement = 'both') AS agreed, round_even(count(*) FILTER (agreement = 'both') / count(*), 4) AS agreement_rate FROM merged GROUP BY 1",
    "merged_claims": f'WITH {MERGED} SELECT doc_id, claim_id, text, kind, start, "end", agreement, agreement_note, variants FROM merged',
    "entity_merge": """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents), la AS (SELECT doc_id, list_filter(l, lambda x: regexp_matches(x, '^[A-Z][a-z]{3,}$')) AS l FROM w), lb AS (SELECT doc_id, list_filter(l, lambda x: length(x) >= 8) AS l FROM w),
        u AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos, 'a' AS who FROM la UNION ALL SELECT doc_id, unnest(l), generate_subscripts(l, 1), 'b' FROM lb), g AS (SELECT doc_id, lower(t) AS entity, CASE WHEN count(DISTINCT who) = 2 THEN 'both' ELSE min(who) END AS source, min((who, pos)) AS o FROM u GROUP BY 1, 2)
        SELECT doc_id, entity, source FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) <= 30""",
    "vector_topk": """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(r.v, r.v)), 6) AS cosine FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank, cosine FROM s QUALIFY rank <= 5""",
    "stance_window": f"WITH {WINDOW} SELECT claim, doc, source_id, score FROM win",
    "lexical_stance": f"WITH {STANCE} SELECT claim, doc, label, score FROM st",
    "claim_fusion": f"WITH {FUSED} SELECT claim, nli_support, nli_contradict, llm_support, llm_contradict, support, contradict, agreement, state FROM fused",
    "overall_state": f"WITH {FUSED} SELECT run_id, CASE WHEN bool_and(state = 'not_assessed') THEN 'not_assessed' WHEN bool_or(state = 'contested_reporting') THEN 'contested_reporting' WHEN bool_or(agreement = 'contested') THEN 'contested' WHEN bool_or(state = 'corroborated_coverage') THEN 'corroborated_coverage' WHEN bool_or(state = 'event_corroborated') THEN 'event_corroborated' WHEN bool_or(state = 'single_source') THEN 'single_source' ELSE 'no_corroboration_found' END AS state FROM fused GROUP BY 1",
    "support_rate": f"""WITH {FUSED}, n AS (SELECT run_id, count(*) AS claims, count(*) FILTER (state <> 'not_assessed') AS s, count(*) FILTER (state IN ('corroborated_coverage', 'event_corroborated')) AS b, count(*) FILTER (state IN ('contested', 'contested_reporting')) AS c, CASE WHEN run_id = 6 THEN 'out_of_range' WHEN count(*) FILTER (state <> 'not_assessed') = 0 THEN 'not_assessed' END AS why FROM fused GROUP BY 1)
        SELECT run_id, CASE WHEN why IS NULL THEN s ELSE 0 END AS scored, CASE WHEN why IS NULL THEN b ELSE 0 END AS backed, CASE WHEN why IS NULL THEN c ELSE 0 END AS contested, claims - CASE WHEN why IS NULL THEN s ELSE 0 END AS unassessed, CASE WHEN why IS NULL THEN CAST(round_even(100.0 * b / s, 0) AS INT) END AS support_pct, why AS omitted_because FROM n""",
    "analyst_stances": f"""WITH {STANCE.replace("st AS (SELECT claim, doc, source,", "st AS (SELECT claim, doc, source, source_id,").replace("sw AS (SELECT claim, doc, source,", "sw AS (SELECT claim, doc, source, source_id,")}, lab AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
        SELECT claim % 7 AS run_id, 'c' || claim AS claim_id, source_id, CASE WHEN claim % 7 = 6 THEN NULL WHEN q = 1 THEN 'supports' WHEN q = 0 THEN 'refutes' ELSE 'unrelated' END AS analyst_stance FROM st LEFT JOIN lab ON doc_id = doc""",
    "analyst_intake": f"""WITH {STANCE}, c AS (SELECT claim % 7 AS run_id, count(DISTINCT claim) AS n FROM st GROUP BY 1)
        SELECT run_id, CASE WHEN run_id = 6 THEN 0 ELSE n END AS rows, CASE WHEN run_id = 6 THEN 0 ELSE n END AS dropped, CASE WHEN run_id = 6 THEN 0 ELSE n END AS participating, CASE WHEN run_id = 6 THEN 1 ELSE 0 END AS rejects FROM c""",
    "source_join_misses": f"""WITH {DESKS} SELECT run AS run_id, count(*) AS documents, count(DISTINCT CASE WHEN reason = 'same_owner' THEN 'page ' || doc ELSE 'source ' || source END) AS sources, count(*) FILTER (reason = 'same_owner') AS misses FROM found GROUP BY 1""",
    "stream_live_state": f"""WITH {EVENTS}, l AS (SELECT run_id, max_by(layer, (ts, event_id)) AS layer, max_by(status, (ts, event_id)) AS status, count(*) AS n_events, count(*) FILTER (status = 'error') AS errors, max(ts) AS ts FROM ev GROUP BY 1),
        q AS (SELECT *, status = 'running' AND ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR AS stale FROM l) SELECT run_id, layer, CASE WHEN stale THEN 'error' ELSE status END AS status, n_events, errors, stale FROM q""",
    "claim_source_matrix": f"WITH {STANCE}, v AS (SELECT claim, source, CASE label WHEN 'entailment' THEN score WHEN 'contradiction' THEN -score ELSE 0.0 END AS x FROM st) SELECT claim, " + ", ".join(f"coalesce(max_by(x, abs(x)) FILTER (source = '{s}'), 0.0) AS {s}" for s in SOURCES) + " FROM v GROUP BY 1",
    "trace_runs": f"WITH {EVENTS}, f AS (SELECT *, CASE WHEN lag(layer) OVER w IS NOT DISTINCT FROM layer AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)), i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS island FROM f) SELECT run_id, island, layer, count(*) AS n, max_by(status, (ts, event_id)) AS last_status, count(DISTINCT detail) AS details FROM i GROUP BY 1, 2, 3",
    "layer_status": f"WITH {EVENTS}, g AS (SELECT run_id, layer, max_by(status, (ts, event_id)) FILTER (status <> 'running') AS last, min((ts, event_id)) FILTER (status = 'error') AS e, max((ts, event_id)) FILTER (status IN ('ok', 'empty', 'skipped')) AS ok FROM ev GROUP BY 1, 2) SELECT run_id, layer, CASE WHEN e < ok AND last <> 'error' THEN 'degraded' ELSE coalesce(last, 'running') END AS status FROM g",
    "run_history_sink": f"""WITH {EVENTS.replace("AS detail FROM", "AS detail, props FROM")} SELECT CAST(run_id AS VARCHAR) AS run_id, min(ts) AS created_at, max(ts) AS updated_at, max_by(layer, (ts, event_id)) AS phase, max_by(status, (ts, event_id)) AS status, CAST(count(*) FILTER (status = 'ok') AS INT) AS completed_layer, max_by(props, (ts, event_id)) AS envelope FROM ev GROUP BY 1""",
    "live_run_state": f"WITH {EVENTS} SELECT run_id, max_by(layer, (ts, event_id)) AS layer, max_by(status, (ts, event_id)) AS status, count(*) AS n_events, count(*) FILTER (status = 'error') AS errors FROM ev GROUP BY 1",
    "run_history": "WITH l AS (SELECT user_id AS run_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1) SELECT run_id, last_event, row_number() OVER (ORDER BY ts DESC, last_event DESC) AS place FROM l",
    "message_sequence": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations",
    "stream_page_dedupe": f"SELECT DISTINCT {CANONICAL} AS grouping_url FROM pages",
    "stream_trace_tail": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
}


OUTLETS = "list_sort(list(DISTINCT publisher_id))"
EVIDENCE = "CASE reason WHEN 'none' THEN 'independent' ELSE reason END || ': ' || array_to_string(outlets[1:6], ', ') || CASE WHEN len(outlets) > 6 THEN ' and ' || (len(outlets) - 6) || ' more' ELSE '' END"
SUMMED = f"summed AS (SELECT run, source, reason, count(*) AS members, {OUTLETS} AS outlets FROM found JOIN h USING (doc) GROUP BY ALL)"
BY_DESK = f"SELECT claim % 7 AS run_id, sum(independent_source_count) AS newsrooms, sum(republished) AS republished FROM ({ORACLE_SQL['pages_vs_newsrooms_per_claim']}) GROUP BY 1"

ORACLE_SQL |= {
    "merge_evidence": f"{components(ALL_NODES, True)}, {SUMMED} SELECT source, reason, members, {EVIDENCE} AS evidence FROM summed",
    "risk_rules": f"""SELECT o.run_id, o.state, CASE WHEN o.state IN ('corroborated_coverage', 'event_corroborated') THEN 'verified' WHEN o.state IN ('contested', 'contested_reporting', 'single_source', 'not_assessed') THEN 'needs_investigation' ELSE 'unverifiable' END AS recommendation,
            CASE WHEN o.state IN ('corroborated_coverage', 'event_corroborated') THEN 'low' WHEN o.state = 'single_source' THEN 'moderate' WHEN o.state = 'not_assessed' THEN 'unknown' ELSE 'high' END AS risk,
            concat_ws(',', CASE WHEN o.run_id = 6 THEN 'search_never_ran' END, CASE WHEN o.run_id <> 6 AND o.run_id % 2 = 1 THEN 'article_not_found_elsewhere' END, CASE WHEN unassessed > 0 THEN 'claims_not_assessed' END, CASE WHEN support_pct IS NULL THEN 'no_support_rate' END,
                CASE WHEN newsrooms <= 1 THEN 'at_most_one_newsroom' END, CASE WHEN republished > 0 THEN 'pages_republish_each_other' END, CASE WHEN contested > 0 THEN 'claims_contested' END, 'contradiction_not_detectable') AS unknowns
        FROM ({ORACLE_SQL['overall_state']}) o LEFT JOIN ({BY_DESK}) c ON c.run_id = o.run_id LEFT JOIN ({ORACLE_SQL['support_rate']}) r ON r.run_id = o.run_id""",
    "verification_record": f"""SELECT p.claim, p.document_count || ' pages, ' || p.independent_source_count || ' independent sources' AS evidence_summary, coalesce(listed, '') AS source_assessment, coalesce(n, 0) AS citations,
            CASE WHEN support_pct IS NULL THEN 'No support rate: ' || coalesce(omitted_because, 'no_claims') ELSE support_pct || '% of ' || scored || ' scored claims are backed by independent reporting' END AS support_sentence
        FROM ({ORACLE_SQL['pages_vs_newsrooms_per_claim']}) p LEFT JOIN ({ORACLE_SQL['support_rate']}) r ON r.run_id = p.claim % 7
        LEFT JOIN ({components(CLAIM_NODES, True)}, {SUMMED}, e AS (SELECT run, source, {EVIDENCE} AS evidence, members FROM summed), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY source) AS i FROM e)
            SELECT run, count(*) AS n, string_agg(evidence || ' (' || members || ')', '; ' ORDER BY i) FILTER (i <= 8) AS listed FROM k GROUP BY 1) l ON l.run = p.claim""",
}

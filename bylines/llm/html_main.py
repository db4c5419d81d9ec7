"""Main text of web pages as the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.scratch import written

TRAIN_PAGES = 3_000  # bound of the pages that weights are learnt from
HTML_BYTES = 100_000  # pages above this length do not teach

# Element names of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "select", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE = {"nav", "aside", "footer", "header", "form", "button", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"article", "aside", "blockquote", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
LEARNT = (INLINE | VOID | ASIDE | ENDS_P | SCOPES | set(CLOSES) | {"caption", "details", "figcaption", "summary", "tbody", "thead", "tfoot", "address"}) - MAIN  # tags that get weights of their own
# Words in the names (class, id, role) that pages give to parts beside the article ...
BESIDE = set("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus discussion footer gdpr header menu masthead modal nav navbar navigation newsletter notice notices pagination popup promo promos promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar trending widget widgets".split())
# ... words that may stand with them in a name, ...
NEUTRAL = set("area article articles aside bar block body bottom box button buttons card center class col column container content cta entry form global group head icon icons id inner item items left link links list main media more outer page panel post posts primary reader right row secondary section site slot stories story strip text thread title top user unit wrap wrapper".split())
# ... names of readers' words, which may outweigh a short article, and of the article itself, whose header is its own.
READERS = {"comment", "comments", "disqus", "discussion", "replies", "reply", "respond"}
OWN = {"article", "content", "entry", "main", "post", "story"}
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in RAW}


def beside_name(value: str) -> str | None:
    """The word in a class, id or role that sets a part beside the article, if every other word of that name is a neutral one."""
    for name in value.split():
        parts = [p.lower().rstrip("0123456789") for p in _PARTS.split(name)]
        parts = [p for p in parts if p]
        told = [p for p in parts if p in BESIDE]
        if told and all(p in BESIDE or p in NEUTRAL for p in parts) and not ({"header", "masthead", "notice"} >= set(told) and OWN & set(parts)):
            return next((p for p in told if p in READERS), told[0])
    return None


def parse(page: str) -> list[tuple[str, str, int, bool, int]]:
    """Tokens in page order: (text, feature, block, aside, main).

    A tag has text "", a piece of text its own; the feature is the tag's name or "word", "link word".
    ``block`` counts stretches between block tags, ``aside`` holds within parts that element or
    class names set beside the article, ``main`` is the number of the enclosing article or main
    element, 0 outside. A name does not set beside what holds both over half of the page's words and
    a first heading, main or article element (of readers' words, no article). Unclosed and unopened
    tags are taken as browsers do, roughly, in time that grows with the page's length: open elements
    are counted, and looked up only if they are there.
    """
    out: list[tuple[str, str, int, int, int]] = []  # as returned, with the element in place of aside
    parents, marks, counts, heads = [0], [""], [0], [0]  # of elements: the one around, why it may stand beside, its words, 1 if it holds an article, 2 for a first heading or main element
    stack: list[tuple[str, int, int, bool]] = []  # open elements: name, element, main, in a link
    frames: list[tuple[str, dict[str, int]]] = [("", {})]  # open scopes, with the open elements in each by name
    scopes: dict[str, int] = {}
    endless: set[str] = set()
    block, mains, at, n = 0, 0, 0, len(page)

    def close_to(names: set[str]) -> None:
        """Close all up to the last open element of ``names``, which is there."""
        while True:
            name = stack.pop()[0]
            if name in SCOPES:
                frames.pop()
                scopes[name] -= 1
            else:
                frames[-1][1][name] -= 1
            if name in names:
                return

    def is_open(names: set[str]) -> bool:
        """Whether one of ``names`` is open, with no scope but table cells around it."""
        for scope, held in reversed(frames):
            if scope in names or any(held.get(x) for x in names):
                return True
            if scope not in ("td", "th"):
                return False
        return False

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        _, element, main, link = stack[-1] if stack else ("", 0, 0, False)
        if not name:
            if page[m.start()] != "<" or m[0] == "<":
                counts[element] += len(m[0].split())
                out.append((m[0], "link word" if link else "word", block, element, main))
            continue
        if name not in INLINE:
            block += name != "br"
            if name == "br" and not m[1]:
                out.append((" ", "word", block, element, main))
        if m[1]:
            if scopes.get(name) if name in SCOPES else frames[-1][1].get(name):
                close_to({name})
            out.append(("", "/" + name, block, element, main))
            continue
        if name in RAW and name != "head":
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "title", "textarea"):
                at = n
            else:
                endless.add(name)
            continue
        if name == "body":  # closes what stood open before it
            while stack and stack[-1][0] != "html":
                close_to({stack[-1][0]})
        if name in ENDS_P and frames[-1][1].get("p"):
            close_to({"p"})
        if name in CLOSES and is_open(CLOSES[name]):
            close_to(CLOSES[name])
        _, element, main, link = stack[-1] if stack else ("", 0, 0, False)
        if name in MAIN:
            if not (main and name == "article" and scopes.get("article")):
                mains += 1
                main = mains
        own = element
        if name not in VOID and not m[3].endswith("/"):
            own = len(parents)
            parents.append(element)
            counts.append(0)
            heads.append(2 if name in ("h1", "main") else int(name == "article"))
            marks.append("tag" if name in ASIDE else mark_of(name, m[3]) if m[3] else "")
            stack.append((name, own, main, link or name == "a"))
            if name in SCOPES:
                frames.append((name, {}))
                scopes[name] = scopes.get(name, 0) + 1
            else:
                frames[-1][1][name] = frames[-1][1].get(name, 0) + 1
        out.append(("", name, block, own, main))
    for e in range(len(parents) - 1, 0, -1):
        if marks[e] != "tag":
            counts[parents[e]] += counts[e]
            heads[parents[e]] = max(heads[parents[e]], heads[e])
    aside = [False]
    for e in range(1, len(parents)):
        void = counts[e] * 2 > counts[0] and marks[e] != "tag" and (heads[e] > (marks[e] in READERS))
        aside.append(aside[parents[e]] or (marks[e] != "" and not void))
    return [(text, feature, block, aside[element], main) for text, feature, block, element, main in out]


def mark_of(name: str, attributes: str) -> str:
    """"tag" for a hidden element, a word of BESIDE for one so named, or nothing."""
    for k in _NAMES.finditer(attributes):
        value, key = k[2] or k[3] or k[4] or "", k[1].lower()
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "tag"
        if key not in ("style", "itemprop") and name not in ("html", "body", *MAIN) and (told := beside_name(value)):
            return told
    return ""


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pages that label themselves, with exactly one article element: (feature, inside, outside) of words and tags."""
    counts: dict[str, list[int]] = {}
    for b in batches:
        for page in b.column(0).to_pylist():
            tokens = parse(page)
            if len({t[4] for t in tokens if not t[3]} - {0}) != 1:
                continue
            for text, feature, _, aside, main in tokens:
                if text or feature.lstrip("/") in LEARNT:
                    inside = main > 0 and not aside
                    counts.setdefault(feature, [0, 0])[0 if inside else 1] += len(text.split()) if feature.endswith("word") else 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["feature", "inside", "outside"])


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` pages, those with the smallest hash of their id, that mark their own article.

    A word weighs 1, in a link the less the more link words stand outside articles; a tag costs
    0.2 to 8, the more the greater its share outside. Tags seen seldom go towards a middle
    cost; tags never seen, and names that HTML does not know, have fixed ones.
    """
    fit = pages.where(F.col(html_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(html_col) <= HTML_BYTES))
    ids = written(fit.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(most).distinct())
    chosen = fit.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).select(F.col(html_col).alias("h"))
    counts = chosen.mapInArrow(feature_counts, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    rows = counts.collect()  # one row for each of LEARNT at most, and its end tag
    weights = {"word": 1.0}
    for r in rows:
        outside = (r.o + 2) / (r.i + r.o + 4)
        if r.feature == "link word":
            weights[r.feature] = 1 - 1.5 * outside
        elif r.feature != "word":
            weights[r.feature] = -(0.2 + 7.8 * outside**2)
    return weights


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """(first, past the last) index of the contiguous run with the largest sum, the earliest of equals; (0, 0) if none is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores.tolist()):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region, whole blocks, without parts set beside the article.

    If an article or main element holds most of the region's words, the region is that element:
    the scan then only chooses among elements, and pages without such marks rely on it alone.
    """
    if not page:
        return ""
    tokens = parse(page)
    sizes = [len(t[0].split()) for t in tokens]

    def token_score(token: tuple[str, str, int, bool, int], n: int) -> float:
        text, feature, _, aside, _ = token
        if aside:  # left out of the text anyway, so hardly a gap
            return -0.1
        if text:
            return n * weights.get(feature, 0.25)
        name = feature.lstrip("/")
        return 0.0 if name in MAIN else weights.get(feature, -0.2 if name in INLINE or name in VOID else -2.0)

    a, b = best_region(np.array([token_score(t, n) for t, n in zip(tokens, sizes, strict=True)]))
    if a == b:
        return ""
    inside: dict[int, int] = {}
    for t, n in zip(tokens[a:b], sizes[a:b], strict=True):
        inside[t[4]] = inside.get(t[4], 0) + (0 if t[3] else n)
    top = max(inside, key=lambda k: (inside[k], k))
    if top and inside[top] * 2 > sum(inside.values()):
        kept = [t for t in tokens if t[4] == top]
    else:
        first, last = tokens[a][2], tokens[b - 1][2]
        kept = [t for t in tokens if first <= t[2] <= last]
    blocks: dict[int, list[str]] = {}
    for text, _, block, aside, _ in kept:
        if text and not aside:
            blocks.setdefault(block, []).append(text)
    return " ".join(x for parts in blocks.values() if (x := " ".join(html.unescape("".join(parts)).split())))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``pages`` without their html and with ``text_col``: the article's text, empty for null, empty or wordless pages.

    Every page is read whole, in one task of its own row; repeated rows come out as they came in.
    A column that is named like ``text_col`` is replaced.
    """
    learnt = learn_weights(pages, id_col, html_col) if weights is None else weights
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*kept, F.col(html_col).alias("_html"))
    schema = rows.select(*kept).schema.add(text_col, "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, learnt) for h in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(apply, schema)

"""Secret scans with multipart credential linking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.texts import text_or_empty
from bylines.scratch import written

# (kind, pattern, group whose length counts, least length, and what else a match must hold). The
# first three are reported wherever they stand; the others are weak and need a complementary part
# nearby. No pattern looks ahead or back over more than a few characters, so a text costs time in
# proportion to its length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6, ()), ("access", r"AKIA[A-Z0-9]+", 0, 20, ()), ("hex", r"[0-9a-f]{24,}", 0, 24, ())]
WEAK = [
    ("endpoint", r"""\b[a-z][a-z0-9+]{0,30}://[^\s"'<>|]+""", 0, 8, ()),
    ("ident", r"""(?i)\b(user(?:name)?|login|account|(?:client|access|key)_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3, ()),
    ("value", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", 0, 16, ("[0-9]", "[A-Za-z]")),
]
KINDS = [k for k, *_ in BASE + WEAK]
ROLE = {"assign": "secret", "hex": "secret", "value": "secret", "access": "locator", "ident": "locator", "endpoint": "locator"}
SCOPE_CHARS = 300
CHUNK = 256  # items of a list that are walked between two copies of it
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used: an array's only element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def walk(items: Column, rest: Column, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """The spans that ``step`` gives out, an array for each item, while it carries ``rest`` along; ``last`` gives those at the end.

    ``aggregate`` copies what it carries at each item, so lists grow in chunks of CHUNK items, and a
    long one is copied once for each chunk.
    """
    empty = F.array().cast(SPAN)

    def one(a, x):
        carried, given = step(a["rest"], x)
        return F.struct(carried.alias("rest"), F.concat(a["out"], given).alias("out"))

    def chunk(items, acc, i):
        done = F.aggregate(F.slice(items, i * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["rest"].alias("rest"), empty.alias("out")), one)
        return _held(done, lambda d: F.struct(d["rest"].alias("rest"), F.concat(acc["out"], d["out"]).alias("out")))

    def whole(items):
        chunks = F.filter(F.sequence(F.lit(0), F.floor(F.size(items) / CHUNK).cast("int")), lambda i: i * CHUNK < F.size(items))
        end = lambda a: F.concat(a["out"], last(a["rest"])) if last else a["out"]
        return F.aggregate(chunks, F.struct(rest.alias("rest"), empty.alias("out")), lambda acc, i: chunk(items, acc, i), end)

    return _held(items, whole)


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int, holds: tuple[str, ...]) -> Column:
    """Leftmost matches without overlap as (start, kind, end) in code points; those that are too short or lack what they must hold are dropped after matching.

    A text splits into the pieces between its matches, so a match starts where the lengths of the
    pieces and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def length(gap, hit, value):
        fit = reduce(lambda c, h: c & hit.rlike(h), holds, F.char_length(value) >= least)
        return F.struct(F.char_length(gap).alias("gap"), F.coalesce(F.char_length(hit), F.lit(0)).alias("hit"), F.coalesce(fit, F.lit(False)).alias("fit"))

    parts = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), sized.alias("value")), lambda p: length(p["gap"], p["hit"], p["value"]))

    def step(at, p):
        start = at + p["gap"]
        end = start + p["hit"]
        return end, F.when(p["fit"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(pattern), walk(parts, F.lit(0).cast("int"), step)).otherwise(F.array().cast(SPAN))


def _apart(spans: Column, others: Column, kind: int) -> Column:
    """Those of ``spans``, all of ``kind`` and without overlap, that no span of ``others`` meets, by one pass in the order of starts.

    A span waits until the next one shows whether it is met; ``upto`` is the last end of ``others`` so far.
    """
    none = F.lit(None).cast("struct<start:int,kind:int,end:int>")

    def step(rest, x):
        mine, wait = x["kind"] == kind, rest["wait"]
        free = wait.isNotNull() & (mine | (x["start"] >= wait["end"]))
        carried = F.struct(F.when(mine, rest["upto"]).otherwise(F.greatest(rest["upto"], x["end"])).alias("upto"), F.when(mine & (x["start"] >= rest["upto"]), x).otherwise(none).alias("wait"))
        return carried, F.when(free, F.array(wait)).otherwise(F.array().cast(SPAN))

    begin = F.struct(F.lit(0).cast("int").alias("upto"), none.alias("wait"))
    left = walk(F.array_sort(F.concat(spans, others)), begin, step, lambda rest: F.when(rest["wait"].isNotNull(), F.array(rest["wait"])).otherwise(F.array().cast(SPAN)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), left).otherwise(spans)


def _role(kind: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == KINDS.index(k), F.lit(ROLE[k])), KINDS, F)


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """(id, key, base, linked) for every row, spans sorted by start, then kind, as indexes into KINDS.

    Base spans are assignments, access identifiers and hex runs. Weak parts are endpoints, labelled
    identifiers and random-looking values that overlap no base span and no weak span of a kind
    listed before. A weak secret is linked when an identifier or endpoint, and a weak identifier or
    endpoint when a secret, base or weak, stands at most ``scope_chars`` from it in the same text.

    Parts of the same role in one stretch of ``scope_chars`` are first reduced to their first start
    and last end, which decides nearness exactly, so a text full of parts meets no pairs. ``key``
    hashes the text: rows that repeat id and text have the same spans. A null text is empty.
    """
    t = text_or_empty(text_col)
    kinds = [spans_of(F.col("_t"), i, *spec) for i, (_, *spec) in enumerate(BASE + WEAK)]
    rows = df.select(F.col(id_col).alias("id"), t.alias("_t"))
    rows = rows.select("id", F.xxhash64("_t").alias("key"), F.array_sort(F.concat(*kinds[: len(BASE)])).alias("base"), *[k.alias(f"w{i}") for i, k in enumerate(kinds[len(BASE):])])
    taken, weak = F.col("base"), F.array().cast(SPAN)
    for i in range(len(WEAK)):
        rows = rows.withColumn(f"f{i}", _apart(F.col(f"w{i}"), taken, len(BASE) + i))
        weak, taken = F.concat(weak, F.col(f"f{i}")), F.concat(taken, F.col(f"f{i}"))
    rows = written(rows.select("id", "key", "base", weak.alias("weak")))

    roles = F.transform(F.concat("base", "weak"), lambda s: _role(s["kind"]))
    hopeful = rows.where(F.size("weak") > 0).where(F.array_contains(roles, "secret") & F.array_contains(roles, "locator"))
    parts = hopeful.distinct().select("id", "key", F.explode(F.concat(F.transform("base", lambda s: F.struct(s.alias("s"), F.lit(False).alias("weak"))), F.transform("weak", lambda s: F.struct(s.alias("s"), F.lit(True).alias("weak"))))).alias("p"))
    parts = written(parts.select("id", "key", "p.weak", "p.s.start", "p.s.kind", "p.s.end", _role(F.col("p.s.kind")).alias("role")))
    w = scope_chars
    bins = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor(F.col("end") / w))))
    held = bins.groupBy("id", "key", "role", "bin").agg(F.min(F.greatest(F.col("start"), F.col("bin") * w)).alias("lo"), F.max(F.least(F.col("end"), (F.col("bin") + 1) * w)).alias("hi"))
    asking = parts.where("weak").withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - w) / w), F.floor((F.col("end") + w) / w))))
    near = (
        asking["id"].eqNullSafe(held["id"]) & (asking["key"] == held["key"]) & (asking["bin"] == held["bin"]) & (asking["role"] != held["role"])
        & (held["lo"] - asking["end"] <= w) & (asking["start"] - held["hi"] <= w)
    )
    linked = asking.join(held.hint("merge"), near, "left_semi").groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))
    linked = written(linked)
    met = rows.join(linked, rows["id"].eqNullSafe(linked["id"]) & (rows["key"] == linked["key"]), "left")
    return met.select(rows["id"], rows["key"], "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap as one."""
    none = F.lit(None).cast("struct<start:int,kind:int,end:int>")

    def step(rest, x):
        wait = rest["wait"]
        meets = wait.isNotNull() & (x["start"] < wait["end"])
        grown = F.struct(wait["start"].alias("start"), wait["kind"].alias("kind"), F.greatest(wait["end"], x["end"]).alias("end"))
        return F.struct(F.when(meets, grown).otherwise(x).alias("wait")), F.when(~meets & wait.isNotNull(), F.array(wait)).otherwise(F.array().cast(SPAN))

    return walk(spans, F.struct(none.alias("wait")), step, lambda rest: F.when(rest["wait"].isNotNull(), F.array(rest["wait"])).otherwise(F.array().cast(SPAN)))


def _cut_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of each span; spans are sorted and apart. Pieces of the text are cut for each CHUNK of spans, so that a long text is not gone through for every span."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    firsts = F.filter(F.sequence(F.lit(0), F.floor(F.size(spans) / CHUNK).cast("int")), lambda c: c * CHUNK < F.size(spans))

    def piece(c):
        lo, some = before(c * CHUNK), F.slice(spans, c * CHUNK + 1, F.lit(CHUNK))
        return F.struct((c * CHUNK).alias("first"), lo.alias("lo"), some.alias("some"), F.substring(text, lo + 1, F.element_at(some, -1)["end"] - lo).alias("text"))

    def marked(p):
        part = lambda s, j: F.concat(F.substring(p["text"], before(p["first"] + j) - p["lo"] + 1, s["start"] - before(p["first"] + j)), F.lit(mark))
        return F.array_join(F.transform(p["some"], part), "")

    end = F.coalesce(F.element_at(spans, -1)["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(F.transform(firsts, piece), marked), ""), F.substring(text, end + 1, F.char_length(text)))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every base and linked span replaced by ``mark``; overlapping spans share one.

    Rows without spans stay as they are, null texts too; repeated rows stay, each redacted; other
    columns pass through, whatever their names. Only rows with spans meet the span table.
    """
    found = find_spans(df, id_col, text_col).where(F.size("base") + F.size("linked") > 0).dropDuplicates(["id", "key"])
    spans = written(found.select("id", "key", _merged(F.array_sort(F.concat("base", "linked"))).alias("spans")))
    names = df.columns
    held = df.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"))
    met = held.join(spans.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    text = F.col("row")[text_col]
    new = F.when(F.col("spans").isNull(), text).otherwise(_cut_out(F.coalesce(text, F.lit("")), F.col("spans"), mark))
    return met.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])

"""Personal data by base patterns and bootstrapped contexts, with DataFrame functions only.

Base spans are regular matches that pass a check (parts, digits, Luhn).  They seed the
bootstrap: the words around a seed form lexical patterns; each pattern is scored on the
pattern-instance graph by the share of known instances among all it takes; patterns of
high confidence label further identifier-like tokens, which count as known in the next round.

Scale: spans are found row by row inside the JVM, texts are never shuffled.  Only tokens
with a digit or an "@" and their neighbours leave the rows; edges (pattern, instance) are made
distinct before they are counted, so that a pattern with a third of all rows is combined
before its shuffle.

Defined results: a null text is empty.  Repeated rows are judged by their texts alike; the
spans of new identifiers join back by id and text.  A new span never overlaps a base span.
Identifiers have LEAST_LENGTH characters at least and no NUL; neighbours are whole words that end
within CONTEXT characters of the span.  An instance that is known as several kinds counts as the
first of them as listed; a new one takes the kind with the largest sum of weights, the first
as listed among equals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import stored

KINDS = ("email", "ip", "card", "phone")
# The patterns as stated, with possessive repetitions and guards so that no text takes
# more than linear time or deep recursion; a guard only skips starts that cannot match.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A row without a match of this has no span of the kind.
LIKELY = {"email": "@", "ip": PATTERNS["ip"], "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
BLANK = r"\x20\x09-\x0D"
#: Identifier-like tokens: a digit or an "@", at a token's start.
TOKEN = rf"(?<![^{BLANK}])[^{BLANK}]*[0-9@][^{BLANK}]*"
#: Characters of an identifier at least; shorter ones are mostly plain numbers.
LEAST_LENGTH = 6
#: Characters before and after a span in which its neighbours are sought.
CONTEXT, MASK = 200, "\x00"
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SHARE = 3, 0.8, 0.5
SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: inside a function of array items it would be evaluated for each item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, state: Column, step, kind: str) -> Column:
    """An array of what step(state, item) -> (state, made) makes of each item in order; kind is the SQL type of made.

    Items go in groups of about the root of their number: an array in a fold is copied whenever
    it grows, which for n items in one fold would take the square of n.
    """

    def grouped(all_: Column, group: Column) -> Column:
        count = F.greatest(F.ceil(F.size(all_) / group).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(all_, (k - 1) * group + 1, group))

    def add(s: Column, x: Column) -> Column:
        after, made = step(s["state"], x)
        return F.struct(after.alias("state"), F.concat(s["out"], F.array(made).cast(f"array<{kind}>")).alias("out"))

    def add_group(whole: Column, some: Column) -> Column:
        start = F.struct(whole["state"].alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(some, start, add, lambda s: F.struct(s["state"].alias("state"), F.concat(whole["out"], F.array(s["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    size = lambda all_: F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
    groups = _let(items, lambda all_: _let(size(all_), lambda group: grouped(all_, group)))
    return F.aggregate(groups, start, add_group, lambda s: F.flatten(s["out"]))


def _matches(text: Column, pattern: str) -> Column:
    """start, end (code points) and text of all matches, from the lengths of what lies between them."""

    def pairs(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("size"), b.alias("text")))

    steps = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["skip"] + x["size"]
        return end, F.struct((at + x["skip"]).alias("start"), end.alias("end"), x["text"].alias("text"))

    return _scan(steps, F.lit(0), step, "struct<start:int,end:int,text:string>")


PIECE = 1000


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters: a substring of the whole would be sought from its start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start ... end - 1 of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.greatest(F.ceil(end / PIECE).cast("int") - first, F.lit(0)))
    return F.substring(F.array_join(some, ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def _replaced(pieces: Column, length: Column, spans: Column, mark) -> Column:
    """The text with mark(at, span) for each span in order of starts; at is the end of those before it."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.concat(_part(pieces, at, F.greatest(at, s["start"])), mark(at, s))

    made = _scan(spans, F.lit(0), step, "string")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.array_join(made, ""), _let(F.coalesce(last, F.lit(0)), lambda at: _part(pieces, at, length)))


def _luhn(digits: Column) -> Column:
    """Doubles every second digit from the right; 5 to 9 become the odd 1 to 9 when doubled."""
    places = F.split(F.reverse(digits), "")
    values = F.transform(places, lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _passes(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return text.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start and then kind, as structs (start, kind, end, text)."""
    text, none = F.coalesce(text, F.lit("")), F.expr(f"cast(array() as {SPAN})")
    def of(i: int, kind: str) -> Column:
        good = F.filter(_matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["text"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["text"].alias("text")))
        likely = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(LIKELY[kind])
        return F.when(likely, spans.cast(SPAN)).otherwise(none)

    each = [of(i, kind) for i, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def instances(docs: DataFrame) -> DataFrame:
    """Base spans and other identifier-like tokens with their neighbours: doc_id, key, start, end, kind (null: unknown), instance, patterns."""
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")).select("doc_id", _key().alias("key"), "text", base_spans(F.col("text")).alias("base"), _pieces(F.col("text")).alias("pieces"))
    # Base spans are masked, so that a token which overlaps one is told by its mask.
    masked = F.when(F.size("base") > 0, _replaced(F.col("pieces"), F.length("text"), F.col("base"), lambda at, s: F.repeat(F.lit(MASK), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))).otherwise(F.col("text"))
    token = F.filter(_let(masked, lambda m: _matches(m, TOKEN)), lambda t: (F.length(t["text"]) >= LEAST_LENGTH) & ~F.contains(t["text"], F.lit(MASK)))
    other = F.transform(token, lambda t: F.struct(t["start"].alias("start"), F.lit(None).cast("int").alias("kind"), t["end"].alias("end"), t["text"].alias("text")))

    def around(s: Column, pieces: Column, size: Column) -> Column:
        before = _part(pieces, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
        after = _part(pieces, s["end"], F.least(s["end"] + CONTEXT, size))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"), before.alias("before"), after.alias("after"), (s["start"] <= CONTEXT).alias("first"), (s["end"] + CONTEXT >= size).alias("last"))

    found = lambda pieces, size: F.transform(F.concat("base", other.cast(SPAN)), lambda s: around(s, pieces, size))
    each = _let(F.col("pieces"), lambda pieces: _let(F.length("text"), lambda size: found(pieces, size)))
    spans = rows.select("doc_id", "key", F.explode(each).alias("s")).select("doc_id", "key", "s.*")
    # A word that the edge of the context may have cut is no word: one must have a blank or the text's end on either side.
    before = F.when(F.col("first"), F.concat(F.lit(" "), "before")).otherwise(F.col("before"))
    after = F.when(F.col("last"), F.concat("after", F.lit(" "))).otherwise(F.col("after"))
    word = F.lower(F.regexp_extract(before, rf"[{BLANK}]([^{BLANK}]+)[{BLANK}]*\z", 1))
    two = F.lower(F.regexp_extract(before, rf"[{BLANK}]([^{BLANK}]+[{BLANK}]+[^{BLANK}]+)[{BLANK}]*\z", 1))
    following = F.lower(F.regexp_extract(after, rf"\A[^{BLANK}]*[{BLANK}]+([^{BLANK}]+)[{BLANK}]", 1))
    # A pattern is two words before, or one before and one after; words with digits are no words.
    plain = F.array(F.when(two != "", F.concat(F.lit("2:"), two)), F.when((word != "") & (following != ""), F.concat_ws("\n", F.lit("1:"), word, following)))
    lexical = F.filter(F.array_compact(plain), lambda p: ~F.substring(p, F.lit(3), F.length(p)).rlike("[0-9@]"))
    return spans.select("doc_id", "key", "start", "end", "kind", F.lower("text").alias("instance"), lexical.alias("patterns"))


def discover(docs: DataFrame, least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE, least_share: float = LEAST_SHARE, hide: Column | None = None) -> DataFrame:
    """New spans (doc_id, key, start, end, kind) that patterns of high confidence take.

    A pattern speaks for a kind if at least least_seeds different known instances of the kind
    stand in it, and they are at least least_confidence of its different known instances and
    at least least_share of all its different instances; an unknown instance takes the kind with the largest sum of
    confidence over its patterns, and needs a digit run like an identifier's or an "@".  Rounds
    end when one finds no new instance; each but the last adds some, so they are finite.  Instances for which `hide`
    holds are not seeds, as if the base patterns had not found them.
    """
    spans = instances(docs)
    if hide is not None:
        spans = spans.withColumn("kind", F.when(~hide, F.col("kind")))
    all_spans = stored(spans, "instances")
    edges = stored(all_spans.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    known = all_spans.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    fit = F.col("instance").rlike(r"@|[0-9].*[0-9].*[0-9].*[0-9]")
    while True:
        seen = edges.join(known, "instance", "left").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        each = seen.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("known"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("top"))
        good = each.where((F.col("top.n") >= least_seeds) & (F.col("top.n") >= least_confidence * F.col("known")) & (F.col("top.n") >= least_share * F.col("n")))
        good = good.select("pattern", F.col("top.kind").alias("says"), (F.col("top.n") / F.col("known") * F.log2(1 + F.col("top.n"))).alias("weight"))
        votes = edges.join(good, "pattern").where(fit).groupBy("instance", "says").agg(F.sum("weight").alias("weight"))
        new = votes.groupBy("instance").agg(F.max(F.struct("weight", (-F.col("says")).alias("order"), "says")).alias("v")).select("instance", F.col("v.says").alias("kind"))
        new = new.join(known, "instance", "left_anti")
        new = stored(new, "new")
        if new.isEmpty():
            break
        known = stored(known.unionByName(new), "known")
    unknown = all_spans.where("kind is null").drop("kind", "patterns")
    return unknown.join(known, "instance").select("doc_id", "key", "start", "end", "kind")


def recall(docs: DataFrame, one_in: int = 3, **settings) -> DataFrame:
    """What the bootstrap finds again of instances that it is not told: hidden, found, right (of the right kind), and others, unknown to the base patterns.

    Every one_in-th known instance, by hash, is hidden from the seeds.  One row.
    """
    hidden = F.pmod(F.xxhash64("instance", F.lit(17)), F.lit(one_in)) == 0
    base = instances(docs)
    known = base.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("truth"))
    found = discover(docs, hide=hidden, **settings).join(base.select("doc_id", "key", "start", "end", "instance"), ["doc_id", "key", "start", "end"])
    found = found.groupBy("instance").agg(F.min("kind").alias("said"))
    both = known.where(hidden).join(found, "instance", "full_outer")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    told = F.col("truth").isNotNull()
    return both.agg(count(told, "hidden"), count(told & F.col("said").isNotNull(), "found"), count(F.col("truth") == F.col("said"), "right"), count(~told, "others"))


def _with_spans(docs: DataFrame, columns: list[str], settings: dict) -> DataFrame:
    """row (the columns of docs that are asked for), base and every: its base spans, and these with the new ones."""
    one = F.struct("start", "kind", "end", F.lit("").alias("text"))
    new = discover(docs, **settings).distinct().groupBy("doc_id", "key").agg(F.collect_list(one).cast(SPAN).alias("new"))
    new = new.select(F.col("doc_id").alias("new_id"), F.col("key").alias("new_key"), "new")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").alias("id"), _key().alias("key"), base_spans(F.col("text")).alias("base"))
    both = own.join(new, (F.col("key") == F.col("new_key")) & F.col("id").eqNullSafe(F.col("new_id")), "left")
    return both.select("row", "base", F.array_sort(F.concat("base", F.coalesce("new", F.expr(f"cast(array() as {SPAN})")))).alias("every"))


def find(docs: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of base spans), spans (all spans)."""
    out = _with_spans(docs, ["doc_id"], settings)
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("row.doc_id", *count, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("every")).alias("spans"))


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span replaced by [KIND]; spans that overlap become one mark, of the first. n_chars follows."""
    rows = _with_spans(docs, docs.columns, settings)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, changed = F.col("row.text"), F.size("every") > 0
    new = _let(_pieces(text), lambda pieces: _replaced(pieces, F.length(text), F.col("every"), lambda at, s: F.when(s["start"] >= at, F.element_at(marks, s["kind"] + 1)).otherwise("")))
    rows = rows.select("row", changed.alias("changed"), F.when(changed, new).otherwise(text).alias("new"))
    made = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select([made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans by the patterns as stated; for tests."""
    import re

    stated = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )

    def good(kind: int, m: str) -> bool:
        digits = [int(c) for c in m if c.isdigit()]
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            total = reduce(lambda a, x: a + (x[1] if x[0] % 2 == 0 else sum(divmod(2 * x[1], 10))), enumerate(digits[::-1]), 0)
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(stated) for m in re.finditer(p, text or "") if good(k, m[0]))

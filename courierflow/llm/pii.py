"""Personal data by patterns and bootstrapped contextual extraction.

Base spans: e-mail addresses, IP addresses, payment cards and phone numbers by
their written form.  The regular expressions here match what the plain forms
match but never retry inside a run of characters that has already failed, so
time stays linear in the text.

Bootstrapping: every identifier-like token (with a digit or an at sign) is an
instance; the one and the two words before it and after it are its patterns, and
the pairs are the edges of a bipartite graph.  The start and the end of a line
count as a word, words with a digit or an at sign make no pattern.  Valid base entities are the seeds, with confidence 1.  In
each round a pattern's score per kind is the share of confidence among its
occurrences, and an instance's confidence is the noisy-or over its patterns.
Patterns with enough distinct supporting instances and a high score then
label their other instances: unseen identifiers that only their context gives
away.  Those spans are added under the kind of their best pattern unless they
overlap a base span.

DataFrame and SQL functions only.  The text is scanned once into a narrow table
(spans, edges) in the shared folder; rounds work on aggregated edges, keys are
reduced map-side before they are joined, and hot patterns are ordinary
equi-join keys that AQE can split.

Defined cases: null text is empty and has no spans; positions count code
points; rows alike in doc_id and text get the same spans; null doc_id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import text_of, written

KINDS = ["email", "ip", "card", "phone"]

#: Fixed forms of the contract; possessive and anchored at the start of a run.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character that every match of the form holds: other texts are not scanned.
MARKS = {"email": "@", "ip": ".", "phone": "+"}

#: Identifier-like stretches: a phone or card as a whole, else a token with a digit or an at sign.
INSTANCE = r"\+[0-9][ ().0-9-]{6,24}[0-9]|(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){15,18}(?![0-9A-Za-z])|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Characters tried first for the words beside an instance; the whole stretch where they do not hold them.
NEAR_CHARS = 96
#: A longer word stands in a pattern by its MD5.
WORD_CHARS = 48
#: The end of a line as a word, and what a pattern of the right side begins with.
LINE, RIGHT = "\u0001", "\u0002"

RUN = 256
ROUNDS = 3
MIN_SCORE = 0.8
MIN_SUPPORT = 3

_SPAN = "array<struct<s:int,e:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _located(text: Column, form: str) -> Column:
    """All matches as (s, e, m): start and end in code points and match.

    Lengths are summed in runs of RUN matches and over the runs, so that no array grows by one
    element at a time for a whole text."""
    row = "array<struct<s:int,e:int,m:string>>"
    pairs = F.filter(F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)),
                                lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m"))), lambda x: x.m.isNotNull())

    def run(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(row).alias("out")), lambda a, x: F.struct(
            (a.at + x.p + F.length(x.m)).alias("at"),
            F.concat(a.out, F.array(F.struct((a.at + x.p).alias("s"), (a.at + x.p + F.length(x.m)).alias("e"), x.m.alias("m")))).alias("out")))

    def every(ps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / RUN).cast("int")), lambda i: run(F.slice(ps, i * RUN + 1, F.lit(RUN))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{row}>>").alias("runs"))
        laid = F.aggregate(runs, start, lambda a, r: F.struct(
            (a.at + r.at).alias("at"), F.concat(a.runs, F.array(F.struct(a.at.alias("at"), r.out.alias("out")))).alias("runs")), lambda a: a.runs)
        moved = F.flatten(F.transform(laid, lambda r: F.transform(r.out, lambda x: F.struct((x.s + r.at).alias("s"), (x.e + r.at).alias("e"), x.m.alias("m")))))
        return F.when(F.size(ps) > 0, moved).otherwise(F.array().cast(row))

    return _bound(pairs, every)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    back = F.reverse(_digits(m))
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(back)), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, "[.]"), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(False)
    return F.length(_digits(m)).between(8, 15)


def _base_spans(text: Column, kind: str) -> Column:
    found = F.transform(F.filter(_located(text, FORMS[kind]), lambda x: _valid(kind, x.m)), lambda x: F.struct(x.s.alias("s"), x.e.alias("e")))
    may = F.contains(text, F.lit(MARKS[kind])) if kind in MARKS else text.rlike("[0-9]")
    return F.when(may, found).otherwise(F.array().cast(_SPAN))


def _kind_of(m: Column) -> Column:
    """The kind of which the whole instance is a valid entity, else null."""
    whole = lambda kind, form: m.rlike(f"^(?:{form})$") & _valid(kind, m)
    trimmed = {k: FORMS[k].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "") for k in KINDS}
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(whole(kind, trimmed[kind]), F.lit(kind)).otherwise(out)
    return out


def _beside(text: Column, last: bool) -> Column:
    """Words and line marks of ``text``, at least the last (or first) two if there are as many."""
    split = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), "[\r\n]++", f" {LINE} "), r"\s+", -1), lambda w: w != "")
    near = F.right(text, F.lit(NEAR_CHARS)) if last else F.left(text, F.lit(NEAR_CHARS))
    return F.transform(F.array(split(near)), lambda w: F.when(F.size(w) > 2, w).otherwise(split(text)))[0]  # of three words two are whole


def _shape(word: Column) -> Column:
    """The word as it stands in a pattern; null for none and for one with a digit or an at sign."""
    return F.when(~word.rlike("[0-9@]"), F.when(F.length(word) > WORD_CHARS, F.concat(F.lit("~"), F.md5(word.cast("binary")))).otherwise(word))


def _contexts(text: Column) -> Column:
    """(s, e, instance, patterns) of each identifier-like token; the patterns (null for none)
    are two words before it, one before, one after, two after.

    Between two instances lies no other digit or at sign that begins a token, so a word of
    an earlier or later instance makes no pattern: a zero stands for it."""
    form = "array<struct<s:int,e:int,instance:string,patterns:array<string>>>"
    bare = lambda m: F.regexp_replace(m, r"^[^0-9A-Za-z+]+|[^0-9A-Za-z]+$", "")
    skip = lambda m: F.length(m) - F.length(F.regexp_replace(m, r"^[^0-9A-Za-z+]+", ""))
    ends = lambda stretches: F.transform(stretches, lambda p, i: F.struct(
        _beside(F.concat(F.when(i == 0, F.lit("\n")).otherwise(F.lit("0")), p), True).alias("left"),
        _beside(F.concat(p, F.when(i == F.size(stretches) - 1, F.lit("\n")).otherwise(F.lit("0"))), False).alias("right")))
    words = F.transform(_bound(F.split(text, INSTANCE, -1), ends), lambda x: F.struct(
        _shape(F.try_element_at(x.left, F.lit(-2))).alias("l2"), _shape(F.try_element_at(x.left, F.lit(-1))).alias("l1"),
        _shape(F.try_element_at(x.right, F.lit(1))).alias("r1"), _shape(F.try_element_at(x.right, F.lit(2))).alias("r2")))
    named = F.transform(words, lambda x: F.struct(
        F.array(F.concat(x.l2, F.lit(" "), x.l1), x.l1).alias("left"),
        F.array(F.concat(F.lit(f"{RIGHT} "), x.r1), F.concat(F.lit(f"{RIGHT} "), x.r1, F.lit(" "), x.r2)).alias("right")))
    patterns = _bound(named, lambda n: F.zip_with(n, F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: F.concat(a.left, b.right)))
    real = F.transform(patterns, lambda ps: F.transform(ps, lambda p: F.when(p.rlike(f"[^ {LINE}{RIGHT}]"), p)))  # marks alone are none
    found = F.zip_with(_located(text, INSTANCE), real, lambda x, ps: F.struct(
        (x.s + skip(x.m)).alias("s"), (x.s + skip(x.m) + F.length(bare(x.m))).alias("e"), F.lower(bare(x.m)).alias("instance"), ps.alias("patterns")))
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda x: F.length(x.instance) >= 5).cast(form)).otherwise(F.array().cast(form))


def _edges(contexts: str, which: range) -> Column:
    """(s, e, instance, pattern) by the patterns at these places."""
    at = lambda n: F.transform(contexts, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.instance.alias("instance"), x.patterns[n].alias("pattern")))
    return F.filter(F.concat(*[at(n) for n in which]), lambda x: x.pattern.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, key (hash of the text), base spans by kind, edges (two words before) and sides (the other patterns)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    found = text.select("doc_id", F.xxhash64("t").alias("key"), *[_base_spans(F.col("t"), k).alias(k) for k in KINDS], _contexts(F.col("t")).alias("contexts"))
    return found.select("doc_id", "key", *KINDS, _edges("contexts", range(1)).alias("edges"), _edges("contexts", range(1, 4)).alias("sides"))


def contextual_patterns(edges: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """High-confidence patterns: kind, pattern, score, support.  ``edges`` has instance and pattern per occurrence."""
    graph = written(edges.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", _kind_of(F.col("instance"))), "pii-graph")
    totals = graph.groupBy("pattern").agg(F.sum("n").alias("all"), F.count("seed").alias("seeds"))
    # a pattern that meets too few instances can never be accepted
    totals = written(totals.join(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("distinct")), "pattern").where(F.col("distinct") >= min_support), "pii-totals")
    graph = written(graph.join(totals.select("pattern"), "pattern", "left_semi"), "pii-core")
    seeds = graph.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("trust")).distinct()
    trust = seeds
    for turn in range(max(1, rounds)):
        scored = (graph.join(trust, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("trust")).alias("hit"), F.sum("trust").alias("support"))
                  .join(totals.select("pattern", "all"), "pattern").select("kind", "pattern", (F.col("hit") / F.col("all")).alias("score"), "support"))
        scored = written(scored, "pii-patterns")
        if turn + 1 == rounds:
            break
        strong = scored.where((F.col("support") >= min_support) & (F.col("score") >= min_score / 2))
        unseen = (graph.where("seed IS NULL").join(strong, "pattern").groupBy("instance", "kind")
                  .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(0.01), 1 - F.col("score")))))).alias("trust")))
        trust = written(seeds.unionByName(unseen.select("instance", "kind", "trust")), "pii-trust")
    return scored.where((F.col("support") >= min_support) & (F.col("score") >= min_score))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Per document: doc_id, base spans per kind (arrays of s, e) and ``added``: (kind, s, e) found by context."""
    work = written(scan(docs), "pii-scan")
    edges = work.select("doc_id", "key", F.explode(F.concat("edges", "sides")).alias("x")).select("doc_id", "key", "x.*")
    patterns = contextual_patterns(edges, rounds, min_score, min_support).select("pattern", "kind", F.round("score", 9).alias("score"))
    seen = _kind_of(F.col("instance")).isNotNull()
    hits = (edges.where(~seen).join(patterns, "pattern").groupBy("doc_id", "key", "s", "e").agg(F.max(F.struct("score", "kind")).alias("best"))
            .select("doc_id", "key", F.struct("best.kind", "s", "e").alias("x")))
    added = hits.groupBy(F.col("doc_id").alias("a_id"), F.col("key").alias("a_key")).agg(F.collect_set("x").alias("added"))
    joined = work.drop("edges", "sides").join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("key") == F.col("a_key")), "left")
    base = F.concat(*KINDS)
    free = F.filter("added", lambda x: ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e)))
    return joined.select("doc_id", *KINDS, F.coalesce(free, F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("added"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans of :func:`find_personal_data`."""
    named = lambda kind, spans: F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x.s.cast("string"), x.e.cast("string")))
    pair = lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))
    added = lambda kind: F.transform(F.filter("added", lambda x: x.kind == kind), pair)
    every = [F.array_sort(F.concat(F.col(k), added(k))) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[named(k, F.col(k)) for k in KINDS]), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*[named(k, s) for k, s in zip(KINDS, every)]), ",").alias("spans"))

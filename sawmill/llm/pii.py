"""Personal data: base patterns plus bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from four fixed patterns. They are the seeds: the words to their left induce
lexical patterns (one and two words). Spark scores the graph of patterns and instances: a pattern
is as good as the share of its instances that are known, damped for rarely seen ones; an instance
is as good as the patterns that find it. Instances that are believed join the known ones, induce
patterns of their own, and the graph is scored again, for a few rounds. Patterns of high confidence
add identifiers that no base pattern matches. The graph holds identifier-like instances only (with
a digit or an @; groups of digits that follow with one space between belong to them), aggregated
before each shuffle.

The base patterns are written with possessive quantifiers and look-behinds, which match the same
spans as the plain forms but take linear time on texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like instances: from one white space to the next, with a digit or an @, and on over groups of digits.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(0-9][0-9()./-]*+(?!\S))*+"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"

#: Rounds, least pattern score, least distinct known instances behind a pattern, least belief of a new known instance.
ROUNDS, MIN_SCORE, MIN_SEEDS, BELIEF = 3, 0.6, 3, 0.75
#: Matches of a text whose places are added up together, and code points of a piece of a long text.
RUN, PIECE = 256, 2048


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost and non-overlapping, with places in code points (end exclusive).

    The gaps between matches come from a split by the same pattern, so lengths add up to places.
    They add up within runs of RUN matches, and over the runs' sums: growing one array by every
    match would copy it as often.
    """
    ints, spans = F.array().cast("array<int>"), F.array().cast(_SPAN)

    def length(x):
        return x["g"] + F.length(x["h"])

    def place(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["h"].alias("value")))).alias("out"))

    def within(run, first):
        return F.aggregate(run, F.struct(first.alias("at"), spans.alias("out")), place, lambda acc: acc["out"])

    def over(runs):
        sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + length(x)))
        firsts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), ints.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, firsts, within))

    def cut(pairs):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda r: F.slice(pairs, r * RUN + 1, RUN))

    def paired(hits):
        gaps = F.split(text, pattern, -1)
        return F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(hits, lambda h: F.when(F.size(h) == 0, spans).otherwise(_let(_let(paired(h), cut), over)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def step(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), step) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, by kind as listed and then start. Null text has none."""
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    email = F.when(text.contains("@"), located(text, PATTERNS["email"], 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(located(text, PATTERNS["ip"], 1), lambda s: s["value"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(none)
    card = F.when(text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), F.filter(located(text, PATTERNS["card"], 2), lambda s: _luhn(s["value"]))).otherwise(none)
    phone = F.when(text.rlike(r"\+[0-9]"), F.filter(located(text, PATTERNS["phone"], 3), lambda s: F.length(_digits(s["value"])).between(8, 15))).otherwise(none)
    return F.when(digit | text.contains("@"), F.concat(email, ip, card, phone)).otherwise(none)


def _pieces(text: Column) -> Column:
    """The text as pieces of PIECE code points: a place is found in its piece, not by a walk over all that stands before."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def _context(pieces: Column, start: Column) -> Column:
    """Up to two words before a place, lower case, punctuation and all.

    Patterns are lexical, so words of more than 30 characters are no part of one, nor is what
    stands more than 80 characters before the place.
    """
    n = F.floor(start / PIECE).cast("int")
    near = F.concat(F.coalesce(F.get(pieces, n - 1), F.lit("")), F.coalesce(F.get(pieces, n), F.lit("")))
    at = start - F.greatest(n - 1, F.lit(0)) * PIECE
    left = F.lower(F.substring(near, F.greatest(F.lit(1), at - 79), F.least(at, F.lit(80))))
    return F.regexp_extract(left, r"(\S{1,30}\s+\S{1,30}|\S{1,30})\s*$", 1)


def _apart(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span. The spans of a kind are sorted and disjoint, so the last that starts before a token's end decides."""

    def of_kind(x, kind):
        def halve(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            below = F.get(kind, mid - 1)["start"] < x["end"]
            go = acc["lo"] < acc["hi"]
            return F.struct(F.when(go & below, mid).otherwise(acc["lo"]).alias("lo"), F.when(go & ~below, mid - 1).otherwise(acc["hi"]).alias("hi"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(kind) + 2)).cast("int"))
        last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(kind).alias("hi")), halve, lambda acc: acc["lo"])
        return F.coalesce(F.get(kind, last - 1)["end"] > x["start"], F.lit(False))

    def searched(kinds):
        return F.filter(tokens, lambda x: ~F.exists(kinds, lambda kind: of_kind(x, kind)))

    by_kind = F.transform(F.array(*map(F.lit, range(len(KINDS)))), lambda k: F.filter(base, lambda s: s["kind"] == k))
    few = F.filter(tokens, lambda x: ~F.exists(base, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    return F.when(F.size(base) <= 32, few).otherwise(_let(by_kind, searched))


def _key(doc_id, text) -> dict[str, Column]:
    """What names a row: its id (0 for null) and 64 bits of id and text."""
    return {"id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "row": F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))}


def _marked(docs: DataFrame) -> DataFrame:
    """Slim rows with texts gone: doc_id, id and row (see _key), base spans, identifier instances in context."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(_key("doc_id", "text")).withColumn("base", base_spans(F.col("text")))
    t = F.col("text")
    tokens = F.when(t.rlike("[0-9@]"), F.filter(located(t, TOKEN, -1), lambda x: F.length(x["value"]) >= 5)).otherwise(F.array().cast(_SPAN))
    seeds = lambda ps: F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), _context(ps, s["start"]).alias("left"), F.lower(s["value"]).alias("value"), s["start"].alias("start"), s["end"].alias("end")))
    others = lambda ps: F.transform(_apart(F.col("tokens"), F.col("base")), lambda x: F.struct(_context(ps, x["start"]).alias("left"), _trimmed(x["value"]).alias("value"), x["start"].alias("start"), (x["start"] + F.length(_trimmed(x["value"]))).alias("end")))
    both = _let(_pieces(t), lambda ps: F.struct(seeds(ps).alias("seeds"), others(ps).alias("others")))
    return rows.withColumn("tokens", tokens).withColumn("both", F.when((F.size("base") > 0) | (F.size("tokens") > 0), both)).select("doc_id", "id", "row", "base", "both.seeds", "both.others")


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"[.,;:!?)\]}\"']++$", "")


def _patterns(left: Column) -> Column:
    """The lexical patterns of a context: its last word, and its last two."""
    words = F.split(F.regexp_replace(left, r"\s+", " "), " ")
    last = F.element_at(words, -1)
    both = F.when(F.size(words) >= 2, F.array(last, F.concat_ws(" ", words))).otherwise(F.array(last))
    return F.filter(both, lambda p: p != "")


def score_patterns(marked: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, belief: float = BELIEF) -> DataFrame:
    """Scored patterns (pattern, kind, score, seeds) of the pattern-instance graph after ``rounds`` rounds.

    ``seeds`` are a pattern's distinct known instances of the kind: those of the base patterns, and
    from the second round those of the others whose belief reached ``belief`` (each other instance
    is of the kind it is most believed to be). Instances count by their values, not by how often
    they occur.
    """
    seeds = marked.select(F.explode("seeds").alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.explode(_patterns(F.col("s.left"))).alias("pattern"))
    others = marked.select(F.explode("others").alias("s")).select(F.lower("s.value").alias("value"), F.explode(_patterns(F.col("s.left"))).alias("pattern"))
    known = common.written(seeds.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")).drop("n"), "pii-seeds")
    unknown = common.written(others.groupBy("pattern", "value").agg(F.count("*").alias("n")).drop("n"), "pii-others")
    base = known.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    sizes = known.groupBy("pattern").agg(F.count("*").alias("n")).union(unknown.groupBy("pattern").agg(F.count("*").alias("n")))
    sizes = common.written(sizes.groupBy("pattern").agg(F.sum("n").alias("instances")), "pii-sizes")
    accepted, scored = None, None
    for r in range(max(1, rounds)):
        counts = base
        if accepted is not None:
            more = unknown.join(accepted, "value").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
            counts = base.union(more).groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"))
        # Patterns with too few known instances can't score now; they may in a later round.
        rated = counts.where(F.col("seeds") >= min_seeds).join(sizes, "pattern")
        score = F.col("seeds") / F.col("instances") * (1 - 1 / (1 + F.log2(1 + F.col("seeds"))))
        scored = common.written(rated.select("pattern", "kind", score.alias("score"), "seeds"), "pii-scores")
        if r + 1 < rounds:
            beliefs = unknown.join(scored, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("belief"))
            beliefs = beliefs.where(F.col("belief") >= belief)
            best = beliefs.groupBy("value").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
            accepted = common.written(best, "pii-accepted")
    return scored


def discovered(marked: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Spans that patterns of high confidence add: (id, row, added: spans by kind and start), one row for each text that has some."""
    good = score_patterns(marked).where(F.col("score") >= min_score)
    best = good.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "seeds", -F.col("kind"))).alias("kind"))
    at = marked.select("id", "row", F.explode("others").alias("s")).select("id", "row", "s.start", "s.end", F.col("s.value").alias("value"), F.explode(_patterns(F.col("s.left"))).alias("pattern"))
    return (
        at.where("value <> ''")
        .join(best, "pattern")
        .groupBy("id", "row")
        .agg(F.sort_array(F.collect_set(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end", "value"))).alias("added"))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, base (spans), spans (all).

    Null and empty texts have no spans. Rows of one id with different texts are told apart by a
    hash of both; repeated rows get the same spans. Null ids stay null; other columns are ignored.
    """
    marked = common.written(_marked(docs), "pii-marked")
    added = discovered(marked)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.sort_array(F.array_union(F.col("base"), F.coalesce(F.col("added"), F.array().cast(_SPAN))))
    return marked.join(added, ["id", "row"], "left").select("doc_id", *[count(k) for k in range(4)], F.col("base"), every.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """Text with spans replaced by <KIND>; of overlapping spans the first decides, and its end grows to cover them."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(ps, ordered):
        def one(p, n):
            first = n * PIECE
            held = F.array_max(F.transform(F.filter(ordered, lambda s: s["start"] < first), lambda s: s["end"]))
            mine = F.filter(ordered, lambda s: (s["start"] >= first) & (s["start"] < first + PIECE))
            cut = lambda a, b: F.substring(p, a - first + 1, F.greatest(F.lit(0), b - a))

            def step(acc, s):
                fresh = s["start"] >= acc["at"]
                new = F.array(F.concat(cut(acc["at"], s["start"]), F.element_at(names, s["kind"] + 1)))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

            zero = F.struct(F.greatest(first, F.coalesce(held, first)).alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(mine, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], first + F.length(p))))

        return F.array_join(F.transform(ps, one), "")

    return _let(by_start, lambda ordered: _let(_pieces(text), lambda ps: piece(ps, ordered)))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced by <EMAIL>, <IP>, <CARD>, <PHONE>; null texts stay null.

    The base patterns run again beside the text: that costs less than shuffling the texts to their spans.
    """
    marked = common.written(_marked(docs), "pii-marked")
    id_, row, more = (common.fresh(docs, c) for c in ("pii_id", "pii_row", "pii_added"))
    added = common.written(discovered(marked).toDF(id_, row, more), "pii-added")
    keyed = docs.withColumns(dict(zip((id_, row), _key("doc_id", "text").values())))
    text = F.col("text").cast("string")
    spans = F.concat(base_spans(text), F.coalesce(F.col(more), F.array().cast(_SPAN)))
    out = _let(spans, lambda x: F.when(F.size(x) > 0, _redacted(text, x)).otherwise(text))
    return common.join_texts(keyed, added, [id_, row], F.size(more) * 60, "left").withColumn("text", out).select(*docs.columns)

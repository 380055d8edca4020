"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns propose more spans of
the same kinds. Labelers vote yes, no or nothing on every span: the strict pattern, a form
check (checksum, number range, number of digits), a gazetteer (address endings, card issuers),
words before the span that name its kind, and neighbours that speak against it. Votes are
counted per kind and vote pattern over all documents (at most 3^5 patterns a kind), and
expectation-maximisation on those counts estimates how often each labeler is right. The
posteriors are soft labels for the final classifier, a naive Bayes model of the span's shape,
length, neighbours, form check and naming words. A proposed span is added if the classifier finds it more likely than not
and it overlaps no base span.

All of it is SQL expressions. The spans of a text are found and judged in its own row; text is
never shuffled, and what is gathered over documents is counts of bounded tables.

Offsets count code points, ends are exclusive. Null text counts as empty: no spans, the digest
of nothing. Repeated rows are judged one by one and count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.quality import bind
from cohortspark.llm.scratch import stored

KINDS = ("email", "ip", "card", "phone")
# A run of address characters or digits is tried once, at its start or behind the last match,
# which finds the same leftmost matches without trying each of its places.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs of digits have no 13
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}"
             r"(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
             r"(?![0-9A-Za-z])",
}
# cheap tests that any match passes
HINTS = {
    ("email", True): lambda t: t.contains("@"),
    ("email", False): lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("ip", False): lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("card", True): lambda t: t.rlike(BASE["card"]),
    ("card", False): lambda t: t.rlike(BASE["card"]),
    ("phone", True): lambda t: t.contains("+"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
# Gazetteers and context words.
ENDINGS = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
ISSUERS = r"^(4|5[1-5]|34|37|6011|65|2[2-7])"
PRIVATE_NETS = r"^(10|127|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."
WORDS_BEFORE = {
    "email": r"(?i)(e-?mail|mail|contact|write|address)\W*\w*\W*$",
    "ip": r"(?i)\b(ip|host|server|addr\w*|from)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|payment)\W*\w*\W*$",
    "phone": r"(?i)(phone|tel|mobile|cell|call|fax|contact)\W*\w*\W*$",
}
WORDS_AGAINST = r"(?i)(version|isbn|issn|order|invoice|id|ref|no|nr|#|[$€£])\W*$"
NO, NOTHING, YES = 0, 1, 2
LABELERS = 5
ROUNDS = 20
PSEUDO = 20.0  # weight of the first guess at a labeler's reliability
BUCKETS = 256
BLOCK = 256
CONTEXT = 32


def prefix_sums(lengths: Column) -> Column:
    """Sum of all earlier elements, per element; blocks keep the copying small."""
    def within(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(block, start, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
            lambda s: s["all"])

    def of(ls: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / BLOCK).cast("int")),
                             lambda b: F.slice(ls, b * BLOCK + 1, F.lit(BLOCK)))
        total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)
        return bind(blocks, lambda bs: bind(
            within(F.transform(bs, total), F.lit(0).cast("long")),
            lambda firsts: F.flatten(F.zip_with(bs, firsts, within))))

    return bind(lengths, lambda ls: F.when(F.size(ls) > 0, of(ls)).otherwise(
        F.array().cast("array<bigint>")))


def found(text: Column, kind: str, base: bool) -> Column:
    """Matches of one pattern: kind (by place in KINDS), base, start, end, value."""
    pattern = F.lit((BASE if base else LOOSE)[kind])

    def placed(values: Column) -> Column:
        gaps = F.split(text, (BASE if base else LOOSE)[kind], -1)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(
            F.length(g).cast("long").alias("gap"), F.length(v).cast("long").alias("own"),
            v.alias("value")))
        return bind(pairs, lambda ps: F.zip_with(
            ps, prefix_sums(F.transform(ps, lambda p: p["gap"] + p["own"])),
            lambda p, at: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"),
                (at + p["gap"]).alias("start"), (at + p["gap"] + p["own"]).alias("end"),
                p["value"].alias("value"))))

    every = bind(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
    good = F.filter(every, lambda m: valid(kind, m["value"]) == F.lit(base)
                    if kind == "card" else (valid(kind, m["value"]) if base else F.lit(True)))
    none = F.array().cast("array<struct<kind:int,base:boolean,start:bigint,end:bigint,value:string>>")
    return F.when(HINTS[kind, base](text), good).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The form check of base spans."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: bind(
            F.regexp_replace(p, "^0+", ""),
            lambda n: (F.length(n) < 4) & (F.coalesce(F.substring(n, 1, 3).try_cast("int"),
                                                      F.lit(0)) <= 255)))
    if kind == "card":
        return bind(digits_of(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d))
                    .otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def vote(yes: Column, no: Column | None = None) -> Column:
    choice = F.when(F.coalesce(yes, F.lit(False)), F.lit(YES))
    if no is not None:
        choice = choice.when(F.coalesce(no, F.lit(False)), F.lit(NO))
    return choice.otherwise(F.lit(NOTHING))


def votes(m: Column, before: Column, after: Column) -> Column:
    """The labelers' votes on a match, in the order given in the module's text."""
    digits, kind = digits_of(m["value"]), m["kind"]
    by_kind = lambda **c: F.coalesce(*(
        F.when(kind == KINDS.index(k), v) for k, v in c.items()), F.lit(False))
    form = by_kind(email=m["value"].rlike(ENDINGS), ip=m["base"], card=m["base"],
                   phone=F.length(digits).between(10, 13))
    listed = by_kind(email=m["value"].rlike(ENDINGS), ip=~m["value"].rlike(PRIVATE_NETS),
                     card=digits.rlike(ISSUERS), phone=m["value"].rlike(r"^(\+|\()"))
    named = by_kind(**{k: before.rlike(w) for k, w in WORDS_BEFORE.items()})
    against = (before.rlike(WORDS_AGAINST) | before.rlike(r"[A-Za-z0-9_/=.-]$")
               | after.rlike(r"^[A-Za-z0-9_/=%]"))
    return F.array(vote(m["base"]), vote(form, ~form), vote(listed), vote(named),
                   vote(F.lit(False), against))


def features(m: Column, before: Column, after: Column, given: Column) -> Column:
    """Keys of the classifier: shape, length, neighbours, form check and naming word, in buckets."""
    shape = F.regexp_replace(F.regexp_replace(m["value"], "[0-9]+", "9"), r"[A-Za-z]+", "a")
    neighbour = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), r"\p{L}", "a")
    values = [shape, F.least(F.length(m["value"]), F.lit(60)).cast("string"),
              neighbour(F.substring(before, -1, 1)), neighbour(F.substring(after, 1, 1)),
              F.get(given, 1).cast("string"), F.get(given, 3).cast("string")]
    return F.array(*((m["kind"] * len(values) + i) * BUCKETS + F.pmod(F.xxhash64(v), F.lit(BUCKETS))
                     for i, v in enumerate(values)))


def candidates(text: Column) -> Column:
    """All spans of a text with votes and features; proposed ones that touch base ones are left out."""
    base = F.concat(*(found(text, k, True) for k in KINDS))
    loose = F.concat(*(found(text, k, False) for k in KINDS))

    def judged(m: Column) -> Column:
        before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)).cast("int") + 1,
                             F.least(m["start"], F.lit(CONTEXT)).cast("int"))
        after = F.substring(text, m["end"].cast("int") + 1, F.lit(1))
        return bind(votes(m, before, after), lambda given: F.struct(
            m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            m["base"].alias("base"), given.alias("votes"),
            features(m, before, after, given).alias("features")))

    def together(bs: Column) -> Column:
        free = F.filter(loose, lambda m: ~F.exists(
            bs, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.transform(F.concat(bs, free), judged)

    return bind(base, together)


# Expectation-maximisation on the counted vote patterns of one kind. ``t`` holds, per labeler,
# vote and class (1: personal), the probability of the vote; ``prior`` that of the class.
_GUESS = "CASE (i DIV 2) % 3 WHEN 1 THEN 0.5D ELSE IF((i DIV 2) % 3 = (i % 2) * 2, 0.4D, 0.1D) END"
_LIKELY = ("aggregate(sequence(0, {last}), {start}, "
           "(a, l) -> a * s.t[(l * 3 + p.v[l]) * 2 + {cls}])")
EM = f"""
aggregate(sequence(1, {ROUNDS}),
  struct(0.5D AS prior, transform(sequence(0, {6 * LABELERS - 1}), i -> {_GUESS}) AS t),
  (s, round) -> aggregate(
    array(transform(patterns, p -> struct(p.v AS v, p.n AS n,
      {_LIKELY.format(last=LABELERS - 1, start='s.prior', cls=1)} AS l1,
      {_LIKELY.format(last=LABELERS - 1, start='(1 - s.prior)', cls=0)} AS l0))),
    s,
    (old, ps) -> aggregate(
      array(struct(
        aggregate(ps, 0D, (a, p) -> a + p.n * p.l1 / (p.l1 + p.l0)) AS n1,
        aggregate(ps, 0D, (a, p) -> a + p.n * p.l0 / (p.l1 + p.l0)) AS n0)),
      old,
      (same, c) -> struct(
        (c.n1 + {PSEUDO}) / (c.n1 + c.n0 + 2 * {PSEUDO}) AS prior,
        transform(sequence(0, {6 * LABELERS - 1}), i ->
          ({PSEUDO} * {_GUESS} + aggregate(ps, 0D, (a, p) -> a + IF(p.v[i DIV 6] = (i DIV 2) % 3,
             p.n * IF(i % 2 = 1, p.l1, p.l0) / (p.l1 + p.l0), 0D)))
          / ({PSEUDO} + IF(i % 2 = 1, c.n1, c.n0))) AS t))))
"""
POSTERIOR = f"""
{_LIKELY.format(last=LABELERS - 1, start='s.prior', cls=1)} /
({_LIKELY.format(last=LABELERS - 1, start='s.prior', cls=1)} +
 {_LIKELY.format(last=LABELERS - 1, start='(1 - s.prior)', cls=0)})
"""


def label_model(spans: DataFrame) -> DataFrame:
    """Reliabilities per kind (``s``) and the counted vote patterns; four rows at most."""
    counted = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    kinds = counted.groupBy("kind").agg(F.array_sort(F.collect_list(
        F.struct(F.col("votes").alias("v"), F.col("n").alias("n")))).alias("patterns"))
    return kinds.withColumn("s", F.expr(EM))


def train(spans: DataFrame) -> DataFrame:
    """The classifier as one row: log-odds of each feature bucket and of each kind."""
    soft = (label_model(spans).select("kind", F.explode("patterns").alias("p"), "s")
            .select("kind", F.col("p.v").alias("votes"), F.expr(POSTERIOR).alias("q")))
    counted = spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    weighted = counted.join(F.broadcast(soft), ["kind", "votes"])  # at most 4 x 3^5 rows
    classes = weighted.groupBy("kind").agg(F.sum(F.col("n") * F.col("q")).alias("n1"),
                                           F.sum(F.col("n") * (1 - F.col("q"))).alias("n0"))
    cells = weighted.select("kind", "q", "n", F.explode("features").alias("key")).groupBy(
        "kind", "key").agg(F.sum(F.col("n") * F.col("q")).alias("k1"),
                           F.sum(F.col("n") * (1 - F.col("q"))).alias("k0"))
    odds = cells.join(F.broadcast(classes), "kind").select(
        "key", F.log((F.col("k1") + 1) / (F.col("n1") + 2) / ((F.col("k0") + 1) / (F.col("n0") + 2)))
        .alias("odds"))
    prior = classes.select((-1 - F.col("kind")).cast("long").alias("key"),
                           F.log((F.col("n1") + 1) / (F.col("n0") + 1)).alias("odds"))
    return stored(odds.unionByName(prior).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "odds"))).alias("odds")), "pii-model")


def accepted(spans: Column, model: Column) -> Column:
    """Base spans and the proposed ones the classifier takes, by kind, then start."""
    def odds(key: Column) -> Column:
        return F.coalesce(F.try_element_at(model, key), F.lit(0.0))

    def takes(c: Column) -> Column:
        return F.aggregate(c["features"], odds((-1 - c["kind"]).cast("long")),
                           lambda a, k: a + odds(k)) > 0

    chosen = F.filter(spans, lambda c: c["base"] | takes(c))
    return F.array_sort(F.transform(chosen, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        c["base"].alias("base"))))


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", name(s), s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` and ``spans``: kind, start, end, base of every accepted span of each row."""
    held = stored(docs.select(*(keep or []), candidates(
        F.coalesce(F.col(text), F.lit(""))).alias("candidates")), "pii-spans")
    model = train(held.select(F.explode("candidates").alias("c")).select("c.*"))
    kept = [c for c in held.columns if c != "candidates"]
    return held.withColumn("__model", model.scalar()).select(
        *kept, accepted(F.col("candidates"), F.col("__model")).alias("spans"))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base spans.
    """
    rows = find_spans(docs, text, [F.col(key).alias("doc_key")])
    base = F.filter("spans", lambda s: s["base"])

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(F.col("doc_key").alias(key), *counts,
                       F.sha2(shown(base), 256).alias("base_sha256"),
                       shown(F.col("spans")).alias("spans"))


def merged(spans: Column) -> Column:
    """Spans by start, overlapping ones as one with the kind of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.slice(ordered, F.lit(1), F.lit(0))

    def grow(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"),
                          F.greatest(last["end"], s["end"]).alias("end"),
                          last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(ordered, none, grow)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets."""
    name = lambda s: F.get(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"])

    def pieces(ms: Column) -> Column:
        end = lambda i: F.coalesce(F.get(ms, i - 1)["end"], F.lit(0).cast("long"))
        cut = F.transform(ms, lambda s, i: F.concat(
            F.substring(text, end(F.greatest(i, F.lit(1))).cast("int") * (i > 0).cast("int") + 1,
                        (s["start"] - end(F.greatest(i, F.lit(1))) * (i > 0).cast("int"))
                        .cast("int")), name(s)))
        tail = F.substring(text, end(F.size(ms)).cast("int") + 1, F.length(text))
        return F.concat(F.array_join(cut, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(bind(merged(spans), pieces))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text``; other columns unchanged, null text null."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = find_spans(docs, text, [row])
    columns = [F.when(F.col(f"row.`{c}`").isNotNull(), masked(F.col(f"row.`{c}`"), F.col("spans")))
               .alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*columns)

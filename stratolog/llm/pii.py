"""Personal data: exact kinds by pattern, and terms that give a protected entity away.

Entities are the values found by pattern and, with ``GROUPS``, what several values share: an address's host, an ip's network, a card's issuer, a phone's
prefix.  A term (a word of four letters or more, lower case) co-occurs with an entity when it is among the five words (runs of letters) before or after one of
its findings (words of another finding count like any other).  Over the whole corpus, P(e | t) = distinct texts with t near e / distinct texts that hold t, and a term
discloses log2(P(e | t) / P(e)) bits about e.  P(e) = texts that hold e / texts, over distinct texts or over all documents, whichever is less: copies of what
discloses e do not hide it.  Contexts that are equal word for word count once, so copies of a passage are no evidence.  A term with ``support`` contexts,
P(e | t) of at least ``share`` and at least ``bits`` bits is a finding wherever it stands: generalised in the clean text (its kind in its place), or removed
when P(e | t) reaches ``remove``.  The thresholds are a parameter (``Thresholds``).

Everything is built from DataFrame functions.  The texts are read three times: for findings, contexts and counts; for the texts that hold a term that may
disclose something; and for the result.  Sets that the rest is compared with are counted first: few rows are broadcast, more are joined by shuffle.

Null and empty texts have no findings.  Long texts are searched whole, with patterns that neither recurse nor look at a character twice.
Repeated rows and rows with equal ids each get their own findings; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, hashes, reliable
from .spans import located, replaced

KINDS = ("email", "ip", "card", "phone", "term")
#: Leftmost matches start where a run starts, or where the last match ended; groups are possessive, so long runs need no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}"
#: The first five words (runs of letters) of a text.
FIVE = r"^(?:\P{L}*+\p{L}++){0,5}+"
#: What several values of a kind share.
GROUPS = {
    "email": lambda v: F.lower(F.substring_index(v, "@", -1)),
    "ip": lambda v: F.substring_index(v, ".", 3),
    "card": lambda v: F.substring(_digits(v), 1, 6),
    "phone": lambda v: F.substring(_digits(v), 1, 4),
}


@dataclass(frozen=True)
class Thresholds:
    """Contexts a term needs beside an entity, the least P(e | t), the least bits, and the P(e | t) from which a term is removed instead of generalised."""

    support: int = 3
    share: float = 0.5
    bits: float = 3.0
    remove: float = 0.9


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    one = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda i: one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(one(i))) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _valid(kind: str):
    return lambda x: VALID[kind](x.getField("value"))


def _numbered(n: int):
    return lambda x: F.struct(x.getField("start").alias("start"), F.lit(n).alias("no"), x.getField("end").alias("end"), x.getField("value").alias("value"))


def _with_places(rows: DataFrame) -> DataFrame:
    """rows (with ``text``, not null) with ``places``: array of (start, no, end, value), in order of start and kind."""
    none = F.expr("cast(array() as array<string>)")
    kept = rows.columns
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"_{kind}", F.when(hint[kind], found).otherwise(none) if kind in hint else found)
    every = []
    for n, kind in enumerate(PATTERNS):
        # matches without any valid one are dropped before their places are looked for
        rows = rows.withColumn(f"_{kind}", F.when(F.exists(f"_{kind}", VALID[kind]), F.col(f"_{kind}")).otherwise(none))
        rows = rows.withColumn(f"_at_{kind}", located("text", f"_{kind}", F.lit(PATTERNS[kind])))
        every.append(F.transform(F.filter(f"_at_{kind}", _valid(kind)), _numbered(n)))
    return rows.select(*kept, F.sort_array(F.concat(*every)).alias("places"))


def base_findings(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), h1 and h2 (of the text), and ``places`` of every document."""
    text = F.coalesce("text", F.lit(""))
    return _with_places(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *hashes(text)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _entities(p: Column) -> Column:
    """array<long>: hashes of the value and of its group."""
    kind, value = p.getField("no"), p.getField("value")
    group = F.lit(None).cast("string")
    for n, name in enumerate(PATTERNS):
        group = F.when(kind == n, GROUPS[name](value)).otherwise(group)
    return F.array(F.xxhash64(kind, value), F.xxhash64(F.lit("group"), kind, group))


def contexts(found: DataFrame) -> DataFrame:
    """h1, h2 (of the text) and ``around``: array of (entities, terms), one for each finding, of every document."""
    around = F.transform(
        "places",
        lambda p: F.struct(
            _entities(p).alias("entities"),
            F.array_distinct(F.concat(*map(_words, _beside(p)))).alias("terms"),
        ),
    )
    none = F.expr("cast(array() as array<struct<entities:array<bigint>,terms:array<string>>>)")
    return found.select("h1", "h2", F.when(F.size("places") > 0, around).otherwise(none).alias("around"))


def _beside(p: Column) -> tuple[Column, Column]:
    """The text's five words before and after a finding, with what stands between them."""
    before = F.reverse(F.substring(F.col("text"), F.lit(1), p.getField("start")))
    after = F.substring(F.col("text"), p.getField("end") + 1, F.length("text"))
    return F.reverse(F.regexp_extract(before, FIVE, 0)), F.regexp_extract(after, FIVE, 0)


def _disclosing(docs: DataFrame, rows: DataFrame, limits: Thresholds) -> tuple[DataFrame, DataFrame | None]:
    """(term, share, bits) of the terms beyond the limits, and (h1, h2, term) of the texts that hold one that may be (None: there is none)."""
    # equal texts have equal findings
    around = rows.where(F.size("around") > 0).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.any_value("around").alias("around"))
    each = around.select("h1", "h2", "n", F.explode("around").alias("a"))
    each = each.select("h1", "h2", "n", F.explode("a.entities").alias("entity"), F.col("a.terms").alias("terms"))
    near = reliable(each.select("entity", "h1", "h2", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term")))
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_c"), F.count_distinct("h1", "h2").alias("n_te")).where(F.col("n_c") >= limits.support)
    # loses nothing: a term is in at least as many distinct texts as have it near any entity, however many entities stand in each
    least = near.groupBy("term").agg(F.count_distinct("h1", "h2").alias("n_least"))
    pairs = reliable(pairs.join(least, "term").where(F.col("n_te") >= limits.share * F.col("n_least")).drop("n_c", "n_least"))
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits")), None
    per_entity = each.select("entity", "h1", "h2", "n").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.sum("n").alias("all_e"))
    candidates = few(reliable(pairs.select("term").distinct()))
    text = F.coalesce("text", F.lit(""))
    words = docs.select(*hashes(text), F.explode(F.array_distinct(_words(text))).alias("term"))
    holding = reliable(words.join(candidates, "term", "left_semi").distinct())
    n_t = holding.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n, every = rows.agg(F.count_distinct("h1", "h2"), F.count(F.lit(1))).first()
    found = pairs.join(n_t, "term").join(per_entity, "entity")
    share = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    bits = F.log2(share / F.least(F.col("n_e") / F.lit(float(n)), F.col("all_e") / F.lit(float(every))))
    found = found.select("term", share.alias("share"), bits.alias("bits")).where((F.col("share") >= limits.share) & (F.col("bits") >= limits.bits))
    return reliable(found.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))), holding


def disclosing_terms(docs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """term, share (the largest P(e | t)) and bits of every term beyond the limits."""
    return _disclosing(docs, reliable(contexts(base_findings(docs))), limits)[0]


def sanitise(docs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """doc_id, ``places`` (kind, start, end; the disclosing terms too) and ``clean_text`` of every document."""
    terms, holding = _disclosing(docs, reliable(contexts(base_findings(docs))), limits)
    found = base_findings(docs)
    none = F.expr("cast(array() as array<struct<term:string,share:double>>)")
    if holding is None or terms.isEmpty():
        found = found.withColumn("_terms", none)
    else:
        own = few(reliable(holding.join(few(terms), "term").groupBy("h1", "h2").agg(F.collect_set(F.struct("term", "share")).alias("_terms"))))
        found = found.join(own, ["h1", "h2"], "left").withColumn("_terms", F.coalesce("_terms", none))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("_terms", lambda t: t.getField("term")), "|"), F.lit(r")(?!\p{L})"))
    found = found.withColumn("_pattern", F.when(F.size("_terms") > 0, pattern).otherwise(F.lit("(?!)x")))
    found = found.withColumn("_hits", F.when(F.size("_terms") > 0, F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")))
    found = found.withColumn("_at", located("text", "_hits", F.col("_pattern")))
    gone = lambda x: F.exists("_terms", lambda t: (t.getField("term") == F.lower(x.getField("value"))) & (t.getField("share") >= limits.remove))
    kind = lambda no: F.element_at(F.array(*map(F.lit, KINDS)), no + 1)
    base = F.transform("places", lambda x: F.struct(x.getField("start").alias("start"), x.getField("no").alias("no"), x.getField("end").alias("end"), F.concat(F.lit("["), F.upper(kind(x.getField("no"))), F.lit("]")).alias("by")))
    more = F.transform("_at", lambda x: F.struct(x.getField("start").alias("start"), F.lit(4).alias("no"), x.getField("end").alias("end"), F.when(gone(x), F.lit("")).otherwise(F.lit("[TERM]")).alias("by")))
    found = found.withColumn("_all", F.sort_array(F.concat(base, more)))
    places = F.transform("_all", lambda x: F.struct(kind(x.getField("no")).alias("kind"), x.getField("start").alias("start"), x.getField("end").alias("end")))
    return found.select("doc_id", places.alias("places"), replaced("text", "_all", lambda x: x.getField("by")).alias("clean_text"))


def as_text(places: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(places, lambda x: F.concat_ws(":", x.getField("kind"), x.getField("start"), x.getField("end"))), ",")

"""Personal data and what gives it away, with DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers.  Each
distinct value is a protected entity.  Words beside its mentions are terms, and the
corpus tells how strongly a term reveals an entity: the share of the term's documents
that mention the entity, and how much larger that is than the entity's share of all
documents, in bits.  Contexts that are copies of each other count once.  A term above
the thresholds is masked wherever it stands, beside the entity or alone, as it gives the
entity away there too: in general terms, or, if it is nearly certain, altogether.

Java's pattern matcher recurses for repeated groups, so patterns with such groups are
matched on a text of equal length in which separators that cannot belong to a match
are blotted out; then a single character class is repeated instead.

Edge cases: a null text is an empty one and has no spans; rows with equal ids and
texts have equal results and are all kept; documents with a null id are told apart by
their texts; terms that overlap personal data are part of it and no span of their own;
an empty table gives no rows; other columns, whatever their names, are kept by
``sanitised`` and not read otherwise.  Matches are added up in groups of ``_GROUP``, so
a text with very many of them takes time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Kinds in their order, and the order of a term.
KINDS = ("email", "ip", "card", "phone", "term", "removed")
EMAIL, IP, CARD, PHONE, TERM, REMOVED = range(len(KINDS))
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "")

# A dot between domain characters, and what stands for it in the blotted text.
_INNER_DOT, _OTHER = "", ""
_LOCAL = rf"[A-Za-z0-9._%+{_INNER_DOT}-]"
_EMAIL = (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++{_INNER_DOT}[A-Za-z0-9{_INNER_DOT}-]++")
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x20-]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LETTERS = r"\p{L}{4,}"

CONTEXT_CHARS = 60
MIN_CONTEXTS = 2
GENERALISED_SHARE, REMOVED_SHARE = 0.5, 0.9
MIN_BITS = 4.0

_SPAN = "struct<start:int,kind:int,end:int,value:string>"


# Rows of an array that are added up before they join the ones before them.
_GROUP = 256


# --- arrays ---------------------------------------------------------------------

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(items: Column) -> Column:
    """``items`` in arrays of ``_GROUP``; the last one has the rest, if any."""
    return _let(items, lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(all_) / _GROUP).cast("int")),
        lambda g: F.slice(all_, g * _GROUP + 1, _GROUP)))


def _ends(group: Column) -> tuple[Column, Column]:
    """Where the spans of a group begin and end; from 0 to -1 without spans."""
    return (F.coalesce(F.array_min(F.transform(group, lambda s: s["start"])), F.lit(0)),
            F.coalesce(F.array_max(F.transform(group, lambda s: s["end"])), F.lit(-1)))


# --- spans ----------------------------------------------------------------------

def _located(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches as spans in code points: gaps and matches add up to positions."""
    wanted = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, wanted, F.lit(0))
    pieces = F.zip_with(matches, F.slice(F.split(text, wanted, -1), F.lit(1), F.size(matches)),
                        lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"),
                     F.array().cast(f"array<array<{_SPAN}>>").alias("done"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["gap"]
        end = begin + F.length(piece["value"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        piece["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"),
                        state["done"].alias("done"))

    def add_group(state: Column, group: Column) -> Column:
        begun = F.struct(state["at"].alias("at"), _none().alias("found"),
                         F.concat(state["done"], F.array(state["found"])).alias("done"))
        return F.aggregate(group, begun, add)

    return F.aggregate(_groups(pieces), start, add_group,
                       lambda state: F.concat(F.flatten(state["done"]), state["found"]))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _emails(text: Column) -> Column:
    blotted = F.regexp_replace(
        F.translate(text, _INNER_DOT, _OTHER), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _INNER_DOT)
    found = F.transform(_located(blotted, _EMAIL, EMAIL), lambda s: s.withField(
        "value", F.lower(F.translate(s["value"], _INNER_DOT, "."))))
    return F.when(F.instr(text, "@") > 0, found).otherwise(_none())


def _ips(text: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    found = F.filter(_located(text, _IP, IP), lambda s: F.forall(F.split(s["value"], r"\."), small))
    return F.when(text.rlike(r"[0-9]\.[0-9]"), found).otherwise(_none())


def _cards(text: Column) -> Column:
    blotted = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")

    def valid(span: Column) -> Column:
        digits = _digits(span["value"])
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)

    found = F.transform(F.filter(_located(blotted, _CARD, CARD), valid),
                        lambda s: s.withField("value", _digits(s["value"])))
    return F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), found).otherwise(_none())


def _phones(text: Column) -> Column:
    found = F.transform(
        F.filter(_located(text, _PHONE, PHONE),
                 lambda s: F.length(_digits(s["value"])).between(9, 15)),
        lambda s: s.withField("value", _digits(s["value"])))
    return F.when(F.instr(text, "+") > 0, found).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind; ``value`` is the entity."""
    return F.sort_array(F.concat(_emails(text), _ips(text), _cards(text), _phones(text)))


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- disclosure -----------------------------------------------------------------

def _context_terms(part: Column, span: Column) -> Column:
    """Words on both sides of a span that lie wholly within reach, in lower case.

    ``part`` is the piece of the text around the span, where it begins, and the length
    of the whole text: places in a piece are found faster than in a long text.
    """
    begin = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    left = part["piece"].substr(begin - part["base"] + 1, span["start"] - begin)
    right = part["piece"].substr(span["end"] - part["base"] + 1, F.lit(CONTEXT_CHARS))
    cut_left = F.when(begin > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    cut_right = F.when(part["chars"] > span["end"] + CONTEXT_CHARS,
                       F.regexp_replace(right, r"\p{L}++$", "")).otherwise(right)
    return F.lower(F.concat(cut_left, F.lit(" "), cut_right))


def _mentions(text: Column, spans: Column) -> Column:
    """``entity, context`` of each span."""
    def of_group(group: Column) -> Column:
        first, last = _ends(group)
        base = F.greatest(first - CONTEXT_CHARS, F.lit(0))
        part = F.struct(base.alias("base"), F.length(text).alias("chars"),
                        text.substr(base + 1, last - base + CONTEXT_CHARS).alias("piece"))
        return _let(part, lambda p: F.transform(group, lambda s: F.struct(
            F.concat_ws(":", s["kind"].cast("string"), s["value"]).alias("entity"),
            _context_terms(p, s).alias("context"))))

    return F.flatten(F.transform(_groups(spans), of_group))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))


def found_spans(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, text_hash, spans`` and the words beside each span."""
    text = F.col("text")
    return _keyed(docs).withColumn("spans", base_spans(text)).select(
        "doc_id", "text_hash", "spans", _mentions(text, F.col("spans")).alias("mentions"))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``entity, term, share, bits`` of the terms that reveal an entity.

    Counts are over all documents: distinct contexts of a pair, documents of a term,
    documents of an entity.  All are combined before they are shuffled.
    """
    mentions = found.where(F.size("mentions") > 0).select(
        "doc_id", "text_hash", F.explode("mentions").alias("m")).select(
        "doc_id", "text_hash", "m.entity", "m.context")
    pairs = (
        mentions.select("entity", "context").distinct()
        .select("entity", F.explode(F.array_distinct(
            F.regexp_extract_all("context", F.lit(_LETTERS), F.lit(0)))).alias("term"))
        .groupBy("entity", "term").agg(F.count("*").alias("contexts"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
    )
    pairs, _ = common.stored(pairs, "pairs")
    wanted = pairs.select("term").distinct()
    term_docs = (
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
            F.lower("text"), F.lit(_LETTERS), F.lit(0)))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("term_docs"))
        .join(wanted, "term", "left_semi")
    )
    beside = (
        mentions.select("doc_id", "text_hash", "entity", F.explode(F.array_distinct(
            F.regexp_extract_all("context", F.lit(_LETTERS), F.lit(0)))).alias("term"))
        .distinct().groupBy("entity", "term").agg(F.count("*").alias("joint"))
    )
    entity_docs = mentions.select("doc_id", "text_hash", "entity").distinct().groupBy("entity").agg(
        F.count("*").alias("entity_docs"))
    everything = docs.count()
    share = F.least(F.col("joint") / F.col("term_docs"), F.lit(1.0))
    bits = F.log2(F.col("share") * F.lit(float(max(everything, 1))) / F.col("entity_docs"))
    return (
        pairs.join(term_docs, "term").join(beside, ["entity", "term"]).join(entity_docs, "entity")
        .withColumn("share", share).withColumn("bits", bits)
        .where((F.col("share") >= GENERALISED_SHARE) & (F.col("bits") >= MIN_BITS))
        .select("entity", "term", "share", "bits")
    )


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, text_hash, terms``: spans of revealing terms in every document that has
    them.

    The terms are stored, so that few are broadcast by their known size; many are joined
    with the distinct words of documents by a shuffle.
    """
    best, _ = common.stored(terms.groupBy("term").agg(F.max("share").alias("share")), "best-terms")
    words = _keyed(docs).select("doc_id", "text_hash", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0)))).alias("term"))
    listed = words.join(best, "term").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("share") < REMOVED_SHARE, F.col("term"))).alias("general"),
        F.collect_set(F.when(F.col("share") >= REMOVED_SHARE, F.col("term"))).alias("gone"))
    listed, _ = common.stored(listed, "listed-terms")
    listed = listed.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    matched = _keyed(docs).join(listed, F.col("doc_id").eqNullSafe(F.col("_id"))
                                & (F.col("text_hash") == F.col("_hash")))

    def spans(names: str, kind: int) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
        return F.when(F.size(names) > 0, _located(F.col("text"), pattern, kind)).otherwise(_none())

    return matched.select("doc_id", "text_hash", F.concat(
        spans("general", TERM), spans("gone", REMOVED)).alias("terms")).dropDuplicates(
        ["doc_id", "text_hash"])


def all_spans(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, text_hash, spans`` of the patterns, and ``every`` span."""
    found, _ = common.stored(found_spans(docs), "found-spans")
    terms, _ = common.stored(disclosing_terms(docs, found), "terms")
    extra, _ = common.stored(_term_spans(docs, terms), "term-spans")
    extra = extra.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = found.join(extra, F.col("doc_id").eqNullSafe(F.col("_id"))
                        & (F.col("text_hash") == F.col("_hash")), "left")

    def meets(span: Column, term: Column) -> Column:
        return (span["start"] < term["end"]) & (term["start"] < span["end"])

    def with_ends(group: Column) -> Column:
        first, last = _ends(group)
        return F.struct(first.alias("start"), last.alias("end"), group.alias("own"))

    apart = _let(F.transform(_groups(F.col("spans")), with_ends), lambda groups: F.filter(
        F.coalesce("terms", _none()), lambda t: ~F.exists(groups, lambda g: meets(g, t) & F.exists(
            g["own"], lambda s: meets(s, t)))))
    return joined.select("doc_id", "text_hash", "spans",
                         F.sort_array(F.concat("spans", apart)).alias("every"))


def masked(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind's mask; overlapping spans once."""
    masks = F.array(*map(F.lit, MASKS))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"), F.array().cast("array<string>").alias("done"),
                     F.lit(0).alias("base"), F.lit("").alias("piece"))

    def state_of(before: Column, at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"), *[before[c].alias(c) for c in ("done", "base", "piece")])

    def add(state: Column, s: Column) -> Column:
        gap = state["piece"].substr(state["at"] - state["base"] + 1, s["start"] - state["at"])
        mask = F.element_at(masks, s["kind"] + 1)
        grown = state_of(state, s["end"], F.concat(state["out"], F.array(gap, mask)))
        inside = state_of(state, F.greatest(state["at"], s["end"]), state["out"])
        return F.when(s["start"] >= state["at"], grown).otherwise(inside)

    def add_group(state: Column, group: Column) -> Column:
        last = F.greatest(_ends(group)[1], state["at"])
        begun = F.struct(
            state["at"].alias("at"), none.alias("out"),
            F.concat(state["done"], F.array(F.array_join(state["out"], ""))).alias("done"),
            state["at"].alias("base"), text.substr(state["at"] + 1, last - state["at"]).alias("piece"))
        return F.aggregate(group, begun, add)

    return F.aggregate(_groups(spans), start, add_group, lambda state: F.concat(
        F.array_join(state["done"], ""), F.array_join(state["out"], ""),
        text.substr(state["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """Documents with personal data and revealing terms masked in ``text``."""
    own_id, own_hash, every = (common.unused(docs, n) for n in ("masked_id", "masked_hash", "masked_spans"))
    spans, _ = common.stored(
        all_spans(docs).where(F.size("every") > 0).dropDuplicates(["doc_id", "text_hash"]).select(
            F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash),
            F.col("every").alias(every)), "masked-spans")
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(own_id)) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(own_hash)), "left")
    return joined.withColumn("text", F.when(
        F.col(every).isNotNull(), masked(F.col("text"), F.col(every))).otherwise(
        F.col("text"))).select(*map(common.quoted, docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each pattern, their digest, and all spans."""
    spans = all_spans(docs)

    def count_of(kind: int) -> Column:
        own = F.filter("spans", lambda s: s["kind"] == kind)
        return F.size(own).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count_of(kind) for kind in (EMAIL, IP, CARD, PHONE)]
    return spans.select("doc_id", *counts, F.sha2(as_text(F.col("spans")), 256).alias("base_sha256"),
                        as_text(F.col("every")).alias("spans"))

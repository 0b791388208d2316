"""Personal data: patterns first, then terms that give the protected entities away.

Entities (addresses, numbers) are found by patterns. A term, a word of a document with the entity,
discloses it as far as it tells which entity is meant: the pointwise mutual information of term and
entity, as a share of the entity's own information, both from document counts over the whole corpus.
1 means that the term occurs only where the entity does. Terms at or above ``generalise_at`` for some
entity are disclosing wherever they occur; those at or above ``remove_at`` are removed rather than
replaced by a label. All counts are of whole documents, and entities of one document count like
others: a word found nowhere but in that document gives it away.

A word can reach the threshold for an entity only if it is rare enough for the entity's count, so
frequent words meet frequent entities only; no pair that could reach it is left out. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.llm.shared import prefix, row_hash, stored, text_of

# The kinds and their patterns. Repetition is possessive where what follows cannot
# match inside it, and a match starts at the beginning of a run or where the last match ended, so
# time is linear in the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts that a pattern cannot match are told by a cheaper test.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
         "phone": r"\+[0-9]"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]",
          "term": "[TERM]"}
TERM = r"\p{L}{3,}"
# A table of at most so many terms, counted first, is small enough to broadcast.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class Disclosure:
    """The thresholds are shares of 1."""

    generalise_at: float = 0.95
    remove_at: float = 0.999


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, ends in 0."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])  # fixed values
    from_right = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(from_right, lambda d, i: F.when(
            i % 2 == 1, F.element_at(doubled, d.cast("int") + 1)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) > 3) | (
            F.right(x, F.lit(3)).cast("int") > 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: Column) -> Column:
    """start, finish and value of each match, in code points.

    The texts between matches and the matches alternate, so running lengths are the places. Both are
    found once for a text, before the lambda, which would find them again for each match.
    """
    parts = F.filter(F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), gap.alias("gap"))),
        lambda x: x["value"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start:bigint,finish:bigint,value:string>>)")

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        finish = start + F.length(part["value"])
        span = F.struct(start.alias("start"), finish.alias("finish"), part["value"].alias("value"))
        return F.struct(finish.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    return F.coalesce(F.aggregate(parts, first, add, lambda s: s["out"]), empty)


def base_spans(text: Column) -> Column:
    """Pattern matches of all kinds as (start, rank, finish, kind, value), by start, then kind.
    ``rank`` is the place of the kind in KINDS."""
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,finish:bigint,kind:string,"
                   "value:string>>)")
    found = []
    for rank, kind in enumerate(KINDS):
        spans = F.transform(
            F.filter(_spans(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["value"])),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), s["finish"].alias("finish"),
                F.lit(kind).alias("kind"), s["value"].alias("value")))
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(empty))
    return F.array_sort(F.concat(*found))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))), ",")


def entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def _words(text: Column) -> Column:
    """The distinct words of a text that may be terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, rules: Disclosure = Disclosure(),
                     text_col: str = "text") -> DataFrame:
    """Terms at or above ``generalise_at`` for some entity: term, disclosure (the highest)."""
    text = text_of(text_col)
    found = docs.select(base_spans(text).alias("spans"), text.alias("text")).where(F.size("spans") > 0)
    mentions = stored(found.select(
        F.monotonically_increasing_id().alias("document"),
        F.array_distinct(F.transform("spans", entity)).alias("entities"),
        _words(F.col("text")).alias("words")), "mentions")
    documents = docs.count()
    n = F.lit(float(documents))
    of_entity = stored(mentions.select(F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") < documents), "entities")
    most = of_entity.agg(F.max("n_entity")).first()[0]

    def bound(n_entity: Column) -> Column:
        """The most documents of a term that reaches the threshold: a pair is in no more documents
        than the entity. The factor is for rounding."""
        return n * F.pow(n_entity / n, F.lit(rules.generalise_at)) * F.lit(1 + 1e-9)

    # Words are counted before they meet the documents: a word of every document is one row by then.
    of_term = docs.select(F.explode(_words(text)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term"))
    of_term = stored(of_term.where(F.col("n_term") <= bound(F.lit(most))), "terms")
    # Both sides of each join come straight from a shuffle, so hot words and documents are split.
    words = mentions.select("document", F.explode("words").alias("term")).join(of_term, "term")
    entities = mentions.select("document", F.explode("entities").alias("entity")).join(
        of_entity, "entity").withColumnRenamed("document", "of")
    pairs = words.join(entities, (F.col("document") == F.col("of"))
                       & (F.col("n_term") <= bound(F.col("n_entity")))).groupBy(
        "entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_pair"))
    told = F.log(n * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    own = F.log(n / F.col("n_entity"))
    return pairs.groupBy("term").agg(F.max(told / own).alias("disclosure")).where(
        F.col("disclosure") >= rules.generalise_at)


def find_personal_data(docs: DataFrame, rules: Disclosure = Disclosure(), id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``pii_base`` (pattern spans) and ``pii_spans`` (those and the
    spans of disclosing terms, kind "term"), arrays by start, then kind.

    Places are code points, the end exclusive. A term that overlaps a pattern's span is left out.
    A null text is empty and has no spans; ids play no part in what is found. Repeated rows count
    as documents each. An empty table gives an empty one. Columns named like the added ones are
    replaced.
    """
    docs = docs.drop("pii_base", "pii_spans")
    p = prefix(docs)
    text, tie = text_of(text_col), row_hash(docs)
    terms = stored(disclosing_terms(docs, rules, text_col).select(
        "term", (F.col("disclosure") >= rules.remove_at).alias("removed")), "disclosing")
    wanted = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    hits = stored(docs.select(tie.alias(f"{p}tie"), F.explode(_words(text)).alias("term"))
                  .join(wanted, "term").groupBy(f"{p}tie").agg(
                      F.collect_set("term").alias(f"{p}terms"),
                      F.collect_set(F.when(F.col("removed"), F.col("term"))).alias(f"{p}gone")),
                  "disclosing-hits")
    rows = docs.withColumn(f"{p}tie", tie).join(hits, f"{p}tie", "left")
    rows = rows.withColumn("pii_base", F.transform(base_spans(text), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["finish"].alias("finish"),
        s["kind"].alias("kind"), F.lit(False).alias("removed"))))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(f"{p}terms", "|"),
                       F.lit(r")(?!\p{L})"))
    extra = F.transform(
        F.filter(_spans(text, pattern), lambda t: ~F.exists(
            F.col("pii_base"), lambda b: (b["start"] < t["finish"]) & (t["start"] < b["finish"]))),
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), t["finish"].alias("finish"),
            F.lit("term").alias("kind"),
            F.array_contains(f"{p}gone", F.lower(t["value"])).alias("removed")))
    return rows.withColumn("pii_spans", F.when(
        F.col(f"{p}terms").isNotNull(), F.array_sort(F.concat("pii_base", extra))
    ).otherwise(F.col("pii_base"))).drop(f"{p}tie", f"{p}terms", f"{p}gone")


def sanitise(docs: DataFrame, rules: Disclosure = Disclosure(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind's label, or removed. Of spans that
    overlap the first by start and kind is replaced, and the rest of the others goes with it."""
    found = find_personal_data(docs, rules, id_col, text_col)
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    text = text_of(text_col)

    def add(state: Column, s: Column) -> Column:
        label = F.when(s["removed"], F.lit("")).otherwise(labels[s["kind"]])
        gap = F.substring(text, state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["finish"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(gap, label)))
            .otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate("pii_spans", first, add, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("pii_spans") > 0, clean)
                            .otherwise(F.col(text_col))).select(*docs.columns)

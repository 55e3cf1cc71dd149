"""Identity vault: numbering identities, placeholders, synthetic values, replacement in texts.

An identity is a type with a normalised text. Identities are reduced to one row each before they
are numbered. Spark cuts them into ranges of equal size by type and first appearance, whatever the
kind of document id; numbers come from counts per range plus a rank inside the range, so no type is
ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import edited as edited_text
from maskwright.functions.text import islands, normalized_key, quoted
from maskwright.scratch import materialise

# Invented values in reserved ranges, as many per type as the numbering rule expects.
_FIRST = ("Avery", "Blake", "Casey", "Devon", "Ellis", "Finley")
_LAST = ("Alder", "Birch", "Cedar", "Dogwood")
_NAMES = tuple(f"{f} {s}" for s in _LAST for f in _FIRST)
_TOWNS = ("Ashford", "Brookvale", "Clearwater", "Dunmore", "Eastbridge", "Foxhollow", "Glenrock", "Highmoor")
POOLS = {
    "PERSON": _NAMES,
    "LOCATION": tuple(f"{a}{t}" for a in ("", "New ") for t in _TOWNS),
    "ORGANIZATION": tuple(f"{t} {k}" for k in ("Works", "Partners") for t in _TOWNS),
    "ADDRESS": tuple(f"{10 * i} {t} Road" for i, t in enumerate((*_TOWNS, *_TOWNS[:4]), 1)),
    "USERNAME": tuple(f"user_{n.lower()}" for n in (*_FIRST, *_LAST)),
    "MISC": tuple(f"Detail {x}" for x in "ABCDEF"),
    "PHONE": tuple(f"+1-202-555-01{i:02d}" for i in range(6)),
    "CREDIT_CARD": ("4000 0000 0000 0002", "4000 0000 0000 0010", "4000 0000 0000 0028", "4000 0000 0000 0036"),
    "SSN": tuple(f"900-00-000{i}" for i in range(1, 6)),
    "IBAN": tuple(f"XX00 0000 0000 000{i}" for i in range(1, 4)),
    "IP_ADDRESS": tuple(f"203.0.113.{i}" for i in range(1, 7)),
    "BANK_ACCOUNT": tuple(f"000000000{i}" for i in range(1, 4)),
}
DOMAINS = ("example.com", "example.org", "example.net")


def placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), n.cast("string"), F.lit("]"))


def pooled(values: tuple[str, ...], index: str) -> str:
    """SQL: the pool's value at an index; later cycles get a number, after a dash if the value is numeric."""
    pool = f"array({', '.join(map(quoted, values))})"
    base = f"element_at({pool}, cast({index} % {len(values)} as int) + 1)"
    cycle = f"cast({index} div {len(values)} + 1 as string)"
    return f"if({index} < {len(values)}, {base}, concat({base}, if(rlike({base}, '^[0-9\\\\s+()-]+$'), '-', ' '), {cycle}))"


def synthetic(kind: str, index: str) -> str:
    """SQL: the synthetic value of the index-th identity (from 0) of a type; null where there is none."""
    local = f"regexp_replace(regexp_replace(lower({pooled(_NAMES, index)}), '[^a-z0-9]+', '.'), '^[.]+|[.]+$', '')"
    mail = f"concat({local}, '@', element_at(array({', '.join(map(quoted, DOMAINS))}), cast({index} % {len(DOMAINS)} as int) + 1))"
    cases = " ".join(f"when {kind} = {quoted(k)} then {pooled(v, index)}" for k, v in POOLS.items())
    return f"case when {kind} = 'EMAIL' then {mail} {cases} end"


def identities(spans: DataFrame, doc: str = "doc_id", counters: DataFrame | None = None) -> DataFrame:
    """One row per identity of exploded spans, numbered by first appearance (doc, start) per type.

    ``counters`` (entity_type, n) holds the numbers already given. Columns: entity_type,
    normalized_key, original_text (the first seen), first_doc, first_start, usage_count, n,
    placeholder and synthetic_value.
    """
    keyed = spans.withColumn("normalized_key", F.expr(normalized_key("text")))
    where = F.struct(F.col(doc), F.col("start"))
    each = keyed.groupBy("entity_type", "normalized_key").agg(F.min_by("text", where).alias("original_text"), F.min(where).alias("w"), F.count(F.lit(1)).alias("usage_count"))
    each = each.select("entity_type", "normalized_key", "original_text", F.col(f"w.{doc}").alias("first_doc"), F.col("w.start").alias("first_start"), "usage_count")
    # the range is written with the rows, so that it stays what it is
    each = materialise(each.repartitionByRange("entity_type", "first_doc", "first_start", "normalized_key").withColumn("range", F.spark_partition_id()), "identities")
    sums = each.groupBy("entity_type", "range").count()
    below = F.coalesce(F.sum("count").over(Window.partitionBy("entity_type").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("entity_type", "range", below.alias("below"))
    if counters is not None:
        sums = sums.join(counters.select("entity_type", F.col("n").alias("given")), "entity_type", "left").select("entity_type", "range", (F.col("below") + F.coalesce("given", F.lit(0))).alias("below"))
    rank = F.row_number().over(Window.partitionBy("entity_type", "range").orderBy("first_doc", "first_start", "normalized_key"))
    out = each.join(sums, ["entity_type", "range"]).withColumn("n", (F.col("below") + rank).cast("long")).drop("range", "below")
    return out.withColumn("placeholder", placeholder(F.col("entity_type"), F.col("n"))).withColumn("synthetic_value", F.expr(f"coalesce({synthetic('entity_type', '(n - 1)')}, '')"))


def active(mode: str = "placeholder") -> Column:
    """What an identity is replaced by: the synthetic value in synthetic mode where there is one."""
    fake = F.col("synthetic_value")
    return F.when((F.lit(mode) == "synthetic") & (fake != ""), fake).otherwise(F.col("placeholder"))


def first_of(edits: str, fields: str) -> str:
    """SQL: edits in their order without those that begin before the end of the ones taken so far."""
    kind = f"struct<{', '.join(':'.join(f.split()) for f in fields.split(','))}>"
    return islands(edits, lambda part: f"aggregate({part}, cast(array() as array<{kind}>), (a, s) -> if(coalesce(s.start < get(a, size(a) - 1).end, false), a, concat(a, array(s))))")


def anonymize(docs: DataFrame, vault: DataFrame, doc: str = "doc_id", text: str = "text", spans: str = "spans", mode: str = "placeholder", found: DataFrame | None = None) -> DataFrame:
    """doc, anonymized text and the number of replaced spans of every row; ``doc`` tells rows apart.

    Spans meet the vault as narrow rows and come back as one list of edits a document; ``found``
    (doc, spans) gives them where ``docs`` has none. A span without an identity in the vault is
    replaced by its type in brackets, so none stays readable. Of overlapping spans the first is
    replaced.
    """
    flat = (docs if found is None else found).select(F.col(doc).alias("doc"), F.posexplode(spans).alias("i", "s")).select("doc", "i", F.col("s.entity_type").alias("entity_type"), F.expr(normalized_key("s.text")).alias("normalized_key"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    chosen = flat.join(vault.select("entity_type", "normalized_key", active(mode).alias("value")), ["entity_type", "normalized_key"], "left")
    chosen = chosen.withColumn("value", F.coalesce("value", F.concat(F.lit("["), "entity_type", F.lit("]"))))
    edits = chosen.groupBy("doc").agg(F.collect_list(F.struct("i", "start", "end", "value")).alias("x")).select("doc", F.expr(first_of("array_sort(x)", "i int, start int, end int, value string")).alias("edits"))
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(edits, "doc", "left")
    return rows.select(F.col("doc").alias(doc), F.expr(edited_text("body", "edits")).alias("anonymized"), F.coalesce(F.size("edits"), F.lit(0)).alias("n_spans"))


def import_records(vault: DataFrame, incoming: DataFrame) -> DataFrame:
    """The vault and those incoming identities whose key it lacks."""
    return vault.unionByName(incoming.join(vault.select("entity_type", "normalized_key"), ["entity_type", "normalized_key"], "left_anti"), allowMissingColumns=True)


def counters(*tables: DataFrame) -> DataFrame:
    """Per type the largest number given in any of the tables (entity_type, n)."""
    every = tables[0].select("entity_type", "n")
    for t in tables[1:]:
        every = every.unionAll(t.select("entity_type", "n"))
    return every.groupBy("entity_type").agg(F.max("n").alias("n"))


def upsert(vault: DataFrame, seen: DataFrame) -> DataFrame:
    """Vault records merged with identities seen now.

    Both have entity_type, normalized_key, original_text, n, placeholder, synthetic_value,
    usage_count, created_at and last_seen_at; ``vault`` also mode and pinned. A known identity keeps
    its number, texts and creation, adds usage and takes the later sight.
    """
    keys = ["entity_type", "normalized_key"]
    a, b = vault.alias("a"), seen.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    return both.select(
        *map(first, [*keys, "original_text", "n", "placeholder", "synthetic_value"]),
        (F.coalesce("a.usage_count", F.lit(0)) + F.coalesce("b.usage_count", F.lit(0))).alias("usage_count"),
        F.least("a.created_at", "b.created_at").alias("created_at"),
        F.greatest("a.last_seen_at", "b.last_seen_at").alias("last_seen_at"),
        F.col("a.mode").alias("mode"),
        F.coalesce("a.pinned", F.lit(False)).alias("pinned"),
    )


def edited(vault: DataFrame, changes: DataFrame) -> DataFrame:
    """Records with changes (entity_type, normalized_key, deleted, mode, pinned; null: as it is) made.

    Synthetic mode falls back to the placeholder where a record has no synthetic value.
    """
    keys = ["entity_type", "normalized_key"]
    new = changes.select(*keys, "deleted", F.col("mode").alias("_mode"), F.col("pinned").alias("_pinned"))
    out = vault.join(new, keys, "left").filter(~F.coalesce("deleted", F.lit(False)))
    mode = F.coalesce("_mode", "mode")
    mode = F.when((mode == "synthetic") & (F.coalesce("synthetic_value", F.lit("")) == ""), "placeholder").otherwise(mode)
    return out.withColumn("mode", mode).withColumn("pinned", F.coalesce("_pinned", "pinned")).select(*vault.columns)


def replacement(default: str = "placeholder") -> Column:
    """What a record is replaced by: its own mode comes before the default; synthetic only where there is a value."""
    fake = F.coalesce("synthetic_value", F.lit(""))
    return F.when((F.coalesce("mode", F.lit(default)) == "synthetic") & (fake != ""), fake).otherwise(F.col("placeholder"))


def cleared(vault: DataFrame) -> DataFrame:
    """What is left when all records but pinned ones go."""
    return vault.filter(F.coalesce("pinned", F.lit(False)))


def recent(vault: DataFrame) -> DataFrame:
    """Records by last sight, latest first, then by type and number."""
    return vault.orderBy(F.desc("last_seen_at"), "entity_type", "n")


def export_json(vault: DataFrame, path: str) -> None:
    """The records and, in lines of their own, the counters, as JSON lines."""
    rows = vault.select(F.lit("record").alias("kind"), F.struct(*vault.columns).alias("record"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("long").alias("n"))
    given = counters(vault).select(F.lit("counter").alias("kind"), F.lit(None).cast(rows.schema["record"].dataType).alias("record"), "entity_type", F.col("n").cast("long").alias("n"))
    rows.unionByName(given).write.json(path)


def import_json(vault: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The vault with the records of an export that it lacks, and the larger of both sides' counters per type."""
    kind = vault.schema.simpleString()
    read = vault.sparkSession.read.schema(f"kind string, record {kind}, entity_type string, n long").json(path)
    records = read.filter("kind = 'record'").select("record.*")
    return import_records(vault, records), counters(vault, read.filter("kind = 'counter'"))


def preview(spans: DataFrame, doc: str = "doc_id", given: DataFrame | None = None) -> DataFrame:
    """Exploded spans with the placeholder that a preview shows: every occurrence numbered in its document, after ``given``."""
    n = F.row_number().over(Window.partitionBy(doc, "entity_type").orderBy("start"))
    out = spans.withColumn("_n", n)
    if given is not None:
        out = out.join(given.select("entity_type", F.col("n").alias("_given")), "entity_type", "left").withColumn("_n", F.col("_n") + F.coalesce("_given", F.lit(0))).drop("_given")
    return out.withColumn("placeholder", placeholder(F.col("entity_type"), F.col("_n"))).drop("_n")


def preview_identities(spans: DataFrame, vault: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Exploded spans with the placeholder that the vault has or, for identities new to it, would give in each document."""
    keyed = spans.withColumn("normalized_key", F.expr(normalized_key("text")))
    known = keyed.join(vault.select("entity_type", "normalized_key", F.col("placeholder").alias("_known")), ["entity_type", "normalized_key"], "left")
    new = known.filter("_known is null").groupBy(doc, "entity_type", "normalized_key").agg(F.min("start").alias("_at"))
    rank = F.row_number().over(Window.partitionBy(doc, "entity_type").orderBy("_at"))
    new = new.join(counters(vault), "entity_type", "left").withColumn("_n", rank + F.coalesce("n", F.lit(0))).select(doc, "entity_type", "normalized_key", "_n")
    out = known.join(new, [doc, "entity_type", "normalized_key"], "left")
    return out.withColumn("placeholder", F.coalesce("_known", placeholder(F.col("entity_type"), F.col("_n")))).drop("_known", "_n", "normalized_key")

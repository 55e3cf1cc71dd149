"""Labelled dataset records: reading with repair, conversion to corpus examples, summary and sampling.

Files are rows of the whole-text source, so files are read in parallel and a file is parsed in one
task. Records become examples by SQL expressions. Character positions are code points.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.text import length_bucket, let, quoted
from maskwright.schema import TYPES
from maskwright.scratch import materialise

# Languages, types that the sampler spreads over, length buckets and physical lines a record may take.
LANGUAGES = ("en", "de")
SUPPORTED = ("ADDRESS", "CREDIT_CARD", "DATE", "EMAIL", "LOCATION", "PERSON", "PHONE", "SSN")
BUCKETS = ("short", "medium", "long")
MOST_LINES = 50
# Dataset labels that are no type themselves, by the type that they stand for.
LABELS = {
    "ADDRESS": ("BUILDING_NUMBER", "STREET", "STREET_ADDRESS"),
    "CREDIT_CARD": ("CREDIT_CARD_NUMBER", "CREDITCARDNUMBER"),
    "DATE": ("BIRTH_DATE", "DATE_OF_BIRTH", "DOB"),
    "EMAIL": ("EMAIL_ADDRESS",),
    "LOCATION": ("CITY", "COUNTRY", "STATE"),
    "MISC": ("AGE", "DRIVER_LICENSE", "DRIVER_LICENSE_NUMBER", "GENDER", "ID_CARD", "ID_CARD_NUMBER", "PASSPORT", "PASSPORT_NUMBER", "PIN", "POSTAL_CODE", "TAX_ID", "TAX_IDENTIFICATION_NUMBER", "ZIP_CODE"),
    "PERSON": ("FIRST_NAME", "FIRSTNAME", "FULL_NAME", "GIVEN_NAME", "LAST_NAME", "LASTNAME", "NAME"),
    "PHONE": ("PHONE_NUMBER",),
    "SSN": ("SOCIALNUMBER", "SOCIAL_SECURITY_NUMBER"),
    "USERNAME": ("ACCOUNT_NAME",),
}
_MASK = "array<struct<start:int,start_offset:int,end:int,end_offset:int,label:string,entity_type:string,type:string,value:string,text:string>>"
RECORD = f"source_text string, unmasked_text string, original_text string, text string, language string, lang string, locale string, sourceRow long, source_row long, id string, uid string, record_id string, recordId string, sourceFile string, source_file string, dataset string, split string, region string, script string, privacy_mask {_MASK}, span_labels array<array<string>>"
GOLD = "array<struct<start:int,end:int,entity_type:string,text:string>>"


def _records(text: str, whole: bool) -> Iterator[tuple[int, str]]:
    """Row and JSON text of a file's records; a line that ends inside a record goes on in the next."""
    if whole:
        parsed = json.loads(text)
        parsed = parsed if isinstance(parsed, list) else parsed.get("data") or parsed.get("records") or []
        yield from ((n, json.dumps(r)) for n, r in enumerate(parsed, 1))
        return
    held: list[str] = []
    first = 0
    for n, line in enumerate(text.splitlines(), 1):
        if not held and not line.strip():
            continue
        first = first if held else n
        held.append(line)
        record = "\\n".join(held)
        try:
            json.loads(record)
        except json.JSONDecodeError as e:
            # only what the end of the text cut off can go on
            open_string = e.msg.startswith("Unterminated string")
            if len(held) < MOST_LINES and (open_string or e.pos >= len(record.rstrip())):
                continue
            raise ValueError(f"line {first}: {e.msg}") from e
        yield first, record
        held = []
    if held:
        raise ValueError(f"line {first}: the file ends inside a record")


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON files (a list, or one under data or records) and of JSON-lines files, with file and row.

    Raw line ends inside a record's strings are repaired over at most ``MOST_LINES`` lines; a broken
    record fails the read.
    """
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), "value")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, value in zip(frame["file"], frame["value"], strict=True):
                rows = [(file, n, r) for n, r in _records(value, file.endswith(".json"))]
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["file", "row", "value"])

    found = files.mapInPandas(parse, "file string, row long, value string")
    return found.select("file", "row", F.from_json("value", RECORD).alias("r")).select("r.*", F.col("file").alias("_file"), F.col("row").alias("_row"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files that a JSON manifest lists (``files``: name, or an object with ``path``), relative to its folder."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    folder = path.rsplit("/", 1)[0]
    names = [f if isinstance(f, str) else f["path"] for f in json.loads(text)["files"]]
    return read_records(spark, *(n if n.startswith("/") or "://" in n else f"{folder}/{n}" for n in names))


def language(value: str) -> str:
    """SQL: en or de of a language tag or name, else null."""
    head = f"regexp_extract(lower({value}), '^[^_-]*', 0)"
    return f"case when {head} in ({', '.join(map(quoted, LANGUAGES))}) then {head} when {head} = 'english' then 'en' when {head} in ('german', 'deutsch') then 'de' end"


def gold_type(label: str) -> str:
    """SQL: the type of a dataset label, or null."""
    bare = f"regexp_replace(regexp_replace(upper(trim({label})), '[^A-Z0-9]+', '_'), '^_+|_+$', '')"
    own = ", ".join(quoted(t[0]) for t in TYPES)
    cases = " ".join(f"when n in ({', '.join(map(quoted, v))}) then {quoted(k)}" for k, v in LABELS.items())
    return let(bare, "n", f"case when n in ({own}) then n {cases} end")


def gold_spans(text: str, spans: str) -> str:
    """SQL: gold spans in bytes, sorted, of source spans (start, end, label, value); unplaceable and unknown ones go.

    Declared positions count if they hold the value; else the value's first place does.
    """
    value = "nullif(s.value, '')"
    declared = f"s.start >= 0 and s.end > s.start and s.end <= char_length({text}) and coalesce(substring({text}, s.start + 1, s.end - s.start) = {value}, {value} is null)"
    at = f"case when {declared} then named_struct('a', s.start, 'b', s.end) when {value} is not null and instr({text}, {value}) > 0 then named_struct('a', instr({text}, {value}) - 1, 'b', instr({text}, {value}) - 1 + char_length({value})) end"
    byte = lambda x: f"octet_length(substring({text}, 1, {x}))"
    span = let(at, "p", f"if(p is null, null, named_struct('start', {byte('p.a')}, 'end', {byte('p.b')}, 'entity_type', {gold_type('s.label')}, 'text', substring({text}, p.a + 1, p.b - p.a)))")
    order = "case when a.start != b.start then a.start - b.start when a.end != b.end then a.end - b.end when a.entity_type < b.entity_type then -1 when a.entity_type > b.entity_type then 1 else 0 end"
    return f"array_sort(filter(transform({spans}, s -> {span}), g -> g is not null and g.entity_type is not null), (a, b) -> {order})"


def examples(records: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Corpus examples of dataset records; records without a text or a known language go."""
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    either = lambda a, b: f"coalesce(s.{a}, s.{b})"
    mask = f"transform(privacy_mask, s -> named_struct('start', {either('start', 'start_offset')}, 'end', {either('end', 'end_offset')}, 'label', coalesce(nullif(s.label, ''), nullif(s.entity_type, ''), s.type), 'value', coalesce(nullif(s.value, ''), s.text)))"
    labels = "transform(span_labels, s -> named_struct('start', try_cast(get(s, 0) as int), 'end', try_cast(get(s, 1) as int), 'label', get(s, 2), 'value', get(s, 3)))"
    empty = "cast(array() as array<struct<start:int,end:int,label:string,value:string>>)"
    rows = records.withColumn("_text", first("source_text", "unmasked_text", "original_text", "text")).withColumn("_lang", F.expr(language("coalesce(nullif(language, ''), nullif(lang, ''), locale)")))
    rows = rows.filter("_text is not null and _lang is not null").withColumn("_n", F.coalesce("sourceRow", "source_row", "_row")).withColumn("_id", F.coalesce(first("id", "uid", "record_id", "recordId"), F.col("_n").cast("string")))
    rows = rows.withColumn("goldSpans", F.expr(gold_spans("_text", f"coalesce({mask}, {labels}, {empty})")))
    source = F.struct(F.coalesce(first("dataset"), F.lit(dataset)).alias("dataset"), F.col("_id").alias("recordId"), F.coalesce(first("split"), F.lit("validation")).alias("split"), F.col("uid").alias("uid"), first("region").alias("region"), first("script").alias("script"), F.coalesce(first("sourceFile", "source_file"), F.col("_file")).alias("sourceFile"), F.col("_n").cast("int").alias("sourceRow"))
    return rows.select(F.concat_ws("-", F.lit("openpii"), "_lang", "_id").alias("id"), F.col("_lang").alias("language"), F.expr(length_bucket("_text")).alias("lengthBucket"), F.col("_text").alias("text"), "goldSpans", source.alias("source"))


def in_order(found: DataFrame) -> DataFrame:
    """Examples in the corpus's order: language, source file, source row, id."""
    return found.orderBy("language", F.coalesce("source.sourceFile", F.lit("")), "source.sourceRow", "id")


def first_examples(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` examples by source file and row."""
    return found.orderBy("source.sourceFile", "source.sourceRow", "id").limit(limit)


def _types(spans: str = "goldSpans") -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))


def summary(found: DataFrame) -> DataFrame:
    """dimension (language, bucket, type, negative, misc), value and number of examples, in one pass."""
    rows = found.select("language", "lengthBucket", _types().alias("types"))
    entry = lambda d, v: f"named_struct('dimension', '{d}', 'value', {v})"
    facts = f"concat(array({entry('language', 'language')}, {entry('bucket', 'lengthBucket')}), transform(types, t -> {entry('type', 't')}), if(size(types) = 0, array({entry('negative', quoted(''))}), cast(array() as array<struct<dimension:string,value:string>>)), if(array_contains(types, 'MISC'), array({entry('misc', quoted(''))}), cast(array() as array<struct<dimension:string,value:string>>)))"
    return rows.select(F.inline(F.expr(facts))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


class Coverage:
    """Quotas of the coverage sample and what they hold so far."""

    def __init__(self, limit: int, negative: int, misc: int) -> None:
        negative = min(negative, limit)
        misc = min(misc, limit - negative)
        plain = [f"{lang}:{b}" for lang in LANGUAGES for b in BUCKETS]
        typed = [f"{lang}:{t}:{b}" for lang in LANGUAGES for t in SUPPORTED for b in BUCKETS]
        self.limit, self.target = limit, {"negative": negative, "misc": misc, "supported": max(0, limit - negative - misc)}
        self.quota = {c: self._shares(self.target[c], keys) for c, keys in (("negative", plain), ("misc", plain), ("supported", typed))}
        self.held = {c: Counter() for c in self.target}

    @staticmethod
    def _shares(target: int, keys: list[str]) -> dict[str, int]:
        """Equal shares, the first keys one more; with fewer places than keys one each, while places last."""
        if target < len(keys):
            return dict.fromkeys(keys, 1 if target > 0 else 0)
        each, more = divmod(target, len(keys))
        return {k: each + (n < more) for n, k in enumerate(keys)}

    def has_room(self, category: str, key: str) -> bool:
        return self.held[category].total() < self.target[category] and self.held[category][key] < self.quota[category].get(key, 0)

    def room(self) -> list[tuple[str, str, int]]:
        """Category, key and open places of every key that can still take an example."""
        return [(c, k, min(q - self.held[c][k], self.target[c] - self.held[c].total())) for c, keys in self.quota.items() for k, q in keys.items() if self.has_room(c, k)]

    def take(self, lang: str, bucket: str, types: list[str]) -> bool:
        """Whether an example gets a place: of its keys with room, that with the fewest examples, the smallest quota, the first."""
        category = "negative" if not types else "misc" if "MISC" in types else "supported"
        keys = [f"{lang}:{bucket}"] if category != "supported" else [f"{lang}:{t}:{bucket}" for t in types if t in SUPPORTED]
        held, quota = self.held[category], self.quota[category]
        room = sorted((held[k], quota[k], k) for k in keys if held[k] < quota.get(k, 0))
        if not room or held.total() >= self.target[category]:
            return False
        held[room[0][2]] += 1
        return True


def coverage(found: DataFrame, limit: int = 500, negative: int = 25, misc: int = 50) -> DataFrame:
    """The coverage sample: in source order, examples fill quotas of negatives, of MISC and by language, type and length; those without a place fill what is left.

    Whether an example gets a place depends on all before it, but only examples with a key that has
    room can get one. So each round fetches, for every such key, as many of the next examples as the
    key has room for: these alone, at most ``limit`` and one for each key, go through the quotas in
    order, up to the place where one of the lists ends and its key still has room. Every round but the last
    gives at least one place, and no task sees more than its part of the examples.
    """
    order = ["file", "row", "id"]
    rows = found.select("id", "language", "lengthBucket", F.coalesce("source.sourceFile", F.lit("")).alias("file"), F.col("source.sourceRow").alias("row"), _types().alias("types"))
    plain, typed = F.concat("language", F.lit(":"), "lengthBucket"), F.transform(F.array_intersect("types", F.array(*map(F.lit, SUPPORTED))), lambda t: F.concat("language", F.lit(":"), t, F.lit(":"), "lengthBucket"))
    category = F.when(F.size("types") == 0, "negative").when(F.array_contains("types", "MISC"), "misc").otherwise("supported")
    rows = materialise(rows.withColumn("category", category).withColumn("keys", F.when(F.col("category") == "supported", typed).otherwise(F.array(plain))), "coverage")
    spark, quotas, taken, cursor = found.sparkSession, Coverage(limit, negative, misc), [], None
    while open_ := quotas.room():
        here = rows.withColumn("at", F.struct(*order)).withColumn("key", F.explode("keys"))
        if cursor is not None:
            here = here.filter(F.col("at") > F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, cursor, strict=True))))
        table = spark.createDataFrame(open_, "category string, key string, room int")  # a row per key at most
        rank = F.row_number().over(Window.partitionBy("category", "key").orderBy(*order))
        near = here.join(F.broadcast(table), ["category", "key"]).withColumn("rank", rank).filter("rank <= room")
        near = near.select(*order, "language", "lengthBucket", "types", "category", "key", (F.col("rank") == F.col("room")).alias("last")).collect()
        if not near:
            break
        lists: dict[tuple, list] = {}
        for r in near:
            lists.setdefault(tuple(r[c] for c in order), []).append(r)
        stopped = False
        for at in sorted(lists, key=lambda a: [(x is not None, x) for x in a]):
            r = lists[at][0]
            if quotas.take(r.language, r.lengthBucket, r.types):
                taken.append(r.id)
            if any(x.last and quotas.has_room(x.category, x.key) for x in lists[at]):
                cursor, stopped = at, True
                break
        if not stopped:
            break
    # what is left goes to the first examples without a place
    spare = [r.id for r in rows.select(*order).orderBy(*order).limit(2 * limit).collect()]
    held = set(taken)
    chosen = spark.createDataFrame([(x,) for x in (taken + [x for x in spare if x not in held])[:limit]], "id string")
    return found.join(F.broadcast(chosen), "id", "left_semi")

"""Queries of corpora, reports, reviewers' decisions, maps, vault upkeep and model tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import decide, ner, policy, report, restore, scope, score, settings, tokens, vault
from maskwright.operators import detect as D
from maskwright.plans import oracle as O
from maskwright.plans.registry import _DIM, _GOLD, _LETTERS, _METRICS, _NAMES, derived, documents, found, letters, query, read
from maskwright.scratch import materialise
from maskwright.sources import dataset

_OF = f"with recursive {O.detected()}"
_LEAST = "(least(1.0, baseline + delta) - {0} * (least(1.0, baseline + delta) - greatest(0.0, baseline - delta)))"


# Detection in SQL, thresholds by row -------------------------------------------------------------


@query(f"{_OF} select doc_id, span_idx, start, \"end\", entity_type, round(score, 6) as score, text, source from det")
def sql_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over all documents."""
    D.register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("documents_to_scan")
    return spark.sql("select d.doc_id, s.span_idx, s.start, s.end, s.entity_type, round(s.score, 6) as score, s.text, s.source from documents_to_scan d, lateral pii_spans(d.text) s")


@query(f"{_OF} select det.doc_id % 11 as slider, det.entity_type, count(*) as n from det join {_DIM} on d.entity_type = det.entity_type where score >= {_LEAST.format('(det.doc_id % 11) / 10.0')} group by all")
def slider_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that each document's own slider position keeps, by position and type."""
    df = D.detect(documents(spark, sf_dir)).withColumn("spans", F.expr(policy.slider_filter("spans", "((doc_id % 11) / 10.0D)")))
    return D.exploded(df, "doc_id").groupBy((F.col("doc_id") % 11).alias("slider"), "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_OF} select doc_id, det.entity_type, text from det join {_DIM} on d.entity_type = det.entity_type where det.entity_type in ({O.groups_on()}) and score >= case det.entity_type when 'EMAIL' then 0.97 when 'PHONE' then 0.8 else {_LEAST.format('0.5')} end")
def adaptive_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review chain with thresholds learned for two types."""
    df = policy.review(D.detect(documents(spark, sf_dir)), adaptive={"EMAIL": 0.97, "PHONE": 0.8})
    return D.exploded(df, "doc_id").select("doc_id", "entity_type", "text")


@query(f"with recursive {O.DERIVED}, {O.detected('derived')} select doc_id, span_idx, text from det where not (entity_type = 'EMAIL' and text like '%@mail.example.org')")
def allow_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that lie in no allowlisted stretch: the addresses stand inside a longer pattern's matches."""
    df = D.detect(derived(spark, sf_dir))
    # the index is the span's place before the allowlist
    df = df.withColumn("spans", F.expr("transform(spans, (s, i) -> named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'score', s.score, 'text', s.text, 'source', s.source, 'cs', s.cs, 'ce', s.ce, 'seq', i))"))
    kept = df.select("doc_id", F.explode(F.expr(policy.allow("spans", "text", ["at *@mail.example.org"]))).alias("s"))
    return kept.select("doc_id", F.col("s.seq").alias("span_idx"), F.col("s.text").alias("text"))


@query(f"with recursive {O.DERIVED}, {O.detected('derived')} select doc_id, start, entity_type, text, source from det union all select doc_id, cast(strlen(substr(text, 1, strpos(text, 'client') - 1)) as integer), 'MISC', 'client', 'manual' from derived where strpos(text, ' client ') > 0")
def block_over_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocklisted addresses that are detected already keep their one span; other matches add theirs."""
    df = D.detect(derived(spark, sf_dir)).withColumn("spans", F.expr(policy.block("spans", "text", [("*@mail.example.org", "EMAIL"), ("Client", "any")])))
    return D.exploded(df, "doc_id").select("doc_id", "start", "entity_type", "text", "source")


# Decisions ---------------------------------------------------------------------------------------

_DECIDED = f"""decided as (select det.doc_id, det.span_idx, det.start, det."end", det.text, case when (det.doc_id + span_idx) % 5 = 0 then 'MISC' else det.entity_type end as entity_type,
    case when (det.doc_id + span_idx) % 7 = 0 then false when (det.doc_id + span_idx) % 7 = 1 then true else score >= greatest(0.7, {_LEAST.format('0.5')}) end as enabled, det.entity_type as detected_type from det join {_DIM} on d.entity_type = det.entity_type)"""


def _decisions(spans: DataFrame) -> DataFrame:
    n = (F.col("doc_id") + F.col("span_idx")) % 7
    return spans.select("doc_id", "span_idx", F.when(n < 2, n == 1).alias("enabled"), F.when((F.col("doc_id") + F.col("span_idx")) % 5 == 0, "MISC").alias("new_type"), F.lit(1).alias("seq"))


@query(f"{_OF}, {_DECIDED} select doc_id, span_idx, entity_type, enabled from decided")
def decided_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = found(spark, sf_dir)
    return decide.decided(spans, _decisions(spans), 0.7).select("doc_id", "span_idx", "entity_type", "enabled")


_MANUAL = "manual as (select doc_id, cast(strlen(substr(text, 1, strpos(text, word) - 1)) as integer) as start, cast(strlen(substr(text, 1, strpos(text, word) - 1)) + strlen(word) as integer) as \"end\", 'PERSON' as entity_type, word as text from (select doc_id, coalesce(text, '') as text, lang as word from documents) where strpos(text, word) > 0)"


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each document's language code in its text, as a span by hand."""
    df = documents(spark, sf_dir).select("doc_id", F.expr(decide.by_hand("coalesce(text, '')", "lang", "'PERSON'")).alias("s")).filter("s is not null")
    return df.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("text"))


@query(f"with {_MANUAL} select * from manual")
def manual_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manual(spark, sf_dir)


@query(f"{_OF}, {_DECIDED}, {_MANUAL} select doc_id, start, \"end\", entity_type, text, 'detected' as origin from decided where enabled union all select doc_id, start, \"end\", entity_type, text, 'manual' from manual")
def confirmed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = found(spark, sf_dir)
    return decide.confirmed(decide.decided(spans, _decisions(spans), 0.7), _manual(spark, sf_dir))


@query(
    f"""{_OF}, {_DECIDED}, k as (select d.doc_id, span_idx, d.text, detected_type, case when entity_type != detected_type then entity_type when (d.doc_id + span_idx) % 7 = 0 then 'NOT_PII' end as corrected_type,
    coalesce(x.text, '') as body, cast(length(decode(encode(coalesce(x.text, ''))[1:start])) as bigint) as cs from decided d join documents x on x.doc_id = d.doc_id)
    select doc_id, span_idx, text, detected_type, corrected_type, substr(body, greatest(cs - 20, 0) + 1, cs + length(text) + 20 - greatest(cs - 20, 0)) as context from k where corrected_type is not null"""
)
def decision_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log receives: dismissed and retyped spans with twenty characters on both sides."""
    df = D.detect(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("body")), text="body")
    spans = df.select("doc_id", "body", F.posexplode("spans").alias("span_idx", "s")).select("doc_id", "span_idx", "body", F.col("s.text").alias("text"), F.col("s.entity_type").alias("entity_type"), F.col("s.cs").alias("cs"), F.col("s.ce").alias("ce"))
    return decide.feedback(spans, _decisions(spans)).drop("seq")


@query(f"{_OF} select doc_id, span_idx, '[' || entity_type || '_' || row_number() over (partition by doc_id, entity_type order by start) || ']' as placeholder from det")
def preview_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.preview(found(spark, sf_dir)).select("doc_id", "span_idx", "placeholder")


@query(
    f"""{_OF}, {O.VAULT}, half as (select * from vault where n % 2 = 0), given as (select entity_type, max(n) as g from half group by entity_type),
    k as (select d.doc_id, d.span_idx, d.entity_type, {O.key('d.text')} as nk, d.start from det d), f as (select k.*, h.placeholder as known from k left join half h on h.entity_type = k.entity_type and h.normalized_key = k.nk),
    fresh as (select doc_id, entity_type, nk, row_number() over (partition by doc_id, entity_type order by min(start)) as r from f where known is null group by doc_id, entity_type, nk)
    select f.doc_id, f.span_idx, coalesce(known, '[' || f.entity_type || '_' || (r + coalesce(g, 0)) || ']') as placeholder from f left join fresh on fresh.doc_id = f.doc_id and fresh.entity_type = f.entity_type and fresh.nk = f.nk left join given on given.entity_type = f.entity_type"""
)
def preview_with_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that a preview shows beside a vault that has every second identity."""
    spans = materialise(found(spark, sf_dir), "spans")
    known = vault.identities(spans).filter("n % 2 = 0")
    return vault.preview_identities(spans, known).select("doc_id", "span_idx", "placeholder")


@query("select c_custkey % 50 as conv, c_nationkey as token from customer where c_custkey % 3 = 0 and c_custkey % 50 not in (select s_suppkey % 50 from supplier where s_suppkey % 4 = 0) group by all")
def ledger_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries that a session owns, without the conversations that have a record."""
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("conv"), F.col("c_nationkey").alias("token"), "c_custkey")
    entries = rows.select("conv", "token").distinct()
    mine = scope.owned(entries, rows.filter("c_custkey % 3 = 0"))
    recorded = read(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select((F.col("s_suppkey") % 50).alias("conv"))
    return scope.ledger_kept(mine, recorded)


# Maps and the vault ------------------------------------------------------------------------------

_MAP = f"""own as (select doc_id, text, arg_min(entity_type, start) as entity_type, min(start) as first from det group by doc_id, text),
    tokens as (select *, '[' || entity_type || '_' || row_number() over (partition by doc_id, entity_type order by first) || ']' as token from own),
    pieces as (select d.doc_id, d.start, d."end", coalesce(lag(d."end") over (partition by d.doc_id order by d.start), 0) as before, t.token as value, x.text as body from det d join tokens t on t.doc_id = d.doc_id and t.text = d.text join documents x on x.doc_id = d.doc_id),
    joined as (select doc_id, any_value(body) as body, max("end") as last, string_agg(decode(encode(body)[before + 1:start]) || value, '' order by start) as head from pieces group by doc_id)"""


def _by_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return restore.by_map(D.detect(docs))


@query(f"{_OF}, {_MAP} select d.doc_id, sha256(coalesce(j.head || decode(encode(j.body)[j.last + 1:]), d.text, '')) as digest from documents d left join joined j using (doc_id)")
def anonymize_by_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a map of its own, keyed by the exact text."""
    return _by_map(spark, sf_dir)[0].select("doc_id", F.sha2("anonymized", 256).alias("digest"))


@query("select doc_id, sha256(coalesce(text, '')) as digest from documents")
def restore_by_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document's placeholders lose their brackets' form before both passes restore them."""
    anon, maps = _by_map(spark, sf_dir)
    mangled = F.when(F.col("doc_id") % 2 == 0, F.expr(f"regexp_replace(anonymized, {T.quoted(restore.CANONICAL)}, '[$1 $2]')")).otherwise(F.col("anonymized"))
    return restore.restore_twice(anon.withColumn("response", mangled), maps, "doc_id", "response").select("doc_id", F.sha2("restored", 256).alias("digest"))


@query(
    f"""{_OF}, k as (select entity_type, {O.key('text')} as normalized_key, doc_id, start, text from det) select entity_type, normalized_key, coalesce(arg_min(text, doc_id * 10000000 + start) filter (doc_id % 2 = 0), arg_min(text, doc_id * 10000000 + start)) as original_text,
    count(*) as usage_count, min(doc_id) as created_at, max(doc_id) as last_seen_at from k group by all"""
)
def vault_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault of even documents after the odd ones were seen; document ids stand for times."""
    spans = materialise(found(spark, sf_dir), "spans")
    last = spans.withColumn("normalized_key", F.expr(T.normalized_key("text"))).groupBy("entity_type", "normalized_key", F.col("doc_id") % 2).agg(F.max("doc_id").alias("last_seen_at"))

    def seen(odd: int) -> DataFrame:
        part = spans.filter(F.col("doc_id") % 2 == odd)
        ends = last.filter(last[2] == odd).select("entity_type", "normalized_key", "last_seen_at")
        return vault.identities(part).withColumn("created_at", F.col("first_doc")).join(ends, ["entity_type", "normalized_key"])

    before = seen(0).withColumn("mode", F.lit(None).cast("string")).withColumn("pinned", F.lit(False))
    return vault.upsert(before, seen(1)).select("entity_type", "normalized_key", "original_text", "usage_count", "created_at", "last_seen_at")


@query(f"{_OF}, {O.VAULT} select entity_type, max(n) as n from vault where n % 2 = 0 or n % 3 = 0 group by entity_type")
def vault_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers given on either side of an import."""
    every = materialise(vault.identities(found(spark, sf_dir)).select("entity_type", "n"), "numbers")
    return vault.counters(every.filter("n % 2 = 0"), every.filter("n % 3 = 0"))


@query(f"{_OF}, {O.VAULT}, e as (select entity_type, n, placeholder, synthetic_value, case when n % 5 = 1 then 'synthetic' end as mode, n % 4 = 2 as pinned from vault where n % 7 != 3) select entity_type, n, case when mode = 'synthetic' and synthetic_value != '' then synthetic_value else placeholder end as replacement, pinned from e")
def vault_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after some were deleted, pinned and set to synthetic mode, with what each is replaced by."""
    known = materialise(vault.identities(found(spark, sf_dir)).withColumn("mode", F.lit(None).cast("string")).withColumn("pinned", F.lit(False)), "vault")
    n = F.col("n")
    changes = known.select("entity_type", "normalized_key", (n % 7 == 3).alias("deleted"), F.when(n % 5 == 1, "synthetic").alias("mode"), F.when(n % 4 == 2, True).alias("pinned"))
    return vault.edited(known, changes).select("entity_type", "n", vault.replacement().alias("replacement"), "pinned")


@query("select c_custkey from customer where c_custkey % 6 = 0")
def list_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of one list that stand in the other in another form."""
    rows = read(spark, sf_dir, "customer")
    one = rows.filter("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("  "), F.upper("c_name"), F.lit(" \t")).alias("pattern"))
    two = rows.filter("c_custkey % 3 = 0").select(F.lower("c_name").alias("pattern"))
    return settings.conflicts(one, two).select("c_custkey")


@query("select page_id, coalesce(starts_with(url, 'https://') or starts_with(url, 'http://www'), false) as curated from pages")
def curated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", settings.curated(F.col("url"), ["https://", "http://www"]).alias("curated"))


@query("select conv_id, turn, list_filter(['the', role, 'und', ''], lambda t: t != '' and contains(coalesce(text, ''), t)) as shown from conversations")
def visible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.expr(restore.visible("coalesce(text, '')", "array('the', role, 'und', '')")).alias("shown"))


_STATES = "case when doc_id % 4 = 0 then 'too-large' when doc_id % 4 = 1 then 'no-text' else 'scanned' end"


@query(
    f"""{_OF}, s as (select doc_id, {_STATES} as status, n_chars > 2000 as truncated from documents), f as (select doc_id, count(*) as n from det group by doc_id)
    select s.doc_id, coalesce(f.n, 0) as n_findings, case status when 'too-large' then 'Not checked: the file is too large to scan.' when 'no-text' then 'Not checked: the file contains no readable text. Scanned documents and images are not read (no OCR).'
    else case when truncated then 'Only the first part of this file was checked.' end end as notice from s left join f using (doc_id) where coalesce(f.n, 0) > 0 or status != 'scanned'"""
)
def file_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scanned files: those with findings or without a scan, with their notices."""
    df = D.detect(documents(spark, sf_dir).select("doc_id", "text", "n_chars"))
    rows = df.select("doc_id", F.expr(_STATES).alias("status"), (F.col("n_chars") > 2000).alias("truncated"), F.size("spans").cast("long").alias("n_findings"))
    return settings.notices(rows).select("doc_id", "n_findings", "notice")


# Corpora and reports -----------------------------------------------------------------------------

_TAG = "case c_custkey % 5 when 0 then 'en-US' when 1 then 'German' when 2 then 'fr' when 3 then 'de_AT' else 'English' end"
_VALUE = "case d.doc_id % 4 when 0 then substr(d.text, 5, 11) when 1 then substr(d.text, 12, 22) when 2 then substr(d.text, 6, 19) else '+1-212-555-' || lpad(cast(d.doc_id % 10000 as varchar), 4, '0') end"
_RECORDS = f"""{O.DERIVED}, rec as (select d.doc_id, d.text, {_TAG.replace('c_custkey', 'd.doc_id')} as tag, {_VALUE} as value from derived d),
    ex as (select doc_id, text, case when tag in ('en-US', 'English') then 'en' else 'de' end as language, case when length(text) <= 120 then 'short' when length(text) <= 260 then 'medium' else 'long' end as bucket,
        case doc_id % 4 when 0 then 'SSN' when 1 then 'IBAN' when 2 then null else 'PHONE' end as entity_type, value, strpos(text, value) - 1 as pos from rec where tag != 'fr')"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of dataset records over customers' texts: right, missing and wrong offsets, an unknown label."""
    value = _VALUE.replace("d.", "").replace("varchar", "string")
    rows = derived(spark, sf_dir).withColumn("value", F.expr(value)).withColumn("tag", F.expr(_TAG.replace("c_custkey", "doc_id")))
    at = "instr(text, value) - 1"
    span = f"""case doc_id % 4 when 0 then named_struct('start', cast({at} as int), 'end', cast({at} as int) + char_length(value), 'label', ' social-security number', 'value', value)
        when 1 then named_struct('start', cast(null as int), 'end', cast(null as int), 'label', 'iban', 'value', value) when 2 then named_struct('start', 0, 'end', 4, 'label', 'shoe size', 'value', value)
        else named_struct('start', 0, 'end', 5, 'label', 'Phone Number', 'value', value) end"""
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("source_text"), F.col("tag").alias("language"), F.array(F.expr(span)).alias("privacy_mask")))
    records = rows.select(F.from_json(record, dataset.RECORD).alias("r"), F.col("doc_id").alias("_row")).select("r.*", F.lit("customers").alias("_file"), "_row")
    return dataset.examples(records)


@query(
    f"""with {_RECORDS} select 'openpii-' || language || '-' || doc_id as id, language, bucket as length_bucket, case when entity_type is null then 0 else 1 end as n_gold, entity_type,
    case when entity_type is not null then cast(strlen(substr(text, 1, pos)) as integer) end as start, case when entity_type is not null then cast(strlen(substr(text, 1, pos)) + strlen(value) as integer) end as "end" from ex"""
)
def dataset_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir).withColumn("g", F.get("goldSpans", F.lit(0)))
    return rows.select("id", "language", F.col("lengthBucket").alias("length_bucket"), F.size("goldSpans").alias("n_gold"), F.col("g.entity_type").alias("entity_type"), F.col("g.start").alias("start"), F.col("g.end").alias("end"))


@query(
    f"""with {_RECORDS} select 'language' as dimension, language as value, count(*) as n from ex group by all union all select 'bucket', bucket, count(*) from ex group by all
    union all select 'type', entity_type, count(*) from ex where entity_type is not null group by all union all select 'negative', '', count(*) from ex where entity_type is null having count(*) > 0"""
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.summary(_examples(spark, sf_dir))


@query(f"with {_RECORDS} select 'openpii-' || language || '-' || doc_id as id from ex order by doc_id, id limit 50")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_examples(_examples(spark, sf_dir), 50).select("id")


@query()
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-dependent coverage sample of the examples."""
    return dataset.coverage(materialise(_examples(spark, sf_dir), "examples"), limit=120).select("id", "language", "lengthBucket")


_BUCKET = "case when length(coalesce(text, '')) <= 120 then 'short' when length(coalesce(text, '')) <= 260 then 'medium' else 'long' end"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.detect(documents(spark, sf_dir), out="found").withColumn("bucket", F.expr(T.length_bucket("coalesce(text, '')")))
    kind = "case when doc_id % 11 = 0 then 'MISC' when i % 3 = 2 then 'PERSON' else s.entity_type end"
    gold = f"filter(transform(found, (s, i) -> named_struct('start', s.start - cast(doc_id % 4 as int), 'end', s.end, 'entity_type', {kind}, 'text', s.text, 'keep', (doc_id + i) % 5 != 0)), g -> g.keep)"
    return docs.withColumn("gold", F.expr(gold))


@query(
    f"""{_OF}, {_GOLD}, b as (select doc_id, {_BUCKET} as bucket from documents), h as (select seg.lang, b.bucket, outcome from seg join b using (doc_id) left join flat using (doc_id) where segment = 'headline'),
    c as (select '' as dimension, '' as value, outcome from h union all select 'lang', lang, outcome from h union all select 'bucket', bucket, outcome from h),
    t as (select dimension, value, count(*) filter (outcome = 'TP') as tp, count(*) filter (outcome = 'FP') as fp, count(*) filter (outcome = 'FN') as fn from c group by all), m as (select *, {_METRICS} from t)
    select dimension, value, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1 from m"""
)
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline figures as a whole, by language and by length, in one pass."""
    facts = score.outcomes(_facts(spark, sf_dir), "doc_id", keep=("lang", "bucket"))
    out = report.metrics(facts, "lang", "bucket")
    return out.select("dimension", "value", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{_OF}, {_GOLD} select d.doc_id, count(*) filter (outcome = 'TP') as matched, count(*) filter (outcome = 'FN') as missed, count(*) filter (outcome = 'FP') as wrong from documents d left join flat f on f.doc_id = d.doc_id group by d.doc_id")
def report_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.by_example(_facts(spark, sf_dir), "doc_id")
    size = lambda c: F.size(c).cast("long")
    return out.select("doc_id", size("matches").alias("matched"), size("false_negatives").alias("missed"), size("false_positives").alias("wrong"))


def _flat(column: str) -> str:
    """The key of a text without its lower case."""
    return O.key(column).removeprefix("lower")


@query(
    f"""{_OF}, k as (select d.doc_id, d.span_idx, {_flat("coalesce(x.text, '')")} as t, {_flat('d.text')} as s from det d join documents x on x.doc_id = d.doc_id), p as (select *, strpos(t, s) as i from k)
    select doc_id, span_idx, case when i > 0 then case when i - 1 > 48 then '...' else '' end || substr(t, greatest(i - 48, 1), i - greatest(i - 48, 1) + length(s) + 48) || case when i - 1 + length(s) + 48 < length(t) then '...' else '' end
    when length(t) <= 96 then t else substr(t, 1, 93) || '...' end as context from p"""
)
def span_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detected span in its compacted surroundings."""
    df = D.detect(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("body")), text="body")
    # one text is compacted once, whatever the number of its spans
    df = df.select("doc_id", F.expr(report.compact("body")).alias("body"), F.posexplode("spans").alias("span_idx", "s"))
    return df.select("doc_id", "span_idx", F.expr(report.context("body", "s.text")).alias("context"))


@query(f"{_OF}, {_GOLD}, m as (select g.doc_id, g.span_idx from gold g where is_gold and not (shift <= 2 and len / (len + shift) >= 0.8)) select doc_id as example, entity_type, count(*) as n from (select g.doc_id, g.gold_type as entity_type from gold g join m on m.doc_id = g.doc_id and m.span_idx = g.span_idx order by g.doc_id, g.span_idx limit 200) group by all")
def missed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two hundred false negatives, counted by example and type."""
    rows = report.samples(report.by_example(_facts(spark, sf_dir), "doc_id"), "false_negatives", 200, order="doc_id")
    return rows.groupBy("example", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_OF}, k as (select doc_id, entity_type, count(*) as n, min(span_idx) as first, list(trim(text) order by span_idx) as texts from det group by all)
    select doc_id, entity_type, n, array_to_string(list_slice(list_filter(texts, lambda x, i: list_position(texts, x) = i), 1, 3), '|') as examples, row_number() over (partition by doc_id order by n desc, first) as place from k"""
)
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings(found(spark, sf_dir), "doc_id").withColumn("examples", F.array_join("examples", "|"))


# Tokens ------------------------------------------------------------------------------------------


@query(r"""with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from documents) select doc_id, len(w) as n_pieces, len(w) as n_placed, 1.0 as placed, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as covered from w""")
def aligned_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case pieces, one for each word of a text, placed in it again."""
    words = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+', 0)"
    df = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(f"transform({words}, w -> concat('▁', lower(w)))").alias("pieces"))
    out = tokens.aligned(df)
    covered = "aggregate(filter(places, p -> p is not null), 0L, (a, p) -> a + p.end - p.start)"
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.expr("size(filter(places, p -> p is not null))").cast("long").alias("n_placed"), "placed", F.expr(covered).alias("covered"))


#: Letters with accents as the texts have them, and without.
_ACCENTS = ("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
_BARE = f"translate(lower({{0}}), '{_ACCENTS[0]}', '{_ACCENTS[1]}')"


@query(
    rf"""with t as (select doc_id, coalesce(text, '') as t from documents), l as (select doc_id, t, regexp_extract_all(t, '[^ \t\n\r]+') as w, string_split_regex(t, '[^ \t\n\r]+') as g from t),
    r as (select doc_id, k, w[k] as w, {_BARE.format('w[k]')} as f, {_BARE.format('w[k + 1]')} as nf, length(g[k]) as gap from l, unnest(range(1, len(w) + 1)) as u(k)),
    a as (select *, sum(gap + length(w)) over (partition by doc_id order by k) - length(w) as o, (k - 1) % 7 = 3 and nf is not null and length(w) <= 40 and strpos(f || ' ' || nf, substr(nf, 1, 4)) = length(f) + 2 as lost from r),
    c as (select doc_id, sum(case when length(f) > 4 and not lost then 2 else 1 end) as n_pieces, count(*) filter (lost) as n_lost, sum(length(w)) filter (not lost) as covered,
        sum(case when lost then 0 when length(f) > 4 then (o + o + 4) + (o + 4 + o + length(w)) else o + o + length(w) end) as places from a group by doc_id)
    select t.doc_id, cast(coalesce(n_pieces, 0) as bigint) as n_pieces, cast(coalesce(n_pieces - n_lost, 0) as bigint) as n_placed, round(coalesce((n_pieces - n_lost) / n_pieces, 1), 6) as placed, cast(coalesce(covered, 0) as bigint) as covered, cast(coalesce(places, 0) as bigint) as places from t left join c using (doc_id)"""
)
def aligned_lost_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces without accents, words cut in two, some words lost: all others find their place again."""
    words = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+', 0)"
    f, nf = _BARE.format("w"), _BARE.format("get(ws, k + 1)")
    lost = f"k % 7 = 3 and get(ws, k + 1) is not null and char_length(w) <= 40 and locate(substring({nf}, 1, 4), concat({f}, ' ', {nf})) = char_length({f}) + 2"
    cut = f"case when {lost} then array('⁇') when char_length({f}) > 4 then array(substring({f}, 1, 4), concat('##', substring({f}, 5))) else array({f}) end"
    pieces = T.let(words, "ws", f"flatten(transform(ws, (w, k) -> {cut}))")
    out = tokens.aligned(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(pieces).alias("pieces")))
    total = lambda x: F.expr(f"aggregate(filter(places, p -> p is not null), 0L, (a, p) -> a + {x})")
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.expr("size(filter(places, p -> p is not null))").cast("long").alias("n_placed"), F.round("placed", 6).alias("placed"), total("p.end - p.start").alias("covered"), total("p.end + p.start").alias("places"))


_PIECES = r"[ \t\n\r]*([\pL\pN_]{1,6}|[^\pL\pN_ \t\n\r])"


@query(
    rf"""with t as (select doc_id, coalesce(text, '') as t from documents), l as (select doc_id, t, regexp_extract_all(t, '{_PIECES}') as w from t),
    r as (select doc_id, n, i, sum(length(x)) over (partition by doc_id order by i) - length(ltrim(x, ' ' || chr(9) || chr(10) || chr(13))) as o from (select doc_id, len(w) as n, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from l)),
    c as (select a.doc_id, x.t, a.i // 416 as chunk, case when a.i = 0 then 0 else a.o end as s, coalesce(b.o, length(x.t)) as e from r a join t x on x.doc_id = a.doc_id left join r b on b.doc_id = a.doc_id and b.i = a.i + 480 where a.i % 416 = 0 and (a.i = 0 or a.i + 64 < a.n))
    select doc_id, cast(chunk as integer) as chunk, cast(s as integer) as start_char, cast(e as integer) as end_char, cast(strlen(substr(t, 1, cast(s as bigint))) as integer) as start_byte, cast(strlen(substr(t, 1, cast(e as bigint))) as integer) as end_byte from c"""
)
def token_chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 480 pieces with an overlap of 64; a piece is a mark or at most six letters, a word's first opens it."""
    raw = f"regexp_extract_all(coalesce(text, ''), {T.quoted(_PIECES.replace(chr(92) + 'pL', chr(92) + 'p{L}').replace(chr(92) + 'pN', chr(92) + 'p{N}'))}, 0)"
    pieces = f"transform({raw}, (m, i) -> concat(if(i = 0 or rlike(m, '^[ \\\\t\\\\n\\\\r]'), '▁', ''), ltrim(' \\t\\n\\r', m)))"
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.expr(pieces).alias("pieces"))
    return tokens.chunked(tokens.aligned(rows, framed=False)).withColumnRenamed("key", "doc_id").drop("text")


_LEAST_SCORES = {"EMAIL": 0.8, "PHONE": 0.5, "SSN": 0.5, "PERSON": 0.55, "LOCATION": 0.55, "ORGANIZATION": 0.5}


@query(
    f"""with {O.DERIVED}, p as (select doc_id, text, doc_id % 4 as k, strlen(substr(text, 1, strpos(text, 'user') - 1)) as u, strlen(substr(text, 1, strpos(text, '+1-212') - 1)) as f from derived)
    select doc_id, 'EMAIL' as entity_type, 'user' || doc_id || '@mail.example.org' as text, cast(u as integer) as start, 0.9::double as score from p where k = 3
    union all select doc_id, 'ORGANIZATION', 'or', cast(u + strlen('user' || doc_id || '@mail.example.org ') as integer), 0.6 from p where k = 3
    union all select doc_id, 'PHONE', substr(text, strpos(text, '+1-212'), 15), cast(f as integer), 0.7 from p where k = 3
    union all select doc_id, 'SSN', substr(text, 5, 11), 4, 0.9 from p where k = 0 and doc_id % 8 = 4
    union all select doc_id, 'SSN', substr(text, 5, 3), 4, 0.9 from p where doc_id % 8 = 0
    union all select doc_id, 'PERSON', substr(text, 8, 4), 7, 0.9 from p where doc_id % 8 = 0
    union all select doc_id, 'SSN', substr(text, 12, 4), 11, 0.5 from p where doc_id % 8 = 0
    union all select doc_id, 'LOCATION', unnest(['Zahlung', 'an']), unnest([0, 8]), 0.9 from p where k = 1"""
)
def repaired_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split predictions over customers' texts: halves rejoined or held apart by a rival, an address given its domain."""
    at = lambda part, more="0": f"octet_length(substring(text, 1, instr(text, {part}) - 1)) + {more}"
    span = lambda start, size, kind, score: f"named_struct('start', cast({start} as int), 'end', cast({start} + {size} as int), 'entity_type', '{kind}', 'score', {score}, 'text', '', 'source', 'ner')"
    user = "concat('user', doc_id, '@')"
    mail = f"array({span(at(user), f'length({user})', 'EMAIL', '0.9D')}, {span(at(user, f'length({user})'), '19', 'ORGANIZATION', '0.6D')}, {span(at(T.quoted('+1-212')), '6', 'PHONE', '0.7D')}, {span(at(T.quoted('+1-212'), '6'), '9', 'PHONE', '0.4D')})"
    number = f"array({span('4', '3', 'SSN', '0.9D')}, {span('7', '4', 'PERSON', 'if(doc_id % 8 = 0, 0.9D, 0.3D)')}, {span('11', '4', 'SSN', '0.5D')})"
    place = f"array({span('0', '7', 'LOCATION', '0.9D')}, {span('8', '2', 'LOCATION', '0.9D')})"
    rows = derived(spark, sf_dir).withColumn("ner", F.expr(f"case doc_id % 4 when 0 then {number} when 1 then {place} when 2 then filter({place}, x -> false) else {mail} end"))
    out = tokens.repaired(rows, "ner", least=_LEAST_SCORES)
    return D.exploded(out, "doc_id", spans="ner").select("doc_id", "entity_type", "text", "start", "score")


@query(
    rf"""with {_LETTERS}, n as (select doc_id, text, {_NAMES}[cast(o_orderkey % 12 as bigint) + 1] as a, {_NAMES}[cast(o_custkey % 12 as bigint) + 1] as b from letters join orders on o_orderkey = doc_id)
    select doc_id, 'PERSON' as entity_type, a as text, 10 as start, 0.8::double as score from n
    union all select doc_id, 'USERNAME', b, cast(10 + length(a) + 10 as integer), 0.7 from n
    union all select doc_id, 'PHONE', substr(text, length(text) - 11), cast(length(text) - 12 as integer), 0.9 from n"""
)
def searched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without offsets, spelled as models write them, found in order in letters."""
    names = "array(" + ", ".join(T.quoted(t) for t, _, _ in ner.ENTITIES) + ")"
    pick = lambda x: f"element_at({names}, cast({x} % 12 as int) + 1)"
    item = lambda word, kind, score: f"named_struct('word', {word}, 'entity_type', '{kind}', 'score', {score})"
    spaced = f"regexp_replace(lower({pick('o_custkey')}), '([_@:/.-])', ' $1 ')"
    items = f"array({item(f'concat({T.quoted(tokens.INNER_MARK)}, {pick("doc_id")})', 'PERSON', '0.8D')}, {item(spaced, 'USERNAME', '0.7D')}, {item(T.quoted('absent'), 'PERSON', '1D')}, {item(T.quoted('212 - 555'), 'PHONE', '0.6D')}, {item('right(text, 4)', 'PHONE', '0.9D')})"
    rows = letters(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id")
    found_ = rows.select("doc_id", "text", F.explode(F.expr(tokens.searched(items, "text"))).alias("s"))
    return found_.select("doc_id", F.col("s.entity_type").alias("entity_type"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"), F.col("s.start").alias("start"), F.col("s.score").alias("score"))

"""The registered queries over the given tables and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import text as T
from maskwright.operators import detect as D
from maskwright.operators import ner, policy, restore, scope, score, vault
from maskwright.plans import oracle as O
from maskwright.schema import RECOGNIZERS, TYPES, Sensitivity
from maskwright.scratch import materialise, scratch_path
from maskwright.sources import pages
from maskwright.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str, most: float = 2) -> DataFrame:
    """Rows dealt out by a hash where the files give a task more than ``most`` times a core's share: a row group is read by one task.

    Narrow rows that are searched for long are worth a shuffle sooner: with ``most`` 0.5 no core works
    more than one and a half times its share.
    """
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if not sizes or max(sizes) * cores <= most * sum(sizes):
        return rows
    return rows.repartition(min(4 * cores, sum(sizes) // 256 + 1), F.xxhash64(*keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "documents"), "doc_id", "text")


def found(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return D.exploded(D.detect(documents(spark, sf_dir)), "doc_id", *keys)


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per customer with an SSN, IBAN, card or contact, some of them invalid."""
    pad = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
    k = "c_custkey"
    text = f"""case {k} % 4
        when 0 then concat('ssn ', {pad(f'{k} * 7919 % 1000', 3)}, '-', {pad(f'{k} * 104729 % 100', 2)}, '-', {pad(f'{k} * 1299709 % 10000', 4)}, ' of client ', c_name)
        when 1 then concat('Zahlung an DE', {pad(f'98 - ({k} * 1000000 + 131400) % 97 + {k} % 3', 2)}, {pad(k, 18)}, ' per bank transfer')
        when 2 then concat('card 4', {pad(f'{k} * 7919 % 1000', 3)}, ' ', {pad(f'{k} * 104729 % 10000', 4)}, ' ', {pad(f'{k} * 611953 % 10000', 4)}, ' ', {pad(f'{k} * 1299709 % 10000', 4)}, ', phone ', '+1-212-555-', {pad(f'{k} % 10000', 4)})
        else concat('Größe: reach me at user', {k}, '@mail.example.org or ', '+1-212-555-', {pad(f'{k} % 10000', 4)}, ' since March ', 1 + {k} % 28, ', 2021') end"""
    rows = dealt(read(spark, sf_dir, "customer").select(k, "c_name"), k, most=0.5)
    return rows.select(F.col(k).alias("doc_id"), F.expr(text).alias("text"))


# Recognizers -----------------------------------------------------------------------------------


def _recognizer(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = documents(spark, sf_dir).select("doc_id", "text").unionAll(derived(spark, sf_dir).select(-F.col("doc_id"), "text"))
        return D.exploded(D.raw_spans(rows, kinds=(kind,)), "doc_id").select("doc_id", "start", "end", "score", "text")

    run.__name__ = f"recognize_{kind.lower()}"
    query(f"with {O.DERIVED}, corpus as (select doc_id, text from documents union all select -doc_id, text from derived), {O.raw('corpus')} select doc_id, start, \"end\", score, text from raw where entity_type = '{kind}'")(run)


for _kind, _, _ in RECOGNIZERS:
    _recognizer(_kind)


@query(f"with {O.DERIVED}, {O.raw('derived')} select doc_id, entity_type, text, {O.CHECK} as valid from raw where entity_type in ('SSN', 'IBAN', 'CREDIT_CARD')")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.exploded(D.raw_spans(derived(spark, sf_dir), kinds=("SSN", "IBAN", "CREDIT_CARD")), "doc_id")
    rule = f"case entity_type when 'CREDIT_CARD' then {S.luhn('text')} when 'IBAN' then {S.iban('text')} else {S.ssn('text')} end"
    return rows.select("doc_id", "entity_type", "text", F.expr(rule).alias("valid"))


@query(f"with recursive {O.detected()} select doc_id, entity_type, start, \"end\", round(score, 6) as score from boost")
def context_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "coalesce(text, '')"
    df = documents(spark, sf_dir).withColumn("spans", F.expr(S.boosted(S.checked(S.recognized(body)), body, O.CONFIG)))
    return D.exploded(df, "doc_id").select("doc_id", "entity_type", "start", "end", F.round("score", 6).alias("score"))


@query(f"with recursive {O.detected()} select doc_id, span_idx, start, \"end\", entity_type, round(score, 6) as score, text, source from det")
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"with recursive {O.DERIVED}, {O.detected('derived')} select doc_id, span_idx, start, \"end\", entity_type, round(score, 6) as score, text, source from det")
def detect_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exploded(D.detect(derived(spark, sf_dir)), "doc_id").withColumn("score", F.round("score", 6))


@query(f"with recursive {O.detected()} select lang, entity_type, count(*) as n_spans, count(distinct doc_id) as n_docs from det join documents using (doc_id) group by all")
def spans_by_lang_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "lang").groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


# Policy ----------------------------------------------------------------------------------------


@query(f"with recursive {O.DERIVED}, {O.detected('derived')} select doc_id, entity_type, text from det where entity_type in ({O.groups_on()})")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.detect(derived(spark, sf_dir)).withColumn("spans", F.expr(policy.group_filter("spans")))
    return D.exploded(df, "doc_id").select("doc_id", "entity_type", "text")


_DIM = "(values " + ", ".join(f"('{t[0]}', '{t[1]}', {t[2]}, {t[3]})" for t in TYPES) + ") as d(entity_type, grp, baseline, delta)"


@query(f"select c_custkey % 11 as slider, entity_type, round(least(1.0, baseline + delta) - (c_custkey % 11) / 10.0 * (least(1.0, baseline + delta) - greatest(0.0, baseline - delta)), 6) as threshold, count(*) as n from customer, {_DIM} group by all")
def sensitivity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 11).alias("slider")).agg(F.count(F.lit(1)).alias("n"))
    table = [(s, t[0], round(Sensitivity(s / 10).threshold(t[0]), 6)) for s in range(11) for t in TYPES]
    return rows.join(spark.createDataFrame(table, "slider long, entity_type string, threshold double"), "slider").select("slider", "entity_type", "threshold", "n")


@query(
    rf"""with recursive {O.detected()} select doc_id, text from det where entity_type in ({O.groups_on()})
    and not regexp_matches(text, '^(?i:152\.[A-Za-z0-9_]+\.143\.131)$') and not regexp_matches(text, '^(?i:[A-Za-z0-9_]+@example\.com)$') and not regexp_matches(text, '^(?i:[A-Za-z0-9_]+\.233\.171\.252)$')"""
)
def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policy.review(D.detect(documents(spark, sf_dir)), allowlist=["152.*.143.131", "*@example.com", "*.233.171.252"], sensitivity=Sensitivity(1.0))
    return D.exploded(df, "doc_id").select("doc_id", "text")


@query(
    r"""with w(word, kind) as (values ('idiot', 'MISC'), ('there', 'PERSON'), ('thing', 'MISC')),
    t as (select doc_id, word, kind, regexp_extract_all(coalesce(text, ''), '(?i)\b' || word || '\b') as m, string_split_regex(coalesce(text, ''), '(?i)\b' || word || '\b') as g from documents, w)
    select doc_id, kind as entity_type, m[i] as text, cast(coalesce(list_sum(list_transform(g[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) as integer) as start
    from t, unnest(range(1, len(m) + 1)) as u(i)"""
)
def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual spans of a blocklist; these words stand alone in the texts, so word edges agree."""
    df = documents(spark, sf_dir).withColumn("spans", F.expr(policy.block(S.EMPTY, "coalesce(text, '')", [("idiot", "any"), ("there", "PERSON"), ("thing", "any")])))
    return D.exploded(df, "doc_id").select("doc_id", "entity_type", "text", "start")


_FEEDBACK = "select event_id, case when event_id % 3 = 0 then null else upper(event_type) end as detected_type, case when event_id % 2 = 0 then 'NOT_PII' else upper(event_type) end as corrected_type from events"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.upper("event_type")
    return read(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, kind).alias("detected_type"), F.when(F.col("event_id") % 2 == 0, "NOT_PII").otherwise(kind).alias("corrected_type"))


@query(
    f"""with f as ({_FEEDBACK}), k as (select case when detected_type is not null and corrected_type = 'NOT_PII' then detected_type when detected_type is null and corrected_type != 'NOT_PII' then corrected_type end as entity_type, detected_type is not null as d from f)
    select entity_type, count(*) filter (d) as dismissed, count(*) filter (not d) as added, round(greatest(0.1, least(0.99, 0.5 + (count(*) filter (d) / count(*) - 0.5) * 0.4)), 6) as threshold from k where entity_type is not null group by entity_type"""
)
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.adaptive_thresholds(feedback(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 1000")
def feedback_last_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "event_type")


@query("select event_type, count(value) as n, round(sum(value), 4) as total, round(avg(value), 6) as average, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as largest from events group by event_type")
def latency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.distribution(read(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("total", F.round("total", 4)).withColumn("average", F.round("average", 6))


# Vault, anonymize, restore ----------------------------------------------------------------------


@query(f"with recursive {O.detected()}, {O.VAULT} select * from vault")
def vault_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.identities(found(spark, sf_dir))


def _anonymized(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = materialise(D.detect(docs).select("doc_id", "spans"), "spans")  # narrow, and read twice
    known = materialise(vault.identities(D.exploded(spans, "doc_id")), "vault")
    return vault.anonymize(docs, known, mode=mode, found=spans), known


@query(f"with recursive {O.detected()}, {O.VAULT}, {O.replaced('v.placeholder')} select doc_id, sha256(anonymized) as digest, n_spans from anon")
def anonymize_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir, "placeholder")[0].select("doc_id", F.sha2("anonymized", 256).alias("digest"), "n_spans")


@query(f"with recursive {O.detected()}, {O.VAULT}, {O.replaced(chr(99) + 'ase when v.synthetic_value != ' + chr(39) * 2 + ' then v.synthetic_value else v.placeholder end')} select doc_id, sha256(anonymized) as digest, n_spans from anon")
def anonymize_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir, "synthetic")[0].select("doc_id", F.sha2("anonymized", 256).alias("digest"), "n_spans")


def _scope(anon: DataFrame, known: DataFrame) -> DataFrame:
    """Per document the tokens that its anonymized text shows."""
    seen = anon.select("doc_id", F.explode(F.expr(restore.observed("anonymized"))).alias("token"))
    return seen.join(known.select(F.col("placeholder").alias("token"), F.col("original_text").alias("original")), "token")


# a token stands for an identity, whose original is its first spelling
_RESTORED = f"with recursive {O.detected()}, {O.VAULT}, {O.replaced('v.original_text')} select doc_id, sha256(anonymized) as digest from anon"


@query(_RESTORED)
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymized texts restored: each span comes back as the first spelling of its identity."""
    anon, known = _anonymized(spark, sf_dir, "placeholder")
    anon = materialise(anon, "anonymized")
    back = restore.restore(anon, _scope(anon, known), "doc_id", "anonymized")
    return back.select("doc_id", F.sha2("restored", 256).alias("digest"))


@query(_RESTORED)
def restore_mangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens lose their brackets, case or separator before they are restored to the first spelling of their identity."""
    anon, known = _anonymized(spark, sf_dir, "placeholder")
    anon = materialise(anon, "anonymized")
    v = T.quoted(restore.CANONICAL)
    mangled = f"case doc_id % 3 when 0 then regexp_replace(anonymized, {v}, '[$1 $2]') when 1 then regexp_replace(anonymized, {v}, '[$1$2') else regexp_replace(anonymized, {v}, '$1_$2]') end"
    back = restore.restore(anon.withColumn("response", F.expr(mangled)), _scope(anon, known), "doc_id", "response")
    return back.select("doc_id", F.sha2("restored", 256).alias("digest"))


@query(f"with recursive {O.detected()}, {O.VAULT}, {O.replaced('v.placeholder')} select doc_id, unnest(list_distinct(regexp_extract_all(anonymized, '\\[[A-Z_]+_[1-9][0-9]*\\]'))) as token from anon")
def observed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir, "placeholder")[0].select("doc_id", F.explode(F.expr(restore.observed("anonymized"))).alias("token"))


@query(f"with recursive {O.detected()}, {O.VAULT} select entity_type, normalized_key, n, placeholder from vault where n % 2 = 0 union all select entity_type, normalized_key, n, placeholder from vault where n % 2 = 1 and n % 3 = 0")
def vault_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = vault.identities(found(spark, sf_dir)).select("entity_type", "normalized_key", "n", "placeholder")
    return vault.import_records(every.filter("n % 2 = 0"), every.filter("n % 3 = 0"))


# Scoring ---------------------------------------------------------------------------------------

_GOLD = """
    gold as (select doc_id, span_idx, case when doc_id % 11 = 0 then 'MISC' when span_idx % 3 = 2 then 'PERSON' else entity_type end as gold_type, entity_type as found_type,
        (doc_id + span_idx) % 5 != 0 as is_gold, doc_id % 4 as shift, "end" - start as len from det),
    facts as (select doc_id, gold_type, found_type, case when is_gold and shift <= 2 and len / (len + shift) >= 0.8 then 'TP' when is_gold then 'X' else 'FP' end as o from gold),
    flat as (select doc_id, 'TP' as outcome, gold_type, found_type from facts where o = 'TP' union all select doc_id, 'FN', gold_type, null from facts where o = 'X' union all select doc_id, 'FP', null, found_type from facts where o in ('X', 'FP')),
    seg as (select d.doc_id, d.lang, case when count(g.doc_id) filter (g.is_gold) = 0 then 'negative' when bool_or(g.is_gold and g.gold_type = 'MISC') then 'misc' else 'headline' end as segment from documents d left join gold g using (doc_id) group by d.doc_id, d.lang)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections against gold spans that are some of them, begun a few bytes early and retyped."""
    docs = D.detect(documents(spark, sf_dir), out="found")
    kind = "case when doc_id % 11 = 0 then 'MISC' when i % 3 = 2 then 'PERSON' else s.entity_type end"
    kept = "filter(transform(found, (s, i) -> named_struct('start', s.start - cast(doc_id % 4 as int), 'end', s.end, 'entity_type', {0}, 'keep', (doc_id + i) % 5 != 0)), g -> g.keep)".format(kind)
    return score.outcomes(docs.withColumn("gold", F.expr(kept)), "doc_id", keep=("lang",))


_METRICS = "coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall"


@query(f"with recursive {O.detected()}, {_GOLD}, c as (select segment, lang, count(*) filter (outcome = 'TP') as tp, count(*) filter (outcome = 'FP') as fp, count(*) filter (outcome = 'FN') as fn from seg left join flat using (doc_id) group by grouping sets ((segment), (segment, lang))), m as (select *, {_METRICS} from c) select segment, lang, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1 from m")
def score_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _outcomes(spark, sf_dir)
    grouped = facts.groupingSets([[F.col("segment")], [F.col("segment"), F.col("lang")]], F.col("segment"), F.col("lang")).agg(*score.counts())
    out = score.with_metrics(grouped)
    return out.select("segment", "lang", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"with recursive {O.detected()}, {_GOLD} select coalesce(gold_type, found_type) as entity_type, count(*) filter (outcome = 'TP') as tp, count(*) filter (outcome = 'FP') as fp, count(*) filter (outcome = 'FN') as fn from flat join seg using (doc_id) where segment = 'headline' group by all")
def score_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _outcomes(spark, sf_dir).filter("segment = 'headline' and outcome is not null")
    return facts.groupBy(F.coalesce("gold_type", "found_type").alias("entity_type")).agg(*score.counts())


@query(f"with recursive {O.detected()}, {_GOLD} select segment, count(*) as matched, count(*) filter (gold_type = found_type) as correct from flat join seg using (doc_id) where outcome = 'TP' group by segment")
def type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).filter("outcome = 'TP'").groupBy("segment").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("gold_type") == F.col("found_type")).alias("correct"))


@query(f"with recursive {O.detected()}, {_GOLD}, f as (select seg.doc_id, count(outcome) filter (outcome = 'FP') as fp from seg left join flat using (doc_id) where segment = 'negative' group by seg.doc_id) select count(*) as examples, count(*) filter (fp = 0) as passed, round(count(*) filter (fp = 0) / count(*), 6) as pass_rate, round(sum(fp) / count(*), 6) as false_positive_rate from f")
def negative_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _outcomes(spark, sf_dir).filter("segment = 'negative'").groupBy("doc_id").agg(F.count_if(F.col("outcome") == "FP").alias("fp"))
    passed, n = F.count_if(F.col("fp") == 0), F.count(F.lit(1))
    return each.agg(n.alias("examples"), passed.alias("passed"), F.round(passed / n, 6).alias("pass_rate"), F.round(F.sum("fp") / n, 6).alias("false_positive_rate"))


@query(f"with recursive {O.detected()}, k as (select doc_id, entity_type, count(*) as n, min(span_idx) as first, list(text order by span_idx) as texts from det group by all) select doc_id, entity_type, n, array_to_string(list_slice(list_filter(texts, lambda x, i: list_position(texts, x) = i), 1, 3), '|') as examples from k")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and type the number of spans and the first three different texts."""
    grouped = found(spark, sf_dir).groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.expr("slice(array_distinct(transform(array_sort(collect_list(struct(span_idx, text))), x -> x.text)), 1, 3)").alias("x"))
    return grouped.select("doc_id", "entity_type", "n", F.array_join("x", "|").alias("examples"))


# Text functions --------------------------------------------------------------------------------


@query("select lang, case when length(text) <= 120 then 'short' when length(text) <= 260 then 'medium' else 'long' end as bucket, count(*) as n from documents where length(text) >= 10 group by all")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter("length(text) >= 10").groupBy("lang", F.expr(T.length_bucket("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select doc_id, cast(strlen(coalesce(text, '')) as integer) as n_bytes, cast(length(decode(encode(coalesce(text, '')))) as integer) as chars_back,
    substr(coalesce(text, ''), length(coalesce(text, '')) // 3 + 1, length(coalesce(text, '')) // 3) as slice from documents"""
)
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length in bytes, back in characters, and each text's middle third by byte places."""
    body = "coalesce(text, '')"
    third = f"(char_length({body}) div 3)"
    df = documents(spark, sf_dir).withColumn("b", F.expr(T.char_to_byte(body, f"char_length({body})")))
    s, e = T.char_to_byte(body, f"cast({third} as int)"), T.char_to_byte(body, f"cast(2 * {third} as int)")
    return df.select("doc_id", F.col("b").alias("n_bytes"), F.expr(T.byte_to_char(body, "b")).alias("chars_back"), F.expr(T.byte_slice(body, f"({s})", f"({e})")).alias("slice"))


@query("select page_id, string_split(string_split(url, '#')[1], '?')[1] as url from pages")
def conversation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.expr(T.conversation_url("url")).alias("url"))


@query(f"select conv_id, turn, {O.key('coalesce(text, chr(32))')} as normalized from conversations")
def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(T.normalized_key("coalesce(text, ' ')")).alias("normalized"))


@query(f"select conv_id, turn, md5({O.key('coalesce(text, chr(32))')}) as key_digest from conversations")
def turn_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the normalised whole text of every turn."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(f"md5(cast({T.normalized_key("coalesce(text, ' ')")} as binary))").alias("key_digest"))


@query(
    """with t as (select doc_id, coalesce(text, '') as body from documents),
    p as (select doc_id, body, q, cast(length(body) * (q - 1) // 4 as bigint) as a, cast(length(body) * q // 4 as bigint) as b from t, (values (1), (2), (3), (4)) as v(q))
    select doc_id, q as quarter, cast(strlen(substr(body, 1, b)) as integer) as byte_end, cast(b as integer) as char_end, md5(substr(body, a + 1, b - a)) as slice_digest from p"""
)
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte and character ends of each text's quarters, and the digests of their byte slices."""
    df = documents(spark, sf_dir).select("doc_id", F.expr("coalesce(text, '')").alias("body"), F.explode(F.expr("sequence(1, 4)")).alias("quarter"))
    ends = [F.expr(T.char_to_byte("body", f"cast(cast(length(body) as long) * {q} div 4 as int)")).alias(n) for n, q in (("s", "(quarter - 1)"), ("e", "quarter"))]
    return df.select("doc_id", "quarter", "body", *ends).select("doc_id", "quarter", F.col("e").alias("byte_end"), F.expr(T.byte_to_char("body", "e")).alias("char_end"), F.expr(f"md5(cast({T.byte_slice('body', 's', 'e')} as binary))").alias("slice_digest"))


# NER, pages, code and streams -------------------------------------------------------------------


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per order that names two of the dictionary's entities and a phone number."""
    names = "array(" + ", ".join(T.quoted(t) for t, _, _ in ner.ENTITIES) + ")"
    pick = lambda x: f"element_at({names}, cast({x} % 12 as int) + 1)"
    text = f"concat('Grüße von ', {pick('o_orderkey')}, ', account ', {pick('o_custkey')}, ' or call 212-555-', lpad(cast(o_custkey % 10000 as string), 4, '0'))"
    rows = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", most=0.5)
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.expr(text).alias("text"))


_NAMES = "[" + ", ".join("'" + t + "'" for t, _, _ in ner.ENTITIES) + "]"
_LETTERS = f"letters as (select o_orderkey as doc_id, 'Grüße von ' || {_NAMES}[cast(o_orderkey % 12 as bigint) + 1] || ', account ' || {_NAMES}[cast(o_custkey % 12 as bigint) + 1] || ' or call 212-555-' || lpad(cast(o_custkey % 10000 as varchar), 4, '0') as text from orders)"
_FIXED = "(values " + ", ".join(f"('{t}', '{k}', {s})" for t, k, s in ner.ENTITIES) + ") as e(name, entity_type, score)"


@query(f"with {_LETTERS}, t as (select doc_id, entity_type, score, name, string_split(text, name) as g from letters, {_FIXED}) select doc_id, entity_type, cast(score as double) as score, name as text, cast(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + (i - 1) * strlen(name) as integer) as start from t, unnest(range(1, len(g))) as u(i)")
def dictionary_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ner.provide(letters(spark, sf_dir), ner.dictionary)
    return D.exploded(df, "doc_id", spans="ner").select("doc_id", "entity_type", "score", "text", "start")


def _with_ner() -> str:
    """The CTEs of detection over letters with the dictionary's spans beside the recognizers'."""
    ner_rows = f"""select doc_id, 100 as seq, i, entity_type, cast(score as double) as score, name as text, cast(before as integer) as start, cast(before + strlen(name) as integer) as "end", length(decode(encode(text)[1:before])) as cs, text as body, 'ner' as source
        from (select l.*, e.*, u.i, cast(list_sum(list_transform(g[1:u.i], lambda x: strlen(x))) + (u.i - 1) * strlen(name) as bigint) as before from (select doc_id, text, entity_type as k, score as s, name as m, string_split(text, name) as g from letters, {_FIXED}) l join {_FIXED} on e.name = l.m, unnest(range(1, len(g))) as u(i))"""
    out = O.detected("letters").replace(f"ok as (select * from raw where {O.CHECK})", f"ok as (select *, 'regex' as source from raw where {O.CHECK} union all {ner_rows})")
    out = out.replace("boost as (select doc_id,", "boost as (select source, doc_id,").replace("case when entity_type in ('", "case when source = 'regex' and entity_type in ('").replace("'regex' as source\n        from winners", "o.source\n        from winners")
    return out


@query(f"with recursive {_LETTERS}, {_with_ner()} select doc_id, span_idx, start, \"end\", entity_type, round(score, 6) as score, text, source from det")
def detect_with_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizers and external spans together, over letters."""
    return D.exploded(D.detect(ner.provide(letters(spark, sf_dir), ner.dictionary), ner="ner"), "doc_id").withColumn("score", F.round("score", 6))


_CHUNK_END = r"case when {0} + 800 >= n then n else {0} + case when regexp_matches(substr(t, {0} + 481, 320), '[\s\x{{00A0}}]') then 480 + length(regexp_extract(substr(t, {0} + 481, 320), '(?s)^.*[\s\x{{00A0}}]')) else 800 end end"


@query(
    f"""with recursive d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
    c(doc_id, t, n, chunk, s, e) as (select doc_id, t, n, 0, cast(0 as bigint), cast({_CHUNK_END.format('0')} as bigint) from d where n > 0
        union all select doc_id, t, n, chunk + 1, greatest(s + 1, e - 256), cast({_CHUNK_END.format('greatest(s + 1, e - 256)')} as bigint) from c where e < n)
    select doc_id, chunk, cast(s as integer) as start_char, cast(e as integer) as end_char, cast(strlen(substr(t, 1, s)) as integer) as start_byte, cast(strlen(substr(t, 1, e)) as integer) as end_byte from c"""
)
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.chunks(documents(spark, sf_dir), size=800).select("doc_id", "chunk", "start_char", "end_char", "start_byte", "end_byte")


@query()
def page_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in the visible text of pages."""
    return D.exploded(D.detect(pages.page_text(read(spark, sf_dir, "pages").select("page_id", "html"))), "page_id")


@query(r"""select page_id, cast(strpos(html, regexp_extract(html, '(?is)<script[^>]*>.*?</script>')) - 1 as integer) as start from pages where regexp_matches(html, '(?is)<script[^>]*>.*?</script>')""")
def first_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character offset of each page's first script, by the offset technique of the recognizers."""
    found_ = S.matches("html", r"(?is)<script[^>]*>.*?</script>", "MISC", 1.0, "regex", 0)
    df = read(spark, sf_dir, "pages").withColumn("s", F.expr(f"element_at(slice({found_}, 1, 1), 1).cs"))
    return df.filter("s is not null").select("page_id", F.col("s").alias("start"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream over the events; each trigger rewrites the whole table of counts."""
    out = scratch_path(spark, "counts")
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = jobs.windowed_counts(events, "ts", "event_type")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/table")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").withColumn("start", F.col("start").cast("timestamp_ntz"))


# Scopes -----------------------------------------------------------------------------------------


@query(
    f"""with recursive {O.detected()}, {O.VAULT}, seen as (select distinct d.doc_id % 20 as conv, v.placeholder as token, v.n, v.synthetic_value, v.original_text from det d join vault v on v.entity_type = d.entity_type and v.normalized_key = {O.key('d.text')}),
    form as (select conv, n, token, original_text, n % 4 < 3 as tolerant from seen union all select conv, n, synthetic_value, original_text, n % 4 < 3 from seen where synthetic_value != '')
    select conv, token, case when bool_or(n % 4 = 0 and starts_with(token, '[')) then 'ledger ' else '' end || any_value(original_text) as original, bool_or(tolerant or n % 4 = 0) as tolerant from (select conv, n, token, original_text, tolerant or n % 4 = 0 as tolerant from form) group by conv, token"""
)
def conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of conversations whose tokens come by ledger, by record or by sight alone."""
    flat = materialise(found(spark, sf_dir), "spans")
    spans, known = flat.withColumn("normalized_key", F.expr(T.normalized_key("text"))), vault.identities(flat)
    seen = spans.join(known, ["entity_type", "normalized_key"]).select((F.col("doc_id") % 20).alias("conv"), F.col("placeholder").alias("token"), "n", "original_text").distinct()
    ledger = seen.filter("n % 4 = 0").select("conv", "token", F.concat(F.lit("ledger "), "original_text").alias("original"))
    record = scope.records(seen.filter("n % 4 in (1, 2)").select("conv", "token", F.lit(None).cast("string").alias("original")))
    return scope.build_scope(record, ledger, seen.select("conv", "token"), known)


@query("select user_id, arg_max(event_type, event_id) as place, max(event_id) as at from events group by user_id")
def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("place"), F.col("event_id").alias("at"))
    return scope.filed(rows, token="user_id", place="place", ts="at")

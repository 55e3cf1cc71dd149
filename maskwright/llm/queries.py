"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import fingerprint, langid, lexical, lm, merkle, mixing, neardup, packing, quality, suffix, tokencount, topk, warc
from maskwright.llm.common import crc_fold, scratch_path, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path, with_payload=False)
    return back.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 3)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 1)
    return quality.classify(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5) != 1)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 3)
    model = langid.fit(docs, fold != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, crc_fold(F.col("doc_id"), 5) == 0, F.translate("text", UPPER, UPPER.lower()))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_removed(table(spark, sf_dir, "documents"))


QUERIES = {"op1_warc": op1_warc, "op2_mixing": op2_mixing, "op3_quality": op3_quality, "op4_fingerprints": op4_fingerprints, "op5_packing": op5_packing, "op6_near_duplicates": op6_near_duplicates, "op7_token_counts": op7_token_counts, "op8_topk": op8_topk, "op9_lm_scores": op9_lm_scores, "op10_langid": op10_langid, "op11_merkle": op11_merkle, "op12_lexical_search": op12_lexical_search, "op13_suffix_dedup": op13_suffix_dedup}
#: SQL: a field as it is hashed, and the unsigned crc32 of a document's decimal id by its bits.
_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || {0} end"
_CRC = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length(coalesce(cast(doc_id as varchar), '')) + 1), lambda i: cast(ascii(substr(coalesce(cast(doc_id as varchar), ''), i, 1)) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)) )"""
_TERMS = rf"regexp_extract_all(translate({{0}}, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL: dict[str, str] = {
    # twenty bits, five hex digits, make four base32 characters
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        h as (select *, sha1(body) as hex, min(page_id) over (partition by body) as first from p)
        select page_id, cast(strlen(body) as bigint) as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + cast((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint), 1)), '') as payload_digest,
            case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id = first then null else first end as refers_to
        from h
    """,
    "op2_mixing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
            cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h from documents),
        s as (select source, sum(size) as s, 3 * sum(size) as cap,
            [5, 2, 1][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as w from d group by source),
        l as (select *, sum(s) over () - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as words_left,
            sum(w) over () - coalesce(sum(w) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as weight_left from s),
        c as (select *, cap * weight_left <= w * words_left as capped from l),
        t as (select source, s, case when capped then cast(cap as double)
            else w * max(case when not capped then cast(words_left as double) / cast(weight_left as double) end) over () end as target from c),
        p as (select d.*, t.s, t.target, case when t.s > 0 then floor(t.target / t.s) else 0 end as epochs,
            coalesce(sum(d.size) over (partition by d.source order by h, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
            from d join t on d.source is not distinct from t.source)
        select doc_id, cast(size as bigint) as size, cast(s as bigint) as source_size, target,
            cast(epochs * size + greatest(0, least(size, floor(target) - epochs * s - before)) as bigint) as taken from p
    """,
    "op8_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings
            where embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id != c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
    """,
    "op6_near_duplicates": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
        n as (select doc_id, count(*) as n from s group by doc_id),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        edge as (select a, b from link union all select b, a from link),
        reach as (select doc_id as a, doc_id as b from documents union select reach.a, edge.b from reach join edge on reach.b = edge.a)
        select r.a as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id, r.a = min(r.b) as kept
        from reach r left join n on n.doc_id = r.a group by r.a
    """,
    # levels are grouped until one node a source is left, then over the subroots; proofs and folds walk a node's ancestors
    "op11_merkle": rf"""
        with recursive d as (select *, {_FIELD.format('doc_id')} || {_FIELD.format('source')} || {_FIELD.format('lang')} || {_FIELD.format('n_chars')} as head from documents),
        l as (select doc_id, source, sha256(head || {_FIELD.format('text')}) as leaf,
            case when {_CRC} % 5 = 0 then sha256(head || {_FIELD.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) end as now from d),
        s as (select source, row_number() over (order by encode(source) nulls first) - 1 as g from (select distinct source from l)),
        p as (select l.*, s.g, row_number() over (partition by s.g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by s.g) as n from l join s on l.source is not distinct from s.source),
        a(level, g, pos, n, digest) as (select 0, g, pos, n, leaf from p
            union all select level + 1, g, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by pos)) from a where n > 1 group by level, g, pos // 16),
        t as (select g, max(level) as height, arg_max(digest, level) as subroot from a group by g),
        b(level, pos, n, digest) as (select 0, g, (select count(*) from s), subroot from t
            union all select level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by pos)) from b where n > 1 group by level, pos // 16),
        r as (select arg_max(digest, level) as root from b),
        -- u: 0 for a source's tree, 1 for the tree of subroots
        step as (select 1 as own, level, g, u, pos, coalesce(string_agg(other, '' order by opos) filter (opos < pos), '') as l, coalesce(string_agg(other, '' order by opos) filter (opos > pos), '') as r from (
                select 0 as u, m.level, m.g, m.pos, o.digest as other, o.pos as opos from a m join a o on o.level = m.level and o.g = m.g and o.pos // 16 = m.pos // 16 where m.n > 1
                union all select 1, m.level, 0, m.pos, o.digest, o.pos from b m join b o on o.level = m.level and o.pos // 16 = m.pos // 16 where m.n > 1) group by all),
        f(doc_id, leaf, source, g, u, level, place, proof, folded) as (select doc_id, leaf, source, g, 0, 0, pos, '', coalesce(now, leaf) from p
            union all select f.doc_id, f.leaf, f.source, f.g, case when step.own is null then f.u + 1 else f.u end, case when step.own is null then 0 else f.level + 1 end,
                case when step.own is null then f.g else f.place // 16 end, f.proof || coalesce(step.l || step.r, ''), case when step.own is null then f.folded else sha256(step.l || f.folded || step.r) end
            from f left join step on step.u = f.u and step.level = f.level and step.pos = f.place and step.g = case when f.u = 0 then f.g else 0 end where f.u < 2)
        select f.doc_id, f.leaf, t.subroot, r.root, sha256(f.proof) as proof_sha256, f.folded as folded_root, f.folded = r.root as verified
        from f join t on t.g = f.g, r where f.u = 2
    """,
    "op12_lexical_search": rf"""
        with d as (select doc_id, {_TERMS.format('text')} as w from documents where len({_TERMS.format('text')}) > 0),
        c as (select count(*) as docs, cast(sum(len(w)) as bigint) as words from d),
        f as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) group by all),
        v as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from f, c group by term, docs),
        m as (select doc_id, 75 + (25 * len(w) * docs) // words as m from d, c),
        q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS.format('text')}) as term from benchmark) group by all),
        s as (select item_id, f.doc_id, cast(sum(times * v.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from q join f using (term) join v using (term) join m on m.doc_id = f.doc_id group by all),
        r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
    """,
    # every window by its digest; starts that meet run together where they touch
    "op13_suffix_dedup": """
        with d as (select doc_id, row_number() over () as r, encode(coalesce(text, '')) as b from documents),
        w as (select r, i, md5(b[i:i + 199]) as k from d, unnest(range(1, octet_length(b) - 198)) as u(i)),
        s as (select r, i, lag(i) over (partition by r order by i) as p from w where k in (select k from w group by k having count(*) > 1)),
        g as (select r, i, sum(case when p is null or i > p + 200 then 1 else 0 end) over (partition by r order by i) as run from s),
        n as (select r, run, min(i) as a, max(i) + 199 as z from g group by r, run),
        c as (select n.*, lag(z, 1, 0) over (partition by r order by a) as before from n),
        k as (select r, count(*) as spans, sum(z - a + 1) as removed, max(z) as last, string_agg(hex(b[before + 1:a - 1]), '' order by a) as head from c join d using (r) group by r)
        select doc_id, octet_length(b) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
            sha256(unhex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1:]))) as kept_sha256 from d left join k using (r)
    """,
}

"""Registered queries of the numbered operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chat, hard_negatives, mixing, ngram_join, packing, quality, suffixes, tokenfiles, toxicity, urls,
               vectors)
from .common import new_path

# Rules of the url query (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary the token queries use; operators take the path as an argument."""
    import public_tokenizers
    return public_tokenizers.path(name)


def q_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_groups(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    files = tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), folder, vocabulary())
    return tokenfiles.read_tokens(files, folder)


def q_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, keep_text=False)
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_by_tiles(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def q_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_bytes(_table(spark, sf_dir, "documents"), least=100)


def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def q_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_by_segments(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def q_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def q_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return told.select("conv_id", "participant", "part", "char_start", "n_turns", "rendered", spans.alias("mask"))


def q_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def q_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model, keep_text=False)
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_join": q_similar,
    "op2_token_files": q_tokens,
    "op3_source_mixing": q_mix,
    "op4_quality_classifier": q_quality,
    "op5_nearest_vectors": q_nearest,
    "op6_suffix_dedup": q_repeats,
    "op7_url_filters": q_urls,
    "op8_exact_top_k": q_top,
    "op9_packing": q_pack,
    "op10_chat_rotation": q_chat,
    "op11_hard_negatives": q_hard,
    "op12_toxicity": q_toxic,
    "op13_alignment": q_align,
}

ORACLE = {
    "op11_hard_negatives": r"""
        with v as (
            select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        s as (
            select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.x, c.x)::bigint as score
            from v a join v c on a.vec_id <> c.vec_id and len(a.x) = len(c.x) where a.vec_id % 100 = 0),
        p as (select * from s where same
              qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        r as (
            select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
                   row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank
            from p join s on p.anchor_id = s.anchor_id
            where not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 10""",
    "op5_nearest_vectors": r"""
        with v as (
            select distinct vec_id, embedding::double[] as x from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
              and len(list_filter(embedding, lambda c: c <> 0)) > 0),
        s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op8_exact_top_k": r"""
        with v as (
            select distinct vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.x::double[], c.x::double[])::bigint as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op3_source_mixing": r"""
        with d as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
            from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (
            select *, 2.0::double * source_size as top,
                   [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
            from s),
        o as (
            select *, sum(top) over before as capped, sum(weight) over from_here as open_weight
            from w window before as (order by top / weight, source rows between unbounded preceding and 1 preceding),
                          from_here as (order by top / weight, source rows between current row and unbounded following)),
        l as (
            select *, (1.5::double * (select sum(source_size)::double from s) - coalesce(capped, 0.0::double)) / open_weight as level
            from o),
        f as (select min(top / weight) as ratio, min_by(level, top / weight) as level from l where top >= level * weight),
        t as (
            select source, source_size,
                   case when f.level is null or top < f.level * weight then top else f.level * weight end as target
            from l, f),
        r as (
            select d.doc_id, d.size, t.source_size, t.target,
                   case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
                   ('0x' || substr(md5('7:' || d.doc_id::varchar), 1, 13))::bigint / 4503599627370496.0::double as chance
            from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               (size * (floor(rate) + case when chance < rate - floor(rate) then 1 else 0 end))::bigint as taken
        from r""",
    "op7_url_filters": r"""
        with p as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
            from pages),
        u as (
            select page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from p),
        r as (
            select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                           when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                           when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                           when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
            from u)
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
        from r""",
    "op10_chat_rotation": r"""
        with t as (
            select conv_id, coalesce(turn, -1) as tn, floor(coalesce(turn, -1) / 256)::bigint as part,
                   replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') as who,
                   replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') as says
            from conversations),
        p as (select distinct conv_id, who as participant from t where who <> 'system'),
        b as (
            select t.conv_id, p.participant, t.part, tn, who, says, who = p.participant as own,
                   '<|im_start|>' || case when who = p.participant then 'assistant' when who = 'system' then 'system'
                                          else 'user name=' || who end || chr(10) as head,
                   says || '<|im_end|>' || chr(10) as tail,
                   row_number() over (partition by t.conv_id, p.participant, t.part order by tn, who, says) as nr
            from t join p on t.conv_id is not distinct from p.conv_id),
        s as (
            select *, coalesce(sum(length(head || tail)) over (partition by conv_id, participant, part order by nr
                               rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from b),
        g as (
            select conv_id, participant, part, count(*)::int as n_turns,
                   string_agg(head || tail, '' order by nr) as rendered,
                   coalesce(string_agg(case when own then (start + length(head))::varchar || '-' ||
                                       (start + length(head || tail) - 1)::varchar end, ',' order by nr), '') as mask
            from s group by all)
        select *, coalesce(sum(length(rendered)) over (partition by conv_id, participant order by part
                           rows between unbounded preceding and 1 preceding), 0)::bigint as char_start
        from g""",
}

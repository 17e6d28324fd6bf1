"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.llm.licenses import NOTICES, PHRASES, THRESHOLD
from bindscape.llm.oracles import MERKLE, RUNS, licenses
from bindscape.session import read_table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    from bindscape.llm.simhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op1_shard_balance")
def op1(spark, sf_dir):
    from bindscape.llm.sharding import shard_documents
    return shard_documents(read_table(spark, sf_dir, "documents"))


@register("op3_prefix_token_counts")
def op3(spark, sf_dir):
    from bindscape.llm.tokens import token_summary
    return token_summary(read_table(spark, sf_dir, "documents"))


@register("op5_warc_index_first", """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
 case when f.first_id is null or f.first_id = d.page_id then 'response' else 'revisit' end as record_type,
 case when f.first_id <> d.page_id then f.first_id end as refers_to
from d left join f using (payload_digest)""")
def op5(spark, sf_dir):
    from bindscape.llm.warc import round_trip
    return round_trip(read_table(spark, sf_dir, "pages"))


@register("op10_poisson_mix", """
with s as (select source, sum(strlen(coalesce(text, '')) + 1)::double as bytes from documents group by 1),
w as (select source, bytes, pow(bytes, 0.5) as w from s),
r as (select source, w * (select sum(bytes) from w) / (select sum(w) from w) / bytes as rate from w),
d as (select doc_id, d.source, text, rate,
  ('0x' || substr(md5('42|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from documents d join r on d.source is not distinct from r.source),
k as (select range as k from range(0, 2000)),
p as (select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from r, k where k <= rate + 12 * sqrt(rate) + 40),
c as (select source, k, sum(p) over (partition by source order by k) as cdf from p),
l as (select source, list(cdf order by k) as cdfs from c group by 1),
n as (select doc_id, d.source, text, len(list_filter(cdfs, lambda x: x <= u)) as n
  from d join l on d.source is not distinct from l.source),
e as (select doc_id, source, text, unnest(range(0, n))::bigint as copy from n)
select doc_id, source, copy, md5(text) as text_md5,
 md5('42|' || coalesce(doc_id::varchar, '') || '|' || copy::varchar) as shuffle_key from e""")
def op10(spark, sf_dir):
    from bindscape.llm.mixing import mix_sources
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__copy").alias("copy"), F.md5("text").alias("text_md5"),
                        F.col("__order").alias("shuffle_key"))


@register("op6_toxicity_lexicon")
def op6(spark, sf_dir):
    from bindscape.llm.toxicity import fit, score
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


@register("op8_pigeonhole_decontamination")
def op8(spark, sf_dir):
    from bindscape.llm.decontam import find_leaks
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").alias("n_items"),
                         F.col("leaks.item_id").alias("item_ids"), F.col("leaks.distance").alias("distances"))


@register("op9_chunk_fingerprints")
def op9(spark, sf_dir):
    from bindscape.llm.chunks import fingerprint_neighbours
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


@register("op4_line_similarity_dedup")
def op4(spark, sf_dir):
    from bindscape.llm.lines import dedup_lines
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.size("__removed").alias("n_removed"),
                       F.col("__removed").alias("removed_lines"), F.md5("text").alias("kept_md5"))


@register("op7_quality_cotraining")
def op7(spark, sf_dir):
    from bindscape.llm.quality import score_quality
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op11_license_scan", licenses(PHRASES, NOTICES, THRESHOLD))
def op11(spark, sf_dir):
    from bindscape.llm.licenses import license_labels
    return license_labels(read_table(spark, sf_dir, "documents"))


@register("op12_merkle_manifest", MERKLE)
def op12(spark, sf_dir):
    from bindscape.llm.merkle import manifest, without_line_feeds
    return manifest(read_table(spark, sf_dir, "documents"), claim=without_line_feeds())


@register("op13_periodic_runs", RUNS)
def op13(spark, sf_dir):
    from bindscape.llm.runs import find_runs, plant_periods, run_report
    return run_report(find_runs(plant_periods(read_table(spark, sf_dir, "documents"))))

"""The operators' queries over the whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import media, mixing, neardup, packing, phrases, pii, secrets, toxicity, vectors, warc
from quillmeter.llm.common import cut, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.text_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.concat(F.lit("seconds="), "seconds_num", F.lit("/"), "seconds_den"), F.concat(F.lit("frames="), "frames"), F.concat(F.lit("crc="), "crc_good", F.lit("+"), "crc_bad"), F.concat(F.lit("kbits="), "bitrates"), F.concat(F.lit("last="), F.coalesce(F.try_element_at("seek", F.lit(-1)), F.lit(-1))))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "samples", "hertz", "frames", "seek")


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    prepare(pages)
    path = warc.archive_folder(spark)
    warc.write_archives(pages, path)
    # the archives are read and parsed once, bodies counted and hashed there
    records = cut(warc.read_records(spark, path, payloads=False))
    return warc.page_captures(cut(warc.transactions(records)))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op8_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_documents(docs.select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_best_fit_packing, op2_mpeg_media, op3_pivot_permutation, op4_credential_linking, op5_compression_toxicity, op6_warc_transactions, op7_bootstrapped_pii, op8_systematic_mixing, op9_circulant_minhash, op10_phrase_automata, pipeline)
    return {f.__name__: f for f in named}


OP3_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as most from embeddings
), scaled as (
  select vec_id, most, case when most > 1e140 or most < 1e-140 then list_transform(v, lambda x: x / most) else v end as v from v where most > 0 and isfinite(most) and len(list_filter(v, lambda x: x is null or isnan(x))) = 0
), good as (
  select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from scaled
), pairs as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95
), reach as (
  select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a
), least as (select a, min(b) as b from reach group by a)
select e.vec_id, (select count(*) from pairs p where p.a = e.vec_id) as n_links,
  least(e.vec_id, coalesce(l.b, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) as kept
from embeddings e left join least l on l.a = e.vec_id
"""

OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source
), w as (
  select *, [3.0, 1.0, 2.0][(i % 3)::int + 1]::double as w, 2.0::double * source_size as cap from s
), o as (
  select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over () - coalesce(sum(w) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as weight from w
), l as (select *, min({'ratio': cap / w, 'i': i, 'level': rest / weight}) filter (where cap / w >= rest / weight) over () as first from o
), t as (
  select source, source_size, case when first is null then cap else least(cap, w * first.level) end as target,
    (('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 4))::bigint % 1024) / 1024.0::double as u from l
), k as (
  select d.doc_id, d.size, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 1.0::double end as r,
    row_number() over (partition by d.source order by d.size, d.doc_id) as k
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * least(floor(k * r + u) - floor((k - 1) * r + u), ceil(r)))::bigint as taken from k
"""

OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(w, i, least(i + 3, len(w))), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id
), c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), pairs as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)
), reach as (
  select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a
), least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) as kept
from documents d left join n using (doc_id) left join least l on l.a = d.doc_id
"""

OP10_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), spot as (
  select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35)
), again as (select h from spot group by h having count(*) > 1
), gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from spot join again using (h)
), word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from w
), kept as (
  select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from word anti join gone using (doc_id, i) group by doc_id
)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL that DuckDB runs on the same tables; what it can't express is held against brute force in the tests."""
    return {"op3_pivot_permutation": OP3_SQL, "op8_systematic_mixing": OP8_SQL, "op9_circulant_minhash": OP9_SQL, "op10_phrase_automata": OP10_SQL}

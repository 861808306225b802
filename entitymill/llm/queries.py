"""The registered query of each operator, on the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.llm import (
    conversation_repair,
    exact_dedup,
    language_mix,
    license_scan,
    packing,
    quality_cnn,
    quality_rules,
    secrets,
    sentencepiece_nbest,
    simhash,
    token_files,
    vector_codes,
    warc,
)
from entitymill.llm.common import scratch, written

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan", license_scan.license_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = quality_rules.apply_rules(documents, labels, threshold=0.3, train_rows=20_000, folds=5)
    return found.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "score")


@query("op3_curve_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=4096).drop("ids")


OP4_SQL = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
)
select page_id, payload_bytes, p.payload_digest,
       case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first <> page_id then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""


@query("op4_warc_boundaries", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), path)
    read = warc.read_archives(spark, path, whole=True)
    return read.select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"
    )


OP5_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), k as (
  select *, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k
"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_sentencepiece_n_best")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.segment(table(spark, sf_dir, "documents"), n=3)


@query("op7_quality_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    net = quality_cnn.fit_labelled(documents, labels, train_rows=4_000, folds=5)
    return quality_cnn.score_quality(documents, net, threshold=0.3, folds=5)


@query("op8_language_mixture")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_mix.identify(documents, language_mix.learn(documents, folds=4, held=2), folds=4, held=2)


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audit_conversations(conversations, conversation_repair.damage(conversations))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds written out, over one row per component."""
    def assigned(r: int) -> str:
        return (
            f"d{r} as materialized (select x.rid, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) as d from x"
            f" join c{r} c on x.part = c.part and x.spot = c.spot group by all),"
            f" a{r} as materialized (select rid, part, min(d) as d, arg_min(entry, d * {entries} + entry) as entry from d{r} group by all)"
        )

    steps = []
    for r in range(rounds):
        steps.append(assigned(r))
        steps.append(
            f"m{r} as (select x.part, a.entry, x.spot, sum(x.v)::bigint as s, count(*) as n from x"
            f" join a{r} a on x.rid = a.rid and x.part = a.part group by all),"
            f" c{r + 1} as materialized (select c.part, c.entry, c.spot, case when n is null then c.v"
            f" else (s - ((s % n) + n) % n) // n end as v from c{r} c left join m{r} m"
            " on c.part = m.part and c.entry = m.entry and c.spot = m.spot)"
        )
    steps.append(assigned(rounds))
    return (
        "with k as materialized (select row_number() over (order by vec_id) as rid, vec_id, label, embedding, len(embedding) as dim"
        " from embeddings where embedding is not null"
        " and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),"
        " u as (select rid, dim, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as place from k),"
        f" x as materialized (select rid, place // (dim // {parts}) as part, place % (dim // {parts}) as spot,"
        " floor(4096 * e::double)::bigint as v from u),"
        f" c0 as materialized (select part, rid - 1 as entry, spot, v from x where rid <= {entries}), " + ", ".join(steps) + ","
        f" f as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by rid),"
        f" h as (select sha256(string_agg(v::varchar, ',' order by part, entry, spot)) as codebooks_sha256 from c{rounds})"
        " select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256"
        " from k join f on k.rid = f.rid, h"
    )


@query("op12_vector_codes", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, lloyd = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    codes = written(codes, "codes")
    labels = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    codes = codes.join(labels, codes["label"].eqNullSafe(labels["_label"]))
    sha = F.lit(lloyd.codebooks_sha256())
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", sha.alias("codebooks_sha256"))


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_ids(table(spark, sf_dir, "documents"), path, end=1)
    return token_files.read_ids(spark, path)

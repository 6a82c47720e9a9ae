"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, language, media, mixing, packing, rans, secrets, simhash, toxicity
from .common import materialize, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["place"])), ",")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), draws.alias("draws"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents")), tensors=True)


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = materialize(chat.format_chats(rows.union(extra)), "formatted")
    return chat.read_back(formatted)


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 tells before any draw: sizes and targets."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's numbers of base spans."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's payloads as they were read back."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's turns and learned texts as they were read back."""
    return op10_chat(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


_SQL = {
    "mixing_sizes": r"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
 s as (select source, cast(sum(size) as bigint) as n from d group by 1),
 w as (select source, n, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, (select sum(size) from d) * 1.5::double as total from s),
 o as (select *, row_number() over (order by 2*n/w, source nulls last) as k from w),
 u as (select *, (total - coalesce(sum(2.0::double*n) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by k rows between current row and unbounded following) as unit from o),
 f as (select coalesce(min(case when unit*w < 2*n then k end), 1e18) as k0 from u),
 t as (select source, n, case when k < (select k0 from f) then 2.0::double*n else w * (select unit from u where k = (select k0 from f)) end as target from u)
 select doc_id, size, n as source_size, round(target, 3) as target from d join t on d.source is not distinct from t.source""",
    "secret_counts": r"""with d as (select doc_id, coalesce(text, '') as t from documents) select doc_id,
 cast(len([x for x in regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) if length(x) >= 8]) as bigint) as n_assign,
 cast(len([x for x in regexp_extract_all(t, 'AKIA[A-Z0-9]+') if length(x) >= 16]) as bigint) as n_access,
 cast(len([x for x in regexp_extract_all(t, '[0-9a-f]+') if length(x) >= 32]) as bigint) as n_hex from d""",
    "media_payloads": r"""with d as (select doc_id, encode(coalesce(text, '')) as b from documents), n as (select doc_id, b, cast(octet_length(b) as bigint) as n_bytes from d),
 p as (select *, greatest(64, (n_bytes + 63) // 64 * 64) as size from n)
 select doc_id, n_bytes, size as payload_bytes, sha256(b || repeat('\x00'::blob, size - n_bytes)) as payload_sha256 from p""",
    "chat_turns": r"""with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256 from r group by 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") or k in _SQL}


def oracle_sql() -> dict[str, str]:
    """SQL for what of the operators' results SQL can tell; the rest (learned scores, drawn places, tokenizers) tests hold against brute force."""
    return dict(_SQL)

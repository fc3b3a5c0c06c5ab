"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from corpusstat.llm import bpe, chat, decontaminate, infill, lm, merkle, minhash, mixing, quality, secret_scan, substring, url_filter, warc
from corpusstat.llm.blocks import shared_dir

RANKS = "byte_bpe_50k.tiktoken"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark, sf_dir):
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    out = substring.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/corpusstat/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -7L conv_id, id turn, if(id = 0, 'user', 'assistant') role, :text text FROM range(2)", args={"text": text})
    out = chat.format_chats(rows.unionByName(extra)).withColumn("read", chat.read_turns(F.col("formatted")))
    said = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learnt = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"])))
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
                      F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op8_secret_scan(spark, sf_dir):
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "place", "run", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "secret")


def op9_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    out = bpe.decode(ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_decontaminate(spark, sf_dir):
    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", F.sort_array("items")), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_fill_in_middle(spark, sf_dir):
    out = infill.transform(table(spark, sf_dir, "documents"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return out.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_merkle_manifest(spark, sf_dir):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(*map(F.col, merkle.FIELDS[:-1]), lower))
    out = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), keep={"tampered": tampered}), "tampered")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_mix_sources(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op6_warc": WARC_SQL, "op7_chat_format": CHAT_SQL, "op11_fill_in_middle": infill.SQL, "op12_merkle_manifest": merkle.sql()}


CHAT_SQL = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
b AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?TURN\]|/?ROLE\])', '\1\2\\\3', 'g') AS safe, regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?TURN\]|/?ROLE\])', '\1\2\\\3', 'g') AS safe_role FROM a),
c AS (SELECT *, CASE role WHEN 'system' THEN '<<SYS>>' || safe || '<</SYS>>' WHEN 'user' THEN '[INST]' || safe || '[/INST]' WHEN 'assistant' THEN '<s>' || safe || '</s>' ELSE '[TURN][ROLE]' || safe_role || '[/ROLE]' || safe || '[/TURN]' END AS shown FROM b)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars, regexp_full_match(string_agg(role || ' ', '' ORDER BY turn NULLS FIRST, role, text), '(system )?(user assistant )+') AS valid FROM c GROUP BY conv_id"""


WARC_SQL = """
WITH a AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
b AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(payload)) AS last FROM a)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM b"""

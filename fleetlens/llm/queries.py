"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import contamination, cotraining, exact_dedup, mixing, near_dup, negatives, packing, quotes, repair, secrets, token_counts, topk, warc
from fleetlens.llm.common import table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(quotes.as_replies(table(spark, sf_dir, "conversations")))


def op1_quote_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.quote_origins(quotes.as_replies(table(spark, sf_dir, "conversations")))


def op2_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality_score", "clean_score", "keep")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quotation_linking, op1_quote_origins, op2_mixing_weights, op3_exact_dedup, op4_token_counts, op5_packing, op6_exact_topk, op7_quality_classifier, op8_secret_scan, op9_warc_captures, op10_minhash_near_dup,
    op11_hard_negatives, op12_conversation_repair, op13_benchmark_decontamination)}
QUERIES["pipeline"] = _pipeline

OP1_SQL = """
with recursive t as (select conv_id, turn, role, coalesce(text, '') as text, split_part(coalesce(text, ''), chr(10), 1) as line from conversations),
one as (select conv_id, turn, min(line) as line from t group by all),
m as (select t.*, case when trim(a.line) <> '' then a.line end as l1, case when trim(b.line) <> '' then b.line end as l2 from t
  left join one a on a.conv_id = t.conv_id and a.turn = t.turn - 1 left join one b on b.conv_id = t.conv_id and b.turn = t.turn - 2),
ln as (select conv_id, turn, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from m),
lf as (select *, trim(regexp_replace(x, '\\s+', ' ', 'g')) = '' as blank from ln),
run as (select *, i - row_number() over (partition by conv_id, turn, blank order by i) as g from lf),
own as (select conv_id, turn, min(i) as i, string_agg(x, chr(10) order by i) as body from run where not blank group by conv_id, turn, g),
kept as (select *, md5(lower(trim(regexp_replace(body, '\\s+', ' ', 'g')))) as h from own),
q as (select conv_id, turn, 1 as level, md5(lower(trim(regexp_replace(l1, '\\s+', ' ', 'g')))) as h from m where l1 is not null
  union all select conv_id, turn, 2, md5(lower(trim(regexp_replace(l2, '\\s+', ' ', 'g')))) from m where l2 is not null),
lines as (select conv_id, turn, md5(lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) as h from lf where not blank),
said as (select conv_id, h, min(turn) as origin from (select conv_id, turn, h from kept union all select * from lines) group by all),
firsts as (select h, min(conv_id) as c1, max(conv_id) as c2 from said group by h),
f as (select q.*, coalesce(said.origin < q.turn, false) as here, coalesce(c1 <> q.conv_id or c2 <> q.conv_id, false) as there, origin from q
  left join said on said.conv_id = q.conv_id and said.h = q.h left join firsts on firsts.h = q.h),
per as (select conv_id, turn, count(*) as n_quotes, sum(case when here or there then 1 else 0 end) as n_linked, max(case when here and level = 1 then origin end) as parent from f group by all),
up as (select conv_id, turn, turn as top, 0 as depth from m union all select up.conv_id, up.turn, per.parent, depth + 1 from up join per on per.conv_id = up.conv_id and per.turn = up.top where per.parent is not null),
roots as (select conv_id, turn, min(top) as root_turn, max(depth) as reply_depth from up group by all),
txt as (select conv_id, turn, string_agg(body, chr(10) || chr(10) order by i) as clean from kept group by all)
select m.conv_id, m.turn, m.role, coalesce(clean, '') as clean_text, coalesce(n_quotes, 0) as n_quotes, cast(coalesce(n_linked, 0) as bigint) as n_linked, parent as parent_turn, root_turn,
  cast(reply_depth as bigint) as reply_depth from m left join per using (conv_id, turn) left join roots using (conv_id, turn) left join txt using (conv_id, turn)
"""

ORACLES: dict[str, str] = {
    "op1_quotation_linking": OP1_SQL,
    "op2_mixing_weights": mixing.oracle(),
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_exact_topk": topk.ORACLE,
    "op9_warc_captures": warc.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_conversation_repair": repair.oracle(),
    "op13_benchmark_decontamination": contamination.oracle(),
}

"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .lang_ppm import language_id
from .license_scan import digest, license_scan
from .near_dedup import near_duplicates
from .rans_store import read_files, write_files
from .secret_scan import digest as secret_digest
from .secret_scan import secret_scan
from .sp_codec import round_trip
from .substring_dedup import substring_dedup
from .token_counts import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near").cast("bigint").alias("n_near"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(license_scan(table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), PIECES)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents"), BYTE_BPE))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_token_counts": op6_token_counts,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_token_files": op8_token_files,
        "op9_language_id": op9_language_id,
        "op10_near_dedup": op10_near_dedup,
    }


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = {
    "op1_decontaminate": f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(len(w), 8) as k, array_to_string(w[i:i + 7], ' ') as g
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as i from b where len(w) > 0)),
spot as (select rid, w, unnest(generate_series(1, len(w))) as i from d),
occ as (
  select distinct rid, i, win.k, item_id
  from spot join (select distinct k from win) ks on i + ks.k - 1 <= len(w)
  join win on win.k = ks.k and win.g = array_to_string(w[i:i + ks.k - 1], ' ')),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + k - 1)) as p from occ) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct rid, item_id::varchar as item from occ) group by rid),
word as (select rid, unnest(w) as t, generate_subscripts(w, 1) as p from d),
freq as (select t, count(*) as n from word group by t),
sets as (select row_number() over () as id, item_id, terms from (select distinct item_id, list_sort(list_distinct(w[i:i + 7])) as terms
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as i from b where len(w) > 0))),
rare as (select id, arg_min(u.t, coalesce(freq.n, 0)) as t from (select id, unnest(terms) as t from sets) u left join freq on freq.t = u.t group by id),
place as (select sets.item_id, sets.terms, word.rid, unnest(generate_series(greatest(1, word.p - 15), word.p)) as s from rare join word on word.t = rare.t join sets on sets.id = rare.id),
close_ as (select rid, count(distinct item_id) as n_near from place join d using (rid) where list_has_all(w[s:s + 15], terms) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated, coalesce(n_near, 0) as n_near
from d left join hit using (rid) left join its using (rid) left join close_ using (rid)
""",
    "op2_exact_dedup": f"""
with t as (select doc_id, {_NORM} as norm, length(coalesce(text, '')) as points from documents),
r as (select *, count(*) over (partition by norm) as group_size, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

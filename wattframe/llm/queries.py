"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_digests
from .exact_dedup import duplicate_report
from .jaccard_join import similar_documents
from .licenses import scan_licenses
from .manifest import document_manifest
from .mixing import mixture
from .neighbours import nearest
from .prefix_bpe import prefix_digests
from .sharding import shard_documents
from .token_files import token_files
from .toxicity import toxicity_report
from .warc import archive_pages
from .whitening import whiten

#: Tokenizer files; every executor has them at the same place.
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: Shares of the corpus's tokens that each language shall have.
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)
    share = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return mixed.select(F.col("id").alias("doc_id"), "tokens", *share, "rate", "copies")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def _encoded(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_encoded, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of the decimal id: the low bits of its bytes, folded eight times each.
_TAMPERED = """
    crc as (
        select doc_id, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
               lambda r, c: list_reduce(list_prepend(xor(r, c), list_transform(range(8), lambda b: b::ubigint)),
                         lambda x, b: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as r
        from (select distinct doc_id from documents where doc_id is not null))"""

SQL: dict[str, str] = {
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as t, strlen(coalesce(html, '')) as n from pages),
        g as (select *, max(page_id) over (partition by t) as m, n >= 1000 and page_id <> max(page_id) over (partition by t) as again from p)
        select page_id, n as payload_bytes, sha1(t) as payload_digest,
               case when again then 'revisit' else 'response' end as record_type, case when again then m end as refers_to from g""",
    "op13_manifest": f"""
        with recursive {_TAMPERED.strip()},
        leaf as (
            select d.doc_id, lang, {_leaf("n_chars")} as leaf,
                   case when xor(r, 4294967295::ubigint) % 7 = 0 then {_leaf("n_chars + 1")} else {_leaf("n_chars")} end as claim
            from documents d left join (select doc_id as crc_id, r from crc) on d.doc_id = crc_id),
        placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx from leaf),
        tree as (
            select lang, 0 as level, idx, leaf as h from placed
            union all
            select lang, level + 1, idx // 2, sha256(string_agg(h, '' order by idx))
            from (select *, count(*) over (partition by lang) as c from tree) where c > 1 group by lang, level, idx // 2),
        subroot as (select lang, h, row_number() over (order by lang nulls first) - 1 as idx from (select lang, arg_max(h, level) as h from tree group by lang)),
        crown as (
            select 0 as level, idx, h from subroot
            union all
            select level + 1, idx // 2, sha256(string_agg(h, '' order by idx))
            from (select *, count(*) over () as c from crown) where c > 1 group by level, idx // 2),
        tree_nodes as (select * from tree), crown_nodes as (select * from crown),
        ends as (
            select s.lang, s.idx as seat, t.depth, (select max(level) from crown) as top, s.h as subroot, (select arg_max(h, level) from crown) as root
            from subroot s join (select lang, max(level) as depth from tree group by lang) t on s.lang is not distinct from t.lang),
        climb as (
            select p.doc_id, p.leaf, e.lang, 0 as level, case when e.depth = 0 then e.seat else p.idx end as idx, p.claim as folded, '' as proof,
                   e.seat, e.depth, e.top, e.subroot, e.root
            from placed p join ends e on p.lang is not distinct from e.lang
            union all
            select c.doc_id, c.leaf, c.lang, c.level + 1, case when c.level + 1 = c.depth then c.seat else c.idx // 2 end,
                   sha256(case when coalesce(n.h, k.h) is null then c.folded when c.idx % 2 = 1 then coalesce(n.h, k.h) || c.folded else c.folded || coalesce(n.h, k.h) end),
                   c.proof || coalesce(n.h, k.h, ''), c.seat, c.depth, c.top, c.subroot, c.root
            from climb c
            left join tree_nodes n on c.level < c.depth and n.lang is not distinct from c.lang and n.level = c.level and n.idx = xor(c.idx, 1)
            left join crown_nodes k on c.level >= c.depth and k.level = c.level - c.depth and k.idx = xor(c.idx, 1)
            where c.level < c.depth + c.top)
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
        from climb where level = depth + top""",
    # Pairs by common shingles; components as the least id that links reach.
    "op9_jaccard_join": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents),
        sets as (
            select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle
            from words),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        links as (
            select a, b from (
                select x.doc_id as a, y.doc_id as b, count(*) as c from sets x join sets y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all)
            join sizes p on p.doc_id = a join sizes q on q.doc_id = b
            where 100 * c >= 80 * (p.n + q.n - c)),
        reach as (
            select a, b from links
            union
            select r.a, l.b from reach r join links l on r.b = l.a)
        select d.doc_id, coalesce(any_value(n), 0) as n_shingles, least(d.doc_id, min(b)) as component_id
        from documents d left join sizes s on s.doc_id = d.doc_id left join reach r on r.a = d.doc_id group by d.doc_id""",
    "op4_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Registered queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import (
    decontaminate,
    exact_dedup,
    hard_negatives,
    jaccard,
    language,
    licenses,
    merkle,
    mixing,
    quality,
    sharding,
    substrings,
    token_counts,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary that op1 counts with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _query(name: str, *tables: str, sql: str | None = None):
    """Register a function of tables, read whole from the given folder."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables])

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@_query("op1_token_counts", "documents")
def op1(documents: DataFrame) -> DataFrame:
    return token_counts.count_tokens(documents, VOCABULARY)


@_query("op2_substring_dedup", "documents")
def op2(documents: DataFrame) -> DataFrame:
    return substrings.deduplicate(documents.select("doc_id", "text"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
     i as (select item_id, coalesce({_WORDS}, []) as w from benchmark),
     windows as (
       select distinct item_id, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') as words, least(13, len(w)) as n
       from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p from i where len(w) > 0)),
     lengths as (select distinct n from windows),
     stretches as (
       select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as words
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lengths where len(w) >= n)),
     found as (select doc_id, s.n, p, item_id from stretches s join windows using (n, words)),
     hits as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by doc_id),
     items as (
       select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
       from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""


@_query("op3_benchmark_decontamination", "documents", "benchmark", sql=DECONTAMINATION_SQL)
def op3(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate.contamination(documents, benchmark)


MIXING_SQL = rf"""
with sized as (
       select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
              md5(concat_ws('/', cast(doc_id as varchar), '1')) as key
       from documents),
     sources as (
       select source, cast(sum(size) as bigint) as source_size, count(*) as n_docs,
              row_number() over (order by source nulls last) - 1 as number
       from sized group by source),
     weighed as (select *, [5, 2, 1][number % 3 + 1] as weight, 3 * source_size as cap, sum(source_size) over () as total from sources),
     levels as (
       select *, cap / weight as ratio,
              (total - coalesce(sum(cap) over (order by cap / weight, number rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by cap / weight, number rows between current row and unbounded following) as level
       from weighed),
     chosen as (select arg_min(level, (ratio, number)) as level from levels where level <= ratio),
     targets as (
       select source, number, source_size, n_docs, least(weight * chosen.level, cast(cap as double)) as target
       from levels, chosen),
     words as (
       select *, case when source_size > 0 then greatest(1, cast(round(target) as bigint)) else 0 end as words from targets),
     laid as (
       select s.doc_id, s.source, s.size, p.source_size, p.target, p.words,
              sum(s.size) over (partition by p.number
                order by cast('0x' || substr(key, 1, 8) as bigint) % cast(ceil(p.n_docs / 4096) as bigint), key, s.size
                rows unbounded preceding) - s.size as start
       from sized s join words p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
       cast(case when size = 0 then 0 else size * (words // source_size)
            + greatest(0, least(start + size, words % source_size) - start) end as bigint) as taken
from laid"""


@_query("op4_source_mixing", "documents", sql=MIXING_SQL)
def op4(documents: DataFrame) -> DataFrame:
    return mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken")


@_query("op5_sharding", "documents")
def op5(documents: DataFrame) -> DataFrame:
    return sharding.sharded(documents).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op6_language_id", "documents")
def op6(documents: DataFrame) -> DataFrame:
    return language.identify(documents)


WARC_SQL = """
with sized as (
       select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes,
              sha1(coalesce(html, '')) as payload_digest
       from pages),
     grouped as (select *, max(page_id) over (partition by payload) as response_id from sized)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> response_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> response_id then response_id end as refers_to
from grouped"""


@_query("op7_warc_bundles", "pages", sql=WARC_SQL)
def op7(pages: DataFrame) -> DataFrame:
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


EXACT_SQL = r"""
with normal as (
       select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
       from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from normal"""


@_query("op8_exact_dedup", "documents", sql=EXACT_SQL)
def op8(documents: DataFrame) -> DataFrame:
    return exact_dedup.deduplicate(documents, exact_dedup.new_index(documents.sparkSession), 0)


@_query("op9_license_scan", "documents")
def op9(documents: DataFrame) -> DataFrame:
    return licenses.scan(documents, licenses.notices(documents.sparkSession))


@_query("op10_jaccard_join", "documents")
def op10(documents: DataFrame) -> DataFrame:
    return jaccard.classes(documents)


HARD_NEGATIVES_SQL = """
with v as (
       select cast(vec_id as bigint) as vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
              list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
       from embeddings
       where label is not null and embedding is not null
         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (
       select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
              cast(list_inner_product(a.q, b.q) as bigint) as score
       from v a join v b on a.vec_id <> b.vec_id
       where a.vec_id % 100 = 0),
     p as (
       select anchor_id, other_id as positive_id, score as positive_score
       from s where same
       qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over best as int) as rank, other_id as negative_id, positive_score,
       score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and score <= positive_score and 80 * positive_score <= 100 * score
window best as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify row_number() over best <= 5"""


@_query("op11_hard_negatives", "embeddings", sql=HARD_NEGATIVES_SQL)
def op11(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.quantised(embeddings.withColumn("label", label))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint)),
    lambda crc, b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, xor(crc, b)),
    cast(4294967295 as bigint)))"""


def _climb_sql(name: str, nodes: str) -> str:
    """CTEs of a tree for each `source` of nodes (source, place, digest, n), all levels, and its runs of children."""
    return f"""
     {name} as (
       select source, 0 as level, place, digest, n from {nodes}
       union all
       select source, level + 1, place // 3, sha256(string_agg(digest, '' order by place)), (n + 2) // 3
       from {name} where n > 1 group by source, level, place // 3, n),
     {name}_runs as (
       select source, level, place // 3 as parent, list(digest order by place) as run
       from {name} where n > 1 group by source, level, place // 3)"""


def _proof_sql(name: str, tree: str, leaves: str) -> str:
    """CTE that takes leaves (id, source, place, acc, proof) level by level to the root."""
    return f"""
     {name} as (
       select id, source, 0 as level, place, acc, proof from {leaves}
       union all
       select id, p.source, p.level + 1, parent,
              sha256(array_to_string(run[:place % 3] || [acc] || run[place % 3 + 2:], '')),
              proof || array_to_string(run[:place % 3] || run[place % 3 + 2:], '')
       from {name} p join {tree}_runs r on p.source is not distinct from r.source and p.level = r.level and place // 3 = parent)"""


MERKLE_SQL = f"""
with recursive docs as (
       select *, row_number() over (order by doc_id) as id, {_CRC} % 2 = 0 as tampered from documents),
     digests as (
       select id, doc_id, source, {_leaf_sql("text")} as leaf,
              case when tampered then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql("text")} end as changed
       from docs),
     leaves as (
       select *, leaf as digest, count(*) over (partition by source) as n,
              row_number() over (partition by source order by doc_id, leaf) - 1 as place
       from digests),{_climb_sql("up", "leaves")},
     subroots as (select source as name, digest as subroot from up where n = 1),
     tops as (
       select name, subroot as digest, 0 as source, count(*) over () as n,
              row_number() over (order by name nulls first) - 1 as place
       from subroots),{_climb_sql("top", "tops")},
     root as (select digest as root from top where n = 1),
     first as (select id, source, place, changed as acc, '' as proof from leaves),{_proof_sql("below", "up", "first")},
     highest as (select id, arg_max(acc, level) as acc, arg_max(proof, level) as proof from below group by id),
     second as (
       select id, 0 as source, tops.place, acc, proof
       from highest join leaves using (id) join tops on leaves.source is not distinct from tops.name),{_proof_sql("above", "top", "second")},
     ends as (select id, arg_max(acc, level) as folded_root, arg_max(proof, level) as proof from above group by id)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified
from ends join leaves using (id) join subroots on source is not distinct from name, root"""


@_query("op12_merkle_manifest", "documents", sql=MERKLE_SQL)
def op12(documents: DataFrame) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    proofs = merkle.manifest(documents, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.folded(F.col("changed"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("op13_quality_classifier", "documents", "labels")
def op13(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.classify(documents, labels)

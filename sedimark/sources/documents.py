"""Observations derived from table-resident documents.

The tables hold no file facts, so a fixed rule supplies them: a path from source, language and id; every
third document shares the identity of the first with its text; every eleventh has no allocation, every
thirteenth stale evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.paths import components


def observed(documents: DataFrame) -> DataFrame:
    """Facts of the documents, in the columns that the relational operators read."""
    base = documents.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("content_hash"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path_key"),
    )
    firsts = base.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    owned = base.join(firsts, "content_hash", "left").withColumn("object_id", F.when(F.col("doc_id") % 3 == 0, F.col("first_id")).otherwise(F.col("doc_id")))
    links = owned.groupBy("object_id").agg(F.count("*").alias("link_count"))
    blocks = F.ceil(F.col("size_bytes") / F.lit(4096.0)).cast("bigint") * 4096
    return owned.join(links, "object_id").select(
        F.col("doc_id").cast("string").alias("observation_id"),
        "doc_id",
        "path_key",
        components(F.col("path_key")).alias("components"),
        "size_bytes",
        (F.col("doc_id") * 1000 + 7).alias("modified_unix_ns"),
        (F.col("doc_id") * 1000 + 9).alias("changed_unix_ns"),
        "content_hash",
        F.lit("1").alias("filesystem_id"),
        F.col("object_id").cast("string").alias("file_id"),
        "link_count",
        F.when(F.col("doc_id") % 11 == 0, None).otherwise(blocks).alias("allocated_size_bytes"),
        F.lit("unknown").alias("extent_sharing_status"),
        F.when(F.col("doc_id") % 13 == 0, "stale").otherwise("current").alias("evidence_validity"),
        F.when(F.col("doc_id") % 5 == 0, "image").when(F.col("doc_id") % 7 == 0, "unknown").otherwise("other").alias("media_kind"),
        F.when(F.col("doc_id") % 5 == 0, "analyzed").when(F.col("doc_id") % 17 == 0, "unreadable").otherwise("unsupported").alias("status"),
        (F.col("doc_id") % 4 == 0).alias("cache_hit"),
    )


#: The same as common table expressions of another engine's SQL.
OBSERVED_SQL = """
base as (
  select doc_id, cast(octet_length(encode(text)) as bigint) as size_bytes, sha256(text) as content_hash,
         '/' || source || '/' || lang || '/' || cast(doc_id as varchar) || '.txt' as path_key from documents),
owned as (
  select *, case when doc_id % 3 = 0 then min(doc_id) over (partition by content_hash) else doc_id end as object_id from base),
obs as (
  select cast(doc_id as varchar) as observation_id, doc_id, path_key, size_bytes, doc_id * 1000 + 7 as modified_unix_ns,
         doc_id * 1000 + 9 as changed_unix_ns, content_hash, '1' as filesystem_id, cast(object_id as varchar) as file_id,
         count(*) over (partition by object_id) as link_count,
         case when doc_id % 11 = 0 then null else cast(ceil(size_bytes / 4096.0) as bigint) * 4096 end as allocated_size_bytes,
         'unknown' as extent_sharing_status,
         case when doc_id % 13 = 0 then 'stale' else 'current' end as evidence_validity,
         case when doc_id % 5 = 0 then 'image' when doc_id % 7 = 0 then 'unknown' else 'other' end as media_kind,
         case when doc_id % 5 = 0 then 'analyzed' when doc_id % 17 = 0 then 'unreadable' else 'unsupported' end as status,
         doc_id % 4 = 0 as cache_hit
  from owned),
ranked as (
  select *, row_number() over (partition by file_id order by path_key) as alias_rank,
         count(*) over (partition by file_id) as observed_path_count, min(path_key) over (partition by file_id) as primary_path from obs),
objects as (select * from ranked where alias_rank = 1),
exact as (
  select size_bytes, content_hash, count(*) as member_count, sum(observed_path_count) as observed_path_count, min(primary_path) as keep_path,
         bool_or(filesystem_id is null) as r1, bool_or(allocated_size_bytes is null) as r2, bool_or(link_count > 1) as r3, bool_or(extent_sharing_status = 'unknown') as r4
  from objects where evidence_validity = 'current' and content_hash is not null group by size_bytes, content_hash having count(*) > 1),
groups as (
  select 'exact-' || substr(sha256(cast(size_bytes as varchar) || ':' || content_hash), 1, 16) as group_id, size_bytes, content_hash, member_count,
         cast(observed_path_count as bigint) as observed_path_count, cast(size_bytes * (member_count - 1) as bigint) as reclaimable_bytes, keep_path,
         concat_ws(',', case when r1 then 'filesystem_identity_unavailable' end, case when r2 then 'allocation_metadata_unavailable' end,
                   case when r3 then 'unobserved_hard_links' end, case when r4 then 'extent_sharing_unknown' end) as reasons from exact),
members as (
  select g.group_id, g.keep_path, o.* from objects o join groups g using (size_bytes, content_hash) where o.evidence_validity = 'current')
"""

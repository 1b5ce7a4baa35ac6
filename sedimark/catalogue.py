"""The registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark import catalogue_files
from sedimark.functions import blake3, media, paths
from sedimark.operators import account, cache, diagnostics, graph, layers, relate, stability
from sedimark.plans import duplicates
from sedimark.sources import pages as page_source
from sedimark.sources.documents import OBSERVED_SQL, observed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def _over_observed(sql: str) -> str:
    return f"with {OBSERVED_SQL} {sql}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(_table(spark, sf_dir, "documents"))


# --- observations


@_register(
    _over_observed(
        "select observation_id, path_key, size_bytes, modified_unix_ns, content_hash, status, media_kind, cache_hit, 'stable' as observation_stability, evidence_validity, filesystem_id, "
        "case when doc_id % 9 <> 0 then file_id end as file_id, case when doc_id % 9 <> 0 then link_count end as link_count, allocated_size_bytes, "
        "case when doc_id % 9 <> 0 then 1 else 0 end as identity_available, case when allocated_size_bytes is null then 0 else 1 end as allocation_available from obs"
    ).replace("evidence_validity, filesystem_id,", "evidence_validity, case when doc_id % 9 <> 0 then filesystem_id end as filesystem_id,")
)
def observations_projection(spark, sf_dir):
    """Nested observations, every ninth without identity, flattened with 0/1 flags."""
    identity = F.struct(F.lit("linux").alias("platform"), "filesystem_id", "file_id", "link_count")
    allocation = F.struct(F.col("size_bytes").alias("logical_size_bytes"), "allocated_size_bytes", F.lit("st_blocks512").alias("allocation_source"), "extent_sharing_status")
    nested = _observed(spark, sf_dir).withColumns({"filesystem_identity": F.when(F.col("doc_id") % 9 != 0, identity), "storage_allocation": allocation, "observation_stability": F.lit("stable")})
    return relate.facts(nested).drop("components", "extent_sharing_status")


@_register(_over_observed("select size_bytes, count(*) as file_count from base group by size_bytes"))
def size_frequency(spark, sf_dir):
    return relate.size_frequency(_table(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size_bytes")))


@_register(_over_observed("select doc_id, size_bytes from base qualify count(*) over (partition by size_bytes) > 1"))
def size_candidates(spark, sf_dir):
    return relate.size_candidates(_table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes")))


@_register(_over_observed("select doc_id, path_key, content_hash from obs where evidence_validity = 'current' and content_hash is not null"))
def eligible_observations(spark, sf_dir):
    return relate.eligible(_observed(spark, sf_dir)).select("doc_id", "path_key", "content_hash")


@_register(
    _over_observed(
        "select file_id, primary_path, observation_id as primary_id, observed_path_count, size_bytes from objects"
    )
)
def identity_aliases(spark, sf_dir):
    return relate.fold_aliases(_observed(spark, sf_dir)).select("file_id", "primary_path", F.col("observation_id").alias("primary_id"), "observed_path_count", "size_bytes")


@_register(_over_observed("select file_id, path_key, path_key = primary_path as is_primary from ranked"))
def alias_paths(spark, sf_dir):
    return relate.aliases(_observed(spark, sf_dir)).select("file_id", "path_key", "is_primary")


@_register(
    _over_observed(
        "select 'hl-' || substr(sha256(filesystem_id || ':' || file_id), 1, 16) as group_id, string_agg(path_key, ' ' order by path_key) as paths, "
        "max(observed_path_count) as observed_path_count, min_by(link_count, path_key) as link_count, min_by(size_bytes, path_key) as size_bytes, "
        "max(link_count) - max(observed_path_count) as unobserved_link_count from ranked group by filesystem_id, file_id having count(*) >= 2"
    )
)
def hard_link_groups(spark, sf_dir):
    groups = relate.hard_link_groups(_observed(spark, sf_dir))
    return groups.select(
        relate.group_id("hl-", F.col("filesystem_id"), F.col("file_id"), relate.sha256).alias("group_id"), F.array_join("paths", " ").alias("paths"),
        "observed_path_count", "link_count", "size_bytes", "unobserved_link_count",
    )


@_register(
    _over_observed(
        "select file_id, count(*) as observed_path_count, min_by(link_count, path_key) + cast(file_id as bigint) % 4 - 1 as link_count, "
        "case when min_by(link_count, path_key) + cast(file_id as bigint) % 4 - 1 >= count(*) then min_by(link_count, path_key) + cast(file_id as bigint) % 4 - 1 - count(*) end as unobserved_link_count "
        "from obs group by file_id"
    )
)
def unobserved_links(spark, sf_dir):
    rows = _observed(spark, sf_dir).withColumn("link_count", F.col("link_count") + F.col("file_id").cast("bigint") % 4 - 1)
    return relate.hard_link_groups(rows, least=1).select("file_id", "observed_path_count", "link_count", "unobserved_link_count")


@_register(
    _over_observed(
        "select file_id, count(*) as observed_path_count, max(link_count) + cast(file_id as bigint) % 4 - count(*) as unobserved_link_count from obs group by file_id having max(link_count) + cast(file_id as bigint) % 4 > count(*)"
    )
)
def unobserved_link_warnings(spark, sf_dir):
    rows = _observed(spark, sf_dir).withColumn("link_count", F.col("link_count") + F.col("file_id").cast("bigint") % 4)
    return relate.with_unobserved_links(relate.hard_link_groups(rows, least=1)).select("file_id", "observed_path_count", "unobserved_link_count")


# --- exact duplicates, accounts, plans


@_register(_over_observed("select group_id, size_bytes, content_hash, member_count, observed_path_count, reclaimable_bytes, keep_path from groups"))
def exact_duplicate_groups(spark, sf_dir):
    return relate.exact_groups(_observed(spark, sf_dir)).select("group_id", "size_bytes", "content_hash", "member_count", "observed_path_count", "reclaimable_bytes", "keep_path")


@_register(_over_observed("select group_id, observation_id, primary_path, observed_path_count, allocated_size_bytes from members"))
def exact_duplicate_members(spark, sf_dir):
    return relate.exact_members(_observed(spark, sf_dir)).select("group_id", "observation_id", "primary_path", "observed_path_count", "allocated_size_bytes")


@_register(_over_observed("select size_bytes, member_count, observed_path_count, reclaimable_bytes, keep_path, 'exact-' as prefix, 64 as digest_length, 1 as groups_of_digest from groups"))
def blake3_groups(spark, sf_dir):
    """Exact groups with true BLAKE3 digests: only size candidates are hashed, the rest never reach Python.

    The digests themselves are compared with published vectors in the tests; here the groups that they make are.
    """
    candidates, _ = relate.split_candidates(_table(spark, sf_dir, "documents").select("text", F.octet_length("text").cast("long").alias("size_bytes")))
    digest = blake3.blake3_udf()
    hashed = candidates.select(F.sha2("text", 256).alias("content_hash"), digest("text").alias("blake3")).dropDuplicates(["content_hash"])
    rows = _observed(spark, sf_dir).join(hashed, "content_hash", "left").drop("content_hash").withColumnRenamed("blake3", "content_hash")
    groups = relate.exact_groups(rows, digest)
    times = groups.groupBy("content_hash").agg(F.count("*").cast("int").alias("groups_of_digest"))
    return groups.join(times, "content_hash").select(
        "size_bytes", "member_count", "observed_path_count", "reclaimable_bytes", "keep_path", F.substring("group_id", 1, 6).alias("prefix"), F.length("content_hash").alias("digest_length"), "groups_of_digest"
    )


@_register(_over_observed("select group_id, reasons, case when reasons = '' then 'estimated' else 'unknown' end as status from groups"))
def group_reclaimability(spark, sf_dir):
    return relate.exact_groups(_observed(spark, sf_dir)).select("group_id", F.array_join("reasons", ",").alias("reasons"), F.col("reclaim_status").alias("status"))


@_register(
    _over_observed(
        "select case when count(*) > 0 and bool_and(reasons = '') then 'estimated' else 'unknown' end as status, "
        "case when count(*) > 0 and not bool_and(reasons = '') then 'extent_sharing_unknown' else '' end as reason_codes from groups"
    )
)
def run_reclaimability(spark, sf_dir):
    return account.run_reclaimability(relate.exact_groups(_observed(spark, sf_dir))).select("status", F.array_join("reason_codes", ",").alias("reason_codes"))


@_register(
    _over_observed(
        "select (select cast(sum(size_bytes) as bigint) from obs) as path_logical_bytes, (select cast(sum(size_bytes) as bigint) from objects) as unique_object_logical_bytes, "
        "(select cast(sum(allocated_size_bytes) as bigint) from objects) as known_allocated_bytes, (select count(*) from objects where allocated_size_bytes is null) as unknown_allocation_object_count, "
        "(select cast(sum(size_bytes) as bigint) from obs) - (select cast(sum(size_bytes) as bigint) from objects) as hard_link_alias_logical_bytes, "
        "(select cast(coalesce(sum(reclaimable_bytes), 0) as bigint) from groups) as duplicate_logical_bytes, cast(null as bigint) as estimated_reclaimable_allocated_bytes"
    )
)
def storage_summary(spark, sf_dir):
    return account.storage_summary(_observed(spark, sf_dir))


_SCAN_SQL = (
    "select count(*) as file_count, cast(sum(size_bytes) as bigint) as total_bytes, count(*) filter (where media_kind in ('image', 'video', 'audio')) as media_files, "
    "count(*) filter (where status = 'unsupported') as unsupported_files, count(*) filter (where status = 'unreadable') as unreadable_files, "
    "(select count(*) from groups) as exact_duplicate_groups, (select cast(coalesce(sum(member_count), 0) as bigint) from groups) as exact_duplicate_files, "
    "(select cast(coalesce(sum(reclaimable_bytes), 0) as bigint) from groups) as reclaimable_bytes, count(*) filter (where cache_hit) as cache_hits, "
    "(select count(*) from objects) as unique_object_count, (select cast(sum(n - 1) as bigint) from (select count(*) as n from obs group by file_id having count(*) > 1)) as hard_link_alias_path_count, "
    "count(*) filter (where evidence_validity <> 'current') as unstable_observation_count from obs"
)


@_register(_over_observed(_SCAN_SQL))
def scan_summary(spark, sf_dir):
    return account.scan_summary(_observed(spark, sf_dir))


@_register(_over_observed(f"select unstable_observation_count > 0 or unreadable_files > 0 as partial from ({_SCAN_SQL})"))
def report_is_partial(spark, sf_dir):
    return account.is_partial(account.scan_summary(_observed(spark, sf_dir)))


@_register(
    _over_observed(
        "select group_id, keep_path, member_count, observed_path_count as path_count, reclaimable_bytes as potential_reclaimable_bytes, "
        "'exact_duplicate' as classification, 'review_duplicates' as proposed_operation, reasons from groups"
    )
)
def plan_actions(spark, sf_dir):
    return duplicates.actions(_observed(spark, sf_dir)).select("group_id", "keep_path", "member_count", "path_count", "potential_reclaimable_bytes", "classification", "proposed_operation", F.array_join("reasons", ",").alias("reasons"))


_PATHS_SQL = (
    "select m.group_id, o.path_key, case when m.primary_path = m.keep_path then 'keep' else 'candidate' end as role, m.size_bytes as expected_size_bytes, "
    "o.modified_unix_ns as expected_modified_unix_ns, m.content_hash as expected_content_hash from members m join obs o on o.file_id = m.file_id"
)


@_register(_over_observed(_PATHS_SQL))
def plan_preconditions(spark, sf_dir):
    return duplicates.paths(_observed(spark, sf_dir))


@_register(
    _over_observed(
        f"select (select count(*) from groups) as action_count, (select count(*) from ({_PATHS_SQL}) where role = 'candidate') as candidate_file_count, "
        "(select cast(coalesce(sum(reclaimable_bytes), 0) as bigint) from groups) as potential_reclaimable_bytes"
    )
)
def plan_summary(spark, sf_dir):
    return duplicates.summary(_observed(spark, sf_dir))


# --- cache and signatures: a second scan in which every other document has a new modification time


def _two_scans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _observed(spark, sf_dir)
    signature = ["path_key", *cache.SIGNATURE]
    first = rows.withColumn("file_id", F.when(F.col("doc_id") % 19 != 0, F.col("file_id")))
    cached = cache.storable(first).select(*signature, "content_hash", "evidence_validity", F.lit("probe-1").alias("probe_signature"))
    again = first.withColumn("modified_unix_ns", F.col("modified_unix_ns") + F.col("doc_id") % 2)
    return again, cached


_SCANS_SQL = (
    ", first as (select * replace (case when doc_id % 19 <> 0 then file_id end as file_id) from obs), "
    "cached as (select * from first where evidence_validity = 'current' and file_id is not null), "
    "again as (select * replace (modified_unix_ns + doc_id % 2 as modified_unix_ns) from first) "
)


@_register(
    _over_observed("select 1").removesuffix("select 1")
    + _SCANS_SQL
    + "select a.path_key, c.path_key is not null as cache_hit, c.content_hash as cached_content_hash from again a left join cached c on a.path_key = c.path_key "
    "and a.size_bytes = c.size_bytes and a.modified_unix_ns is not distinct from c.modified_unix_ns and a.file_id = c.file_id and a.changed_unix_ns = c.changed_unix_ns"
)
def cache_lookup(spark, sf_dir):
    again, cached = _two_scans(spark, sf_dir)
    return cache.lookup(again.drop("cache_hit"), cached.drop("probe_signature", "evidence_validity")).select("path_key", "cache_hit", "cached_content_hash")


@_register(
    _over_observed("select 1").removesuffix("select 1")
    + _SCANS_SQL
    + "select path_key, modified_unix_ns, content_hash from again where evidence_validity = 'current' and file_id is not null and doc_id % 3 = 1 "
    "union all select path_key, modified_unix_ns, content_hash from cached where not (doc_id % 3 = 1)"
)
def cache_upsert(spark, sf_dir):
    again, cached = _two_scans(spark, sf_dir)
    new = again.where("doc_id % 3 = 1").select("path_key", *cache.SIGNATURE, "content_hash", "evidence_validity", F.lit("probe-1").alias("probe_signature"))
    return cache.upsert(cached, new).select("path_key", "modified_unix_ns", "content_hash")


@_register(
    "select e.event_id, case when event_id % 11 = 3 then 'became_symlink' when event_id % 7 = 2 then 'filesystem_boundary_changed' when event_id % 5 = 1 then 'replaced_during_scan' "
    "when event_id % 13 = 4 then 'metadata_unavailable' when event_id % 3 = 0 or user_id % 2 = 1 then 'changed_during_hash' else 'stable' end as stability from events e"
)
def signature_change_class(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    n = F.col("event_id")

    def signature(after: bool):
        def moved(test, one, other):
            return F.when(test, other).otherwise(one) if after else one

        return F.struct(
            moved(n % 11 == 3, F.lit(False), F.lit(True)).alias("is_symlink"), moved(n % 7 == 2, F.lit("1"), F.lit("2")).alias("filesystem_id"), moved(n % 5 == 1, F.lit("a"), F.lit("b")).alias("file_id"),
            moved(F.col("user_id") % 2 == 1, F.lit(1), F.lit(2)).alias("link_count"), moved(n % 3 == 0, n, n + 1).alias("size_bytes"), n.alias("modified_unix_ns"),
            moved(n % 13 == 4, n, F.lit(None).cast("bigint")).alias("changed_unix_ns"),
        )

    return rows.select("event_id", stability.change_class(signature(False), signature(True), "changed_during_hash").alias("stability"))


# --- scalar functions

# Content types of the media query.
_TYPES = ("image/png", "video/mp4", "audio/flac", "application/pdf", "text", "image", "video/x-matroska/extra", "")


@_register(
    "with types(n, content_type) as (values (0, 'image/png'), (1, 'video/mp4'), (2, 'audio/flac'), (3, 'application/pdf'), (4, 'text'), (5, 'image'), (6, 'video/x-matroska/extra'), (7, ''), (8, null)), "
    "kinds as (select doc_id, content_type, case when content_type is null or not contains(content_type, '/') then 'unknown' "
    "when split_part(content_type, '/', 1) in ('image', 'video', 'audio') then split_part(content_type, '/', 1) else 'other' end as media_kind from documents join types on n = doc_id % 9) "
    "select *, case when media_kind in ('unknown', 'other') then 'unsupported' else 'analyzed' end as status from kinds"
)
def media_kind_status(spark, sf_dir):
    names = F.array(*map(F.lit, _TYPES), F.lit(None))
    rows = _table(spark, sf_dir, "documents").select("doc_id", names[(F.col("doc_id") % 9).cast("int")].alias("content_type"))
    kinds = rows.withColumn("media_kind", media.media_kind(F.col("content_type")))
    return kinds.withColumn("status", media.status(F.col("media_kind")))


@_register(
    "with texts as (select event_id, case when event_id % 4 = 0 then json_extract_string(props, '$.k') when event_id % 4 = 1 then json_extract_string(props, '$.k') || ' Hz' "
    "when event_id % 4 = 2 then cast(value as varchar) end as t from events) "
    "select event_id, case when regexp_full_match(t, '\\+?[0-9]+') then try_cast(t as bigint) end as parsed, try_cast(t as double) as seconds from texts"
)
def probe_numeric_parse(spark, sf_dir):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    text = F.when(n == 0, k).when(n == 1, F.concat(k, F.lit(" Hz"))).when(n == 2, F.col("value").cast("string"))
    probe = F.to_json(F.struct(F.struct(text.alias("duration"), text.alias("bit_rate")).alias("format")))
    got = _table(spark, sf_dir, "events").select("event_id", media.probe_descriptor(probe).alias("m"))
    return got.select("event_id", F.col("m.bit_rate").alias("parsed"), F.col("m.duration_seconds").alias("seconds"))


@_register(
    "with raw as (select doc_id, case when doc_id % 3 = 0 then unhex('2FFF') || encode(cast(doc_id as varchar)) else encode('/' || source || '/' || cast(doc_id as varchar)) end as b, doc_id % 3 = 0 as odd, source from documents) "
    "select doc_id, case when odd then 'unix_bytes' else 'utf8' end as encoding, case when odd then chr(0) || 'unix_bytes:' || to_base64(b) else '/' || source || '/' || cast(doc_id as varchar) end as path_key from raw"
)
def native_path_keys(spark, sf_dir):
    text = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).cast("binary")
    odd = F.concat(F.lit(b"\x2f\xff"), F.col("doc_id").cast("string").cast("binary"))
    raw = F.when(F.col("doc_id") % 3 == 0, odd).otherwise(text)
    rows = _table(spark, sf_dir, "documents").select("doc_id", paths.native_path(raw).alias("path"))
    return rows.select("doc_id", "path.encoding", paths.path_key(F.col("path")).alias("path_key"))


@_register(
    "with p as (select page_id, case when page_id % 3 = 0 then 'a/.git/' || cast(page_id as varchar) when page_id % 3 = 1 then 'a/b.c/' || cast(page_id as varchar) else '.top' end as relative from pages) "
    "select page_id, relative from p where not regexp_matches(relative, '(^|/)\\.')"
)
def hidden_path_filter(spark, sf_dir):
    n, text = F.col("page_id") % 3, F.col("page_id").cast("string")
    relative = F.when(n == 0, F.concat(F.lit("a/.git/"), text)).when(n == 1, F.concat(F.lit("a/b.c/"), text)).otherwise(".top")
    return _table(spark, sf_dir, "pages").select("page_id", relative.alias("relative")).where(~paths.is_hidden(F.col("relative")))


@_register(_over_observed("select path_key from obs union select path_key from obs where doc_id % 2 = 0"))
def inventory_union_distinct(spark, sf_dir):
    rows = _observed(spark, sf_dir)
    return rows.unionByName(rows.where("doc_id % 2 = 0")).select("path_key").distinct()


@_register("select doc_id, to_base64(encode(text)) as base64, octet_length(encode(text)) as n from documents where text is not null")
def base64_text(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", paths.base64_text(F.col("text").cast("binary")).alias("base64"))
    return rows.withColumn("n", F.octet_length(paths.base64_bytes(F.col("base64"))).cast("long"))


_MESSAGES = ("the file was Replaced", "path not found", "a SYMLINK now", "size changed", "no metadata", "permission denied")


@_register(
    "select event_id, case event_id % 6 when 0 then 'replaced_during_scan' when 1 then 'disappeared_during_scan' when 2 then 'became_symlink' when 3 then 'changed_during_hash' "
    "when 4 then 'metadata_unavailable' else 'unreadable' end as stability from events"
)
def instability_of_message(spark, sf_dir):
    messages = F.array(*map(F.lit, _MESSAGES))
    return _table(spark, sf_dir, "events").select("event_id", stability.instability_of(messages[(F.col("event_id") % 6).cast("int")]).alias("stability"))


@_register(
    "with allocated as (select doc_id, octet_length(encode(text)) as size_bytes, case when doc_id % 11 = 0 then null else doc_id * 512 end as b from documents) "
    "select doc_id, least(9223372036854775807::hugeint, size_bytes::hugeint * 9000000000000000)::bigint as clamped, b from allocated"
)
def saturating_sizes(spark, sf_dir):
    size = F.octet_length("text").cast("decimal(19,0)")
    return _table(spark, sf_dir, "documents").select("doc_id", relate.clamped(size * F.lit(9000000000000000).cast("decimal(19,0)")).alias("clamped"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") * 512).alias("b"))


# --- diagnostics and policy

_EVENT_CLASS = {"error": "internal", "purchase": "state", "signup": "capability", "view": "input", "click": "observation"}


def _event_diagnostics(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in _EVENT_CLASS.items() for x in pair))
    n = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(n % 97 == 0, "operation_interrupted").otherwise("partial_inventory").alias("code"), kinds[F.col("event_type")].alias("classification"),
        F.when(n % 5 == 0, "blocks_command").when(n % 5 < 3, "degrades_coverage").otherwise("none").alias("impact"), F.when(n % 2 == 0, n % 4 + 1).alias("count"), "event_type",
    )


@_register(
    "select user_id, event_type, case when count(*) > 1 then cast(sum(coalesce(case when event_id % 2 = 0 then event_id % 4 + 1 end, 1)) as bigint) else max(case when event_id % 2 = 0 then event_id % 4 + 1 end) end as \"count\" "
    "from events group by user_id, event_type"
)
def diagnostic_coalesce(spark, sf_dir):
    return diagnostics.coalesce(_event_diagnostics(spark, sf_dir), ["user_id", "event_type"])


@_register(
    "with d as (select user_id, event_id % 97 = 0 as stopped, case event_type when 'error' then 'internal' when 'purchase' then 'state' when 'signup' then 'capability' when 'view' then 'input' else 'observation' end as c, "
    "case when event_id % 5 = 0 then 'blocks_command' when event_id % 5 < 3 then 'degrades_coverage' else 'none' end as i from events) "
    "select user_id, case when bool_or(stopped) then 'interrupted' when bool_or(i = 'blocks_command' and c in ('internal', 'artifact')) then 'internal_failure' "
    "when bool_or(i = 'blocks_command' and c = 'state') then 'stale_state' when bool_or(i = 'blocks_command' and c = 'capability') then 'capability_unavailable' "
    "when bool_or(i = 'blocks_command' and c = 'input') then 'invalid_input' when bool_or(i = 'degrades_coverage') then 'partial_success' else 'success' end as outcome, "
    "case when bool_or(i = 'degrades_coverage') then 'partial' else 'complete' end as coverage from d group by user_id"
)
def outcome_class(spark, sf_dir):
    return _event_diagnostics(spark, sf_dir).groupBy("user_id").agg(diagnostics.outcome_class().alias("outcome"), diagnostics.coverage().alias("coverage"))


def _event_layers(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("setting"), F.col("event_id").alias("precedence"), F.col("event_type").alias("value"))


@_register('select user_id as setting, max_by(event_type, event_id) as "value", max(event_id) as precedence, count(*) - 1 as shadowed from events group by user_id')
def policy_layering(spark, sf_dir):
    return layers.resolved(_event_layers(spark, sf_dir), ["setting"], "precedence", "value")


@_register(
    'select * from (select user_id as setting, cast(row_number() over w as int) as step, event_id as precedence, event_type as "value", lead(event_type) over w as replaced_by '
    "from events window w as (partition by user_id order by event_id)) where replaced_by is not null"
)
def policy_shadowed(spark, sf_dir):
    return layers.shadowed(_event_layers(spark, sf_dir), ["setting"], "precedence", "value")


# --- graphs


@_register(
    "select 'customer without order' as gap, c_custkey as id from customer where c_custkey not in (select o_custkey from orders) union all "
    "select 'document without label', doc_id from documents where doc_id not in (select doc_id from labels) union all "
    "select 'order without customer', o_custkey from orders where o_custkey not in (select c_custkey from customer) union all "
    "select 'label without document', doc_id from labels where doc_id not in (select doc_id from documents)"
)
def reference_integrity(spark, sf_dir):
    customer, orders, docs, labels = (_table(spark, sf_dir, t) for t in ("customer", "orders", "documents", "labels"))
    found = (
        ("customer without order", graph.unresolved(customer.select(F.col("c_custkey").alias("id")), "id", orders, "o_custkey")),
        ("document without label", graph.unresolved(docs.select(F.col("doc_id").alias("id")), "id", labels, "doc_id")),
        ("order without customer", graph.unresolved(orders.select(F.col("o_custkey").alias("id")), "id", customer, "c_custkey")),
        ("label without document", graph.unresolved(labels.select(F.col("doc_id").alias("id")), "id", docs, "doc_id")),
    )
    out = None
    for name, rows in found:
        named = rows.select(F.lit(name).alias("gap"), "id")
        out = named if out is None else out.unionAll(named)
    return out


# Which table refers to which.
_DEPENDS = (
    ("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"),
    ("lineitem", "supplier"), ("labels", "documents"), ("pages", "documents"), ("benchmark", "documents"),
)
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_RANK_SQL = (
    "with recursive e(id, depends_on) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _DEPENDS) + "), n(id) as (values " + ", ".join(f"('{t}')" for t in _TABLES) + "), "
    "walk(id, r) as (select id, 0 from n where id not in (select id from e) union select e.id, walk.r + 1 from e join walk on e.depends_on = walk.id), "
    "ranked as (select id, cast(max(r) as int) as \"rank\" from walk group by id) "
)


def _ranked(spark) -> DataFrame:
    return graph.dag_rank(spark.createDataFrame([(t,) for t in _TABLES], "id string"), spark.createDataFrame(list(_DEPENDS), "id string, depends_on string"))


@_register(_RANK_SQL + 'select id, "rank" from ranked')
def dag_rank(spark, sf_dir):
    return _ranked(spark)


@_register(_RANK_SQL + 'select "rank", count(*) as nodes from ranked group by "rank"')
def rank_histogram(spark, sf_dir):
    return graph.rank_histogram(_ranked(spark))


@_register(_RANK_SQL + "select 'lineitem' as id, depends_on as neighbour from e where id = 'lineitem' union all select 'lineitem', id from e where depends_on = 'lineitem'")
def graph_neighbourhood(spark, sf_dir):
    edges = spark.createDataFrame(list(_DEPENDS), "source string, target string")
    return graph.neighbourhood(edges, "lineitem").select(F.lit("lineitem").alias("id"), "neighbour")


_LINKS_SQL = (
    "with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, '<(?:a|link|script|img)\\b[^>]*?\\b(?:href|src)\\s*=\\s*\"([^\"]*)\"', 1))) as link from pages), "
    "found as (select page_id, link, not (regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') or starts_with(link, '//')) as is_local, url_decode(regexp_replace(link, '[?#].*$', '')) as p from l), "
    "links as (select page_id, link, case when is_local then case when ends_with(p, '/') then p || 'index.html' else p end end as path, is_local from found) "
)


@_register(_LINKS_SQL + "select * from links")
def page_links(spark, sf_dir):
    return page_source.links(_table(spark, sf_dir, "pages"))


@_register(
    _LINKS_SQL + "select page_id, path, link, is_local from links where is_local and path <> '' and path not in (select '/' || text from (select distinct unnest(string_split(text, ' ')) as text from benchmark))"
)
def broken_links(spark, sf_dir):
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(F.concat(F.lit("/"), "w").alias("path"))
    return page_source.broken(page_source.links(_table(spark, sf_dir, "pages")), words)


@_register(
    "with site as (select page_id, '/' || page_id || '.html' as path, html || '<h1 id=\"a' || page_id % 3 || '\"><a href=\"#a0\"><a href=\"/' || (page_id + 1) || '.html?q#a%31\">' as html from pages), "
    "l as (select page_id, path as own, unnest(list_distinct(regexp_extract_all(html, '<(?:a|link|script|img)\\b[^>]*?\\b(?:href|src)\\s*=\\s*\"([^\"]*)\"', 1))) as link from site), "
    "asked as (select page_id, own, link, url_decode(regexp_replace(link, '[?#].*$', '')) as p, url_decode(regexp_extract(link, '#(.*)$', 1)) as anchor from l "
    "where not (regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') or starts_with(link, '//'))), "
    "aimed as (select page_id, link, case when p = '' then own when ends_with(p, '/') then p || 'index.html' else p end as path, anchor from asked where anchor <> ''), "
    "held as (select distinct path, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*?\\bid\\s*=\\s*\"([^\"]*)\"', 1)) as anchor from site) "
    "select page_id, link, path, anchor from aimed a where path in (select path from site) and not exists (select 1 from held h where h.path = a.path and h.anchor = a.anchor)"
)
def broken_anchors(spark, sf_dir):
    n = F.col("page_id")
    more = F.concat(F.lit('<h1 id="a'), (n % 3).cast("string"), F.lit('"><a href="#a0"><a href="/'), (n + 1).cast("string"), F.lit('.html?q#a%31">'))
    site = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), n.cast("string"), F.lit(".html")).alias("path"), F.concat("html", more).alias("html"))
    return page_source.broken_anchors(site)


_LEVELS = "".join(
    f", l{digits} as (select substr(name, 1, {digits}) as name, sha256(string_agg(d, '' order by {above}.name, d)) as d from {above} group by 1)" for digits, above in ((8, "leaf"), (6, "l8"), (4, "l6"), (2, "l4"), (0, "l2"))
)


@_register("with leaf as (select sha256(cast(doc_id as varchar) || chr(0) || text) as name, name as d from documents)" + _LEVELS + " select d as fingerprint from l0")
def corpus_fingerprint(spark, sf_dir):
    return graph.fingerprint(_table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | catalogue_files.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | catalogue_files.oracle_sql()

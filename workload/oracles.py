"""DuckDB SQL for the queries of ``registry``, written from the definitions, not from the plans."""

from __future__ import annotations

_OBJ = r"""
obj0 as (
 select doc_id, 'main' as bucket,
  'Music/'||lang||'/'||source
   ||CASE doc_id%3 WHEN 1 THEN ' ['||CAST(1000+doc_id%2 AS VARCHAR)||'] [2020]'
                   WHEN 2 THEN ' ['||CAST(2000+doc_id%2 AS VARCHAR)||']' ELSE '' END
   ||'/d'||CAST(doc_id AS VARCHAR)||'/'||CASE WHEN doc_id%13=0 THEN ' ' ELSE '' END
   ||'track'||CAST(doc_id%40 AS VARCHAR)
   ||CASE doc_id%6 WHEN 1 THEN ' (1)' WHEN 2 THEN '_copy' WHEN 3 THEN ' - Copie'
                   WHEN 4 THEN '_2' WHEN 5 THEN '  été' ELSE '' END
   ||CASE WHEN doc_id%3=0 THEN '.jpg' WHEN doc_id%5=0 THEN '.flac' WHEN doc_id%5=1 THEN '.MP3'
          WHEN doc_id%5=2 THEN '.mkv' ELSE '' END as key,
  cast(strlen(text) as bigint) as size,
  '"'||md5(text)||CASE WHEN doc_id%4=0 THEN '-'||CAST(2+doc_id%8 AS VARCHAR) ELSE '' END||'"'
   as etag,
  doc_id%4=0 as is_multipart,
  CASE WHEN strlen(text) IN (SELECT strlen(text) FROM documents WHERE doc_id%4=0)
        AND strlen(text) IN (SELECT strlen(text) FROM documents GROUP BY 1 HAVING count(*)>1)
       THEN sha256(text) END as full_sha,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((doc_id*37)%1000 AS INTEGER)) as last_modified,
  source, lang, sha256(text) as any_sha
 from documents),
obj as (select * exclude (full_sha), cast(null as varchar) as sha256 from obj0),
objh as (select * exclude (full_sha), full_sha as sha256 from obj0),
objp as (select * exclude (full_sha), CASE WHEN doc_id%9<>0 THEN full_sha END as sha256 from obj0)
"""

_MEDIA = r"""
media as (
 select doc_id, bucket, key, source as artist, 'Album '||CAST(doc_id%7 AS VARCHAR) as album,
  CASE WHEN doc_id%17<>0 THEN 'Title '||CAST(doc_id%60 AS VARCHAR) END as title,
  CAST(doc_id%300 AS DOUBLE) as duration_s,
  CASE doc_id%5 WHEN 0 THEN 'flac' WHEN 1 THEN 'mp3' END as codec,
  CAST(128+64*(doc_id%4) AS BIGINT) as bitrate
 from obj where doc_id%3<>0 and doc_id%5 in (0,1,2))
"""

_EXT = r"regexp_extract(regexp_extract({k}, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1)"
_BASE = "regexp_extract({k}, '[^/]*$')"


def _ext(k: str) -> str:
    return _EXT.format(k=k)


def _base(k: str) -> str:
    return _BASE.format(k=k)


def _stem(k: str) -> str:
    return f"left({_base(k)}, length({_base(k)}) - length({_ext(k)}))"


def _normalized(k: str) -> str:
    name = f"strip_accents(lower({_stem(k)}))"
    for pattern, flags in (
        (r"\s*\(\d+\)$", ""), (r"\s*-\s*Copie$", "i"), (r"\s*-\s*Copy$", "i"),
        (r"[_ ]copy$", "i"), (r"_\d+$", ""),
    ):
        name = f"regexp_replace({name}, '{pattern}', '', 'g{flags}')"
    return f"regexp_replace(trim({name}), '\\s+', ' ', 'g') || lower({_ext(k)})"


def _score(k: str) -> str:
    s = _stem(k)
    moji = r"Ã[\x{80}-\x{bf}]|Ã[©¨ ´¹²³¼½¾]|Â[\x{a0}-\x{bf}]"
    copies = r"\(\d+\)$|-\s*copie$|-\s*copy$|[_ ]copy$|_\d+$"
    return (
        f"(CASE WHEN regexp_matches({s}, '{moji}') THEN 10 ELSE 0 END"
        f" + CASE WHEN regexp_matches({s}, '{copies}', 'i') THEN 5 ELSE 0 END"
        f" + CASE WHEN {s} <> trim({s}) THEN 2 ELSE 0 END"
        f" + CASE WHEN contains({s}, '  ') THEN 1 ELSE 0 END)"
    )


def _human(x: str) -> str:
    steps = [("o", 0), ("Ko", 1), ("Mo", 2), ("Go", 3), ("To", 4)]
    cases = " ".join(
        f"WHEN abs({x}) < {1024 ** (p + 1)} THEN format('{{:.1f}}', ({x})/{float(1024 ** p)})"
        f"||' {u}'" for u, p in steps
    )
    return f"CASE {cases} ELSE format('{{:.1f}}', ({x})/{float(1024 ** 5)})||' Po' END"


_QUOTE = "''''||replace({x}, '''', '''\\''''')||''''"


def _uri(bucket: str, key: str) -> str:
    return _QUOTE.format(x=f"'s3://'||{bucket}||'/'||{key}")


def _with(*ctes: str) -> str:
    return "with recursive " + ", ".join(c.strip() for c in ctes) + "\n"


# Duplicate groups and members, from the three passes.

_GROUPS = r"""
size_dups as (select size from {t} group by size having count(*) > 1),
etag_dups as (
 select etag from {t} join size_dups using (size) group by etag having count(*) > 1),
etag_rows as (
 select o.* from {t} o join size_dups using (size) where etag in (select etag from etag_dups)),
plain as (
 select etag from etag_rows group by etag having not bool_or(is_multipart)),
sha_dups as (
 select sha256 from {t} where sha256 is not null group by sha256 having count(*) > 1),
members as (
 select 'etag' as kind, etag as fingerprint, size, bucket, key, last_modified
 from etag_rows where etag in (select etag from plain)
 union all
 select 'sha256', sha256, size, bucket, key, last_modified
 from {t} where sha256 in (select sha256 from sha_dups)),
groups as (
 select kind, fingerprint, size, count(*) as n, size * (count(*) - 1) as wasted_bytes
 from members group by kind, fingerprint, size),
dups as (
 select kind, fingerprint, size, bucket, key, last_modified, n, wasted_bytes
 from members join groups using (kind, fingerprint, size))
"""

_EXCLUSIVE = r"""
ident as (
 select *, coalesce(sha256,
   max(sha256) over (partition by size, etag, is_multipart),
   case when not is_multipart then etag end) as fingerprint
 from {t}),
xgroups as (
 select fingerprint, size, count(*) as n, size * (count(*) - 1) as wasted_bytes
 from ident where fingerprint is not null group by fingerprint, size having count(*) > 1),
xdups as (
 select 'content' as kind, fingerprint, size, bucket, key, last_modified, n, wasted_bytes
 from ident join xgroups using (fingerprint, size))
"""

_FOLDERS = r"""
placed as (
 select *, split_part(key,'/',1)||'/'||split_part(key,'/',2)||'/'||split_part(key,'/',3) as folder
 from obj where starts_with(key, 'Music/') and split_part(key,'/',3) <> ''),
counted as (
 select bucket, folder,
  count(*) filter (starts_with(key, folder||'/')) as file_count,
  count(*) filter (starts_with(key, folder||'/')
   and regexp_matches(lower(key), '\.(flac|mp3|ogg|m4a|wav|opus|aac|wma)$')) as media_count,
  count(*) filter (starts_with(key, folder||'/')
   and regexp_matches(lower(key), '\.(jpg|jpeg|png|gif|bmp|webp)$')) as image_count,
  cast(coalesce(sum(size) filter (starts_with(key, folder||'/')), 0) as bigint) as total_size
 from placed group by all),
stats as (
 select bucket, folder,
  case when regexp_matches(split_part(folder,'/',3), '^(.*?)\s*\[\d+\](?:\s*\[\d{4}\])?$')
   then split_part(folder,'/',1)||'/'||split_part(folder,'/',2)||'/'||rtrim(regexp_extract(
    split_part(folder,'/',3), '^(.*?)\s*\[\d+\](?:\s*\[\d{4}\])?$', 1))
   else folder end as base_name,
  file_count, media_count, image_count, total_size,
  image_count = file_count and file_count > 0 as only_images
 from counted),
fgroups as (
 select bucket, base_name,
  case when bool_or(media_count = 0) and bool_or(media_count > 0) then 'orphan'
   else 'both_music' end as category,
  bool_or(media_count > 0) as any_media, count(*) as n,
  min(folder) filter (media_count = 0) as s, min(folder) filter (media_count > 0) as a
 from stats group by all having count(*) > 1),
fgroups2 as (
 select bucket, base_name, category, any_media, n,
  case when category = 'orphan' then s end as first_orphan,
  case when category = 'orphan' then a end as first_complete from fgroups),
dupfolders as (
 select bucket, base_name, category, any_media, folder, file_count, media_count, image_count,
  total_size, only_images,
  case when category = 'orphan' then
   case when media_count > 0 then 'complete' else 'orphan' end end as role,
  first_orphan, first_complete, n
 from stats join fgroups2 using (bucket, base_name))
"""

_WORKS = r"""
pairs as (
 select artist, title, count(*) as n from media
 where artist is not null and title is not null group by all having count(*) > 1),
works as (
 select artist, title, m.bucket, m.key, codec, bitrate, o.size, n
 from media m join obj o on m.bucket = o.bucket and m.key = o.key join pairs using (artist, title))
"""


def _suspects(table: str, identity: str) -> str:
    return rf"""
named as (select *, {_normalized('key')} as normalized from {table}),
snames as (
 select normalized, count(*) as n from named group by normalized
 having count(*) > 1 and count(distinct {identity}) > 1),
suspects as (select named.*, n from named join snames using (normalized))
"""


_SCAN = r"""
old as (
 select * replace (case when doc_id%9=0 then 'old-'||etag else etag end as etag)
 from {t} where doc_id%10<>2),
cur as (
 select bucket, key, size, etag, is_multipart, last_modified from {t} where doc_id%10<>1)
"""

_DIFF = r"""
diff as (
 select bucket, key,
  case when o.etag is null then 'new' when c.etag is null then 'deleted'
   when o.etag <> c.etag then 'updated' else 'unchanged' end as change,
  o.etag as old_etag, c.etag as new_etag
 from (select bucket, key, etag from old where starts_with(key, '{p}')) o
 full join (select bucket, key, etag from cur where starts_with(key, '{p}')) c
  using (bucket, key))
"""

_AFTER = r"""
after as (
 select size, etag, is_multipart, sha256 from old where key not in (select key from diff where change in ('deleted', 'updated'))
 union all
 select size, etag, is_multipart, null from cur where key in (select key from diff where change in ('new', 'updated'))),
again as (
 select size, count(*) as n from after group by etag, size having count(*) > 1 and not bool_or(is_multipart)
 union all
 select size, count(*) from after where sha256 is not null group by sha256, size having count(*) > 1)
"""

_LOG = r"""
state as (
 select *, not gone and changed and (not known or etag <> old_etag) as fresh from (
  select bucket, key, doc_id%10<>2 as known, doc_id%6=1 and doc_id%7<>3 as gone,
   doc_id%10=2 or doc_id%9=0 or doc_id%7=3 as changed, etag as new_etag,
   case when doc_id%9=0 then 'old-'||etag else etag end as old_etag,
   case when doc_id%7=3 then size+1 else size end as new_size,
   size, etag, is_multipart, sha256, last_modified from objh))
"""

_CONFIG = r"""
sources as (
 select source as bucket, max(doc_id) as last, count(*) as n from documents group by source),
oldc as (
 select bucket, case when last%5<>0 then 'https://'||bucket end as endpoint_url
 from sources where last%3<>0),
newc as (
 select bucket, case when n%2=0 then 'https://'||bucket
  when n%3=0 then 'https://'||bucket||':9000' end as endpoint_url
 from sources where n%4<>0),
config as (
 select bucket,
  case when newc.bucket is not null then newc.endpoint_url else oldc.endpoint_url end
   as endpoint_url,
  TIMESTAMP '2024-06-01 00:00:00' as updated_at,
  case when newc.bucket is not null and oldc.endpoint_url is not null
   and oldc.endpoint_url is distinct from newc.endpoint_url then oldc.endpoint_url end as previous
 from oldc full join newc using (bucket))
"""

_RKEYS = r"""
rkeys as (
 select doc_id, 'main' as bucket,
  'dir'||CAST((doc_id//5)%10 AS VARCHAR)||CASE WHEN (doc_id//5)%3=0 THEN ' ' ELSE '' END||'/'
   ||CASE doc_id%5 WHEN 1 THEN ' ' ELSE '' END||'item'||CAST((doc_id//5) AS VARCHAR)
   ||CASE doc_id%5 WHEN 2 THEN '.txt ' WHEN 3 THEN chr(92)||'.txt' WHEN 4 THEN '_2.txt'
                   ELSE '.txt' END as key
 from documents),
spaced as (
 select *, array_to_string(list_filter(list_transform(
  string_split(key, '/'), lambda x: trim(x)), lambda x: x <> ''), '/') as s1 from rkeys),
cleaned as (
 select *, case when contains(s1, chr(92))
  then regexp_replace(replace(s1, chr(92), ''), ' {2,}', ' ', 'g') else s1 end as wanted
 from spaced)
"""

# The greedy choice itself, one source per step in every family (the names that can collide).
_RESOLVED = r"""
fam as (
 select *, regexp_replace(key, '(_[0-9]+)*\.txt$', '') as kfam,
  regexp_replace(wanted, '(_[0-9]+)*\.txt$', '') as wfam from cleaned),
todo as (
 select *, min(key) over (partition by wanted) as first_key from fam
 where wanted <> key and wanted <> ''),
steps as (
 select *, row_number() over (partition by wfam order by first_key, wanted, key) as step,
  row_number() over (partition by wanted order by key) as turn from todo),
kept as (
 select kfam, list(key) as keys from fam where wanted = key or wanted = '' group by kfam),
state as (
 select f.wfam, 0 as step, coalesce(kept.keys, []::varchar[]) as taken,
  cast(null as varchar) as key, cast(null as varchar) as target
 from (select distinct wfam from steps) f left join kept on f.wfam = kept.kfam
 union all
 select wfam, step, list_append(taken, target), key, target from (
  select st.wfam, s.step, st.taken, s.key,
   case when turn = 1 and not list_contains(st.taken, wanted) then wanted
    else list_filter(list_transform(range(2, len(st.taken) + 3),
     lambda i: regexp_replace(wanted, '\.txt$', '')||'_'||i||'.txt'),
     lambda c: not list_contains(st.taken, c))[1] end as target
  from state st join steps s on s.wfam = st.wfam and s.step = st.step + 1)),
resolved as (
 select t.bucket, t.key, t.wanted, s.target, s.target <> t.wanted as conflict,
  false as invalid_target, case when m.key <> t.key then m.key end as depends_on
 from todo t join state s on s.key = t.key left join todo m on m.key = s.target),
stay as (select bucket, key from cleaned where wanted = key or wanted = ''),
finalkeys as (
 select bucket, key from stay union select bucket, target from resolved),
above as (
 select distinct bucket, array_to_string(list_slice(string_split(key, '/'), 1, i), '/') as dir
 from (select bucket, key, unnest(range(1, len(string_split(key, '/')))) as i from finalkeys)),
emptied as (
 select bucket, dir, cast(len(string_split(dir, '/')) - 1 as integer) as depth from (
  select distinct bucket, array_to_string(list_slice(string_split(key, '/'), 1, i), '/') as dir
  from (select bucket, key, unnest(range(1, len(string_split(key, '/')))) as i from resolved))
 where (bucket, dir) not in (select (bucket, dir) from above))
"""

_DUPS_H = _GROUPS.format(t="objh")
_EX = _EXCLUSIVE.format(t="objp")

_BEST = f"{_score('key')}, length({_base('key')}), last_modified, bucket, key"

def _documents(rows: str, group: str, head: str, members: str, member: str, name: str) -> str:
    """The texts of a JSON array with one document per group, one text per member."""
    names = group.replace(" desc", "")
    return f"""
select row_number() over whole as position,
 case when row_number() over inside > 1 then ',' else
  case when row_number() over whole > 1 then ']}},' else '[' end
  ||regexp_replace(cast(to_json({head}) as varchar), '.$', '')||',"{name}":[' end
 ||cast(to_json({member}) as varchar)||case when row_number() over whole = (select count(*) from {rows}) then ']}}]' else '' end as text
from {rows} window whole as (order by {group}, {members}), inside as (partition by {names} order by {members})"""


ORACLES: dict[str, str] = {
    "multipart_flag": _with(_OBJ) + """
select key, etag, regexp_matches(trim(etag, '"'), '-[0-9]+$') as multipart from obj""",
    "split_ext": _with(_OBJ) + f"""
select key, {_base('key')} as base, left(key, length(key) - length({_ext('key')})) as root,
 {_ext('key')} as ext from obj""",
    "normalize_name": _with(_OBJ) + f"select key, {_normalized('key')} as normalized from obj",
    "name_quality_score": _with(_OBJ) + f"select key, {_score('key')} as score from obj",
    "media_files": _with(_OBJ) + f"""
select key, case when regexp_matches(lower(key), '\\.(flac|mp3|ogg|m4a|wav|opus|aac|wma)$')
  then 'media' when regexp_matches(lower(key), '\\.(jpg|jpeg|png|gif|bmp|webp)$') then 'image'
  else 'other' end as class
from obj where lower({_ext('key')}) in ('.mp3','.flac','.ogg','.m4a','.aac','.wma','.opus','.wav',
 '.mp4','.mkv','.avi','.mov','.wmv','.webm')""",
    "human_size": _with(_OBJ) + f"""
select key, size, {_human('size*97')} as size_text, size // 1024 as kib from obj""",
    "iso_times": """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
 ||case when microsecond(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end as iso
from events""",
    "shell_words": f"""
select doc_id, {_QUOTE.format(x="text")} as word from documents""",
    "key_ancestors": _with(_OBJ) + """
select key, array_to_string(list_slice(string_split(key, '/'), 1, i), '/') as dir,
 cast(i - 1 as integer) as depth
from (select key, unnest(range(1, len(string_split(key, '/')))) as i from obj)""",
    "folders_at_depth": _with(_OBJ, _FOLDERS) + "select distinct folder from placed",
    "folder_base_name": _with(_OBJ, _FOLDERS) + "select folder, base_name from stats",
    "rule_strip_spaces": _with(_RKEYS) + "select key, s1 as cleaned from spaced",
    "rule_strip_backslashes": _with(_RKEYS) + """
select key, case when contains(key, chr(92))
 then regexp_replace(replace(key, chr(92), ''), ' {2,}', ' ', 'g') else key end as cleaned
from rkeys""",
    "first_tags": """
select doc_id, case when doc_id%3=0 then lang when doc_id%2=0 then source end as tag
from documents""",
    "object_index": _with(_OBJ) + """
select bucket, key, size, etag, is_multipart, sha256, last_modified from objh""",
    "keys_with_prefix": _with(_OBJ) + """
select bucket, key, etag from obj where starts_with(key, 'Music/en/')""",
    "all_keys": _with(_OBJ) + """
select bucket, key from obj where starts_with(key, 'Music/fr/src1')""",
    "listing_rows": _with(_OBJ) + """
select bucket, key, size, etag, is_multipart, last_modified from obj where doc_id%7<>0""",
    "snapshot_diff": _with(_OBJ, _SCAN.format(t="obj"), _DIFF.format(p="Music/"))
    + "select * from diff",
    "scan_result": _with(_OBJ, _SCAN.format(t="obj"), _DIFF.format(p="Music/")) + """
select count(*) filter (change = 'new') as new, count(*) filter (change = 'updated') as updated,
 count(*) filter (change = 'deleted') as deleted from diff""",
    "apply_listing_objects": _with(_OBJ, _SCAN.format(t="objh"), _DIFF.format(p="Music/en/")) + """
select bucket, key, size, etag, is_multipart, sha256, last_modified, last_modified as scanned_at
from old where key not in (select key from diff where change in ('deleted', 'updated'))
union all
select bucket, key, size, etag, is_multipart, null, last_modified, TIMESTAMP '2024-06-01 00:00:00'
from cur where key in (select key from diff where change in ('new', 'updated'))""",
    "apply_listing_media": _with(_OBJ, _SCAN.format(t="objh"), _DIFF.format(p="Music/en/"), _MEDIA)
    + """
select * exclude (doc_id) from media
where key not in (select key from diff where change in ('deleted', 'updated'))""",
    "stats_after_scan": _with(_OBJ, _SCAN.format(t="objh"), _DIFF.format(p="Music/en/"), _AFTER) + """
select count(*) as total_objects, cast(coalesce(sum(size), 0) as bigint) as total_size,
 (select count(*) from again) as duplicate_groups,
 (select cast(coalesce(sum(n-1), 0) as bigint) from again) as duplicate_objects,
 (select cast(coalesce(sum(size*(n-1)), 0) as bigint) from again) as wasted_bytes from after""",
    "index_after_changes": _with(_OBJ, _SCAN.format(t="objh"), _LOG) + """
select bucket, key, case when fresh then new_size else size end as size, case when fresh then new_etag else old_etag end as etag,
 is_multipart, case when fresh then null else sha256 end as sha256, last_modified,
 case when fresh then TIMESTAMP '2024-06-01 00:00:00' else last_modified end as scanned_at
from state where not gone and (known or changed)""",
    "media_after_changes": _with(_OBJ, _SCAN.format(t="objh"), _LOG, _MEDIA) + """
select * exclude (doc_id) from media where key not in (select key from state where gone or fresh)""",
    "upsert_objects": _with(_OBJ) + """
select bucket, key, size, etag, is_multipart, sha256, last_modified, last_modified as scanned_at
from objh where doc_id%10 not in (1, 2)
union all
select bucket, key, case when doc_id%10=2 then size+1 else size end, etag, is_multipart, null,
 last_modified, TIMESTAMP '2024-06-01 00:00:00' from objh where doc_id%10 in (1, 2)""",
    "upsert_media": _with(_OBJ, _MEDIA) + """
select * exclude (doc_id) from media where doc_id%5<>1 and doc_id%3<>1
union all
select * exclude (doc_id) replace ('opus' as codec) from media where doc_id%3=1""",
    "config_upsert_previous": _with(_CONFIG) + "select * from config",
    "endpoint_lookup": _with(_CONFIG) + """
select d.source as bucket, doc_id, endpoint_url from documents d
left join config on d.source = config.bucket""",
    "delete_cascade": _with(_OBJ, _MEDIA) + """
select 'objects' as tab, bucket, key from obj where doc_id%6<>1
union all select 'media', bucket, key from media where doc_id%6<>1""",
    "update_sha256": _with(_OBJ) + """
select bucket, key, case when doc_id%2=0 then any_sha end as sha256 from obj""",
    "content_sha256": "select doc_id, sha256(text) as sha256 from documents",
    "hash_candidates": _with(_OBJ) + """
select bucket, key, any_sha as sha256, cast(null as varchar) as error from obj
where size in (select size from obj where is_multipart and sha256 is null)
 and size in (select size from obj group by size having count(*) > 1)""",
    "content_bins": _with(_OBJ) + """
select bucket, key, size, cast(floor((sum(size + 100) over (order by bucket, key rows unbounded preceding) - size - 100) / 1000000) as bigint) as bin
from obj where size in (select size from obj where is_multipart and sha256 is null)
 and size in (select size from obj group by size having count(*) > 1)""",
    "hash_pending": _with(_OBJ) + """
select bucket, key, etag from obj
where size in (select size from obj where is_multipart)
 and size in (select size from obj group by size having count(*) > 1) and doc_id%3<>0 and doc_id%5<>0""",
    "remember_failures": _with(_OBJ) + """
select bucket, key, etag, 'denied' as error, TIMESTAMP '2024-06-01 00:00:00' as failed_at
from obj where doc_id%4=1 and doc_id%3=0
union all
select bucket, key, etag, 'timeout', last_modified from obj where doc_id%5=0 and doc_id%4<>1""",
    "chunked_sha256": _with(_OBJ) + """
select bucket, key, any_sha as sha256, size, cast(greatest(1, ceil(size / 4096)) as bigint) as chunks,
 cast(null as varchar) as error from obj""",
    "enrich_media": _with(_OBJ.replace("sha256(text) as any_sha", "sha256(text) as any_sha, encode(text) as content"), _MEDIA) + f"""
select o.bucket, o.key, md5(content[1:64]) as artist, cast(null as varchar) as album, lower({_ext('o.key')}) as title,
 octet_length(content[1:64]) / 2 as duration_s, cast(null as varchar) as codec, cast(octet_length(content[1:64]) as bigint) as bitrate,
 cast(null as varchar) as error
from obj o left join (select * from media where doc_id%2=0) m on o.key = m.key
where m.key is null and lower({_ext('o.key')}) in ('.mp3','.flac','.ogg','.m4a','.aac','.wma',
 '.opus','.wav','.mp4','.mkv','.avi','.mov','.wmv','.webm')""",
    "media_pending": _with(_OBJ, _MEDIA) + f"""
select o.bucket, o.key from obj o left join (select * from media where doc_id%2=0) m
 on o.key = m.key
where m.key is null and lower({_ext('o.key')}) in ('.mp3','.flac','.ogg','.m4a','.aac','.wma',
 '.opus','.wav','.mp4','.mkv','.avi','.mov','.wmv','.webm')""",
    "size_duplicates": _with(_OBJ) + """
select bucket, key, size, etag, is_multipart, last_modified, n
from obj join (select size, count(*) as n from obj group by size having count(*) > 1) using (size)
""",
    "etag_duplicates": _with(_OBJ, _GROUPS.format(t="obj")) + """
select etag as fingerprint, size, bucket, key, is_multipart,
 count(*) over (partition by etag) as n,
 size * (count(*) over (partition by etag) - 1) as wasted_bytes from etag_rows""",
    "multipart_candidates": _with(_OBJ) + """
select bucket, key, size, etag, is_multipart from obj
where size in (select size from obj where is_multipart and sha256 is null)
 and size in (select size from obj group by size having count(*) > 1)""",
    "hash_duplicates": _with(_OBJ, _DUPS_H) + """
select fingerprint, size, bucket, key, n, wasted_bytes from dups where kind = 'sha256'""",
    "duplicate_groups": _with(_OBJ, _DUPS_H) + "select * from groups",
    "all_duplicates": _with(_OBJ, _DUPS_H) + "select * from dups",
    "exclusive_duplicates": _with(_OBJ, _EX) + "select * from xdups",
    "exclusive_groups": _with(_OBJ, _EX)
    + "select 'content' as kind, fingerprint, size, n, wasted_bytes from xgroups",
    "content_identity": _with(_OBJ, _EX) + "select bucket, key, fingerprint from ident",
    "scan_stats": _with(_OBJ, _DUPS_H) + """
select count(*) as total_objects, cast(coalesce(sum(size), 0) as bigint) as total_size,
 (select count(*) from groups) as duplicate_groups,
 (select cast(coalesce(sum(n-1), 0) as bigint) from groups) as duplicate_objects,
 (select cast(coalesce(sum(wasted_bytes), 0) as bigint) from groups) as wasted_bytes from objh""",
    "scan_stats_text": _with(_OBJ, _DUPS_H) + f"""
select *, {_human('total_size')} as total_size_text, {_human('wasted_bytes')} as wasted_text from (
select count(*) as total_objects, cast(coalesce(sum(size), 0) as bigint) as total_size,
 (select count(*) from groups) as duplicate_groups,
 (select cast(coalesce(sum(n-1), 0) as bigint) from groups) as duplicate_objects,
 (select cast(coalesce(sum(wasted_bytes), 0) as bigint) from groups) as wasted_bytes from objh)""",
    "same_work_groups": _with(_OBJ, _MEDIA, _WORKS) + "select * from works",
    "same_work_rows": _with(_OBJ, _MEDIA, _WORKS) + f"""
select artist, title, key, coalesce(nullif(codec, ''), '?') as codec,
 {_human('size')} as size_text from works""",
    "suspect_names": _with(_OBJ, _suspects("obj", "etag"))
    + "select normalized, bucket, key, size, etag, n from suspects",
    "suspect_names_by_content": _with(
        _OBJ, _EXCLUSIVE.format(t="objh"), _suspects("ident", "fingerprint")
    ) + "select normalized, bucket, key, size, etag, fingerprint, n from suspects",
    "retention_keepers": _with(_OBJ, _DUPS_H) + f"""
select kind, fingerprint, size, n, key as keeper from (
 select *, row_number() over (partition by kind, fingerprint, size order by {_BEST}) as rn
 from dups) where rn = 1""",
    "retention_newest": _with(_OBJ, _DUPS_H) + f"""
select kind, fingerprint, key, keeper, key = keeper as is_keeper from (
 select *, first_value(key) over (partition by kind, fingerprint, size
  order by last_modified desc, length({_base('key')}), bucket, key) as keeper from dups)""",
    "delete_plan": _with(_OBJ, _EX) + f"""
select fingerprint, size, n as copies, wasted_bytes, {_human('wasted_bytes')} as wasted,
 keeper_bucket, keeper, bucket, key,
 'aws s3 rm --endpoint-url ''https://store.example'' '||{_uri('bucket', 'key')} as command
from (
 select *, row_number() over w as rn, first_value(key) over w as keeper,
  first_value(bucket) over w as keeper_bucket
 from xdups window w as (partition by fingerprint, size order by {_BEST}))
where rn > 1""",
    "ranked_groups": _with(_OBJ, _DUPS_H) + f"""
select row_number() over (order by wasted_bytes desc, fingerprint, kind) as group_no,
 kind, fingerprint, n as copies, size, {_human('size')} as size_text, wasted_bytes,
 {_human('wasted_bytes')} as wasted_text from groups""",
    "top_groups": _with(_OBJ, _DUPS_H) + f"""
select row_number() over (order by wasted_bytes desc, fingerprint, kind) as group_no,
 kind, fingerprint, n as copies, size, {_human('size')} as size_text, wasted_bytes,
 {_human('wasted_bytes')} as wasted_text from groups
order by wasted_bytes desc, fingerprint, kind limit 10""",
    "report_rows": _with(_OBJ, _DUPS_H, _MEDIA, _WORKS, _suspects("objh", "etag")) + """
select 'duplicate' as section, fingerprint as group_id, size as group_size, key as object_key,
 strftime(last_modified, '%Y-%m-%dT%H:%M:%S') as detail from dups
union all select 'suspect_name', normalized, size, key, etag from suspects
union all select 'same_work', artist||' - '||title, size, key, coalesce(codec, '') from works""",
    "report_documents": _with(_OBJ, _DUPS_H) + """
select fingerprint, size, wasted_bytes, bucket, key,
 strftime(last_modified, '%Y-%m-%dT%H:%M:%S') as last_modified from dups""",
    "folder_documents": _with(_OBJ, _FOLDERS) + """
select bucket, base_name, category, folder as path, file_count, media_count, image_count, total_size
from dupfolders""",
    "group_documents": _with(_OBJ, _DUPS_H) + _documents(
        "dups", "wasted_bytes desc, fingerprint, size", "{'fingerprint': fingerprint, 'size': size, 'wasted_bytes': wasted_bytes}",
        "bucket, key", "{'bucket': bucket, 'key': key, 'last_modified': strftime(last_modified, '%Y-%m-%dT%H:%M:%S')}", "objects",
    ),
    "folder_group_documents": _with(_OBJ, _FOLDERS) + _documents(
        "dupfolders", "bucket, base_name, category", "{'bucket': bucket, 'base_name': base_name, 'category': category}",
        "media_count desc, folder", "{'path': folder, 'file_count': file_count, 'media_count': media_count,"
        " 'image_count': image_count, 'total_size': total_size}", "folders",
    ),
    "ordered_duplicates": _with(_OBJ, _DUPS_H) + """
select row_number() over (order by wasted_bytes desc, fingerprint, size, key) as position, wasted_bytes, fingerprint, size, key
from dups""",
    "ordered_suspects": _with(_OBJ, _suspects("obj", "etag")) + """
select row_number() over (order by normalized, key) as position, normalized, key from suspects""",
    "ordered_works": _with(_OBJ, _MEDIA, _WORKS) + """
select row_number() over (order by artist, title, size desc, key) as position, artist, title, size, key from works""",
    "ordered_folders": _with(_OBJ, _FOLDERS) + """
select row_number() over (order by base_name, media_count desc, folder) as position, base_name, media_count, folder
from dupfolders where category = 'both_music'""",
    "folder_stats": _with(_OBJ, _FOLDERS) + "select * from stats",
    "folder_category": _with(_OBJ, _FOLDERS) + "select * from fgroups2",
    "duplicate_folders": _with(_OBJ, _FOLDERS) + "select * from dupfolders",
    "orphan_folders": _with(_OBJ, _FOLDERS) + """
select base_name, folder, role from dupfolders where category = 'orphan'""",
    "diagnosis_summary": _with(_OBJ, _FOLDERS) + """
select (select count(*) from stats) as total_folders, count(*) as duplicate_groups,
 count(*) filter (category = 'orphan') as orphan_groups,
 count(*) filter (category = 'both_music') as both_music_groups from fgroups2""",
    "folder_report_rows": _with(_OBJ, _FOLDERS) + """
select category, base_name, folder as folder_path, file_count, media_count, total_size,
 total_size // 1024 as size_kib, total_size // 1048576 as size_mib from dupfolders""",
    "orphan_plan": _with(_OBJ, _FOLDERS) + f"""
select bucket, base_name, category, folder, file_count, media_count, total_size,
 {_human('total_size')} as size_text, first_complete,
 case when category = 'orphan' and only_images then 'delete' else 'review' end as action,
 'aws s3 rm --recursive '||{_uri('bucket', "folder||'/'")} as command
from dupfolders where file_count > 0 and (category = 'both_music' or role = 'orphan')""",
    "orphan_totals": _with(_OBJ, _FOLDERS) + """
select count(*) as folders, cast(coalesce(sum(file_count), 0) as bigint) as files,
 cast(coalesce(sum(total_size), 0) as bigint) as bytes
from dupfolders where file_count > 0 and category = 'orphan' and role = 'orphan' and only_images""",
    "clean_keys": _with(_RKEYS) + """
select key, wanted, array_to_string(list_filter([
 case when s1 <> key then 'strip-spaces' end,
 case when wanted <> s1 then 'strip-backslashes' end], lambda x: x is not null), ',') as fired
from cleaned""",
    "rename_stats": _with(_RKEYS) + """
select count(*) as total_keys, count(*) filter (wanted <> key) as rename_count from cleaned""",
    "rename_rule_counts": _with(_RKEYS) + """
select 'strip-spaces' as rule, count(*) as fired from cleaned where s1 <> key having count(*) > 0
union all select 'strip-backslashes', count(*) from cleaned where wanted <> s1
having count(*) > 0""",
    "resolve_conflicts": _with(_RKEYS, _RESOLVED) + "select * from resolved",
    "keys_after_rename": _with(_RKEYS, _RESOLVED) + "select * from finalkeys",
    "emptied_folders": _with(_RKEYS, _RESOLVED) + "select * from emptied",
    "emptied_by_counts": _with(_RKEYS, _RESOLVED) + "select * from emptied",
    "rename_plan": _with(_RKEYS, _RESOLVED) + f"""
select case when depends_on is null then 1 else 2 end as step, 0 as order_key, bucket, key, target,
 conflict, depends_on,
 'aws s3 mv --copy-props none '||{_uri('bucket', 'key')}||' '||{_uri('bucket', 'target')}
  as command
from resolved
union all
select 3, -depth, bucket, dir||'/', null, false, null,
 'aws s3 rm '||{_uri('bucket', "dir||'/'")} from emptied""",
}

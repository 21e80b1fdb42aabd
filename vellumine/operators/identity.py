"""Who a record is: scopes, normal forms, keys, and the merging of what its sources say beside the facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.link_types import host_under
from ..functions.text import collapsed, nfkc, normal_url, url_host
from .merging import digest, identity_key

# Hosts that name a platform, and what describes where a fact came from.
PLATFORM_HOSTS = [
    "jobs.feishu.cn", "mokahr.com", "zhiye.com", "beisen.com", "zhaopin.com", "51job.com", "iguopin.com", "hotjob.cn",
]
PROVENANCE = [
    "feishu_record_id", "feishu_record_ids", "feishu_last_modified_at", "sheet_updated_at", "table_row_number",
    "source_id", "source_ids", "source_url", "fallback_source_url", "batch",
]
TEXT_MAP = "map<string,string>"


def plain(text: Column) -> Column:
    """Comparison form of a wording: compatibility form, single spaces, lower case."""
    return F.lower(collapsed(nfkc(text)))


def identifier(text: Column) -> Column:
    return F.trim(nfkc(text))


def scope(platforms: list[Column], urls: list[Column], source: Column, group: Column) -> Column:
    """`platform:company`: the first named platform, else a known host among the urls, else the source."""
    named = [F.when(F.trim(p) != "", p) for p in platforms]
    hosts = [F.when(host_under(h := F.rtrim(url_host(u), F.lit(".")), PLATFORM_HOSTS), F.concat(F.lit("host:"), h)) for u in urls]
    return F.concat_ws(":", plain(F.coalesce(*named, *hosts, source)), group)


def scoped_key(scope_: Column, source_id: Column, url: Column, facts: list[Column]) -> Column:
    """merging.identity_key over normal forms of id and url; facts come in theirs."""
    return identity_key(scope_, identifier(source_id), normal_url(url), facts)


def facts_of(metadata: Column, hidden: list[str] = PROVENANCE) -> Column:
    """The entries of a map of texts that aren't provenance."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(hidden))


def sorted_map(m: Column) -> Column:
    """Entries in the order of their keys, so that equal maps have one text."""
    return F.array_sort(F.map_entries(m))


def content_hash(facts: list[Column], metadata: Column) -> Column:
    """Digest of the facts and of what the metadata says that isn't provenance; a null map is an empty one."""
    entries = sorted_map(facts_of(F.coalesce(metadata, F.create_map().cast(TEXT_MAP))))
    return digest(*facts, F.to_json(entries))


def distinct_in_order(*lists: Column) -> Column:
    """Values of several arrays in order, the first spelling of each; nulls and blanks go."""
    every = reduce(lambda a, b: F.concat(a, b), [F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    shown = F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    firsts = F.filter(shown, lambda x, i: F.array_position(F.transform(shown, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return firsts


def merged_metadata(old: Column, new: Column) -> Column:
    """Entries of both maps of texts, the new value where both have one."""
    empty = F.create_map().cast(TEXT_MAP)
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def merged_ids(old_list: Column, old_one: Column, new_list: Column, new_one: Column) -> Column:
    """All ids of two records that name one or a list each; null unless there are several or either kept a list."""
    ids = distinct_in_order(old_list, F.array(old_one), new_list, F.array(new_one))
    kept = (F.size(ids) > 1) | old_list.isNotNull() | new_list.isNotNull()
    return F.when(kept & (F.size(ids) > 0), ids)


def source_entry_id(company: Column, url: Column) -> Column:
    """Id of a source that a sheet names by company and link."""
    evidence = F.concat_ws("\n", F.lower(F.trim(company)), normal_url(url))
    return F.concat(F.lit("entry-"), F.left(F.sha2(evidence, 256), F.lit(20)))


def job_id(key: Column) -> Column:
    return F.concat(F.lit("job-"), F.left(key, F.lit(24)))

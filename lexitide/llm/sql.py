"""SQL of those queries that DuckDB can express over whole tables."""

from __future__ import annotations

_TERMS = r"""
with terms as (select row_no, unnest(regexp_extract_all(lower(abstract), '\p{L}+')) as term from paper where abstract is not null),
counts as (select term, count(*) as occurrences, count(distinct row_no) as records from terms group by term),
marked as (
  select term, occurrences, records,
         case when records <= 2 then 'rare' when records > 0.2 * (select count(*) from paper where abstract is not null) then 'common' else 'useful' end as mark
  from counts)
"""

_COPIES = r"""
with keyed as (
  select row_no, regexp_replace(lower(coalesce(paper_id, '')), '[^\p{L}\p{N}]+', '', 'g') as k1,
         regexp_replace(replace(lower(replace(abstract, 'ẞ', 'ß')), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') as k2
  from paper where regexp_matches(abstract, '[^\s\p{Z}]')),
grouped as (select row_no, min(row_no) over (partition by k1, k2) as rep from keyed)
"""

_PHRASES = r"""
with words as (select row_no, regexp_extract_all(lower(abstract), '\p{L}+') as ws from paper where abstract is not null),
places as (select row_no, ws, unnest(range(1, len(ws) + 1)) as i from words),
phrases as (select row_no, array_to_string(ws[i : i + k - 1], ' ') as term from places, (values (1), (2), (3)) lengths(k) where i + k - 1 <= len(ws))
"""

SQL = {
    "p1_found": _TERMS + "select term, mark from marked where mark <> 'useful'",
    "p1_terms": _TERMS + "select term, occurrences, records, mark from marked",
    "p1_phrases": _PHRASES + "select term, count(*) as occurrences, count(distinct row_no) as records from phrases group by term",
    "p6_found": _COPIES + "select rep as row_no_a, row_no as row_no_b from grouped where rep <> row_no",
    "p6_groups": _COPIES + "select rep as row_no, count(*) as copies from grouped group by rep",
}

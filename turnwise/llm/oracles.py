"""The results of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

PHRASES = r"""
with pieces as (
  select lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
numbered as (
  select coalesce(lang, 'und') as lang, row_number() over () as id, string_split_regex(piece, '[\x20\x09]+') as w from pieces
),
words as (
  select * from (select lang, id, unnest(w) as word, generate_subscripts(w, 1) as pos from numbered) where word <> ''
),
runs as (
  select lang, word, lead(word) over piece as second, lead(word, 2) over piece as third
  from words window piece as (partition by id order by pos)
),
grams as (
  select lang, 1 as k, word as phrase from runs
  union all select lang, 2, word || ' ' || second from runs where second is not null
  union all select lang, 3, word || ' ' || second || ' ' || third from runs where third is not null
),
counts as materialized (select lang, k, phrase, count(*)::hugeint as f from grams group by all),
totals as (select lang, sum(f) as n from counts where k = 1 group by lang),
candidates as materialized (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k > 1 and f >= 10
),
cuts as (
  select c.lang, c.k, c.phrase, c.a, cut, l.f as l, r.f as r, (1000000 * c.a * c.a) // (l.f * r.f) as score
  from (select *, unnest(range(1, k)) as cut from candidates) c
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : cut], ' ')
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1 :], ' ')
),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (
  select lang, phrase, max(a) as around
  from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from candidates where k = 3
  )
  group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from worst left join inside using (lang, phrase) join totals using (lang)
where around is null or 100 * around < 50 * a
qualify rank <= 2000
"""

MIX = r"""
with rows as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substring(md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')), 1, 15))::bigint as place
  from documents
),
sources as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from rows group by source
),
prefixes as (
  select weight, sum(source_size) over () * 150 / 100.0::double as budget,
    coalesce(sum(2 * source_size) over earlier, 0) as held, sum(weight) over () - coalesce(sum(weight) over earlier, 0) as left_weight
  from sources
  window earlier as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
),
shared as (select max((budget - held::double) / left_weight::double) as share from prefixes),
targets as (
  select source, source_size, least(weight * share, (2 * source_size)::double) as target from sources, shared
),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from targets
),
places as (
  select source, place, sum(size)::bigint as held from rows group by source, place
),
running as (
  select p.source, p.place, p.held, sum(p.held) over (partition by p.source order by p.place) as upto,
    b.target - b.times * b.source_size as rest
  from places p join budgets b on p.source is not distinct from b.source
),
once_more as (
  select source, place from running
  where upto <= rest or (upto - held <= rest and upto - rest < rest - (upto - held))
)
select r.doc_id, r.size, b.source_size, b.target,
  (r.size * (b.times + case when m.place is null then 0 else 1 end))::bigint as taken
from rows r
join budgets b on r.source is not distinct from b.source
left join once_more m on r.source is not distinct from m.source and r.place = m.place
"""

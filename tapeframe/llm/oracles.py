"""DuckDB SQL of the training-data queries that SQL can express, written from their contracts."""

from __future__ import annotations

#: op8: measures, sketches' quartiles by language and source (above: language, all), limits and verdicts.
QUALITY_RULES = r"""
with docs as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents
), split as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs
), windows as (
  select rid, i, array_to_string(list_slice(words, i, i + 7), ' ') as said
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from split where len(words) >= 8)
), places as (
  select rid, unnest(range(i, i + 8)) as place
  from (select rid, i, count(*) over (partition by rid, said) as times from windows) where times > 1
), again as (
  select rid, count(distinct place) as n_repeat_words from places group by rid
), measured as (
  select rid, doc_id, lang, source, len(words)::bigint as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
    len(list_filter(words, lambda x: x = '|'))::bigint as n_pipes
  from split left join again using (rid)
), rated as (
  select *, n_symbols * 10000 // greatest(n_words, 1) as symbol_rate, n_pipes * 10000 // greatest(n_words, 1) as pipe_rate,
    n_dup_lines * 10000 // greatest(n_lines, 1) as dup_line_rate, n_repeat_words * 10000 // greatest(n_words, 1) as repeat_rate,
    word_chars * 10000 // greatest(n_words, 1) as word_length
  from measured
), stacked as (
  unpivot (select lang, source, n_words, n_lines, symbol_rate, pipe_rate, dup_line_rate, repeat_rate, word_length from rated)
  on n_words, n_lines, symbol_rate, pipe_rate, dup_line_rate, repeat_rate, word_length into name measure value v
), binned as (
  select lang, source, measure, greatest(length(bin(v)) - 6, 0) as shift, v from stacked
), sketch as (
  select lang, source, measure, shift * 32 + (v >> shift) as b, count(*) as n from binned group by all
), levels as (
  select 0 as depth, null as lang, null as source, measure, b, sum(n) as n from sketch group by all
  union all select 1, lang, null, measure, b, sum(n) from sketch group by all
  union all select 2, lang, source, measure, b, n from sketch
), ranked as (
  select *, sum(n) over (partition by depth, lang, source, measure order by b) as upto, sum(n) over (partition by depth, lang, source, measure) as total from levels
), bins as (
  select depth, lang, source, measure, max(total) as n_docs, min(case when upto >= ceil(total * 0.25) then b end) as b0,
    min(case when upto >= ceil(total * 0.5) then b end) as b1, min(case when upto >= ceil(total * 0.75) then b end) as b2
  from ranked group by all
), tops as (
  select depth, lang, source, measure, n_docs,
    (b0 - greatest(b0 // 32 - 1, 0) * 32 + 1) * (1::bigint << greatest(b0 // 32 - 1, 0)::int) - 1 as q0,
    (b1 - greatest(b1 // 32 - 1, 0) * 32 + 1) * (1::bigint << greatest(b1 // 32 - 1, 0)::int) - 1 as q1,
    (b2 - greatest(b2 // 32 - 1, 0) * 32 + 1) * (1::bigint << greatest(b2 // 32 - 1, 0)::int) - 1 as q2
  from bins
), lengths as (
  select depth, lang, source, max(n_docs) as n_docs, greatest(max(case when measure = 'n_words' then q1 end), 1) as words,
    greatest(max(case when measure = 'n_lines' then q1 end), 1) as lines
  from tops group by all
), limits as (
  select t.depth, t.lang, t.source,
    max(case when measure = 'symbol_rate' then q2 + 3 * (q2 - q0) + 30000 // words end) as most_symbols,
    max(case when measure = 'pipe_rate' then q2 + 3 * (q2 - q0) + 30000 // words end) as most_pipes,
    max(case when measure = 'dup_line_rate' then q2 + 3 * (q2 - q0) + 20000 // lines end) as most_lines,
    max(case when measure = 'repeat_rate' then q2 + 3 * (q2 - q0) + 480000 // words end) as most_repeats,
    max(case when measure = 'word_length' then q2 + 3 * (q2 - q0) + floor(1.5 * q1 / sqrt(words))::bigint end) as most_length
  from tops t join lengths l on t.depth = l.depth and t.lang is not distinct from l.lang and t.source is not distinct from l.source
  where t.depth = 0 or l.n_docs >= 30 group by all
), judged as (
  select r.*,
    coalesce(c.most_symbols, b.most_symbols, a.most_symbols) as most_symbols, coalesce(c.most_pipes, b.most_pipes, a.most_pipes) as most_pipes,
    coalesce(c.most_lines, b.most_lines, a.most_lines) as most_lines, coalesce(c.most_repeats, b.most_repeats, a.most_repeats) as most_repeats,
    coalesce(c.most_length, b.most_length, a.most_length) as most_length
  from rated r left join limits a on a.depth = 0
  left join limits b on b.depth = 1 and b.lang is not distinct from r.lang
  left join limits c on c.depth = 2 and c.lang is not distinct from r.lang and c.source is not distinct from r.source
), said as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, concat_ws(',',
    case when symbol_rate > most_symbols and n_symbols > 3 then 'symbol_rate' end,
    case when pipe_rate > most_pipes and n_pipes > 3 then 'pipe_rate' end,
    case when dup_line_rate > most_lines and n_dup_lines > 2 then 'dup_line_rate' end,
    case when repeat_rate > most_repeats and n_repeat_words > 48 then 'repeat_rate' end,
    case when word_length > most_length then 'word_length' end) as rules_failed
  from judged
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_pipes, base_failed, rules_failed,
  not base_failed and rules_failed = '' as kept from said
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: op1's base columns (query licenses_base).
LICENSES_BASE = rf"""
with split as (select row_number() over () as rid, doc_id, {_WORDS} as words from documents
), placed as (
  select rid, unnest(range(1, len(words) + 1)) as i, words from split
), found as (
  select rid, i - 1 as place, case
    when list_slice(words, i, i + 3) = ['gnu', 'general', 'public', 'license'] then 'gpl'
    when list_slice(words, i, i + 1) = ['apache', 'license'] then 'apache'
    when list_slice(words, i, i + 1) = ['cc', 'by'] then 'cc-by'
    when list_slice(words, i, i + 1) = ['mit', 'license'] then 'mit' end as label
  from placed
), summed as (
  select rid, count(*) as n_base, min(place) as first_word, max(place) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels
  from found where label is not null group by rid
)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels
from split left join summed using (rid)
"""

#: op9, with the length of the template and its escapes.
CHAT = r"""
with said as (
  select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), escaped as (
  select *, replace(replace(text, '\', '\\'), '<|', '<\|') as shown,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') as head from said
), joined as (
  select conv_id, count(*)::bigint as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length(head) + length(shown) + length('<||>') + length('<|end|>') + 2)::bigint as formatted_chars
  from escaped group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from joined
"""

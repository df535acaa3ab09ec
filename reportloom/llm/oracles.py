"""DuckDB SQL for the rows of the queries that SQL can express."""

OP8 = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
win as (
  select doc_id, p.i as i, array_to_string(list_slice(w, p.i, p.i + 4), ' ') as x
  from d, lateral (select unnest(range(1, len(w) - 3)) as i) p),
twice as (select doc_id, i, count(*) over (partition by doc_id, x) > 1 as again from win),
pos as (select doc_id, p.i as i from d, lateral (select unnest(range(1, len(w) + 1)) as i) p),
cov as (
  select pos.doc_id, bool_or(coalesce(again, false)) over (
           partition by pos.doc_id order by pos.i rows between 4 preceding and current row) as c
  from pos left join twice on pos.doc_id = twice.doc_id and pos.i = twice.i),
rep as (select doc_id, count(*) filter (c) as n_repeat_words from cov group by doc_id),
lines as (
  select doc_id, l, count(*) - 1 as extra
  from (select doc_id, unnest(string_split(t, chr(10))) as l from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id, l),
dup as (select doc_id, sum(extra) as n_dup_lines from lines group by doc_id),
m as (
  select d.doc_id, source, len(w)::bigint as n_words,
         length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join dup on d.doc_id = dup.doc_id left join rep on d.doc_id = rep.doc_id),
f as (
  select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
         (n_words < 10 or 100 * n_repeat_words > 20 * n_words)::int + (10 * n_symbols > n_words)::int
         + (10 * n_symbols > 5 * n_words)::int + (word_chars > 15 * n_words)::int
         + (word_chars < 2 * n_words)::int + (20 * n_dup_lines > n_words)::int as n_failures
  from m),
h as (select source, count(*)::double as n, (count(*) filter (n_failures > 0))::double as failed from f group by source),
p as (select sum(n) as total, sum(failed) / sum(n) as mean, sum(n * n) as squares, sum(failed * failed / n) as spread, count(*) as hosts from h),
x as (select mean, case when hosts > 1 and mean > 0 and mean < 1 and total - squares / total > hosts - 1
  then ((spread - total * mean * mean) / (mean * (1 - mean)) - (hosts - 1)) / (total - squares / total - (hosts - 1)) else 0 end as share from p),
s as (select mean, case when share > 0 then least(greatest(1 / share - 1, 1.0), 1000.0) else 1000.0 end as k from x),
r as (select source, mean, (mean * k + failed) / (k + n) as host_rate from h, s)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when host_rate < mean * 0.98 then 1 when host_rate * 0.98 > mean then -1 else 0 end as host_trust,
       (not base_failed and (n_failures = 0 or n_failures = 1 and (host_rate < mean * 0.98 or host_rate * 0.98 <= mean
         and 20 * n_symbols <= 3 * n_words and 2 * word_chars <= 45 * n_words and 3 * word_chars >= 4 * n_words and 40 * n_dup_lines <= 3 * n_words))) as kept
from f join r on f.source is not distinct from r.source
"""

# After a run of lines that might end a chunk, every second one does, as a chunk has two lines at least.
OP1 = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as i from documents where text is not null),
h as (select *, ('0x' || substr(md5(line), 1, 15))::bigint as h from l),
c as (select *, ((coalesce(lag(h) over w, 0) % 2147483647) * 1000003 + h) % 2147483647 % 2 = 0 as cand, max(i) over (partition by doc_id) as last from h window w as (partition by doc_id order by i)),
g as (select *, i - row_number() over (partition by doc_id, cand order by i) as island from c),
r as (select *, min(i) over (partition by doc_id, cand, island) as first from g),
e as (select *, (i = last or cand and (i - first) % 2 = (first = 0)::int)::int as ends from r),
k as (select *, sum(ends) over (partition by doc_id order by i rows unbounded preceding) - ends as chunk from e),
x as (select doc_id, chunk, count(*) as n, string_agg(line, chr(10) order by i) as body from k group by doc_id, chunk),
y as (select *, n > 1 and regexp_matches(body, '[^\x20\x09-\x0D]') and row_number() over (partition by body order by doc_id, chunk) > 1 as gone from x),
z as (select doc_id, sum(n)::bigint as n_lines, coalesce(sum(n) filter (gone), 0)::bigint as n_removed, coalesce(string_agg(body, chr(10) order by chunk) filter (not gone), '') as kept from y group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join z on z.doc_id = d.doc_id
"""

# The order of sources and documents, the targets and the schedule are whole-number arithmetic, so all of it can be said in SQL.
OP6 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('20260101:' || doc_id) as ord from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by (source is null), source) as sid from d group by source),
s as (select *, ((sid - 1) % 3 + 1)::bigint as weight, 3 * source_size as lim from s0),
-- sources are full in the order of lim / weight: the first so many that are above the level that the others would have
f as (select *, sum(lim) over w - lim as full_, sum(weight) over w - weight as taken_weight from s window w as (order by lim::double / weight, sid rows unbounded preceding)),
g as (select *, (select sum(source_size) from s) as total, (select sum(weight) from s) as weights from f),
l as (select max((total - full_)::bigint::double / (weights - taken_weight)::bigint) filter (lim::double / weight >= (total - full_)::bigint::double / (weights - taken_weight)::bigint) as level from g),
t as (select sid, source, source_size, least(lim::double, level * weight) as target from s, l),
u as (select *, least(round(target)::bigint, 3 * source_size) as words from t),
v as (select *, ceil(words / 256.0)::bigint as blocks, (sum(words) over (order by sid rows unbounded preceding) - words)::hugeint as before from u),
n as (select sum(words)::hugeint as total, sum(blocks)::bigint as slots, count(*) as sources from v),
i as (select sid, blocks, before * 1000000000000000000::hugeint // total as lo, (before + words) * 1000000000000000000::hugeint // total as hi from v, n where words > 0),
p as (select k as slot, ((k + 1)::hugeint * 618033988749894848::hugeint) % 1000000000000000000::hugeint as u from (select unnest(range(0, (select slots from n))) as k)),
q as (select slot, sid, blocks, row_number() over (partition by sid order by slot) - 1 as rank from p join i on u >= lo and u < hi),
have as (select sid, count(*) as have from q group by sid),
late as (select v.sid, unnest(range(coalesce(have, 0), blocks)) as rank from v left join have on have.sid = v.sid),
slots as (select sid, rank, slot from q where rank < blocks union all select late.sid, rank, slots + rank * sources + sid - 1 from late, n),
a as (select d.doc_id, sid, size, v.source_size, target, words, sum(size) over (partition by sid order by ord rows unbounded preceding) - size as pos
      from d join v on d.source is not distinct from v.source),
e as (select doc_id, sid, epoch * source_size + pos as x, least(epoch * source_size + pos + size, words) as y from a, (select unnest([0, 1, 2]) as epoch) where size > 0),
b as (select doc_id, sid, x, y, unnest(range((x // 256)::bigint, ((y - 1) // 256)::bigint + 1)) as rank from e where x < y),
k as (select doc_id, sum(least((b.rank + 1) * 256, y) - greatest(b.rank * 256, x))::bigint as taken, min(slot) as first_slot, count(*) as n_slots
      from b join slots on slots.sid = b.sid and slots.rank = b.rank group by doc_id)
select a.doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot::bigint as first_slot, coalesce(n_slots, 0)::bigint as n_slots from a left join k on k.doc_id = a.doc_id
"""

OP7 = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, substr(h, 2 * i + 1, 2) as byte, i, case when length(h) >= 2 * i + 200 then md5(substr(h, 2 * i + 1, 200)) end as win
      from (select doc_id, h, unnest(range(0, length(h) // 2)) as i from d)),
f as (select doc_id, byte, i, win is not null and row_number() over (partition by win order by doc_id, i) > 1 as again from b),
c as (select doc_id, byte, i, bool_or(again) over (partition by doc_id order by i rows between 99 preceding and current row) as gone from f),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from c),
r as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (starts) as n_spans, coalesce(string_agg(byte, '' order by i) filter (not gone), '') as kept from s group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join r on d.doc_id = r.doc_id
"""

SQL: dict[str, str] = {"op1_line_dedup": OP1, "op6_source_mixing": OP6, "op7_suffix_array_dedup": OP7, "op8_quality_rules": OP8}

"""DuckDB SQL for the queries of this subpackage that SQL can express, over the same whole tables."""

from __future__ import annotations

from corpusloom.llm.quality_rules import COMMON, MAX_CLASSES, MAX_COMMON, MIN_CHARS_FOR_CLASSES, MIN_WORDS, MIN_WORDS_FOR_COMMON

_SPACES = "[\\x20\\x09-\\x0D]+"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""with t as (select doc_id, {_LOWER} as norm from documents), g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from t join g using (norm)"""

SUBSTRING = f"""with w as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from w where len(w) >= 20)),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from win) where n > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) as p from again)),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from w),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) as t from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by words.doc_id),
cut as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(cut.n, 0)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from w left join cut on cut.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id"""

CHAT = """with t as (select conv_id as c, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as txt from conversations),
p as (select distinct c, role as speaker from t where role <> 'system'),
x as (select t.*, speaker, case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user' end as chat_role from t join p on p.c is not distinct from t.c),
y as (select *, case when chat_role = 'user' then role end as name from x),
z as (select *, '<|im_start|>' || chat_role || case when name is null then '' else ' name=' || name end || chr(10) as head from y)
select c as conv_id, speaker, turn, chat_role, name, head || txt || '<|im_end|>' || chr(10) as segment,
 (case when chat_role = 'assistant' then length(head) else 0 end)::bigint as mask_start, (case when chat_role = 'assistant' then length(head) + length(txt) + 10 else 0 end)::bigint as mask_end from z"""

DIALOGUES = f"""with s as ({CHAT}), a as (select *, turn // 1024 as part, coalesce(sum(length(segment)) over (partition by conv_id, speaker, turn // 1024 order by turn, segment rows between unbounded preceding and 1 preceding), 0) as pos from s)
select conv_id, speaker, part::bigint as part, string_agg(segment, '' order by pos, segment) as text, coalesce(string_agg((pos + mask_start)::bigint || '-' || (pos + mask_end)::bigint, ',' order by pos, segment) filter (mask_end > mask_start), '') as masks from a group by conv_id, speaker, part"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _shares(counts: list[str], total: str) -> str:
    return "[" + ", ".join(f"case when {total} > 0 then {c}::double / {total} else 0.0 end" for c in counts) + "]"


def _distance(p: str, q: str) -> str:
    term = lambda a: f"case when {a} > 0 then {a} * log2({a} / ((x[1] + x[2]) / 2)) else 0.0 end"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda x: {term('x[1]')} + {term('x[2]')})) / 2))"


_N = len(COMMON["en"])
#: Words for a language without a list: a fixed value.
OTHER = ["the", "der", "de", "of", "die", "la", "and", "und", "le", "que", "to", "den", "et", "el", "in", "von"]
_CLASSES = ["\\p{Ll}", "\\p{Lu}", "\\p{N}", "[.,;:?''\"()-]", "[#*$%&|<>]"]
_BY_LANG = "case lang " + " ".join(f"when '{k}' then {_list(v)}" for k, v in COMMON.items()) + f" else {_list(OTHER)} end"
#: Without a language: that whose list has most of the words (of equal ones the last by name), if any has one.
_HITS = "list_max([" + ", ".join(f"{{'n': len(list_filter(w, lambda x: list_contains({_list(v)}, x))), 'k': '{k}'}}" for k, v in COMMON.items()) + "])"


def _mean(x: str) -> str:
    return f"coalesce(avg({x}) filter (given), avg({x}))"


QUALITY = f"""with w0 as (select doc_id, coalesce(lang, '') as said, coalesce(text, '') as t, {_WORDS} as w from documents),
w as (select *, said <> '' as given, case when said <> '' then said when best.n > 0 then best.k else '' end as lang from (select *, {_HITS} as best from w0)),
b as (select *, regexp_replace(t, '{_SPACES}', '', 'g') as bare, {_BY_LANG} as ls from w),
r0 as (select *, {', '.join(f"regexp_replace({'bare' if i == 0 else f'c{i}'}, '{c}+', '', 'g') as c{i + 1}" for i, c in enumerate(_CLASSES))} from b),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from b where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
f as (select r0.doc_id, lang, given, len(w)::bigint as n_words, length(bare)::bigint as word_chars, (length(c4) - length(c5))::bigint as n_symbols, (len(lines.ls) - len(list_distinct(lines.ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
  [length(bare) - length(c1), length(c1) - length(c2), length(c2) - length(c3), length(c3) - length(c4), length(c4) - length(c5), length(c5)] as classes,
  list_append(list_transform(r0.ls, lambda k: len(list_filter(w, lambda x: x = k))), len(list_filter(w, lambda x: not list_contains(r0.ls, x)))) as common
  from r0 join lines on lines.doc_id = r0.doc_id left join rep on rep.doc_id = r0.doc_id),
s as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, {_shares([f'classes[{i}]' for i in range(1, 7)], 'word_chars')} as p_classes, {_shares([f'common[{i}]' for i in range(1, _N + 2)], 'n_words')} as p_common from f),
q as (select lang, [{', '.join(_mean(f'p_classes[{i}]') for i in range(1, 7))}] as q_classes, [{', '.join(_mean(f'p_common[{i}]') for i in range(1, _N + 2))}] as q_common from s where lang <> '' and not base_failed and word_chars >= {MIN_CHARS_FOR_CLASSES} and n_words >= {MIN_WORDS_FOR_COMMON} group by lang),
j as (select s.*, case when word_chars >= {MIN_CHARS_FOR_CLASSES} then {_distance('p_classes', 'q_classes')} end as class_distance, case when n_words >= {MIN_WORDS_FOR_COMMON} then {_distance('p_common', 'q_common')} end as common_distance from s left join q on q.lang = s.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(class_distance, 0) <= {MAX_CLASSES} and coalesce(common_distance, 0) <= {MAX_COMMON} as kept,
 round(class_distance, 9) as class_distance, round(common_distance, 9) as common_distance from j"""

DIVERGENCE = f"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
k as (select lang, term from (select lang, unnest(list_distinct(w)) as term from d) group by lang, term having count(*) >= 3),
o as (select lang, source, term, count(*) as n from (select lang, source, unnest(w) as term from d) join k using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d), v as (select lang, count(*) as v from k group by lang),
s as (select lang, source, sum(n)::bigint as total from o group by lang, source), a as (select lang, sum(total)::bigint as total from s group by lang),
p as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + (1000000000 * (coalesce(o.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) as p
  from g join k on k.lang = g.lang join v on v.lang = g.lang left join o on o.lang = g.lang and o.source = g.source and o.term = k.term left join s on s.lang = g.lang and s.source = g.source),
q as (select lang, term, 1 + (1000000000 * (sum(n)::bigint + 1)) // (a.total + v.v) as q from o join a using (lang) join v using (lang) group by lang, term, a.total, v.v),
f as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p)::bigint as value from p x join p y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by x.lang, x.source, y.source),
pair as (select x.lang, x.source, y.source as item, coalesce(f.value, 0) as value from g x join g y on y.lang = x.lang and y.source <> x.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
term as (select lang, source, term as item, (p - q) * (p - q) // q as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, 'pair' as part from pair union all select *, 'term' as part from term), z as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from r)
select lang, source, part, item, value, rank from z where part = 'pair' or rank <= 200"""

_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

REPAIR = f"""with recursive convs as (select conv_id, row_number() over () as k from (select distinct conv_id from conversations)),
c0 as (select k, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as t, coalesce(c.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations c join convs on convs.conv_id is not distinct from c.conv_id),
c1 as (select *, {_CRC.format('name')} % 20 as code from c0),
c2 as (select k, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then translate(t, '.!?', '') else t end as t, unnest(case when code = 3 then [0, 1] else [0] end) as copy from c1 where code > 0),
c3 as (select *, row_number() over (partition by k order by turn nulls first, role, t, copy) as n, right(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last from c2),
c4 as (select *, row_number() over (partition by k, role, t order by n) as again, left(role, 1) as i, lag(left(role, 1)) over (partition by k order by n) as before from c3),
line as (select *, case when last = '' then 1 when again > 1 then 3 when last in ('.', '!', '?') then 0 else 2 end as fault from c4),
figures as (select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 3) as duplicate, count(*) filter (fault = 2) as truncated,
  count(*) filter (n > 1 and before || i not in ('su', 'ua', 'au')) as illegal from line group by k),
shift(st, sym, nxt) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(st, nxt, many, shown) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'u'), (1, 2, 1, 'u'), (2, 3, 1, 'a'), (3, 2, 1, 'u'), (0, 3, 2, 'ua'), (1, 3, 2, 'ua')),
added as (select st, nxt, many, case shown when '' then '' when 'u' then chr(10) || 'user:' when 'a' then chr(10) || 'assistant:' else chr(10) || 'user:' || chr(10) || 'assistant:' end as lines from ins),
edit as (select k, n, q.st as st, op.e as e, op.cost + case when fault = 2 and op.e <> 'D' then 5 else 0 end as cost, op.nxt as nxt, op.line as line from line cross join (values (0), (1), (2), (3)) q(st),
  lateral (select 'D' as e, 2 as cost, q.st as nxt, '' as line union all
    select 'K', 0, shift.nxt, chr(10) || line.role || ':' || line.t from shift where shift.st = q.st and shift.sym = line.i and line.fault in (0, 2) union all
    select 'R', 1, case when q.st = 2 then 3 else 2 end, chr(10) || case when q.st = 2 then 'assistant:' else 'user:' end || line.t where line.fault in (0, 2)) op),
run as (select k, 0::bigint as n, 0 as st, 0::bigint as cost, '' as audit, '' as lines from convs union all
  select k, n, st, cost, audit, lines from (select r.k, r.n + 1 as n, e.nxt as st, (r.cost + 5 * a.many + e.cost)::bigint as cost, r.audit || repeat('I', a.many) || e.e as audit, r.lines || a.lines || e.line as lines,
    row_number() over (partition by r.k, e.nxt order by r.cost + 5 * a.many + e.cost, r.audit || repeat('I', a.many) || e.e) as best
    from run r join added a on a.st = r.st join edit e on e.k = r.k and e.n = r.n + 1 and e.st = a.nxt) where best = 1),
sizes as (select k, count(*) as n from line group by k),
fin as (select r.k, r.cost + 5 * a.many as cost, r.audit || repeat('I', a.many) as audit, r.lines || a.lines as lines, row_number() over (partition by r.k order by r.cost + 5 * a.many, r.audit || repeat('I', a.many)) as best
  from run r left join sizes using (k) join added a on a.st = r.st and a.nxt in (0, 3) where r.n = coalesce(sizes.n, 0))
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 cost::bigint as cost, audit, sha256(substr(lines, 2)) as repaired_sha256 from convs join fin using (k) left join figures using (k) where best = 1"""

ORACLES = {"op2_quality_rules": QUALITY, "op3_substring_dedup": SUBSTRING, "op6_exact_dedup": EXACT, "op7_chat_perspectives": CHAT, "op12_source_divergence": DIVERGENCE, "op13_conversation_repair": REPAIR, "chat_dialogues": DIALOGUES}

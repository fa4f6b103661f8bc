"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, OPEN
from .lines import WINDOW
from .neardup import SHINGLE, THRESHOLD
from .quality import LINE_CHARS_LIMIT, LINES_LIMIT, MIN_WORDS, NGRAM_LIMITS, REPEAT_WORDS_PERCENT
from .resampling import BUCKETS, PERCENT, SEED
from .resampling import MIN_WORDS as MIN_DRAWN
from .secrets import ACCESS, ASSIGN, BANDS, DECADES, ENCODINGS, FOLDED, HEADED, HEX, KINDS, LEVEL, NOISE_SWITCH, ODD, STEPS_PER_DECADE, TEXT_PAIR, TEXT_SWITCH, TEXT_TRIPLE, TOKEN
from .vectors import THRESHOLD as COSINE

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _dup_gram(n: int) -> str:
    gram = " || ' ' || ".join(f"lead(w, {j}) over o" if j else "w" for j in range(n))
    return f"""
g{n} as (select doc_id, i, chars, {gram} gram from words window o as (partition by doc_id order by i)),
d{n} as (select doc_id, i, chars, gram is not null and row_number() over (partition by doc_id, gram order by i) > 1 later,
                gram is not null and count(*) over (partition by doc_id, gram) > 1 again from g{n}),
c{n} as (select doc_id, i, chars, bool_or(later) over o later, bool_or(again) over o again from d{n}
         window o as (partition by doc_id order by i rows between {n - 1} preceding and current row)),
s{n} as (select doc_id, sum(case when later then chars else 0 end)::bigint later_chars, sum(again::int)::bigint again_words from c{n} group by doc_id)"""


OP3 = f"""
with docs as (select doc_id, coalesce(text, '') t from documents),
words as (select doc_id, unnest(regexp_extract_all(t, {_WORDS})) w, generate_subscripts(regexp_extract_all(t, {_WORDS}), 1) i from docs),
words2 as (select *, length(w) chars from words),
lines as (select doc_id, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from docs),
full_lines as (select doc_id, list_sum(list_transform(regexp_extract_all(l, {_WORDS}), lambda x: length(x)))::bigint chars,
                      row_number() over (partition by doc_id, l order by i) > 1 later from lines where regexp_matches(l, {_WORDS})),
line_sums as (select doc_id, count(*)::bigint n_lines, sum(later::int)::bigint n_dup_lines, sum(case when later then chars else 0 end)::bigint dup_line_chars from full_lines group by doc_id),
word_sums as (select doc_id, count(*)::bigint n_words, sum(chars)::bigint word_chars from words2 group by doc_id),
{",".join(_dup_gram(n).replace("from words ", "from words2 ") for n in (3, *NGRAM_LIMITS))},
m as (select docs.doc_id, coalesce(n_words, 0) n_words, coalesce(word_chars, 0) word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
       coalesce(n_dup_lines, 0) n_dup_lines, coalesce(s3.again_words, 0) n_repeat_words, coalesce(n_lines, 0) n_lines, coalesce(dup_line_chars, 0) dup_line_chars,
       {", ".join(f"coalesce(s{n}.later_chars, 0) dup_{n}gram_chars" for n in NGRAM_LIMITS)}
      from docs left join word_sums using (doc_id) left join line_sums using (doc_id) {" ".join(f"left join s{n} using (doc_id)" for n in (3, *NGRAM_LIMITS))}),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_WORDS_PERCENT} * n_words base_failed from m)
select *, not base_failed and not (dup_line_chars > {LINE_CHARS_LIMIT}::double * word_chars or n_dup_lines > {LINES_LIMIT}::double * n_lines
  {" ".join(f"or dup_{n}gram_chars > {limit}::double * word_chars" for n, limit in NGRAM_LIMITS.items())}) kept from b
"""

OP9 = f"""
with docs as (select doc_id, coalesce(text, '') t, text from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from docs),
numbered as (select doc_id, i, trim(l, ' ') k, {", ".join(f"lead(i, {j}) over o i{j}, lead(trim(l, ' '), {j}) over o k{j}" for j in range(1, WINDOW))}
             from lines where trim(l, ' ') <> '' window o as (partition by doc_id order by i)),
later as (select doc_id, i, i{WINDOW - 1} e from (select *, row_number() over (partition by k, {", ".join(f"k{j}" for j in range(1, WINDOW))} order by doc_id, i) r
          from numbered where i{WINDOW - 1} is not null) where r > 1),
gone as (select distinct doc_id, unnest(range(i, e + 1)) i from later),
kept as (select l.doc_id, coalesce(string_agg(l.l, chr(10) order by l.i) filter (g.i is null), '') text, count(g.i)::bigint n_removed
         from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select docs.doc_id, n_removed, length(case when n_removed = 0 then docs.text else kept.text end)::bigint n_chars,
       sha256(case when n_removed = 0 then docs.text else kept.text end) text_sha256
from docs join kept using (doc_id)
"""

_ESCAPE = r"regexp_replace({}, '(\\|###|</turn>|:)', '\\\1', 'g')"
OP10 = f"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + {len(OPEN) + 2 + len(CLOSE)})::bigint formatted_chars
from c group by conv_id
"""

# classes of a table links(a, b) over a table nodes(id): the smallest id that links lead to
_CLASSES = """
ends as (select a, b from links union select b, a from links),
classes as (with recursive r(id, root) as (select id, id from nodes union select ends.b, r.root from r join ends on ends.a = r.id where ends.b > r.root)
  select id, min(root) root from r group by id)"""

OP1 = f"""
with docs as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) w from documents),
nodes as (select doc_id id from docs),
shingles as materialized (select distinct doc_id, hash(list_slice(w, i, i + {SHINGLE - 1})) s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) m from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where m >= {THRESHOLD}::double * (x.n + y.n - m) - 1e-9), {_CLASSES},
counts as (select a id, count(*)::bigint n from ends group by a)
select c.id doc_id, coalesce(n, 0)::bigint n_links, root class_id, c.id = root kept from classes c left join counts using (id)
"""

OP8 = f"""
with v as materialized (select vec_id id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as materialized (select id, e, sqrt(list_dot_product(e, e)) n from v), nodes as (select vec_id id from embeddings),
links as materialized (select x.id a, y.id b from u x join u y on x.id < y.id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / (x.n * y.n) >= {COSINE}::double), {_CLASSES},
counts as (select a id, count(*)::bigint n from ends group by a)
select c.id vec_id, coalesce(n, 0)::bigint n_links, root component_id, c.id = root kept from classes c left join counts using (id)
"""

_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))


def _found(name: str, kind: int, pattern: str, ok: str = "true", source: str = "docs") -> str:
    p = pattern.replace("'", "''")
    return f"""
{name}_m as (select doc_id, regexp_extract_all(t, '{p}') f, string_split_regex(t, '{p}') g from {source} where regexp_matches(t, '{p}')),
{name} as (select doc_id, {kind} kind, pos, pos + length(f[i]) till, f[i] v from (select doc_id, f, i, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::bigint pos
  from (select *, unnest(range(1, len(f) + 1)) i from {name}_m)) where {ok.replace("V", "f[i]")})"""


_ASSIGN = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", _EITHER)
_BAND = "case " + " ".join(f"when n >= {n} then {i}" for i, n in reversed(list(enumerate(BANDS))) if i) + " else 0 end"
_STEP = f"least({DECADES * STEPS_PER_DECADE}, floor(-log10(greatest(p, 1e-300::double)) * {STEPS_PER_DECADE})::int)"
def _tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::double * abs({z})))"
    upper = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530::double + {t} * (-0.356563782::double + {t} * (1.781477937::double + {t} * (-1.821255978::double + {t} * 1.330274429::double)))))"
    return f"(case when {z} >= 0 then {upper} else 1 - {upper} end)"


def _of(values: tuple) -> str:
    return f"[{', '.join(f'{v!r}::double' for v in values)}][code + 1]"


OP4 = f"""
with docs as (select doc_id, coalesce(text, '') t from documents),
{_found("assign", 0, _ASSIGN, f"length(regexp_extract(V, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8")}, {_found("acc", 1, ACCESS)}, {_found("hexa", 2, HEX)},
base as (select * from assign union all select * from acc union all select * from hexa),
ahead as (select *, coalesce(max(till) over (partition by doc_id order by pos, kind rows between unbounded preceding and 1 preceding), 0) b from base),
blanks as (select doc_id, string_agg(case when pos >= b then substr(t, b + 1, pos - b) else '' end || repeat(' ', greatest(till - greatest(b, pos), 0)), '' order by pos, kind) head, max(till) last
  from ahead join docs using (doc_id) group by doc_id),
free as (select docs.doc_id, case when last is null then t else head || substr(t, last + 1) end t from docs left join blanks using (doc_id)),
{_found("tok", 3, TOKEN, source="free")},
bared as (select *, case when key <> '' then key else whole end bare from (select *, regexp_extract(whole, '{HEADED}', 1) key from (select *, regexp_replace(v, '=+$', '') whole, (till - pos) len from tok))),
coded as (select *, {"case " + " ".join(f"when regexp_matches(bare, '{p}') then {i}" for i, (_, p, _) in enumerate(ENCODINGS)) + " end"} code,
  regexp_matches(bare, '[0-9]')::int + regexp_matches(bare, '[a-z]')::int + regexp_matches(bare, '[A-Z]')::int >= 2 mixed from bared),
placed as (select *, length(alphabet)::double k, length(folded)::double n, regexp_replace(folded, '[+/_-]', '', 'g') alnum, list_transform(string_split(folded, ''), lambda c: strpos(alphabet, c) - 1) x
  from (select *, [{", ".join(f"'{x}'" for _, _, x in ENCODINGS)}][code + 1] alphabet, case when code in ({", ".join(str(i) for i, (name, _, _) in enumerate(ENCODINGS) if name in FOLDED)}) then lower(bare) else bare end folded from coded)),
counted as (select *, list_sum(list_transform(range(k::int), lambda s: pow(len(list_filter(x, lambda c: c = s)), 2))) squares, length(alnum) - 1.0::double m,
  length(regexp_replace(alnum, '[0-9]+|[a-z]+|[A-Z]+', 'x', 'g')) - 1.0::double switches, list_sum(list_transform(list_zip(x[:-2], x[2:]), lambda q: (q[1] - (k - 1) / 2) * (q[2] - (k - 1) / 2))) lag,
  2 / (9 * (k - 1)) spread, {_of(NOISE_SWITCH)} w, {_of(TEXT_SWITCH)} q, {_of(TEXT_PAIR)} pair, {_of(TEXT_TRIPLE)} triple from placed),
z as (select *, (pow(greatest(squares * k / n - n, 0) / (k - 1), 1.0::double / 3) - (1 - spread)) / sqrt(spread) z_chi, abs(switches - m * w) / sqrt(m * w * (1 - w)) z_runs,
  abs(lag) / (sqrt(n - 1) * (k * k - 1) / 12) z_serial, ((n * (n - 1) * pair - (squares - n)) / sqrt(4 * n * (n - 1) * (n - 2) * triple + 2 * n * (n - 1) * (pair - pair * pair)) + (switches - m * q) / sqrt(m * q * (1 - q))) / sqrt(2) z_text from counted),
tested as (select doc_id, kind, pos, till, len n, case when mixed and 3 * least({_tail("z_chi")}, 2 * {_tail("z_runs")}, 2 * {_tail("z_serial")}) >= {ODD}::double then {_tail("z_text")} else 1 end p from z),
stepped as (select *, {_BAND} band, {_STEP} step from tested),
hist as (select band, step, count(*) c from stepped group by all),
cum as (select band, step, sum(c) over (partition by band order by step desc) seen, sum(c) over (partition by band) total from hist),
cut as (select band, coalesce(min(step) filter (pow(10, -step / {STEPS_PER_DECADE}.0::double) <= {LEVEL}::double * seen / total), {DECADES * STEPS_PER_DECADE + 1}) cut from cum group by band),
spans as (select doc_id, kind, pos, till from base union all select doc_id, kind, pos, till from stepped join cut using (band) where step >= cut),
named as (select *, [{", ".join(f"'{k}'" for k in KINDS)}][kind + 1] || ':' || pos || ':' || till s from spans)
select doc_id, count(*) filter (kind = 0)::bigint n_assign, count(*) filter (kind = 1)::bigint n_access, count(*) filter (kind = 2)::bigint n_hex,
  sha256(coalesce(string_agg(s, ',' order by pos, kind) filter (kind < 3), '')) base_sha256, coalesce(string_agg(s, ',' order by pos, kind), '') spans, count(*) filter (kind = 3)::bigint n_random
from docs left join named using (doc_id) group by doc_id
"""

OP13 = f"""
with crc_table as materialized (select list(c order by i)::bigint[] k from (select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))),
folded as (select doc_id id, false goal, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
  union all select item_id, true, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as materialized (select id, goal, w, count(*) n from (select id, goal, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) w from folded) group by all),
hexes as (select w, hex(encode(w)) h from (select distinct w from words)),
bytes as (select w, list_transform(range(1, length(h)::bigint, 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)::bigint[] b from hexes),
placed as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1])), 4294967295::bigint) % {BUCKETS} bucket from bytes, crc_table),
counted as (select bucket, sum(n) filter (not goal) s, sum(n) filter (goal) t from words join placed using (w) group by bucket),
totals as (select coalesce(sum(s), 0)::double s_all, coalesce(sum(t), 0)::double t_all from counted),
gain as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (s_all + {BUCKETS})) / ((coalesce(s, 0) + 1)::double * (t_all + {BUCKETS}))))::bigint g from counted, totals),
weights as (select id, sum(n)::bigint n, sum(n * g)::bigint weight from words join placed using (w) join gain using (bucket) where not goal group by id),
scored as (select doc_id, coalesce(n, 0) n_words, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint score
  from documents left join weights on id = doc_id),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) r, {PERCENT} * count(*) over () // 100 most from scored where n_words >= {MIN_DRAWN})
select doc_id, n_words, n_words n_features, weight, score, case when r <= most then r end::bigint rank from scored left join ranks using (doc_id)
"""

ORACLES = {"op1_ngram_jaccard_join": OP1, "op3_quality_rules": OP3, "op4_secret_scan": OP4, "op8_embedding_near_dedup": OP8, "op9_line_dedup": OP9, "op10_chat_format": OP10, "op13_importance_resampling": OP13}

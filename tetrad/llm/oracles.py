"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from tetrad.llm.chat import Template
from tetrad.llm.licenses import BASE, NOTICES
from tetrad.llm.licenses import Template as Notice
from tetrad.llm.quality import Limits

LIMITS = Limits()
WORD = r"'[^\x20\x09-\x0D]+'"


def _covered(n: int) -> str:
    """Words, and characters in words, inside n-grams that a text has twice or more."""
    return (
        f"g{n} as (select r, unnest(range(1, len(w) - {n - 2})) i, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: hash(array_to_string(w[i:i + {n - 1}], ' ')))) h from d where len(w) >= {n}), "
        f"p{n} as (select distinct r, i + o j from (select r, i from g{n} qualify count(*) over (partition by r, h) > 1), unnest(range({n})) t(o)), "
        f"c{n} as (select r, count(*) n, sum(length(w[j])) c from p{n} join d using (r) group by r)"
    )


OP7 = (
    f"with d as (select row_number() over () r, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {WORD}) w from documents), "
    + ", ".join(_covered(n) for n in (3, *(n for n, _ in LIMITS.ngrams)))
    + f", line as (select r, unnest(string_split(t, chr(10))) x from d), said as (select r, x, count(*) n from line where regexp_matches(x, {WORD}) group by r, x), "
    f"dup as (select r, sum(n - 1) n, sum(case when n > 1 then n * length(array_to_string(regexp_extract_all(x, {WORD}), '')) else 0 end) c from said group by r), "
    "m as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(c3.n, 0)::bigint n_repeat_words, "
    + ", ".join(f"coalesce(c{n}.c, 0)::double / greatest(length(array_to_string(w, '')), 1) coverage_{n}" for n, _ in LIMITS.ngrams)
    + ", coalesce(dup.c, 0)::double / greatest(length(array_to_string(w, '')), 1) coverage_lines from d left join dup using (r) "
    + " ".join(f"left join c{n} using (r)" for n in (3, *(n for n, _ in LIMITS.ngrams)))
    + f"), b as (select *, n_words < {LIMITS.min_words} or 100 * n_repeat_words > 50 * n_words base_failed from m) select *, not base_failed and n_symbols <= "
    + f"{LIMITS.symbols_per_word} * n_words and coverage_lines <= {LIMITS.lines} and " + " and ".join(f"coverage_{n} <= {most}" for n, most in LIMITS.ngrams) + " kept from b"
)

#: Links by all pairs that share an n-gram; components by what can be reached.
OP8 = r"""
with recursive d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select r, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) when len(w) > 0 then [hash(array_to_string(w, ' '))] else [] end s from d),
x as (select r, unnest(s) h from g),
shared as (select a.r a, b.r b, count(*) c from x a join x b on a.h = b.h and a.r < b.r group by all),
link as (select a, b from shared join g p on p.r = a join g q on q.r = b where 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
e as (select a, b from link union all select b, a from link),
reach(a, b) as (select r, r from g union select reach.a, e.b from reach join e on reach.b = e.a),
low as (select a r, min(doc_id) component_id from reach join g on g.r = reach.b group by a),
n as (select a r, count(*) n_links from e group by a)
select g.doc_id, len(s)::bigint n_shingles, component_id, coalesce(n_links, 0)::bigint n_links from g join low using (r) left join n using (r)
"""

#: Windows of 200 bytes as hexadecimal text, by their hashes; runs of covered bytes are islands.
OP9 = r"""
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) hx, octet_length(encode(coalesce(text, ''))) n from documents),
k as (select r, hx, unnest(range(greatest(n - 199, 0))) k from d),
w as (select r, k, hash(substr(hx, 2 * k + 1, 400)) h from k),
rep as (select r, k from w qualify count(*) over (partition by h) > 1),
mark as (select r, k, case when k <= lag(k) over (partition by r order by k) + 200 then 0 else 1 end first from rep),
isl as (select r, k, sum(first) over (partition by r order by k) g from mark),
run as (select r, g, min(k) a, max(k) + 200 z from isl group by r, g),
gone as (select r, sum(z - a) n_removed, count(*) n_spans, list(a order by a) a, list(z order by a) z from run group by r),
kept as (select d.r, array_to_string(list_transform(range(1, len(a) + 2), lambda i: substr(hx, (case when i = 1 then 0 else 2 * z[i - 1] end) + 1, 2 * ((case when i > len(a) then n else a[i] end) - (case when i = 1 then 0 else z[i - 1] end)))), '') hx from d join gone using (r))
select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept.hx, d.hx))) kept_sha256 from d left join gone using (r) left join kept using (r)
"""



def _row(t: Notice) -> str:
    at = next(i for i in range(len(t.words)) if t.words[i : i + len(t.key)] == t.key)
    return f"('{t.label}', {str(t.base).lower()}, {list(t.words)}, {list(t.key)}, {at})"


#: Every place of a template's key, and the share of the template's words that stand in place around it.
OP1 = (
    f"with t(label, base, tw, kw, pre) as (values {', '.join(map(_row, (*BASE, *NOTICES)))}), "
    r"d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents), "
    "pos as (select r, unnest(range(1, len(w) + 1)) p, unnest(w) x from d), "
    "hit as (select r, label, base, p - 1 start, list_sum(list_transform(range(1, len(tw) + 1), lambda i: case when i > pre and i <= pre + len(kw) then 1 when p - pre + i - 1 between 1 and len(w) and w[p - pre + i - 1] = tw[i] then 1 else 0 end))::double / len(tw) share from pos join t on x = kw[1] join d using (r) where w[p:p + len(kw) - 1] = kw), "
    "kept as (select * from hit where base or share >= 0.6), "
    "m as (select r, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word, string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(share) score from kept group by r) "
    "select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score from d left join m using (r)"
)


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks by rounds of assignment and means, each a step of the statement."""
    near = "{name} as materialized (select x.r, x.p, min(list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.k) m from x join {book} c on x.p = c.p group by x.r, x.p)"
    step = (
        "t{i} as (select n.p, m % 256 k, j, sum(x[j])::hugeint s, count(*) n from n{i} n join x on x.r = n.r and x.p = n.p, (select unnest(range(1, (select max(len(x)) + 1 from x))) j) group by n.p, k, j), "
        "c{o} as materialized (select p, k, coalesce(t.x, c.x) x from c{i} c left join (select p, k, list(((s - ((s % n) + n) % n) // n)::bigint order by j) x from t{i} group by p, k) t using (p, k))"
    )
    return (
        "with q as (select row_number() over (order by vec_id nulls last, embedding) r, vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = len(embedding)), "
        f"x as materialized (select r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] x from q, range({parts}) t(p)), "
        f"c0 as materialized (select p, r - 1 k, x from x where r <= {entries}), "
        + ", ".join(f"{near.format(name=f'n{i}', book=f'c{i}')}, {step.format(i=i, o=i + 1)}" for i in range(rounds))
        + f", {near.format(name='f', book=f'c{rounds}')}, "
        "coded as (select r, vec_id, label, string_agg(printf('%02x', (m % 256)::int), '' order by p) code, sum(m // 256)::bigint error from f join q using (r) group by r, vec_id, label), "
        f"h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) codebooks_sha256 from c{rounds}) "
        "select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from coded, h"
    )


def _formatted(t: Template, spoken: str) -> str:
    """Escaped texts between marks; a text under the loss is one of the assistant's."""
    escaped = "regexp_replace(regexp_replace({0}, '(<)(\\\\*)(" + "|".join(re.escape(c[1:]) for c in t.controls if c[0] == "<") + ")', '\\1\\\\\\2\\3', 'g'), '(\\[)(\\\\*)(" + "|".join(re.escape(c[1:]) for c in t.controls if c[0] == "[") + ")', '\\1\\\\\\2\\3', 'g')"
    marks = len(t.turn + t.body + t.end)
    return (
        f"with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations union all values (-7, 0, 'user', '{spoken}'), (-7, 1, 'assistant', '{spoken}')) "
        "select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, t)) turns_sha256, "
        "coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by turn nulls first, t) filter (role = 'assistant'), '')) loss_sha256, "
        f"sum({marks} + length({escaped.format('role')}) + length({escaped.format('t')}))::bigint formatted_chars, 0::bigint n_attachments, 0::bigint expanded_tokens from c group by conv_id"
    )


SQL = {
    "op1_license_scan": OP1,
    "op7_quality_rules": OP7,
    "op8_ngram_jaccard_join": OP8,
    "op9_suffix_array_dedup": OP9,
    "op12_vector_codes": _codes(),
    "op13_chat_formatting": _formatted(Template(), "</s>[INST] ok [/INST]"),
}

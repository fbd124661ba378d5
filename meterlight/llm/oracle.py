"""DuckDB SQL for the operators of this folder that SQL can express."""

from __future__ import annotations

from meterlight.llm.license_scan import length_class, notice_words
from meterlight.llm.license_texts import NOTICES

_EXACT_DEDUP = r"""
with texts as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body
    from documents
),
groups as (
    select body, min(doc_id) as keep_id, count(*) as group_size
    from texts
    group by body
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
from texts join groups using (body)
"""

# Plain: all pairs of sets that share a shingle, and the links' closure.
_JACCARD_JOIN = r"""
with recursive spoken as (
    select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as words
    from documents
),
sets as (
    select doc_id, case
        when len(words) = 0 then []
        when len(words) < 5 then [array_to_string(words, ' ')]
        else list_sort(list_distinct(list_transform(
            range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))))
        end as shingles
    from spoken
),
classes as (
    select shingles, min(doc_id) as rep, count(*) as copies
    from sets where len(shingles) > 0 group by shingles
),
each as (select rep, len(shingles) as size, unnest(shingles) as shingle from classes),
pairs as (
    select a.rep as a, b.rep as b, a.size + b.size as sizes, count(*) as shared
    from each a join each b on a.shingle = b.shingle and a.rep <> b.rep
    group by all
),
links as (select a, b from pairs where shared >= 0.8 * (sizes - shared)),
reach as (
    select rep, rep as root from classes
    union
    select links.a, reach.root from reach join links on links.b = reach.rep
),
roots as (select rep, min(root) as class_id from reach group by rep),
counts as (select a as rep, count(*) as n_links from links group by a)
select doc_id,
       coalesce(class_id, doc_id) as class_id,
       coalesce(n_links, 0) as n_links,
       coalesce(classes.rep, doc_id) as copy_of,
       coalesce(copies, 1) as n_copies
from sets
left join classes on sets.shingles = classes.shingles
left join roots on roots.rep = classes.rep
left join counts on counts.rep = classes.rep
"""


def _notice_rows() -> str:
    rows = []
    for number, (name, text) in enumerate(NOTICES):
        words = notice_words(text)
        wanted = sorted({" ".join(words[k : k + 5]) for k in range(len(words) - 4)})
        listed = ", ".join(f"'{shingle}'" for shingle in wanted)
        rows.append(f"({number}, '{name}', {length_class(len(words))}, [{listed}])")
    return ",\n        ".join(rows)


# Plain: every shingle of a notice in every text, counted per window that holds it.
_LICENSES = rf"""
with spoken as (
    select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words
    from documents
),
notices(notice, license, length, wanted) as (
    values
        {_notice_rows()}
),
places as (
    select doc_id, len(words) as n, unnest(list_transform(range(0, len(words) - 4),
        lambda k: {{'spot': k, 'shingle': array_to_string(words[k + 1:k + 5], ' ')}})) as place
    from spoken where len(words) >= 5
),
parts as (select notice, license, length, len(wanted) as size, unnest(wanted) as shingle from notices),
hits as (
    select doc_id, n, notice, license, length, size, place.spot as spot, place.shingle as shingle
    from places join parts on place.shingle = parts.shingle
),
held as (
    select *, length * (spot // length) - back * length as low
    from hits, (values (0), (1)) as steps(back)
),
shares as (
    select doc_id, notice, license, low, count(distinct shingle) / any_value(size) as containment
    from held
    where low >= 0 and low <= greatest(0, n - length - 1) and spot + 5 <= low + 2 * length
    group by doc_id, notice, license, low
)
select doc_id, notice, license, max(containment) as containment,
       arg_min(low, (-containment, low)) as start_word
from shares where containment >= 0.8 - 1e-9
group by doc_id, notice, license
"""

# Plain: every phrase at every place, every cut, and the longer phrase around each pair.
_COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
spoken as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
phrases as (
    select lang, 1 as size, unnest(words) as phrase from spoken
    union all
    select lang, 2, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))
    from spoken where len(words) > 1
    union all
    select lang, 3, unnest(list_transform(range(1, len(words) - 1),
        lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2]))
    from spoken where len(words) > 2
),
counts as (
    select lang, size, phrase, count(*) as f, string_split(phrase, ' ') as words
    from phrases group by lang, size, phrase having count(*) >= 10
),
halves as (
    select lang, phrase, size, f, 1 as k, words[1] as head, array_to_string(words[2:], ' ') as tail
    from counts where size > 1
    union all
    select lang, phrase, size, f, 2, array_to_string(words[1:2], ' '), words[3] from counts where size = 3
),
cuts as (
    select c.lang, c.phrase, c.size, c.f as a, k, l.f as l, r.f as r,
           1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f) as score
    from halves c
    join counts l on l.lang = c.lang and l.phrase = c.head
    join counts r on r.lang = c.lang and r.phrase = c.tail
),
lowest as (
    select * from cuts
    qualify row_number() over (partition by lang, phrase order by score, k) = 1
),
around as (
    select lang, phrase, max(f) as f from (
        select lang, array_to_string(words[1:2], ' ') as phrase, f from counts where size = 3
        union all
        select lang, array_to_string(words[2:3], ' '), f from counts where size = 3
    ) group by lang, phrase
),
ranked as (
    select lowest.lang, lowest.phrase, a, l, r, score,
           row_number() over (partition by lowest.lang order by score desc, a desc, lowest.phrase) as rank
    from lowest left join around on lowest.lang = around.lang and lowest.phrase = around.phrase
    where lowest.size = 3 or around.f is null or 100 * around.f < 50 * a
),
totals as (select lang, sum(len(words)) as n from spoken group by lang)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from ranked join totals using (lang)
where rank <= 2000
"""

ORACLE_SQL = {
    "op2_licenses": _LICENSES,
    "op5_jaccard_join": _JACCARD_JOIN,
    "op7_exact_dedup": _EXACT_DEDUP,
    "op12_collocations": _COLLOCATIONS,
}

"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

#: The table of CRC-32's polynomial (0xEDB88320), and the checksum of a list of bytes by it.
CRC_TABLE = """crc_table as (select list(c order by i) tab from (
    select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) c from (select unnest(range(256)) i)))"""


def crc(listed: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {listed}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])))"


def utf8(text: str) -> str:
    """The bytes of a text whose code points are below 256."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end))"


TRIE = f"""
with {CRC_TABLE},
turns as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i from conversations where conv_id is not null),
own as (select conv_id, list({{'r': r, 'x': x}} order by i) t from turns group by conv_id),
grafted as (select o.conv_id c, coalesce(b.t[:h], []) || o.t[h + 1:] t
    from (select *, {crc(utf8("conv_id::varchar"))} % 9 h from own, crc_table) o left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
paths as (select c, d, len(t) n, t[:d] p, case when d > 0 then strlen(t[d].x) else 0 end size from (select c, t, unnest(range(len(t) + 1)) d from grafted)),
nodes as (select p, d depth, min(c) conv_id, count(*) n_convs, any_value(size) size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) ends_sha256 from paths group by p, d),
children as (select p[:depth - 1] p, depth - 1 depth, count(*) n_children from nodes where depth > 0 group by 1, 2),
kids as (select n.*, k.conv_id parent_conv_id, coalesce(c.n_children, 0) n_children from nodes n left join nodes k on k.depth = n.depth - 1 and k.p = n.p[:n.depth - 1] left join children c on c.depth = n.depth and c.p = n.p),
above as (select p, d, n_children, (n_convs - 1) * size own from (select *, unnest(range(depth + 1)) d from kids)),
summed as (select p[:d] p, d depth, sum(case when n_children = 0 then 1 else 0 end)::bigint n_leaves, sum(own)::bigint saved_tokens from above group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from kids join summed using (p, depth)
"""

SPELLING = f"""
with recursive {CRC_TABLE},
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) k from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) run from documents) group by 1, 2),
hashed as (select run, k, {crc(utf8("coalesce(doc_id::varchar, '') || ':' || run"))} h from runs, crc_table where length(run) >= 5),
changed as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, k from hashed),
words as (select word, sum(k)::bigint n from changed where length(word) >= 5 group by word having sum(k) >= 3),
gaps as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) g from (select *, unnest(range(length(word))) i from words)),
pairs as (
    select a.word, b.word near, b.n from gaps a join gaps b on a.g = b.g and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from gaps a join words b on a.g = b.word
    union select b.word, a.word, a.n from gaps a join words b on a.g = b.word),
best as (select word, count(*) n_near, max(n) best_n, first(near order by n desc, near) best from pairs group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) n_near, case when best_n >= 2 * w.n then best end form, case when best_n >= 2 * w.n then best_n end form_n from words w left join best b on b.word = w.word),
steps as (select word, word ahead from forms union all select s.word, f.form from steps s join forms f on f.word = s.ahead where f.form is not null),
roots as (select s.word, s.ahead root from steps s join forms f on f.word = s.ahead where f.form is null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join roots r on r.word = f.word
"""

FACTORS = """
with split as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
windows as (select r, doc_id, i, sha256(array_to_string(w[i + 1:i + 50], ' ')) h from (select *, unnest(range(greatest(len(w) - 49, 0))) i from split)),
firsts as (select h, min(coalesce(doc_id, 9223372036854775807)) d from windows group by h),
gone as (select distinct r, unnest(range(i, i + 50)) spot from windows join firsts using (h) where d < coalesce(doc_id, 9223372036854775807)),
held as (select r, unnest(w) word, unnest(range(len(w))) spot from split),
kept as (select h.r, count(g.spot) n_removed, sha256(coalesce(string_agg(h.word, ' ' order by h.spot) filter (g.spot is null), '')) kept_sha256 from held h left join gone g on g.r = h.r and g.spot = h.spot group by h.r)
select doc_id, len(w) n_words, coalesce(n_removed, 0) n_removed, coalesce(kept_sha256, sha256('')) kept_sha256 from split left join kept using (r)
"""

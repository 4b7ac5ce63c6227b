"""op12 in SQL: each pair of sources and kept term is a row, its counts side by side."""

SQL = """
with docs as (
    select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words
    from documents
),
in_doc as (select doc, lang, source, term, count(*) as n from (select doc, lang, source, unnest(words) as term from docs) group by all),
kept as (select lang, term, sum(n)::bigint as n from in_doc group by all having count(*) >= 30),
langs as (select lang, sum(n)::bigint as total, count(*) as v from kept group by all),
sources as (select distinct lang, source from docs),
cells as (
    select s.lang, s.source, k.term, coalesce(c.n, 0)::bigint as n
    from sources s join kept k on k.lang = s.lang
    left join (select lang, source, term, sum(n) as n from in_doc group by all) c on c.lang = s.lang and c.source = s.source and c.term = k.term
),
totals as (select lang, source, sum(n) as total from cells group by all),
shares as (
    select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 5)) // (t.total + 5 * l.v)::hugeint as p
    from cells c join totals t on t.lang = c.lang and t.source = c.source join langs l on l.lang = c.lang
),
of_lang as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v)::hugeint as q from kept k join langs l on l.lang = k.lang),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value
    from sources a join sources b on a.lang = b.lang and a.source <> b.source
    left join (
        select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as value
        from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
    ) d on d.lang = a.lang and d.source = a.source and d.other = b.source
),
terms as (
    select s.lang, s.source, 'term' as part, s.term as item, (s.p - o.q)::bigint as value
    from shares s join of_lang o on o.lang = s.lang and o.term = s.term where s.n > 0 and s.p > o.q
)
select * from (
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
    from (select * from pairs union all select * from terms)
) where part = 'pair' or rank <= 50
"""

"""op13 in SQL: every query with every row."""

SQL = """
with whole as (
    select vec_id, [floor(1024 * x::double) for x in embedding] as z from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
scores as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.z, c.z)::bigint as score
    from whole q join whole c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
)
select query_id, (row_number() over best)::int as rank, vec_id, score from scores
window best as (partition by query_id order by score desc, vec_id) qualify row_number() over best <= 10
"""

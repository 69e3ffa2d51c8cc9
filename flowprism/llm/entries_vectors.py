"""Queries on embeddings: hard negatives and whitening."""

from pyspark.sql import functions as F

from flowprism.llm import negatives, whitening
from flowprism.llm.registry import query, table

NEGATIVES_SQL = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pairs as materialized (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other as positive_id, score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (
  select p.anchor_id, p.positive_id, other as negative_id, p.score as positive_score, q.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by q.score desc, other) as rank
  from p join pairs q on q.anchor_id = p.anchor_id and not q.same
    and 50 * p.score <= 100 * q.score and 100 * q.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0, label=label)


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

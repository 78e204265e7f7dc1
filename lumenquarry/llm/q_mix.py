"""op7: the mix of all documents."""

from lumenquarry.llm.common import unit_sql
from lumenquarry.llm.mixing import SEED, mix

NAME = "op7_mixing"
COLUMNS = ("doc_id", "source", "size", "source_size", "target", "taken")


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


SQL = f"""
with d as (
  select doc_id, source, {unit_sql(SEED, "doc_id")} as u,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         [3.0, 1.0, 2.0][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1]::double as weight
  from d group by source),
r as (select *, 2.0 * source_size as cap, 2.0 * source_size / weight as ratio, 1.5 * sum(source_size) over () as total from s),
l as (
  select *, (total - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from r window before as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
o as (select max(level) as water, min(ratio) as lowest from l where level < ratio),
t as (
  select source, source_size,
         cast(case when o.lowest is null or ratio < o.lowest then cap else weight * o.water end as double) as target
  from l cross join o),
a as (
  select d.*, t.source_size, t.target,
         coalesce(sum(d.size) over (partition by d.source order by u, doc_id, d.size
                  rows between unbounded preceding and 1 preceding), 0) as pos,
         case when t.source_size > 0 then least(floor(t.target / t.source_size), 2) else 0 end as whole
  from d join t on d.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
       cast(whole * size + greatest(0, least(size, round(target - whole * source_size) - pos)) as bigint) as taken
from a
"""

"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there. The rank over the size of the source
is a row's fractional rank; all rows sorted by it are an even mixture of the sources from start to end,
and equal cuts of that order are shards whose row counts differ by at most one.

Ranks come from running sums over hash buckets, so a source with a third of all rows is spread like any
other. Only functions of Spark SQL are used, and texts leave the scan as a size and a checksum.

Cases: rows without a source form a stratum of their own. A null text has the size of the row overhead and
the checksum of nothing. Null or repeated ids and repeated rows are ranked by what they hold, equal rows in
any order. With fewer rows than shards some shards are empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import staged
from sitehex.operators.atscale import broadcast_bounded, bucketed_running_sum

SHARDS = 40
SEED = 17
ROW_BYTES = 16


def interleave(rows: DataFrame, strata: str, shuffled: str, shards: int) -> DataFrame:
    """``rows`` with shard and slot. ``strata`` names the source column, ``shuffled`` a column of hexadecimal hashes."""
    hexed = lambda at, n: F.conv(F.substring(shuffled, at, n), 16, 10).cast("int")
    ties = [F.col(c) for c in rows.columns if c not in (strata, shuffled)]
    ranked = staged(
        bucketed_running_sum(
            rows, [strata], [hexed(1, 2), hexed(3, 3)], [F.col(shuffled), *ties], F.lit(1).cast("bigint"), "_rank"
        ),
        "shard-ranks",
    )
    sizes = ranked.groupBy(strata).agg(F.max("_rank").alias("_size"))
    sized = ranked.join(broadcast_bounded(sizes, sizes.count()), strata)
    placed = sized.withColumn("_at", (F.col("_rank") - F.lit(0.5)) / F.col("_size"))
    fine = F.floor(F.col("_at") * (1 << 20))
    ordered = bucketed_running_sum(
        placed, [], [F.shiftright(fine, 10), fine % 1024], [F.col("_at"), F.col(strata)], F.lit(1).cast("bigint"), "_position"
    )
    total = ranked.count()
    position = F.col("_position") - 1
    shard = F.expr(f"(_position - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    out = ordered.withColumn("_shard", shard).withColumn("slot", position - first)
    return out.withColumn("shard", F.col("_shard").cast("int")).drop("_rank", "_size", "_at", "_position", "_shard")


def shard(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, source of every row of ``documents`` (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_stratum"),
    )
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"))
    narrow = staged(rows.withColumn("_order", shuffled), "shard-rows")
    out = interleave(narrow, "_stratum", "_order", shards)
    source = F.when(F.col("_stratum") != "", F.substring("_stratum", 2, 1 << 30))
    return out.withColumn("source", source).drop("_stratum", "_order")


# A table of checksums of single bytes, and a checksum folded over the bytes of a text.
CRC_SQL = """
bits as (select b, list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8],
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256))::bigint as b)),
crc_table as (select list(c order by b) as t from bits),
crcs as (select x.text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
        lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc
    from (select distinct coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents) x, crc_table)
"""

SHARD_SQL = f"""
with {CRC_SQL},
base as (select doc_id, octet_length(encode(coalesce(d.text, ''))) + {ROW_BYTES} as size, crc as text_crc32,
        coalesce('=' || source, '') as stratum
    from documents d join crcs on crcs.text = coalesce(d.text, '')),
ranked as (select *, count(*) over (partition by stratum) as n,
        row_number() over (partition by stratum order by
            md5(concat_ws(':', '{SEED}', coalesce(doc_id::varchar, ''), text_crc32::varchar)), doc_id, size, text_crc32) as r
    from base),
ordered as (select *, row_number() over (order by (r - 0.5::double) / n, stratum) - 1 as p, count(*) over () as total from ranked),
cut as (select *, (p * {SHARDS}) // total as k from ordered)
select doc_id, size, text_crc32, 'rows' as law, k::int as shard, p - (k * total + {SHARDS - 1}) // {SHARDS} as slot,
    null::int as grown_shard
from cut
"""

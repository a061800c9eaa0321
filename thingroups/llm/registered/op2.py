"""op2: all documents in 40 shards of nearly equal bytes."""

from thingroups.llm import sharding
from thingroups.llm.common import table
from thingroups.llm.queries import register

# The checksum is the usual one: reflected polynomial 0xEDB88320, byte by byte.
SQL = """
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS value, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1
  FROM steps WHERE step < 8
), lookup AS (
  SELECT list(value ORDER BY byte) AS entries FROM steps WHERE step = 8
), sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, coalesce(md5(text), '') AS digest, text FROM documents
), summed AS (
  SELECT *,
    row_number() OVER o - 1 AS row, sum(size) OVER o - size AS before, sum(size) OVER () AS total
  FROM sized WINDOW o AS (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
), placed AS (
  SELECT *, (before * 40 // total)::INT AS shard FROM summed
)
SELECT doc_id, size::BIGINT AS size,
  CASE WHEN text IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
      string_split(rtrim(regexp_replace(hex(text), '(..)', '\\1,', 'g'), ','), ','),
      lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END)),
    lambda c, b: CASE WHEN b IS NULL THEN c ELSE xor(c >> 8, entries[(xor(c, b) & 255) + 1]) END)) END AS text_crc32,
  'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM placed, lookup
"""


@register("op2_sharding", SQL)
def op2(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))

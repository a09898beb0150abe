"""Registered queries of the subpackage; each takes (spark, folder)."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_root

from .ann import nearest
from .best_fit import best_fit
from .common import table
from .decontam import SHARE, WHOLE, WINDOW, passages
from .line_dedup import dedup_lines
from .packing import pack
from .pii import pseudonyms
from .repair import repair
from .simhash import near_components
from .spelling import count_runs, variants
from .token_files import read_token_files, write_token_files
from . import langid, sql, toxicity
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents", "doc_id", "text"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, folder, "documents", "doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents", "doc_id", "text"))


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings", "vec_id", "embedding"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(table(spark, folder, "documents", "doc_id", "text"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """The key is an example; a real one stays out of code."""
    return pseudonyms(table(spark, folder, "documents", "doc_id", "text"), key="example key")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{checkpoint_root(spark).rstrip('/')}/riskloom-tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, folder, "documents", "doc_id", "text"), place)
    return read_token_files(spark, place)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations damaged by a hash of conversation and turn: a twentieth of the rows each is dropped, emptied,
    stripped of its sentence ends, repeated, and given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    report = repair(damaged(conversations)).withColumnRenamed("conv_id", "id")
    all_ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit(table(spark, folder, "documents", "doc_id", "text"))


def _lose_one(doc_id: str | None, found: list[str]) -> list[str]:
    """Every 199th run by crc32 of ``<doc_id>:<run>`` loses the code point that the same hash points at."""
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    marks = [zlib.crc32(run.encode(), start) for run in found]
    return [run if mark % 199 else run[: mark % len(run)] + run[mark % len(run) + 1 :] for run, mark in zip(found, marks)]


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Some runs lose a code point first (so shorter runs give no word); a null id is an empty one."""
    return variants(count_runs(table(spark, folder, "documents", "doc_id", "text"), edit=_lose_one))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_nearest": op4_nearest,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_token_files": op10_token_files,
    "op11_conversations": op11_conversations,
    "op12_best_fit": op12_best_fit,
    "op13_spelling": op13_spelling,
}
LINE_DEDUP_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), repeated as (
    select key, max(doc_id) as owner from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
    select k.*, r.owner is not null and r.owner <> k.doc_id as dropped from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""


# Where 11 of 13 tokens agree, or 10 of 12, four in a row do; where 9 of 11 do, three.
DECONTAMINATION_SQL = f"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w
    from documents
), items as (
    select item_id, v, len(v) as n, least({WINDOW}, len(v)) as width, case when len(v) >= 12 then 4 when len(v) = 11 then 3 else len(v) end as run
    from (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as v from benchmark)
    where len(v) > 0
), at_item as (
    select item_id, run, q, array_to_string(v[q + 1 : q + run], ' ') as gram from (select *, unnest(range(n - run + 1)) as q from items)
), at_doc as (
    select doc_id, run, p, array_to_string(w[p + 1 : p + run], ' ') as gram
    from (select *, unnest(range(len(w) - run + 1)) as p from words, (select distinct run from items))
), diagonals as (
    select distinct doc_id, item_id, p - q as d from at_doc join at_item using (run, gram)
), aligned as (
    select doc_id, item_id, d, n, width,
        list_transform(range(n), lambda i: case when d + i >= 0 and w[d + i + 1] = v[i + 1] then 1 else 0 end) as same
    from diagonals join words using (doc_id) join items using (item_id)
), checked as (
    select *, list_sum(same) as m from aligned
    where list_max(list_transform(range(n - width + 1), lambda s: list_sum(same[s + 1 : s + width])))
        >= case when n < {WHOLE} then n else ceil(width * {SHARE}) end
), ranked as (
    select *, row_number() over (partition by doc_id, item_id order by m desc, d) as r from checked
)
select doc_id, item_id, cast(m as bigint) as n_match, cast(n as bigint) as n_item, cast(d as bigint) as doc_start
from ranked where r = 1
"""

ORACLE_SQL = {
    "op2_line_dedup": LINE_DEDUP_SQL, "op6_decontamination": DECONTAMINATION_SQL, "op11_conversations": sql.REPAIR,
    "op13_spelling": sql.SPELLING,
}

"""The queries of this subpackage, each over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""
with w as (
    select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents where doc_id is not null),
p as (select doc_id, words, unnest(range(0, len(words) - 19)) as i from w where len(words) >= 20),
h as (select doc_id, i, sha256(array_to_string(words[i + 1:i + 20], ' ')) as h from p),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as rn from h) where rn > 1),
gone as (select distinct doc_id, i + j as k from again, (select unnest(range(0, 20)) as j)),
lost as (select doc_id, count(*) as n, list(k) as ks from gone group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
    sha256(array_to_string(case when n is null then words
        else [x.w for x in list_transform(words, lambda x, i: {'w': x, 'i': i - 1}) if not list_contains(ks, x.i)] end, ' ')) as kept_sha256
from w left join lost using (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents where doc_id is not null),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as sh from w),
x as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * c >= 80 * (len(sa.sh) + len(sb.sh) - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as reach from s union select r.doc_id, e.b from r join e on r.reach = e.a)
select s.doc_id, any_value(len(sh))::bigint as n_shingles, min(reach) as component_id from s join r using (doc_id) group by s.doc_id
""")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), k=5, percent=80)


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from tandem.llm.byte_bpe import decode, encode

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(r"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size from s group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
    3 * source_size as most, sum(source_size) over () as total from t),
l as (select *, most / weight as fill, (total - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following)::double as level from w),
f as (select arg_min(level, rn) as level from (select level, row_number() over (order by fill, source nulls last) as rn from l where level * weight <= most)),
g as (select source, source_size, least(most::double, f.level * weight) as target from l, f),
r as (select s.*, g.source_size, target, case when g.source_size > 0 then target / g.source_size else 0 end as rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double as u from s join g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from r
""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.mixing import decisions

    return decisions(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.fingerprints import edits

    return edits(table(spark, sf_dir, "documents"))


@query(r"""
with crc as (select list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::bigint, range(0, 8)::bigint[]), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab),
d as (select doc_id, coalesce(text, '') as text, hex(coalesce(text, '')) as h from documents),
s as (select doc_id, (strlen(text) + 16)::bigint as size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))::bigint as text_crc32 from d, crc),
p as (select *, sum(size) over (order by doc_id nulls first, size, text_crc32 rows unbounded preceding) - size as start, sum(size) over () as total from s),
q as (select *, least(39, floor((2 * start + size) * 40 / (2 * total)::double))::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1)::int as slot, null::int as grown_shard from q
""")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.sharding import shards

    out = shards(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op8_sst_output(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import zlib

    from tandem.llm.common import arrow_map, list_values
    from tandem.llm.sst_output import token_table

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def digest(batch):
        ids, first = list_values(batch.column("ids"))
        raw = ids.astype("<u4").tobytes()
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": first[1:] - first[:-1], "ids_crc32": sums}

    return arrow_map(token_table(table(spark, sf_dir, "documents"), path, end_id=2), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query()
def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.ann_permutation import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

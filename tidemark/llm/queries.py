"""The registered queries of the thirteen operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import centroids, leaks, maxent, mixing, packing, repeats, secrets, simhash, topk, toxicity, tries, warc, winnow
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return register


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_best_two_fit")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


@query("op8_source_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


@query("op5_warc", """
    with p as (
      select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
    f as (select h, max(page_id) as first from p where n >= 1000 group by h)
    select p.page_id, p.n as payload_bytes, sha1(p.h) as payload_digest,
           case when f.first is not null and p.page_id <> f.first then 'revisit' else 'response' end as record_type,
           case when f.first is not null and p.page_id <> f.first then f.first end as refers_to
    from p left join f on p.h = f.h""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_top_k", """
    with v as (
      select vec_id, [floor(256 * cast(x as double)) for x in embedding] as e from embeddings
      where embedding is not null
        and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
    s as (
      select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
    r as (
      select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
             vec_id, score
      from s)
    select * from r where rank <= 5""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op10_maxent_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


@query("op6_winnowing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").withColumnRenamed("source", "path"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_decontamination", """
    with d as materialized (
      select doc_id, row_number() over () as rid, [x for x in regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] as w
      from documents),
    b as (
      select item_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] as w
      from benchmark),
    items as materialized (
      select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as k
      from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
    places as (
      select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as k
      from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from items)) ),
    met as materialized (select rid, n, i, k from places where k in (select k from items)),
    hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from met) group by rid),
    named as (
      select rid, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
      from (select distinct rid, cast(item_id as varchar) as item_id from met join items using (n, k) where item_id is not null)
      group by rid)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (rid) left join named using (rid)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op12_prefix_trie", """
    with ids as (select distinct conv_id as c from conversations where conv_id is not null),
    crc as (
      select c, xor(4294967295, list_reduce(list_concat([4294967295::bigint], [cast(ord(x) as bigint) for x in string_split(cast(c as varchar), '')]),
        lambda s, b: list_reduce(list_concat([xor(s, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
          lambda t, z: case when t & 1 = 1 then xor(t >> 1, 3988292384) else t >> 1 end))) % 4 as h
      from ids),
    turns as (
      select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t,
             row_number() over (partition by conv_id order by turn nulls first,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
      from conversations where conv_id is not null),
    rebuilt as (
      select crc.c, 0 as own, pos, r, t from crc join turns on turns.c = crc.c - crc.c % 20 and pos <= h
      union all select crc.c, 1, pos, r, t from crc join turns on turns.c = crc.c and pos > h),
    numbered as (
      select c, r, len([x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> '']) as w,
             length(r) || ':' || r || t as k, row_number() over (partition by c order by own, pos) as d
      from rebuilt),
    steps as materialized (
      select c, d, w, sha256(string_agg(sha256(k), '') over (partition by c order by d)) as p,
             count(*) over (partition by c) as n
      from numbered
      union all select ids.c, 0, 0, '', (select count(*) from numbered x where x.c = ids.c) from ids),
    nodes as materialized (
      select d, p, min(c) as conv_id, count(*) as n_convs, any_value(w) as w,
             sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = d), '')) as ends_sha256
      from steps group by d, p),
    links as materialized (
      select distinct a.d, a.p, b.p as up from steps a left join steps b on a.c = b.c and b.d = a.d - 1),
    kids as (select d - 1 as d, up as p, count(*) as k from links where d > 0 group by 1, 2),
    full_nodes as (
      select n.*, coalesce(k, 0) as k, u.conv_id as parent_conv_id
      from nodes n left join kids on kids.d = n.d and kids.p = n.p
      left join links l on l.d = n.d and l.p = n.p left join nodes u on u.d = n.d - 1 and u.p = l.up),
    under as (
      select distinct a.d, a.p, b.d as low_d, b.p as low_p from steps a join steps b on a.c = b.c and b.d >= a.d),
    sums as (
      select u.d, u.p, cast(sum(cast(f.k = 0 as integer)) as bigint) as n_leaves,
             cast(sum((f.n_convs - 1) * f.w) as bigint) as saved_tokens
      from under u join full_nodes f on f.d = u.low_d and f.p = u.low_p group by u.d, u.p)
    select f.conv_id, cast(f.d as bigint) as depth, f.parent_conv_id, f.n_convs, f.k as n_children, n_leaves, saved_tokens, ends_sha256
    from full_nodes f join sums s on s.d = f.d and s.p = f.p""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def _clusters_twin(rounds: int = 3) -> str:
    nearest = """
    a{k} as materialized (
      select rid, any_value(v.e) as e,
             min(struct_pack(d := cast(list_sum([(v.e[i] - m[i]) * (v.e[i] - m[i]) for i in range(1, 65)]) as bigint), c := c)) as best
      from v cross join c{k} group by rid),"""
    means = """
    f{k} as (
      select best.c as c, i, cast(floor(sum(e[i]) / count(*)) as bigint) as f from a{k} cross join range(1, 65) t(i) group by 1, 2),
    c{next} as materialized (
      select c{k}.c, coalesce(n.m, c{k}.m) as m from c{k} left join (select c, list(f order by i) as m from f{k} group by c) n on n.c = c{k}.c),"""
    return """
    with v as materialized (
      select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e, row_number() over () as rid
      from embeddings where embedding is not null and len(embedding) = 64
        and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
    c0 as materialized (
      select cast(place - 1 as integer) as c, e as m
      from (select e, row_number() over (order by sha256('1:' || vec_id) nulls last, e) as place from v) where place <= 16),""" + "".join(
        nearest.format(k=k) + (means.format(k=k, next=k + 1) if k < rounds else "") for k in range(rounds + 1)) + f"""
    s as (select best.c as c, cast(sum(best.d) as bigint) as own from a{rounds} group by 1)
    select vec_id, best.c as cluster, best.d as distance, s.own as cluster_inertia,
           (select cast(sum(own) as bigint) from s) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
    from a{rounds} a join v on v.rid = a.rid join s on s.c = best.c join c{rounds} c on c.c = best.c"""


@query("op13_bit_plane_clusters", _clusters_twin())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))

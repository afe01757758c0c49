"""One thin query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, decontam, hmm, htmltext, langid, licenses, mixing, quality, sharding, simhash, vectorcodes, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file that a query is defined on."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs))


def op3_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    rows = langid.predict(docs, prototypes)
    return rows.select("doc_id", langid.held_out(rows["doc_id"]).alias("held_out"), "lang_pred", "score")


def op5_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), bpe.Vocabulary.load(tokenizer_path()))
    return bpe.digests(coded)


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contract(decontam.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_html_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.score(table(spark, sf_dir, "documents"), align.Pair(tokenizer_path(), tokenizer_path("piece_bpe_32k.model")))


def op12_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "quota")


def op13_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jump_sharding": op1_jump_sharding,
        "op2_kneser_ney_quality": op2_kneser_ney_quality,
        "op3_license_compression": op3_license_compression,
        "op4_hyperdimensional_langid": op4_hyperdimensional_langid,
        "op5_hidden_markov_lm": op5_hidden_markov_lm,
        "op6_bpe_segment_tree": op6_bpe_segment_tree,
        "op7_fm_index_decontamination": op7_fm_index_decontamination,
        "op8_warc_revisits": op8_warc_revisits,
        "op9_simhash_pigeonring": op9_simhash_pigeonring,
        "op10_html_block_tree": op10_html_block_tree,
        "op11_token_alignment": op11_token_alignment,
        "op12_sainte_lague_mix": op12_sainte_lague_mix,
        "op13_segment_mean_codes": op13_segment_mean_codes,
        "pipeline": pipeline,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _codes(rounds: int = 2) -> str:
    """Vectors in 16 parts by books of 64 entries; an entry's number and its distance ride in one number, distance * 64 + entry."""
    nearest = "(select r, p, min(64 * list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) as m from parts join book{i} using (p) group by r, p)"
    steps = [
        f"""near{i} as {nearest.format(i=i)},
means{i} as (select p, e, list((s - ((s % n) + n) % n) // n order by j) as c
  from (select p, cast(m % 64 as bigint) as e, j, cast(sum(x[j]) as bigint) as s, count(*) as n from near{i} join parts using (r, p), (select unnest(range(1, (select w from sizes) + 1)) as j) group by all) group by p, e),
book{i + 1} as (select b.p, b.e, coalesce(n.c, b.c) as c from book{i} b left join means{i} n using (p, e))"""
        for i in range(rounds)
    ]
    return f"""
with kept as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
sizes as (select max(len(v)) // 16 as w from kept),
parts as (select r, p, v[p * w + 1:p * w + w] as x from kept, sizes, (select unnest(range(0, 16)) as p)),
book0 as (select p, r - 1 as e, x as c from parts where r <= 64),
{", ".join(steps)},
found as (select r, string_agg(printf('%02x', cast(m % 64 as bigint)), '' order by p) as code, cast(sum(m // 64) as bigint) as error from {nearest.format(i=rounds)} group by r),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join found using (r), digest"""


def _mix(block: int = mixing.BLOCK) -> str:
    hashed = "cast('0x' || substr(md5(concat_ws('/', '0', {})), 1, 15) as bigint)"
    own = hashed.format("coalesce(cast(doc_id as varchar), 'null'), cast(size as varchar), cast(lot as varchar)")
    shard = hashed.format("cast(l.rank as varchar), cast(l.shard as varchar)")
    return f"""
with recursive equal as (select source, doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size, count(*) as copies from documents group by all),
sources as (select source, cast(sum(size * copies) as bigint) as source_size, cast(sum(ceil(copies / {mixing.LOT})) as bigint) as lots, row_number() over (order by source nulls last) - 1 as rank from equal group by source),
ranked as (select *, [5, 2, 1][rank % 3 + 1] as weight from sources),
levels as (select cast(sum(source_size) as hugeint) as s, cast(sum(weight) as hugeint) as w from ranked
  union select (select sum(source_size) from ranked) - coalesce(sum(3 * source_size) filter (over_it), 0), coalesce(sum(weight) filter (not over_it), 0)
    from (select source_size, weight, weight * s > 3 * source_size * w as over_it from ranked, levels) having count(*) > 0),
level as (select s, w from levels order by w, s limit 1),
known as (select *, greatest(cast(round(source_size / {block}) as bigint), 1) as n_blocks,
    cast(least(greatest(ceil(source_size / {mixing.SHARD_WORDS}), ceil(lots / {mixing.SHARD_LOTS}), 1), {mixing.SHARDS}) as bigint) as shards,
    case when weight * s > 3 * source_size * w then cast(3 * source_size as double) else cast(weight * s as double) / cast(w as double) end as target from ranked, level),
seated as (select *, case when source_size > 0 then cast(floor(target / (cast(source_size as double) / n_blocks) + 0.5) as bigint) else 0 end as seats from known),
lots0 as (select *, unnest(range(0, (copies + {mixing.LOT} - 1) // {mixing.LOT})) as lot from equal),
lots as (select l.*, k.* exclude (source, lots), least({mixing.LOT}, copies - lot * {mixing.LOT}) as n, {own} as turn, turn % shards as shard from lots0 l join seated k on l.source is not distinct from k.source),
cells0 as (select rank, shard, cast(sum(size * n) as bigint) as words, first(source_size) as source_size, first(n_blocks) as n_blocks, first(seats) as seats from lots group by all),
cells as (select *, case when words > 0 then greatest(cast(round(cast(words as double) * n_blocks / greatest(source_size, 1)) as bigint), 1) else 0 end as blocks from cells0),
offers as (select rank, shard, seats, row_number() over (partition by rank order by cast(words as double) / (2 * k + 1) desc, shard) as place from (select *, unnest(range(0, 3 * blocks)) as k from cells)),
quotas as (select c.rank, c.shard, c.words, c.blocks, (select count(*) from offers o where o.rank = c.rank and o.shard = c.shard and o.place <= o.seats) as quota from cells c),
laid as (select l.*, q.words, q.blocks, q.quota, {shard} % {mixing.PRIME} as turned,
    sum(size * n) over (partition by l.rank, l.shard order by turn, doc_id nulls first, size, lot rows unbounded preceding) - size * n as start from lots l join quotas q on q.rank = l.rank and q.shard = l.shard),
copies as (select *, row_number() over () as row_id, cast(start + copy * size as bigint) as begin from (select *, unnest(range(0, n)) as copy from laid)),
extra as (select row_id, sum(greatest(least(((k + 1) * words) // blocks, begin + size) - greatest((k * words) // blocks, begin), 0)) as more
  from (select *, unnest(range(greatest(begin * blocks // words - 1, 0), least((begin + size - 1) * blocks // words + 1, blocks - 1) + 1)) as k from copies where size > 0)
  where (k * {mixing.PRIME} + turned) % blocks < quota % blocks group by row_id)
select doc_id, size, source_size, target, cast(case when size > 0 then size * (quota // blocks) + coalesce(more, 0) else 0 end as bigint) as taken, shard, cast(quota as bigint) as quota
from copies left join extra using (row_id)"""


#: The queries that SQL can express; the others are tested against brute force.
ORACLES = {
    "op7_fm_index_decontamination": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as k
  from (select *, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as k
  from (select r, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) as i from d cross join (select distinct n from win))),
hit as (select dw.r, dw.i, dw.n, win.item from dw join win on win.n = dw.n and win.k = dw.k),
places as (select r, cast(count(distinct p) as bigint) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
found as (select r, cast(count(*) as bigint) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hit) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(places.n_hit, 0) as n_hit, coalesce(found.n_items, 0) as n_items,
  sha256(coalesce(found.names, '')) as items_sha256, coalesce(places.n_hit, 0) > 0 as contaminated
from d left join places on places.r = d.r left join found on found.r = d.r""",
    "op8_warc_revisits": """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as m from p group by h),
t as (select p.page_id, p.h, g.m, strlen(p.h) >= 1000 and p.page_id is distinct from g.m as again from p join g on g.h = p.h)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest, case when again then 'revisit' else 'response' end as record_type,
  cast(case when again then m end as bigint) as refers_to from t""",
    "op12_sainte_lague_mix": _mix(),
    "op13_segment_mean_codes": _codes(),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

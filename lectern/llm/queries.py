"""Registered queries opN_<name>: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, kit, language, licences, maintext, mixing, neardup, quality, ranked, sharding, suffixdup, tokencount, tokens, whitening,
)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(kit.read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(kit.read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(kit.read_table(spark, sf_dir, "documents"))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # This tokenizer drops white space and its pieces never cross it.
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.token_report(kit.read_table(spark, sf_dir, "documents"), path, by_word=True)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdup.remove_repeats(kit.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(kit.read_table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(kit.read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = kit.read_table(spark, sf_dir, "documents"), kit.read_table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("item_ids")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(kit.read_table(spark, sf_dir, "pages"))


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(kit.read_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(kit.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(kit.read_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(kit.read_table(spark, sf_dir, "documents"), kit.read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_blocks": op4_token_blocks,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_minhash_near_dups": op6_minhash_near_dups,
    "op7_language_mixture": op7_language_mixture,
    "op8_decontamination": op8_decontamination,
    "op9_main_text": op9_main_text,
    "op10_extendible_shards": op10_extendible_shards,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

OP2_SQL = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           md5(concat_ws('|', '0', doc_id::varchar, md5(coalesce(text, '')))) as key
    from documents
), sources as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
    from sized group by source
), weighed as (
    select *, case place % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end::double as weight, 2.0::double * source_size as cap
    from sources
), ranked as (
    select *, coalesce(sum(cap) over before, 0) as capped, coalesce(sum(weight) over before, 0) as gone,
           1.5::double * sum(source_size) over () as total, sum(weight) over () as weights
    from weighed window before as (order by cap / weight, place rows between unbounded preceding and 1 preceding)
), levels as (
    select *, (total - capped) / (weights - gone) as level from ranked
), chosen as (
    select arg_min(level, cap / weight) as level from levels where level * weight <= cap
), aims as (
    select source, source_size, least(cap, chosen.level * weight) as target from levels, chosen
), summed as (
    select s.*, a.source_size, a.target, floor(a.target + 0.5)::bigint as quota,
           coalesce(sum(size) over (partition by s.source order by key rows between unbounded preceding and 1 preceding), 0) as before
    from sized s join aims a on s.source is not distinct from a.source
)
select doc_id, size::bigint as size, source_size, target,
       (case when size = 0 then 0 else (quota // source_size) * size
        + least(size, greatest(0, quota % source_size - before)) end)::bigint as taken, source
from summed
"""

OP3_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, coalesce(text, '') as text from documents
), each as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words where len(w) > 0
), lines as (
    select doc_id, line, place from (
        select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from words)
    where regexp_matches(line, '[^\x20\x09-\x0D]')
), later_lines as (
    select doc_id, line from (select *, row_number() over (partition by doc_id, line order by place) as nth from lines) where nth > 1
), line_measures as (
    select doc_id, count(*) as n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) as dup_line_chars
    from later_lines group by doc_id
), grams as (
    select doc_id, n, i, hash(w[i:i + n - 1]) as gram
    from (select doc_id, w, unnest(range(5, 11)) as n from words where len(w) >= 5),
         lateral (select unnest(range(1, len(w) - n + 2)) as i)
), ranked as (
    select *, row_number() over (partition by doc_id, n, gram order by i) as nth, count(*) over (partition by doc_id, n, gram) as times
    from grams
), covered as (
    select distinct doc_id, n, nth > 1 as later, i + unnest(range(n)) as i from ranked where times > 1
), chars as (
    select doc_id, n, sum(length(word)) as c from covered join each using (doc_id, i) where later group by all
), coverage as (
    select doc_id, coalesce(sum(c) filter (n = 5), 0) as dup_chars_5, coalesce(sum(c) filter (n = 6), 0) as dup_chars_6,
           coalesce(sum(c) filter (n = 7), 0) as dup_chars_7, coalesce(sum(c) filter (n = 8), 0) as dup_chars_8,
           coalesce(sum(c) filter (n = 9), 0) as dup_chars_9, coalesce(sum(c) filter (n = 10), 0) as dup_chars_10
    from chars group by doc_id
), repeats as (
    select doc_id, count(distinct i) as n_repeat_words from covered where n = 8 group by doc_id
), measured as (
    select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
           coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
           coalesce(dup_line_chars, 0)::bigint as dup_line_chars, coalesce(dup_chars_5, 0)::bigint as dup_chars_5,
           coalesce(dup_chars_6, 0)::bigint as dup_chars_6, coalesce(dup_chars_7, 0)::bigint as dup_chars_7,
           coalesce(dup_chars_8, 0)::bigint as dup_chars_8, coalesce(dup_chars_9, 0)::bigint as dup_chars_9,
           coalesce(dup_chars_10, 0)::bigint as dup_chars_10
    from words left join line_measures using (doc_id) left join coverage using (doc_id) left join repeats using (doc_id)
), judged as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured
)
select *, not base_failed and 100 * dup_line_chars <= 20 * word_chars and 100 * dup_chars_5 <= 15 * word_chars
    and 100 * dup_chars_6 <= 14 * word_chars and 100 * dup_chars_7 <= 13 * word_chars and 100 * dup_chars_8 <= 12 * word_chars
    and 100 * dup_chars_9 <= 11 * word_chars and 100 * dup_chars_10 <= 10 * word_chars as kept
from judged
"""

OP8_SQL = r"""
with items as (
    select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
    select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as gram
    from items, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) as i) where len(w) > 0
), docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), grams as (
    select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
    from docs, (select distinct n from windows) sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i)
), hits as (
    select doc_id, g.n, i, item_id from grams g join windows x on g.gram = x.gram and g.n = x.n
), hit_words as (
    select doc_id, count(distinct k) as n_hit from (select doc_id, i + unnest(range(n)) as k from hits) group by doc_id
), hit_items as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct doc_id, item_id from hits where item_id is not null) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

OP10_SQL = r"""
with keyed as (
    select doc_id, strlen(coalesce(text, ''))::bigint as bytes,
           lpad(bin(('0x' || substr(md5(concat_ws('|', doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint), 60, '0') as bits
    from documents
), prefixes as (
    select doc_id, bytes, bits, d, substr(bits, 1, d) as prefix from keyed, (select unnest(range(0, 61))::int as d)
), sums as (
    select prefix, sum(bytes)::bigint as size, count(*) as docs from prefixes group by prefix
), fits as (
    select doc_id, bits, bytes, arg_min(prefix, d) as shard, min(d) as depth, arg_min(size, d) as shard_bytes
    from prefixes join sums using (prefix) where size <= 1048576 or docs = 1 group by all
)
select doc_id, shard, depth, bytes, shard_bytes, shard_bytes > 1048576 as oversized from fits
"""

OP13_SQL = r"""
with docs as (
    select doc_id, row_number() over () as nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), items as (
    select item_id, row_number() over () as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark
), totals as (
    select count(*)::bigint as n_docs, sum(len(w))::bigint as n_terms from docs where len(w) > 0
), asked as (
    select item, term, count(*)::bigint as times from (select item, unnest(w) as term from items) group by item, term
), postings as (
    select nr, term, count(*)::bigint as tf from (select nr, unnest(w) as term from docs) group by nr, term
), weighed as (
    select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from postings, totals group by term, n_docs
), lengths as (
    select nr, doc_id, 25 + (75 * len(w)::bigint * n_docs) // n_terms as m from docs, totals where len(w) > 0
), scored as (
    select item, nr, doc_id, sum(times * weighed.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from asked join postings using (term) join weighed using (term) join lengths using (nr) group by item, nr, doc_id
), ranked as (
    select item_id, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank, doc_id, score
    from scored join items using (item) where score > 0
)
select * from ranked where rank <= 10
"""

SQL: dict[str, str] = {
    "op2_mix_sources": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_extendible_shards": OP10_SQL,
    "op13_ranked_search": OP13_SQL,
}

"""Queries of the training-data operators with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bitpack, bytelevel, chat, fingerprints, lexical, mixing, near_dedup, neighbours, packing, phrases, substring_dedup, token_counts, toxicity
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = bitpack.write_blocks(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return bitpack.read_documents(blocks)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytelevel.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts_of(token_counts.write_prefixes(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), limit=512)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    formatted = chat.write_formatted(turns.unionByName(extra))
    rows = chat.write_examples(formatted)
    lengths = chat.context_chars(chat.write_contexts(formatted, rows)).withColumnRenamed("conv_id", "conv")
    made = chat.digests(formatted, rows)
    return made.join(lengths, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv").fillna(0, ["context_chars"])


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_fingerprints": op2_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_chat_format": op8_chat_format,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op11_mixing": r"""with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
  cast(cast('0x' || substr(md5(coalesce(text, '')), 1, 13) as bigint) as varchar) as digest from documents),
per_source as (select source, cast(sum(size) as bigint) as words, row_number() over (order by source is null, encode(source)) as t from sized group by source),
weighed as (select *, case t % 3 when 1 then 3 when 2 then 1 else 2 end as weight, 2 * words as cap from per_source),
-- with sources ordered by cap over weight, those above their limit come first
laid as (select *, 3 * sum(words) over () - 2 * coalesce(sum(cap) over w, 0) as num, 2 * sum(weight) over (order by cap * 1.0 / weight, t rows between current row and unbounded following) as den
  from weighed window w as (order by cap * 1.0 / weight, t rows between unbounded preceding and 1 preceding)),
level as (select min_by(num, (cap * 1.0 / weight, t)) as num, min_by(den, (cap * 1.0 / weight, t)) as den from laid where not cap * den < weight * num),
aims as (select source, words, t, case when level.num is null or cap * level.den < weight * level.num then cast(cap as double) else cast(weight * level.num as double) / level.den end as target from weighed left join level on true),
parts as (select *, case when words > 0 then cast(floor(target) as bigint) // words else 0 end as epochs from aims),
keyed as (select s.doc_id, s.size, a.t, a.words, a.target, cast(a.epochs as bigint) as epochs, cast(floor(target) as bigint) - cast(a.epochs as bigint) * words as rest,
  md5(concat_ws('|', '11', cast(cast(a.epochs as bigint) as varchar), coalesce(cast(doc_id as varchar), ''), digest)) as key from sized s join parts a on a.source is not distinct from s.source),
summed as (select *, sum(size) over (partition by t order by substr(key, 1, 13), doc_id nulls first, size rows between unbounded preceding and current row) - size as before from keyed)
select doc_id, cast(size as bigint) as size, words as source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken from summed""",
    "op12_ranked_search": r"""with found as (select doc_id, row_number() over () as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
sizes as (select d, any_value(doc_id) as doc_id, cast(count(*) as bigint) as n from found group by d),
corpus as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as words from sizes),
tfs as (select d, term, cast(count(*) as bigint) as tf from found group by d, term),
dfs as (select term, cast(count(*) as bigint) as df from tfs group by term),
asked as (select distinct q, item_id, term from (select row_number() over () as q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)),
weighed as (select a.*, cast(floor(1000 * ln((2 * docs + 2) * 1.0e0 / (2 * df + 1))) as bigint) as w from asked a join dfs f on f.term = a.term, corpus),
scored as (select q, item_id, s.doc_id, s.d, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) as bigint) as score from weighed a join tfs t on t.term = a.term join sizes s on s.d = t.d, corpus group by q, item_id, s.doc_id, s.d),
placed as (select *, cast(row_number() over (partition by q order by score desc, doc_id nulls first) as int) as rank from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 10""",
    "op13_collocations": r"""with pieces as (select d, doc_id, lang, i, unnest(p) as piece, generate_subscripts(p, 1) as j from (select row_number() over () as d, doc_id, coalesce(lang, 'und') as lang, 0 as i, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents)),
listed as (select lang, doc_id, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
spread as (select lang, doc_id, words, unnest(range(1, len(words) + 1)) as i from listed where len(words) > 0),
grams as (select lang, doc_id, k, array_to_string(words[i : i + k - 1], ' ') as phrase from spread, range(1, 4) r(k) where i + k - 1 <= len(words)),
f as (select lang, k, phrase, cast(count(*) as bigint) as n, min(doc_id) as first_doc from grams group by lang, k, phrase having count(*) >= 10),
totals as (select lang, cast(sum(len(words)) as bigint) as n from listed group by lang),
cuts as (select lang, k, phrase, n as a, first_doc, c, array_to_string(w[1 : c], ' ') as lefts, array_to_string(w[c + 1 :], ' ') as rights from (select *, string_split(phrase, ' ') as w from f where k > 1), range(1, 3) s(c) where c < k),
scored as (select cuts.*, x.n as l, y.n as r, cast((cast(a as hugeint) * a * 1000000) // (cast(x.n as hugeint) * y.n) as bigint) as score from cuts join f x on x.lang = cuts.lang and x.phrase = lefts join f y on y.lang = cuts.lang and y.phrase = rights),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (select lang, phrase, max(n) as n from (select lang, n, array_to_string(string_split(phrase, ' ')[1:2], ' ') as phrase from f where k = 3 union all select lang, n, array_to_string(string_split(phrase, ' ')[2:3], ' ') from f where k = 3) group by lang, phrase),
kept as (select b.* from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where g.n is null or 100 * g.n < 50 * b.a),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select p.lang, cast(rank as bigint) as rank, phrase, a, l, r, t.n, score, first_doc from placed p join totals t on t.lang = p.lang where rank <= 2000""",
}

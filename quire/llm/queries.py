"""Queries of the corpus operators over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, language, mixing, personal, preference, sharding, spelling, substring, token_counts, topk, trie, url_filter, url_rules
from quire.llm.work import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.RULES)
    given = F.when(F.col("rule_rank") == 2, F.col("rule"))
    return judged.select("page_id", "host", "path", given.alias("rule"), "verdict", F.when(F.col("rule_rank") == 1, F.col("rule")).alias("pattern"))


ORACLE["op2_url_filter"] = f"{url_rules.JUDGED_SQL} select page_id, host, path, given as rule, {url_rules.VERDICT_SQL}, case when given is null then own end as pattern from r"


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE["op3_exact_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score from (select distinct * from v where vec_id % 20 = 0) q join v d on d.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", "replica", "n_replicas", "order_key", "text")


ORACLE["op4_source_mixing"] = """
with recursive n as (select source, count(*) n_docs from documents group by source
), r as (select source, sum(n_docs) over () * (pow(n_docs, 0.5) / sum(pow(n_docs, 0.5)) over ()) / n_docs as rate from n
), parts as (select source, greatest(1, ceil(rate / 32.0))::int m, rate / greatest(1, ceil(rate / 32.0)) as l from r
), cdf(source, k, p, c) as (
  select source, 0, exp(-l), exp(-l) from parts
  union all select cdf.source, k + 1, p * l / (k + 1), c + p * l / (k + 1) from cdf join parts using (source) where k < 120
), d as materialized (select doc_id, source, text, md5(doc_id || ':' || md5(coalesce(text, '')) || '::1') as draw from documents
), u as (select d.*, j.j, ('0x' || substr(md5('17:' || draw || ':' || j.j), 1, 13))::bigint / 4503599627370496.0 as u
  from d join parts on d.source is not distinct from parts.source, lateral (select unnest(range(1, m + 1)) j) j
), c as (select doc_id, source, draw, any_value(text) as text, sum((select count(*) from cdf where cdf.source is not distinct from u.source and c <= u.u)) as n from u group by doc_id, source, draw)
select doc_id, source, r.r::int as replica, n::int as n_replicas,
  ('0x' || substr(md5('order17:' || draw || ':' || r.r), 1, 15))::bigint as order_key, text
from c, lateral (select unnest(range(1, n::bigint + 1)) r) r
"""


#: A file of a public tokenizer that every executor has.
TOKENIZER = "byte_bpe_50k.json"


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op6_substring_dedup"] = r"""
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (select doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) as h from w, lateral (select unnest(range(1, len(w) - 33)) i) where len(w) >= 35
), twice as (select h from s group by h having count(*) > 1
), gone as (select distinct doc_id, i + k as p from s join twice using (h), (select unnest(range(0, 35)) k)
), words as (select doc_id, w, p from (select doc_id, w, unnest(range(1, len(w) + 1)) p from w)
), kept as (select words.doc_id, p, w[p] as word from words left join gone using (doc_id, p) where gone.doc_id is null
), joined as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) n from kept group by doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join joined using (doc_id)
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language.fit(language.sample(docs))
    named = language.identify(docs.select("doc_id", "text"), field)
    return named.select("doc_id", F.coalesce(~language.may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.pairs_of(table(spark, sf_dir, "conversations"))
    runs = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["length"].cast("string"), F.when(r["train"], "+").otherwise("-"))), "")
    formatted = preference.format_preferences(pairs)
    return formatted.withColumns({c: runs(c) for c in ("chosen_mask", "rejected_mask")})


ORACLE["op8_preference_format"] = """
with w as (select conv_id, list({'role': role, 'text': text} order by turn, role, text) t from conversations where conv_id is not null group by conv_id
), c as (select conv_id, t[1:list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant'))] as c from w where len(list_filter(t, lambda x: x.role = 'assistant')) > 0
), p as (select a.conv_id, a.c, case when b.c is null then a.c[1:len(a.c) - 1] else list_concat(a.c[1:len(a.c) - 1], [b.c[-1]]) end as r
  from c a left join c b on b.conv_id = (case when a.conv_id % 2 = 0 then a.conv_id + 1 else a.conv_id - 1 end)
), n as (select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] is distinct from r[i])) - 1, least(len(c), len(r))) as n from p)
select conv_id, n::int as n_prompt_turns,
  list_aggregate(list_concat(['']::varchar[], list_transform(c[1:n], lambda x: '<|turn|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10))), 'string_agg', '') as prompt,
  list_aggregate(list_concat(['']::varchar[], list_transform(c[n + 1:], lambda x: '<|turn|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10))), 'string_agg', '') as chosen,
  list_aggregate(list_concat(['']::varchar[], list_transform(c[n + 1:], lambda x: (len(x.role) + 9) || '-' || (len(x.text) + 8) || case when x.role = 'assistant' then '+' else '-' end)), 'string_agg', '') as chosen_mask,
  list_aggregate(list_concat(['']::varchar[], list_transform(r[n + 1:], lambda x: '<|turn|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10))), 'string_agg', '') as rejected,
  list_aggregate(list_concat(['']::varchar[], list_transform(r[n + 1:], lambda x: (len(x.role) + 9) || '-' || (len(x.text) + 8) || case when x.role = 'assistant' then '+' else '-' end)), 'string_agg', '') as rejected_mask
from n
"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


ORACLE["op9_jaccard_join"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (
  select distinct doc_id, hash(array_to_string(w[i:i + 3], ' ')) as h from w, lateral (select unnest(range(1, len(w) - 2)) i) where len(w) >= 4
  union all select doc_id, hash(array_to_string(w, ' ')) from w where len(w) between 1 and 3
), n as materialized (select doc_id, count(*) as n from s group by doc_id
), pairs as materialized (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by x, y
), links as materialized (select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)
), reach(doc_id, root) as (select doc_id, doc_id from documents union select reach.doc_id, links.y from reach join links on links.x = reach.root)
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(root) as component_id from reach left join n using (doc_id) group by doc_id
"""


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_corpus(table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    return sharded.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "shard", "shard_rows", "shard_bytes", "shard_since")


@query
def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


#: crc32 in SQL: the bytes of a text as eight steps each, folded over the reversed polynomial.
CRC32 = """xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(range(1, octet_length(encode({0})) + 1),
    lambda i: [('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::ubigint)"""

ORACLE["op13_spelling_groups"] = (
    r"""
with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), d as (select doc_id, run, count(*) as k from runs where length(run) >= 5 group by doc_id, run
), h as (select run, k, """
    + CRC32.format("coalesce(doc_id::varchar, '') || ':' || run")
    + r""" as h from d
), w as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, k from h
), v as materialized (select word, sum(k)::bigint as n from w where length(word) >= 5 group by word having sum(k) >= 3
), cuts as materialized (select distinct word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from v, lateral (select unnest(range(1, length(word) + 1)) i)
), near as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from (select distinct word, cut from cuts) a join v b on a.cut = b.word
  union select b.word, a.word, a.n from (select distinct word, n, cut from cuts) a join v b on a.cut = b.word
), best as (select word, count(*) as n_near, first(near order by near_n desc, near collate "binary") as near, max(near_n) as near_n from near group by word
), f as (select v.word, n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n from v left join best using (word)
), climb as (select word, word as at from f union select climb.word, f.form from climb join f on climb.at = f.word where f.form is not null
), r as (select climb.word, climb.at as root from climb join f on climb.at = f.word where f.form is null)
select word, form, root, n, n_near, form_n from f join r using (word)
"""
)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_openings(trie.turn_rows(table(spark, sf_dir, "conversations"))))


ORACLE["op12_prefix_trie"] = (
    r"""
with t as (select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words, turn from conversations where conv_id is not null
), o as materialized (select conv_id, x, words, row_number() over (partition by conv_id order by turn nulls first, x) as pos from t
), c as materialized (select conv_id, conv_id - conv_id % 20 as lender, """
    + CRC32.format("conv_id::varchar")
    + r""" % 4 as h from (select distinct conv_id from o)
), r as (
  select c.conv_id, 0 as part, o.pos, x, words from c join o on o.conv_id = c.lender and o.pos <= c.h
  union all select c.conv_id, 1, o.pos, x, words from c join o on o.conv_id = c.conv_id and o.pos > c.h
), n as (select *, row_number() over (partition by conv_id order by part, pos) as depth from r
), m as materialized (
  select conv_id, depth, md5(string_agg(x, '') over (partition by conv_id order by depth)) as node, words from n
  union all select conv_id, 0, 'root', 0 from c
), up as (select m.*, lag(node) over (partition by conv_id order by depth) as above, lead(node) over (partition by conv_id order by depth) as below from m
), nodes as materialized (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, count(distinct below) as n_children, any_value(above) as above, any_value(words) as words,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (below is null), '') as ends from up group by node, depth
), sums as (select a.node, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.words) as saved from nodes b join m a on a.conv_id = b.conv_id and a.depth <= b.depth group by a.node)
select a.conv_id, a.depth::bigint as depth, p.conv_id as parent_conv_id, a.n_convs::bigint as n_convs, a.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(a.ends) as ends_sha256
from nodes a join sums using (node) left join nodes p on p.node = a.above
"""
)


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal.detect(docs, personal.fit(docs)).drop("text")

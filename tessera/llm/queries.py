"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib
import re

from tessera.llm.common import table

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op9_histogram_topk"] = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(embedding) = 64),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 5"""


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Targets of the mixture: integer weights among siblings; "*" is for names that are not listed.
MIXTURE = {"domain": {"*": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1, "*": 1}, "source": {"*": 1}}


def _fill_sql(name: str, source: str, parents: str, key: str) -> str:
    """CTEs that deal each parent's budget to its children (cap, w, budget), as mixing._fill does."""
    by = f"partition by {parents}" if parents else ""
    order = f"{by} order by cap / w, {key}"
    return f"""{name}1 as (select *, row_number() over ({order}) rn, budget - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0) brem, sum(w) over ({order} rows between current row and unbounded following) wrem from {source}),
{name}2 as (select *, min(case when cap::hugeint * wrem > w::hugeint * brem then rn end) over ({by}) f from {name}1),
{name}3 as (select * exclude (brem, wrem), (f is null or rn < f) ok, max(case when rn = f then brem end) over ({by}) b, max(case when rn = f then wrem end) over ({by}) t from {name}2),
{name}4 as (select *, case when ok then cap else (w::hugeint * b) // t end s, row_number() over (partition by {parents + "," if parents else ""} ok order by {key}) turn from {name}3),
{name} as (select * exclude (s), (s + case when not ok and turn <= b - sum(case when not ok then s end) over ({by}) then 1 else 0 end)::bigint as share from {name}4)"""


def _mixture_sql() -> str:
    lang = "case kl " + " ".join(f"when '+{k}' then {v}" for k, v in MIXTURE["lang"].items() if k != "*") + " else 1 end"
    return f"""with k as (select doc_id, lang, source, '+' || case when source is null then 'none' else 'd' || left(md5(source), 1) end kd, coalesce('+' || lang, '-') kl, coalesce('+' || source, '-') ks,
 coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) n from documents),
leaf as (select kd, kl, ks, sum(n)::bigint tokens, (sum(n) * 4)::bigint cap from k group by all),
top as (select kd, sum(cap)::bigint cap, 1 w, (select least(sum(tokens) * 3 // 5, sum(cap))::bigint from leaf) budget from leaf group by kd), {_fill_sql("d", "top", "", "kd")},
mid as (select kd, kl, sum(leaf.cap)::bigint cap, {lang} w, any_value(share) budget from leaf join d using (kd) group by kd, kl), {_fill_sql("l", "mid", "kd", "kl")},
low as (select kd, kl, ks, tokens, leaf.cap, 1 w, share budget from leaf join l using (kd, kl)), {_fill_sql("s", "low", "kd, kl", "ks")},
p as (select kd, kl, ks, share // tokens as whole, share % tokens rest from s where share > 0 and tokens > 0),
h as (select k.*, whole, rest, md5('11|' || whole || '|' || coalesce(doc_id::varchar, 'null')) h from k join p using (kd, kl, ks)),
c as (select *, sum(n) over (partition by kd, kl, ks order by h) upto from h), m as (select *, max(case when rest > 0 and upto <= rest then h end) over (partition by kd, kl, ks) last from c)
select doc_id, substr(kd, 2) as domain, lang, source, n as n_tokens, unnest(range(whole + case when h <= last then 1 else 0 end))::integer as epoch from m"""


def op1_mixture(spark, sf_dir):
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), MIXTURE).selectExpr("doc_id", "substr(k_domain, 2) domain", "lang", "source", "n_tokens", "epoch")


def op3_secrets(spark, sf_dir):
    from tessera.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_simple8b(spark, sf_dir):
    from tessera.llm.tokenstore import token_store

    return token_store(table(spark, sf_dir, "documents"), _vocabulary(), end_id=2)


def op4_interleave(spark, sf_dir):
    from tessera.llm.sharding import interleave

    return interleave(table(spark, sf_dir, "documents"), n_shards=16, seed=7).drop("source")


def op5_reply_trees(spark, sf_dir):
    from tessera.llm.chat import conversations, digests, formatted, linear

    schema = "conv_id long, turn long, role string, text string"
    probe = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], schema)
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return digests(formatted(conversations(linear(turns.unionByName(probe)))))


def op6_ngram_trie(spark, sf_dir):
    from tessera.llm.ngrams import encode, score, train

    docs = encode(table(spark, sf_dir, "documents"))
    return score(docs, train(docs, order=3))


def op7_spaced_seeds(spark, sf_dir):
    from tessera.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxic_crf(spark, sf_dir):
    from tessera.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_histogram_topk(spark, sf_dir):
    from tessera.llm.topk import histogram_topk

    return histogram_topk(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op10_simhash(spark, sf_dir):
    from tessera.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), radius=2, size=3)


def pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def _reply_sql() -> str:
    from tessera.llm.chat import CLOSE, CONTROLS, ESCAPE, OPEN, SEP

    pattern = "|".join(re.escape(c) for c in (ESCAPE, *CONTROLS))
    size = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{pattern}'))"
    return f"""with t as (select conv_id::bigint c, turn::bigint n, role r, text x from conversations
 union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o as (select c, row_number() over (partition by c order by n nulls first, r nulls first, x nulls first) i, coalesce(r, '') r, coalesce(x, '') x from t)
select c as conv_id, count(*)::bigint as n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by i)) as turns_sha256,
 coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(x, '' order by i) filter (r = 'assistant'), '')) as loss_sha256,
 sum({len(OPEN) + len(SEP) + len(CLOSE)} + {size("r")} + {size("x")})::bigint as formatted_chars from o group by c"""


ORACLE_SQL["op1_mixture"] = _mixture_sql()
ORACLE_SQL["op5_reply_trees"] = _reply_sql()
QUERIES = {f.__name__: f for f in (op1_mixture, op2_simple8b, op3_secrets, op4_interleave, op5_reply_trees, op6_ngram_trie, op7_spaced_seeds, op8_toxic_crf, op9_histogram_topk, op10_simhash, pipeline)}

"""The queries of the numbered operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, language_id, language_model, license_scan, mixing, periodic_runs, quality, simhash, spotsigs, topk_search, unigram, url_filter
from .common import crc_mod, read

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def pieces(spark: SparkSession) -> str:
    """The place of the vocabulary file: the setting ``spark.pairlens.pieces``, else that of the public package, if there is one."""
    if at := spark.conf.get("spark.pairlens.pieces", None):
        return at
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model") if importlib.util.find_spec("public_tokenizers") else PIECES


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return topk_search.top_k(asked, vectors, k=5, scale=256.0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.default_templates(spark)).unionByName(license_scan.scan_short(docs, license_scan.short_templates(spark)))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.parse(chat_format.render(chat_format.canonical_turns(chat_format.gather(rows), roles={})))
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "schema_id", "layout",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), may_learn=crc_mod("doc_id", 4) != 2)
    out = quality.scores(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = unigram.encode(docs, pieces(spark), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("decoded_chars"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_edits(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs, may_learn=crc_mod("doc_id", 3) != 1)
    return language_id.identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find(periodic_runs.stuttered(read(spark, sf_dir, "documents").select("doc_id", "text")))
    out = out.withColumn("longest", periodic_runs.longest())
    start, length, period = -F.col("longest.back"), F.col("longest.length"), -F.col("longest.short")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * longest.length div -longest.short").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 1
    out = language_model.score(docs, *language_model.train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_license_scan, op3_chat_format, op4_quality, op5_simhash, op6_mixing, op7_sentencepiece, op8_spotsigs, op9_url_filter, op10_language_id, op11_periodic_runs, op12_lm_scoring, op13_collocations)}

_LAYOUTS = {m["name"]: chat_format.fingerprint(m["paths"]) for m in chat_format.MAPPINGS}
#: What the template escapes, for an engine without look-ahead: whole control strings, none of which holds the start of another.
_CONTROL = r"<\||</?s>|<</?SYS>>|</?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>|\[/?INST\]|\[/?(?:SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\]"
_ESCAPED = lambda c: f"length({c}) + length({c}) - length(replace({c}, chr(92), '')) + len(regexp_extract_all({c}, '{_CONTROL}'))"

#: op1, op3 and op13 are all SQL; the others train, hash by XXH64, or cut by a vocabulary, and are tested against brute force.
ORACLES = {
    "op1_topk_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
                   from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
             r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op3_chat_format": f"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
             c as (select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text)) as turns_sha256,
                       coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss, list(role order by turn nulls first, role, text) as roles,
                       list(text order by turn nulls first, role, text) as texts,
                       sum(length('<|turn|><|text|><|end|>') + {_ESCAPED("role")} + {_ESCAPED("text")}) as formatted_chars from t group by conv_id),
             l as (select *, case when roles = ['user', 'assistant'] then 'prompt_response' when roles = ['system', 'user', 'assistant'] and texts[1] <> '' then 'system_prompt'
                       when roles[1] not in ('user', 'system') then 'conversations' else 'messages' end as layout from c)
        select conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars,
               case layout {" ".join(f"when '{n}' then '{h}'" for n, h in _LAYOUTS.items())} end as schema_id, layout from l""",
    "op13_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
             w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
             i as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
             f as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k as m, count(*) as f from i cross join (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w) group by all),
             n as (select lang, cast(sum(f) as bigint) as n from f where m = 1 group by 1),
             c as (select lang, phrase, string_split(phrase, ' ') as w, m, f as a from f where m > 1 and f >= 100),
             cut as (select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, n.n, cast((1000::hugeint * c.a * n.n) // (l.f::hugeint * r.f) as bigint) as score
                     from (select *, unnest(range(1, m)) as k from c) c join n using (lang) join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
             best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
             free as (select * from best b where not exists (select 1 from c where c.lang = b.lang and c.phrase <> b.phrase and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and 100 * c.a >= 100 * b.a))
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from free qualify rank <= 2000""",
}

"""One query per operator over the whole table ``documents``, with DuckDB text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm import bpe, conversation_trie, exact_dedup, fingerprints, licenses, line_dedup, merkle, mixing
from sitegraph.llm import oracles, quality, sharding, simhash_dedup, substrings, token_files
from sitegraph.llm.common import LOWER, UPPER, text_of
from sitegraph.llm.tokens import default_tokenizer
from sitegraph.sources.tables import read_table

MIN_DOCS = 10  # documents in which a line is dropped everywhere
SHARDS = 40
REPEATS = 3
SHINGLE, RADIUS = 3, 3
WINDOW = 35  # words


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.line_dedup(docs, min_docs=MIN_DOCS).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), F.array("source"), mixing.word_count(text_of()), F.col("doc_id"), REPEATS,
                       carry={"doc_id": F.col("doc_id")})
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(documents(spark, sf_dir), shingle=SHINGLE, radius=RADIUS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_decode(documents(spark, sf_dir), default_tokenizer()))


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(documents(spark, sf_dir), default_tokenizer())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(documents(spark, sf_dir), tampered={"text": F.translate("text", UPPER, LOWER)},
                           tamper_where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), "verified")


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(documents(spark, sf_dir), WINDOW, finish=lambda kept: F.sha2(kept, 256)).select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_exact_dedup, op3_line_dedup, op4_sharding, op5_license_scan, op6_mixing, op7_simhash_dedup,
    op8_bpe, op9_token_files, op10_quality, op11_merkle, op12_substrings, op13_conversation_trie, pipeline)}

BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _canonical_sql(c: str) -> str:
    c = f"regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), '{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
    c = f"trim(regexp_replace({c}, '{licenses.PUNCTUATION}', ' ', 'g'), ' ')"
    for other, usual in licenses.SPELLINGS:
        c = f"replace({c}, '{other}', '{usual}')"
    return c


_KNOWN_SQL = ", ".join(f"('{name}', '{text}')" for name, text in licenses.NOTICES)

ORACLES = {
    "op2_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') t from documents),
        n as (select doc_id, t, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') norm from d),
        k as (select *, first_value(doc_id) over (partition by norm order by length(t) desc, doc_id nulls last) keep_id,
                     count(*) over (partition by norm) group_size from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k""",
    "op3_line_dedup": f"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
        l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos from d),
        k as (select *, translate(trim(line, {BLANK_SQL}), '{UPPER}', '{LOWER}') key from l),
        f as (select key from k where key <> '' group by key having count(distinct doc_id) >= {MIN_DOCS}),
        m as (select k.*, f.key is not null gone from k left join f on k.key = f.key)
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op5_license_scan": f"""
        with d as (select doc_id, coalesce(text, '') t from documents),
        known as (select license, {_canonical_sql('text')} c from (values {_KNOWN_SQL}) v(license, text)),
        l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos
              from (select doc_id, string_split(t, chr(10)) ls from d)),
        h as (select doc_id, string_agg(distinct license, ',' order by license) line_licenses,
                     count(distinct pos) n_license_lines
              from (select doc_id, pos, {_canonical_sql('line')} c from l) x join known on x.c = known.c and x.c <> ''
              group by doc_id),
        w as (select doc_id, {_canonical_sql('t')} c from d),
        g as (select c, string_agg(license, ',' order by license) text_license from known where c <> '' group by c)
        select w.doc_id, sha256(w.c) as text_digest, text_license, line_licenses,
               coalesce(n_license_lines, 0) as n_license_lines
        from w left join h on w.doc_id = h.doc_id left join g on w.c = g.c""",
    "op11_merkle": oracles.merkle_sql(),
    "op12_substrings": oracles.substring_sql(WINDOW),
    "op13_conversation_trie": oracles.trie_sql(),
}

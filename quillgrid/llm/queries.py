"""The registered queries of the subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import (
    chat,
    fm_dedup,
    forced_bpe,
    norm_search,
    rlbwt_dedup,
    run_automaton,
    sharding,
    simhash_pivots,
    suffix_decontam,
    token_alignment,
    toxic_crf,
    warc_zip,
    weak_quality,
)
from quillgrid.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24
TOKENIZER = "word_bpe_49k.json"
QUERY_EVERY = 50


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


# The control text of the contract, as one more conversation.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query(
    "op2_chat",
    rf"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
    ), e AS (
        SELECT *, length(regexp_replace(
                      replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
                  + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars
        FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
               AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))
               AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id""",
)
def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
        "conv_id long, turn long, role string, text string",
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    segments = chat.format_conversations(
        turns.unionByName(control), "conv_id", "turn", "role", chat.text_parts(F.col("text"))
    )
    return chat.conversation_digests(segments, "conv_id", "turn")


@query("op4_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = forced_bpe.encode_texts(
        read(spark, sf_dir, "documents"), "text", public_tokenizers.path(TOKENIZER),
        keep=["doc_id"], ids=False, digests=True,
    )
    return encoded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    "op5_top_products",
    f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.top_products(
        read(spark, sf_dir, "embeddings"), "vec_id",
        norm_search.quantised(F.col("embedding")), F.col("vec_id") % QUERY_EVERY == 0, k=5,
    )


@query("op10_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(
        read(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_bits=3
    )
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = (
    "regexp_extract_all(" + LOWERED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op9_decontamination",
    f"""
    WITH w AS (
        SELECT doc_id, {ITEM_WORDS} AS words FROM documents
    ), b AS (
        SELECT item_id, {ITEM_WORDS} AS words FROM benchmark
    ), t AS (
        SELECT DISTINCT item_id, least(len(words), 13) AS size,
               array_to_string(words[i:i + 12], ' ') AS win
        FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 12))) AS i FROM b WHERE len(words) > 0)
    ), n AS (SELECT DISTINCT size FROM t
    ), k AS (
        SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
        FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM w, n)
    ), h AS (
        SELECT doc_id, i, size, item_id FROM k JOIN t USING (win, size)
    ), c AS (
        SELECT doc_id, count(DISTINCT j) AS hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM h) GROUP BY doc_id
    ), l AS (
        SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
    )
    SELECT w.doc_id, len(words) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(words) AS contaminated
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
        "text", "item_id", "text", window=13, one_in=20, keep=["doc_id"],
    )
    return found.select(
        "row.doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query(
    "op3_substring_dedup",
    r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), j AS (
        SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w
    ), k AS (
        SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w)
    ), m AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM k
    ), g AS (
        SELECT j.doc_id, j, word, coalesce(bool_or(again) OVER (
                   PARTITION BY j.doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
        FROM j LEFT JOIN m ON m.doc_id = j.doc_id AND m.i = j.j
    ), s AS (
        SELECT doc_id, count(*) FILTER (gone) AS lost,
               string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id
    )
    SELECT w.doc_id, len(words) AS n_words, coalesce(lost, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN s ON s.doc_id = w.doc_id""",
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_dedup.remove_repeated_words(
        read(spark, sf_dir, "documents"), "doc_id", "text", window=20, keep=["doc_id"]
    )
    return found.select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query("op8_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlbwt_dedup.remove_repeated_bytes(
        read(spark, sf_dir, "documents"), "doc_id", "text", window=400, keep=["doc_id"]
    )
    return found.select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_quality.quality(read(spark, sf_dir, "documents"), "text", keep=["doc_id"])
    return found.select("row.doc_id", "votes", "posterior", "score", "accepted")


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxic_crf.toxicity(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
        "doc_id", "text", "toxic", ~held_out("doc_id"), keep=["doc_id"],
    )
    return found.select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query(
    "op11_warc",
    f"""
    WITH d AS (
        SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
    SELECT page_id, n::BIGINT AS payload_bytes,
           array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{BASE32}',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '')
               AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f""",
)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    packages = warc_zip.write_packages(pages, "page_id", "url", "html", work_folder(spark, "warc"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return warc_zip.read_packages(packages).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


WORD = r"[^\x20\x09-\x0D]+"
# The CRC-32 of a text, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({0})),
    lambda k: ord(substr({0}, k + 1, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""


@query(
    "op12_runs",
    f"""
    WITH t AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
               {CRC32.format("doc_id::VARCHAR")} AS h FROM documents
    ), a AS (
        SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a, h // 10 AS g FROM t
    ), w AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
                   words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
               ELSE words END AS words FROM a
    ), k AS (
        SELECT doc_id, i, array_to_string(words[i + 1:i + 8], ' ') AS gram
        FROM (SELECT *, unnest(range(n - 7)) AS i FROM w WHERE n >= 24)
    ), m AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i
    ), s AS (
        SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
        GROUP BY doc_id, q, island
    ), r AS (
        SELECT doc_id, start, length, min(q) AS period FROM s
        WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length
    ), b AS (
        SELECT *, row_number() OVER (
            PARTITION BY doc_id ORDER BY length::DECIMAL(18, 0) / period DESC, start, period) AS place FROM r
    ), l AS (
        SELECT doc_id, count(*) AS n_runs,
               string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id
    ), d AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS j FROM r
    ), c AS (
        SELECT e.doc_id, coalesce(string_agg(word, ' ' ORDER BY e.j) FILTER (d.j IS NULL), '') AS text
        FROM (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS j FROM w) e
        LEFT JOIN d ON d.doc_id = e.doc_id AND d.j = e.j GROUP BY e.doc_id
    )
    SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period,
           (1000 * b.length) // b.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
           sha256(coalesce(c.text, '')) AS collapsed_sha256
    FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN b ON b.doc_id = w.doc_id AND place = 1
    LEFT JOIN c ON c.doc_id = w.doc_id""",
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = run_automaton.collapse_runs(docs, "text", least_length=24, least_exponent=3, keep=["doc_id"])
    # Runs are in the order of start and period, so the first of equal exponents stays.
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Ids and texts, of which the contract makes one in ten periodic from some word on."""
    at = "IF(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8)))"
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
        .withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(f"regexp_extract_all(text, r'{WORD}', 0)")))
        .withColumn("n", F.size("w").cast("long"))
        .withColumn("a", F.expr("g % greatest(n, 1)"))
        .withColumn("text", F.when(F.col("n") > 0, F.expr(
            f"array_join(transform(sequence(0L, n - 1), i -> w[int({at})]), ' ')")).otherwise(F.col("text")))
        .select("doc_id", "text")
    )


@query("op13_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align_texts(
        read(spark, sf_dir, "documents"), "text", public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"],
    )
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256",
    )

"""One query per operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import (
    chat,
    contamination,
    licenses,
    phrases,
    quality,
    secrets,
    sentencepieces,
    sigtree,
    simhash,
    substrings,
    tokenids,
    urls,
    variants,
)
from kpiloom.llm.common import documents
from kpiloom.sources.stage import checkpoint_folder


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kinds = [table.schema[c] for c in ("conv_id", "turn", "role", "text")]
    more = spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    more = more.select(*(F.col(k.name).cast(k.dataType) for k in kinds))
    made = chat.format_chats(table.select(*more.columns).unionByName(more))
    turns = chat.parsed(F.col("formatted"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    return made.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(replace(replace(replace(replace(replace(role || chr(10) || text,
        '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
        - 1 + 20 AS chars
    FROM rows
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepieces.encode_decode(documents(spark, sf_dir), model, ["doc_id"])
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4()}"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokenids.write_ids(documents(spark, sf_dir), path, tokenizer, end_id=2)
    found = tokenids.read_ids(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    mark = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", mark, "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join(F.array_sort(F.array_distinct("licenses")), ",").alias("licenses"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.contaminated(documents(spark, sf_dir), benchmark)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    number = [
        F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) AS long) AS n_{kind}")
        for kind in secrets.BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *number,
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [
    urls.host_rule("net/", "block"),
    urls.host_rule("example.net/en/", "allow"),
    urls.host_rule("example.com/de/", "block"),
    urls.host_rule("org/fr/", "allow"),
    urls.Rule("advertising host", ".ad?.**", "block"),
    urls.Rule("tracking host", "*.track*.*/**", "block"),
    urls.Rule("sign-in page", "**/login**", "block"),
    urls.Rule("basket page", "**/cart**", "block"),
    urls.Rule("archive", "**.zip", "block"),
    urls.Rule("program", "**.exe", "block"),
    urls.Rule("picture", "**.jp?g", "block"),
    urls.Rule("small picture", "**.gif", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = urls.judge(pages, URL_RULES, "allow", "page_id")
    rule = F.when(F.col("tier") == 1, F.col("rule")).alias("rule")
    return found.select("page_id", "host", "path", rule, "verdict")


OP9_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), named AS (
    SELECT *, CASE
        WHEN suffix('.' || host, '.example.net') AND prefix(path, '/en/') THEN 'example.net/en/'
        WHEN suffix('.' || host, '.example.com') AND prefix(path, '/de/') THEN 'example.com/de/'
        WHEN suffix('.' || host, '.org') AND prefix(path, '/fr/') THEN 'org/fr/'
        WHEN suffix('.' || host, '.net') AND prefix(path, '/') THEN 'net/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN regexp_matches('.' || host || path,
        '(?s)^\.ad.\.|^[^/]*\.track[^/]*\.[^/]*/|/login|/cart|\.(zip|exe|gif|jp.g)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM named
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *names, "base_failed", "kept")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.similar_groups(documents(spark, sf_dir))


OP11_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(
        [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) END AS s
    FROM words
), texts AS (
    SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s
), shingles AS (
    SELECT id, n, unnest(s) AS x FROM texts
), links AS (
    SELECT a.id AS a, b.id AS b
    FROM shingles AS a JOIN shingles AS b ON a.x = b.x AND a.id <> b.id
    WHERE 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.id, b.id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
    SELECT id, id AS other FROM texts WHERE n > 0
    UNION
    SELECT r.id, l.b FROM reached AS r JOIN links AS l ON l.a = r.other
), least AS (
    SELECT id, min(other) AS component_id FROM reached GROUP BY id
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
    CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM sets AS d
LEFT JOIN texts AS t ON t.s = list_sort(d.s)
LEFT JOIN least AS l ON l.id = t.id
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
    FROM words, range(1, 6) AS t(k)
), f AS (
    SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, k, phrase
), cand AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), inside AS (
    SELECT DISTINCT s.lang, s.phrase
    FROM cand AS s JOIN cand AS g ON g.lang = s.lang AND g.k > s.k AND g.a >= s.a
        AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ')
), cuts AS (
    SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f * y.f) AS score
    FROM cand AS c ANTI JOIN inside AS i ON c.lang = i.lang AND c.phrase = i.phrase
    CROSS JOIN range(1, 5) AS t(j)
    JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
    JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
    JOIN totals AS o ON o.lang = c.lang
    WHERE j < c.k
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM best WHERE place = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
    CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_ids": op3_token_ids,
    "op4_simhash": op4_simhash,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_phrases": op12_phrases,
    "op13_spelling": op13_spelling,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_ngram_jaccard": OP11_SQL,
    "op12_phrases": OP12_SQL,
}

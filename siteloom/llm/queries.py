"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import scratch_path
from siteloom.llm.decontaminate import contamination_report
from siteloom.llm.exact_dedup import exact_dedup
from siteloom.llm.html_text import extract_main_text
from siteloom.llm.language import identify_languages, train_grams
from siteloom.llm.mixing import mix
from siteloom.llm.ngram_join import near_duplicates
from siteloom.llm.pii import personal_data
from siteloom.llm.prefix_trie import conversation_trie, rebuilt, turn_sequences
from siteloom.llm.quality import graded, train_quality
from siteloom.llm.ranked_search import ranked_search
from siteloom.llm.token_counts import count_tokens
from siteloom.llm.token_files import document_digests, write_token_file
from siteloom.llm.toxicity import remainder, scored, train_toxicity

#: Production parameters: the tokenizer of token files, and the vocabulary of token counts.
WORD_TOKENIZER = "word_bpe_49k.json"
UNIGRAM_VOCABULARY = "piece_bpe_32k.model"
#: The quality classifier keeps a document whose highest grade is this probable.
LEAST_P_TOP = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    found = graded(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", "quality.*")
    return found.withColumn("kept", F.col("p_top") >= LEAST_P_TOP)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("found", "removed_terms")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path(WORD_TOKENIZER)))
    return document_digests(spark, path)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_grams(table(spark, sf_dir, "documents"))
    return identify_languages(table(spark, sf_dir, "pages"), model)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path(UNIGRAM_VOCABULARY)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(rebuilt(turn_sequences(table(spark, sf_dir, "conversations"))))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

_SPAN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"\p{L}+",
    "secret": r"(?i)(?:^|[^\p{L}\p{N}])(?:[a-z0-9]{1,20}[_-]){0,3}(?:token|secret|password|passwd|passphrase|apikey|api[_-]key|access[_-]key|private[_-]key)"
    r"[\x22\x27]?\s{0,3}[:=]\s{0,3}[\x22\x27]?[A-Za-z0-9_+/=-]{12,}",
}


def _located_sql(kind: str, table: str) -> str:
    """doc_id, start, hit of the matches of a pattern: what stands between matches gives their places."""
    pattern = _SPAN_PATTERNS[kind]
    return f"""
        SELECT doc_id, hit, CAST(sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS start
        FROM (
            SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit, CASE WHEN i > 1 THEN hits[i - 1] END AS before
            FROM (
                SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
                FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM {table})
            )
        )"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0
    THEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INT)
    ELSE CAST({_DIGITS}[length({_DIGITS}) - i] AS INT) * 2 - CASE WHEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

ORACLE_SQL = {
    "op3_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM d
        ), postings AS (
            SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared
            FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
                AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
            GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (an + bn - shared)
        ), ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id AS node, doc_id AS comp FROM s
            UNION
            SELECT ways.b, reach.comp FROM reach JOIN ways ON ways.a = reach.node
        )
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id
        FROM s JOIN (SELECT node, min(comp) AS component_id FROM reach GROUP BY node) ON doc_id = node
    """,
    "op5_personal_data": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        found AS (
            SELECT doc_id, 0 AS kind, 'email' AS name, start, hit FROM ({_located_sql("email", "d")})
            UNION ALL SELECT doc_id, 1, 'ip', start, hit FROM ({_located_sql("ip", "d")})
                WHERE len(list_filter(string_split(hit, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL OR CAST(x AS HUGEINT) > 255)) = 0
            UNION ALL SELECT doc_id, 2, 'card', start, hit FROM ({_located_sql("card", "d")}) WHERE length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}
            UNION ALL SELECT doc_id, 3, 'phone', start, hit FROM ({_located_sql("phone", "d")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15
            UNION ALL SELECT doc_id, 4, 'secret', start + length(whole) - length(hit), hit FROM (
                SELECT doc_id, start, hit AS whole, regexp_extract(hit, '[:=]\\s{{0,3}}[\\x22\\x27]?([A-Za-z0-9_+/=-]{{12,}})$', 1) AS hit
                FROM ({_located_sql("secret", "d")})) WHERE regexp_matches(hit, '[0-9]')
        ),
        values_of AS (
            SELECT DISTINCT doc_id, unnest(list_filter([
                'value:' || kind || ':' || CASE WHEN kind = 0 THEN lower(hit) WHEN kind = 4 THEN hit ELSE {_DIGITS} END,
                'group:' || kind || ':' || CASE kind WHEN 0 THEN lower(split_part(hit, '@', 2)) WHEN 1 THEN regexp_extract(hit, '^[0-9]+\\.[0-9]+\\.[0-9]+')
                    WHEN 2 THEN left({_DIGITS}, 6) WHEN 3 THEN left({_DIGITS}, 4) END,
                'kind:' || kind], lambda x: x IS NOT NULL)) AS c
            FROM found
        ),
        total AS (SELECT count(*) AS n FROM d),
        entities AS (SELECT c, count(*) AS n_c FROM values_of GROUP BY c HAVING count(*) >= 2 AND count(*) < (SELECT n FROM total)),
        terms AS (
            SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(text, '{_SPAN_PATTERNS["email"]}', ' ', 'g'),
                '{_SPAN_PATTERNS["secret"]}', ' ', 'g'), '[\\p{{L}}\\p{{N}}_+/=-]*[0-9][\\p{{L}}\\p{{N}}_+/=-]*', ' ', 'g')), '[^\\p{{L}}]+'), lambda t: length(t) >= 3))) AS t
            FROM d
        ),
        families AS (
            SELECT doc_id, min(md5(t)[1:8]) AS h0, min(md5(t)[9:16]) AS h1, min(md5(t)[17:24]) AS h2 FROM terms
            WHERE doc_id IN (SELECT doc_id FROM values_of) GROUP BY doc_id
        ),
        together AS (
            SELECT c, n_c, t, count(*) AS n_ct FROM terms JOIN values_of USING (doc_id) JOIN families USING (doc_id) JOIN entities USING (c) GROUP BY c, n_c, t
            HAVING count(*) >= 2 AND count(*) * ln((SELECT n FROM total) / n_c) >= 20 AND min(h0) < max(h0) AND min(h1) < max(h1) AND min(h2) < max(h2)
                AND 2 * count(DISTINCT h0) >= count(*)
        ),
        telling AS (
            SELECT DISTINCT t FROM (SELECT c, n_c, t, n_ct, (SELECT n FROM total) AS n FROM together)
            JOIN (SELECT t, count(*) AS n_t FROM terms GROUP BY t) USING (t)
            WHERE round(ln(n * n_ct / (n_c * n_t)) / ln(n / n_c), 9) >= 0.85
        ),
        spans AS (
            SELECT doc_id, kind, name, start, hit FROM found
            UNION ALL
            SELECT doc_id, 5, 'term', start, hit FROM ({_located_sql("word", "d")}) WHERE lower(hit) IN (SELECT t FROM telling)
                AND (doc_id, lower(hit)) IN (SELECT (doc_id, t) FROM terms WHERE t IN (SELECT t FROM telling))
        ),
        listed AS (SELECT *, name || ':' || start || ':' || (start + length(hit)) AS span FROM spans)
        SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip,
               count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
               sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 4), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans,
               count(*) FILTER (WHERE kind = 4) AS n_secret, count(*) FILTER (WHERE kind = 5) AS n_term, count(kind) AS n_spans
        FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id GROUP BY d.doc_id
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
            FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d CROSS JOIN (SELECT DISTINCT n FROM windows)
            )
        ), hits AS (
            SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, words)
        ), covered AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM hits GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op12_prefix_trie": """
        WITH o AS (
            SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), h AS (
            SELECT c, s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])),
                           lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h
            FROM o
        ), m AS (
            SELECT h.c, coalesce(b.s, [])[1:h.h] || h.s[h.h + 1:] AS s
            FROM h LEFT JOIN o AS b ON b.c = h.c - ((h.c % 5) + 5) % 5
        ), p AS (
            SELECT c, d, s[1:d] AS prefix, len(s) = d AS last, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS bytes
            FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM m)
        ), n AS (
            SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
            FROM p GROUP BY d, prefix
        ), k AS (
            SELECT n.d, n.prefix, count(*) AS n_children FROM n JOIN n AS x ON x.d = n.d + 1 AND x.prefix[1:n.d] = n.prefix GROUP BY ALL
        ), below AS (
            SELECT a.d, a.prefix, CAST(sum((x.n_convs - 1) * x.bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
            FROM (SELECT d AS at, prefix AS whole, n_convs, bytes, unnest(range(0, d + 1)) AS d FROM n) AS x
            JOIN n AS a ON a.d = x.d AND a.prefix = x.whole[1:x.d]
            LEFT JOIN k ON k.d = x.at AND k.prefix = x.whole GROUP BY ALL
        )
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, below.n_leaves,
               below.saved_tokens, n.ends_sha256
        FROM n JOIN below USING (d, prefix) LEFT JOIN k USING (d, prefix) LEFT JOIN n AS u ON u.d = n.d - 1 AND u.prefix = n.prefix[1:n.d - 1]
    """,
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), whole AS (
            SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0
        ), postings AS (
            SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d
        ), held AS (
            SELECT r, doc_id, n, term, count(*) AS tf FROM postings WHERE term IN (SELECT term FROM q) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM whole) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held GROUP BY term
        ), scores AS (
            SELECT item_id, r, doc_id,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * (SELECT n FROM whole)) // (SELECT l FROM whole))))) AS BIGINT) AS score
            FROM q JOIN held USING (term) JOIN weights USING (term) GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10
    """,
}

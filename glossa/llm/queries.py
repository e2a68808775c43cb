"""The queries over the driver tables: each reads its whole table, applies its operator and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import chat_format, exact_dedup, fingerprint, html_extract, jaccard_join, licenses, line_quality, packing, quality, sentencepiece, token_align, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.verdicts(_table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).drop("n_repeated")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Where the public vocabulary files are; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    words = sentencepiece.Vocabulary.load(vocabulary)
    return sentencepiece.summarise(docs, words)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op11_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


#: The byte-level vocabulary that is aligned with ``VOCABULARY``; a parameter of the operator.
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str = BYTE_VOCABULARY, b: str = VOCABULARY) -> DataFrame:
    return token_align.align(_table(spark, sf_dir, "documents"), token_align.Pair.load(a, b))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_license_scans": op2_license_scans,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_html_extraction": op6_html_extraction,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_toxicity": op8_toxicity,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_document_fingerprints": op10_document_fingerprints,
        "op11_line_quality_rules": op11_line_quality_rules,
        "op12_vector_code_compression": op12_vector_code_compression,
        "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
    }


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SAID = "'</s>[INST] ok [/INST]'"

_CONTROL = r"(\\|<\||\|>|</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)"



def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """All distances to all entries, round by round."""

    def nearest(book: str) -> str:
        far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"SELECT vec_id, label, part, x, min((d, e)) AS best FROM (SELECT p.*, c.e, {far} AS d FROM p JOIN {book} c USING (part)) GROUP BY ALL"

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(
            f"m{r} AS (SELECT part, best[2] AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL)"
        )
        steps.append(
            f"c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(y, x) AS x FROM c{r} LEFT JOIN (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM m{r} GROUP BY ALL) USING (part, e))"
        )
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda z: floor(4096 * z::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
        ),
        p AS MATERIALIZED (SELECT vec_id, label, part, q[part * len(q) // {parts} + 1:(part + 1) * len(q) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
        c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
        {", ".join(steps)},
        z AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM ({nearest(f"c{rounds}")}) GROUP BY vec_id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256
        FROM z
    """


ORACLE_SQL = {
    # All pairs that share a shingle, and all that can be reached: for tables of some thousand documents.
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
            JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)
        ),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) r USING (doc_id)
    """,
    # The given pages mark their articles; inside, block tags part words and bold does not.
    "op6_html_extraction": """
        WITH a AS (
            SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages
        ),
        u AS (
            SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM a
        ),
        x AS (SELECT page_id, url, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM u)
        SELECT page_id, url, text, length(text) AS n_chars FROM x
    """,
    "op4_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(17 + length(regexp_replace(replace(role, chr(10), ''), '{_CONTROL}', '\\1x', 'g')) + 2 * (length(role) - length(replace(role, chr(10), '')))
                   + length(regexp_replace(text, '{_CONTROL}', '\\1x', 'g')))::BIGINT AS formatted_chars,
               0::BIGINT AS rewrites
        FROM t GROUP BY conv_id
    """,
    "op12_vector_code_compression": _codes_sql(),
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

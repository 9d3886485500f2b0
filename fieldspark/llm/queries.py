"""The registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import chat, circulant, fingerprint, langid, mixing, ngram_join, packing, page_text, phrases, pii, quality, repair, secrets
from .storage import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(-1).cast("bigint").alias("conv_id"),
                        F.lit(i).cast("bigint").alias("turn"),
                        F.lit(role).alias("role"),
                        F.lit(tricky).alias("text"),
                    )
                    for i, role in enumerate(("user", "assistant"))
                ]
            )
        ).alias("t")
    ).select("t.*")
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, ["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs, width=4, percent=85)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_personal_data(docs))


def op6_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.fingerprint_documents(docs)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = quality.judge(docs, labels, F.col("lang"), ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extract_main_text(pages, ["page_id", "url"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secrets.digest(secrets.find_secrets(docs, F.col("source"), F.col("lang")))


def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return circulant.near_duplicates(docs, width=2, percent=80)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(repair.damage(turns), turns.select("conv_id"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.collocations(docs, F.col("lang"))


FUNCTIONS = [
    op1_best_fit_packing,
    op2_chat_format,
    op3_mix_sources,
    op4_ngram_jaccard_join,
    op5_personal_data,
    op6_phrase_fingerprint,
    op7_language_id,
    op8_quality_rules,
    op9_page_text,
    op10_secret_scan,
    op11_near_duplicates,
    op12_conversation_repair,
    op13_phrase_collocations,
]


def _configured(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__ = run.__qualname__ = fn.__name__
    return run


QUERIES = {fn.__name__: _configured(fn) for fn in FUNCTIONS}
ORACLES: dict[str, str] = {
    "op2_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        o AS (
            SELECT *, row_number() OVER w AS place, lag(role) OVER w AS earlier, lead(role) OVER w AS later,
                   length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body,
                   length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS name
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(body + CASE WHEN earlier IS DISTINCT FROM role THEN 13 + name ELSE 10 END
                             + CASE WHEN later IS DISTINCT FROM role THEN 11 ELSE 0 END) AS BIGINT)
                   AS formatted_chars
        FROM o GROUP BY conv_id""",
    "op13_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        runs AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM places),
        totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
        ones AS (SELECT lang, x, CAST(count(*) AS HUGEINT) AS f FROM runs GROUP BY ALL),
        twos AS (SELECT lang, x, y, CAST(count(*) AS HUGEINT) AS f FROM runs WHERE y IS NOT NULL GROUP BY ALL
                 HAVING count(*) >= 10),
        threes AS (SELECT lang, x, y, z, CAST(count(*) AS HUGEINT) AS f FROM runs WHERE z IS NOT NULL
                   GROUP BY ALL HAVING count(*) >= 10),
        longer AS (SELECT lang, x, y, max(f) AS f FROM (
                       SELECT lang, x, y, f FROM threes UNION ALL SELECT lang, y, z, f FROM threes)
                   GROUP BY ALL),
        cuts AS (
            SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
            FROM twos t JOIN ones p ON t.lang = p.lang AND t.x = p.x JOIN ones q ON t.lang = q.lang AND t.y = q.x
            LEFT JOIN longer g ON t.lang = g.lang AND t.x = g.x AND t.y = g.y
            WHERE g.f IS NULL OR 100 * g.f < 50 * t.f
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
            FROM threes t JOIN ones p ON t.lang = p.lang AND t.x = p.x
            JOIN twos q ON t.lang = q.lang AND t.y = q.x AND t.z = q.y
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
            FROM threes t JOIN twos p ON t.lang = p.lang AND t.x = p.x AND t.y = p.y
            JOIN ones q ON t.lang = q.lang AND t.z = q.x),
        scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
                   FROM weakest)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
               CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}

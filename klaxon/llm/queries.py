"""The numbered queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klaxon.llm import langid, merkle, quality, toxicity
from klaxon.llm.bpe import encode_documents
from klaxon.llm.common import fold, shipped, table
from klaxon.llm.context_tree import score_texts
from klaxon.llm.exact_dedup import mark_duplicates
from klaxon.llm.fingerprints import compare_edited
from klaxon.llm.near_dedup import mark_near_duplicates
from klaxon.llm.packing import pack, pieces_of
from klaxon.llm.phrases import mine_phrases
from klaxon.llm.token_counts import apply_edits, example_edits
from klaxon.llm.token_files import read_documents, write_token_files
from klaxon.session import fresh_path

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edited(table(spark, folder, "documents"))


def op2_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"), held_out=fold() == 1)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.classify(documents, table(spark, folder, "labels"), use=fold() != 0)
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    digests = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_documents(documents, BYTE_VOCABULARY, outputs=digests).drop("text")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_duplicates(table(spark, folder, "documents"), keep="max")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    edited = apply_edits(documents.withColumn("edits", example_edits(F.col("text"))), BYTE_VOCABULARY, "edits")
    return edited.select(
        "doc_id",
        "n_tokens",
        F.size("edits").alias("n_edits"),
        "edited_tokens",
        F.length("edited_text").cast("long").alias("edited_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "encoded_chars",
    )


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(pieces_of(table(spark, folder, "documents"), WORD_VOCABULARY))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = langid.identify(documents, use=fold() != 0)
    return judged.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.classify(documents, table(spark, folder, "labels"), use=fold() != 0)
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_near_duplicates(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = {"n_chars": F.col("n_chars") + 1}
    return merkle.manifest(table(spark, folder, "documents"), changed=changed, changes=tampered)


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(table(spark, folder, "documents"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    written = write_token_files(table(spark, folder, "documents"), BYTE_VOCABULARY, fresh_path(spark, "token-files"))
    return read_documents(written)


QUERIES = {
    "op1_weighted_fingerprints": op1_weighted_fingerprints,
    "op2_context_tree": op2_context_tree,
    "op3_toxicity": op3_toxicity,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_near_dedup": op10_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrases": op12_phrases,
    "op13_token_files": op13_token_files,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}

def leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(
        f"coalesce(strlen(cast({f} AS VARCHAR)) || ':' || cast({f} AS VARCHAR), '-')" for f in fields
    ) + ")"


# 3988292384 is the reversed polynomial of crc32; the text is a decimal number, so its bytes are its letters.
MERKLE_SQL = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {leaf_sql("n_chars")} AS leaf, {leaf_sql("n_chars + 1")} AS other,
               list_reduce([4294967295] || list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: cast(ascii(c) AS BIGINT)),
                   lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0],
                       lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
        FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
               dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               count(*) OVER (PARTITION BY lang) AS many
        FROM leaves),
    nodes AS (
        SELECT tree, 0 AS level, place, leaf AS digest, many FROM placed
        UNION ALL
        SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (many + 1) // 2
        FROM nodes WHERE many > 1 GROUP BY tree, level, place // 2, many),
    subroots AS (SELECT tree, digest, count(*) OVER () AS many FROM nodes WHERE many = 1),
    tops AS (
        SELECT 0 AS level, tree AS place, digest, many FROM subroots
        UNION ALL
        SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (many + 1) // 2
        FROM tops WHERE many > 1 GROUP BY level, place // 2, many),
    steps AS (
        SELECT p.doc_id, p.tree, p.place, n.level, n.digest AS sibling, (p.place >> n.level) % 2 AS side
        FROM placed p JOIN nodes o ON o.tree = p.tree AND o.place = p.place >> o.level AND o.many > 1
        LEFT JOIN nodes n ON n.tree = o.tree AND n.level = o.level AND n.place = xor(o.place, 1)
        WHERE n.digest IS NOT NULL
        UNION ALL
        SELECT p.doc_id, p.tree, p.place, 1000 + n.level, n.digest, (p.tree >> n.level) % 2
        FROM placed p JOIN tops o ON o.place = p.tree >> o.level AND o.many > 1
        JOIN tops n ON n.level = o.level AND n.place = xor(o.place, 1)),
    proofs AS (
        SELECT tree, place, sha256(string_agg(sibling, '' ORDER BY level)) AS proof_sha256
        FROM steps GROUP BY tree, place),
    ways AS (
        SELECT p.tree, p.place, list(coalesce(s.sibling, '') ORDER BY w.level) AS siblings,
               list(coalesce(s.side, 2) ORDER BY w.level) AS sides
        FROM placed p
        JOIN (SELECT DISTINCT tree, level FROM nodes WHERE many > 1
              UNION ALL
              SELECT t.tree, 1000 + o.level FROM subroots t JOIN (SELECT DISTINCT level FROM tops WHERE many > 1) o ON true) w
          ON w.tree = p.tree
        LEFT JOIN steps s ON s.tree = p.tree AND s.place = p.place AND s.level = w.level
        GROUP BY p.tree, p.place),
    folds AS (
        SELECT p.tree, p.place, 0 AS done,
               CASE WHEN crc IS NOT NULL AND (4294967295 - crc) % 7 = 0 THEN other ELSE leaf END AS digest,
               coalesce(siblings, []) AS siblings, coalesce(sides, []) AS sides
        FROM placed p LEFT JOIN ways w ON w.tree = p.tree AND w.place = p.place
        UNION ALL
        SELECT tree, place, done + 1,
               sha256(CASE sides[done + 1] WHEN 1 THEN siblings[done + 1] || digest ELSE digest || siblings[done + 1] END),
               siblings, sides
        FROM folds WHERE done < len(sides)),
    root AS (SELECT digest FROM tops WHERE many = 1)
    SELECT p.doc_id, p.leaf, r.digest AS subroot, (SELECT digest FROM root) AS root,
           coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root,
           f.digest = (SELECT digest FROM root) AS verified
    FROM placed p JOIN subroots r ON r.tree = p.tree
    JOIN folds f ON f.tree = p.tree AND f.place = p.place AND f.done = len(f.sides)
    LEFT JOIN proofs q ON q.tree = p.tree AND q.place = p.place
"""

PHRASES_SQL = """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    worded AS (
        SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS words FROM pieces),
    totals AS (SELECT lang, cast(sum(len(words)) AS HUGEINT) AS n FROM worded GROUP BY lang),
    spans AS (
        SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
        FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded) s
        JOIN (SELECT unnest(range(1, 6)) AS k) sizes ON i + k - 1 <= len(words)),
    counts AS (
        SELECT lang, k, phrase, cast(count(*) AS HUGEINT) AS a FROM spans GROUP BY ALL HAVING count(*) >= 100),
    inner_parts AS (
        SELECT lang, k, a, array_to_string(string_split(phrase, ' ')[i : i + j - 1], ' ') AS part
        FROM (SELECT *, unnest(range(2, k)) AS j FROM counts) c JOIN (SELECT unnest(range(1, 5)) AS i) o ON i + j - 1 <= k),
    dropped AS (
        SELECT DISTINCT c.lang, c.phrase FROM counts c JOIN inner_parts p ON p.lang = c.lang AND p.part = c.phrase
        WHERE 100 * p.a >= 100 * c.a),
    cuts AS (
        SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS head,
               array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS j FROM counts ANTI JOIN dropped USING (lang, phrase) WHERE k > 1)),
    scored AS (
        SELECT c.lang, c.phrase, c.a, h.a AS l, t.a AS r, n, (1000 * c.a * n) // (h.a * t.a) AS score, j
        FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
        JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals o ON o.lang = c.lang),
    least AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
    SELECT lang, cast(rank AS BIGINT) AS rank, phrase, cast(a AS BIGINT) AS a, cast(l AS BIGINT) AS l,
           cast(r AS BIGINT) AS r, cast(n AS BIGINT) AS n, cast(score AS BIGINT) AS score
    FROM ranked WHERE rank <= 2000
"""

ORACLES = {
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_merkle_manifest": MERKLE_SQL,
    "op12_phrases": PHRASES_SQL,
}

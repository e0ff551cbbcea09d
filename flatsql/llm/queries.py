"""The operators as queries over the synthetic tables, each with its production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatsql.llm import automaton, bpe, chat, decontam, exact, materialise, simhash, suffixarray, toxicity, urlfilter
from flatsql.llm.common import LOWER, UPPER, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("log_odds")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out().alias("held_out"), toxicity.toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", F.col("n").alias("n_words"), _removed().alias("n_removed"), F.lower(F.hex("kept")).alias("kept_sha256"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.read_back(chat.format_messages(chat.fold(chat.events_of_rows(rows))))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixarray.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", F.col("n").alias("n_bytes"), _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


def _removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_training_order": op7_training_order,
    "op8_chat": op8_chat,
    "op9_suffix_array": op9_suffix_array,
    "op10_decontamination": op10_decontamination,
}

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_WORDS10 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

_WORDS6 = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL = {
    "op6_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
        s AS (SELECT doc_id, p, list_aggregate(w[p : p + 34], 'string_agg', ' ') AS k
              FROM (SELECT *, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
        m AS (SELECT s.doc_id, s.p FROM s WHERE md5(k) IN (SELECT md5(k) FROM s GROUP BY md5(k) HAVING count(*) > 1)),
        r AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM m) GROUP BY doc_id),
        e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
        k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY q) AS kept FROM e LEFT JOIN
              (SELECT doc_id, unnest(gone) AS q, true AS bad FROM r) g USING (doc_id, q) WHERE bad IS NULL GROUP BY e.doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(24 + length(replace({_ESCAPED.format('role')}, chr(10), '\\n')) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op9_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS k
              FROM (SELECT *, unnest(range(0, len(x) // 2 - 399)) AS p FROM d WHERE len(x) >= 800)),
        m AS (SELECT doc_id, p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
        g AS (SELECT doc_id, p, sum(CASE WHEN p <= q + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
              FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM m)),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, run),
        l AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
        k AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
                     max(b) AS last, sum(b - a) AS gone, count(*) AS runs FROM l JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op10_decontamination": f"""
        WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS10} AS w FROM benchmark),
        q AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_aggregate(w[s : s + least(len(w), 13) - 1], 'string_agg', ' ') AS k
              FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
        o AS (SELECT doc_id, s, n, list_aggregate(w[s : s + n - 1], 'string_agg', ' ') AS k
              FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
        m AS (SELECT doc_id, s, o.n, item_id FROM o JOIN q ON o.n = q.n AND o.k = q.k),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY body)""",
}

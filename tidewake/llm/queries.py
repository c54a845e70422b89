"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import bpe, chat, ctw, exact_dedup, jaccard, langid, mixing, quality, search, variants, warc, whitening
from tidewake.llm.common import id_remainder, table

TOKEN_LIMIT = 2048
QUALITY_THRESHOLD = 0.7


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is held out by its id; one without an id isn't."""
    return F.coalesce(id_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), learn=id_remainder(F.col("id"), 4) != 2)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), items AS (SELECT doc_id, unnest(s) AS item FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT c.a, c.b FROM common c JOIN sets x ON x.doc_id = c.a JOIN sets y ON y.doc_id = c.b WHERE 100 * c.n >= 90 * (len(x.s) + len(y.s) - c.n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, coalesce(l.n_links, 0) AS n_links
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM both_ways GROUP BY a) l ON l.doc_id = s.doc_id
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", sample), (-7, 1, "assistant", sample)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.format_chats(chat.turn_rows(rows))
    turns = chat.read_turns(F.col("formatted"))
    made = made.select("conv_id", "formatted", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Escaping is checked by the lengths that it adds, character by character and run by run.
OP5_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), sized AS (
    SELECT *, length(text) + (length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<turn', ''))) // 5 + (length(text) - length(replace(text, '</turn', ''))) // 6 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda r: greatest(length(r) - 2, 0))), 0)) AS body, length(role) + (length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '<turn', ''))) // 5 + (length(role) - length(replace(role, '</turn', ''))) // 6 + coalesce(list_sum(list_transform(regexp_extract_all(role, '#+'), lambda r: greatest(length(r) - 2, 0))), 0)) + length(role) - length(replace(role, chr(10), '')) AS head FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<turn>') + head + 1 + body + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ctw.score_texts(docs, _held_out(5, 1))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(3, 1)
    model = langid.train_languages(docs.filter(~held_out))
    found = langid.predict_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH named AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY bare) AS group_size
    FROM named WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(bare) AS text_sha256 FROM ranked
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


#: Rounds of sharing in place of a level found at once, and one sorted sum in place of buckets.
OP9_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents
), shares AS (
    SELECT 0 AS round, source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, false AS stopped FROM sized GROUP BY source
    UNION ALL
    SELECT round + 1, source, source_size, weight,
        stopped OR weight * CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (stopped) OVER (), 0) AS DOUBLE) > CAST(3 * source_size AS DOUBLE) * coalesce(sum(weight) FILTER (NOT stopped) OVER (), 0)
    FROM shares WHERE round < (SELECT count(DISTINCT source) + 1 FROM sized)
), targets AS (
    SELECT source, source_size, CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE)
        ELSE weight * (CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (stopped) OVER (), 0) AS DOUBLE) / sum(weight) FILTER (NOT stopped) OVER ()) END AS target
    FROM shares WHERE round = (SELECT max(round) FROM shares)
), classes AS (
    SELECT s.source, length(bin(s.size)) AS bits, CAST(sum(s.size) AS BIGINT) AS words, any_value(t.source_size) AS source_size, any_value(t.target) AS target
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source GROUP BY s.source, length(bin(s.size))
), levels AS (
    SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(bits * words) OVER (PARTITION BY source ORDER BY bits ROWS UNBOUNDED PRECEDING), 0) AS c FROM classes
), expected AS (
    SELECT l.source, l.bits, l.words, l.source_size, l.target, CASE WHEN coalesce(l.c * l.bits >= 3, false) THEN 3.0::DOUBLE
        ELSE greatest(least(coalesce((SELECT max_by(m.c, m.bits) FROM levels m WHERE m.source IS NOT DISTINCT FROM l.source AND NOT coalesce(m.c * m.bits >= 3, false)) * l.bits, 0), 3), 0) END AS e
    FROM levels l
), ranked AS (
    SELECT s.doc_id, s.size, s.u, e.source, e.source_size, e.target, CAST(floor(e.e) AS BIGINT) AS base, least(e.e - floor(e.e), 1 - 1e-9::DOUBLE) AS p
    FROM sized s JOIN expected e ON s.source IS NOT DISTINCT FROM e.source AND e.bits = length(bin(s.size))
), odds AS (
    SELECT *, CASE WHEN size > 0 AND p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(base * size) OVER (PARTITION BY source) AS rest FROM ranked
), sampled AS (
    SELECT *, q IS NOT NULL AND sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source, q IS NULL ORDER BY q, u, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS is_in FROM odds
), missing AS (SELECT *, rest - sum(CASE WHEN is_in THEN size ELSE 0 END) OVER (PARTITION BY source) AS miss FROM sampled
), closing AS (
    SELECT source, arg_min(doc_id, {'off': abs(size - miss), 'q': coalesce(q, 'infinity'::DOUBLE), 'u': u, 'd': doc_id}) AS doc_id
    FROM missing WHERE NOT is_in AND size > 0 AND base < 3 AND miss > 0 AND abs(size - miss) < miss GROUP BY source
)
SELECT m.doc_id, m.size, m.source_size, m.target, m.base + (m.is_in OR c.doc_id IS NOT NULL)::INT AS copies, (m.base + (m.is_in OR c.doc_id IS NOT NULL)::INT) * m.size AS taken
FROM missing m LEFT JOIN closing c ON c.doc_id = m.doc_id AND c.source IS NOT DISTINCT FROM m.source
"""


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, k=10)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.damaged_words(table(spark, sf_dir, "documents")))


#: Deletions of every word in place of grams; the checksum comes from its table of 256 remainders.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS (
    SELECT run, count(*) AS m, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, (ord(x) - 64)::BIGINT] END))),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
    FROM runs, crc WHERE length(run) >= 7 GROUP BY run, id, t
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(m) >= 2
), gone AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
    UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.v = w.word
    UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.v = w.word
), best AS (
    SELECT x.word, count(*) AS n_near, arg_min(y.word, {'n': -y.n, 'w': y.word}) AS best, max(y.n) AS best_n
    FROM near x JOIN words y ON y.word = x.other GROUP BY x.word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 10 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 10 * w.n THEN b.best_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
), follow AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT f.word, f.next, g.form FROM follow f JOIN forms g ON g.word = f.next
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN follow r ON r.word = f.word AND r.next IS NULL
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.resolved(warc.read_archive(spark, warc.archive_pages(pages)))
    as_id = pages.schema["page_id"].dataType
    return found.select(F.col("page_id").cast(as_id).alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(as_id).alias("refers_to"))


OP12_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), ranked AS (SELECT *, row_number() OVER w AS i, first_value(page_id) OVER w AS first FROM payloads WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND i > 1 THEN first END AS refers_to FROM ranked
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_roundtrip": op1_bpe_roundtrip,
        "op2_quality": op2_quality,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_token_counts": op4_token_counts,
        "op5_chat_format": op5_chat_format,
        "op6_lm_score": op6_lm_score,
        "op7_language_id": op7_language_id,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_mixing": op9_mixing,
        "op10_search": op10_search,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_warc": op12_warc,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op5_chat_format": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_warc": OP12_SQL}

"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, html_main_text, importance, language_id, lexical_search, license_scan, mixing, mtree, near_dedup, pseudonyms, quality_rules
from .tables import table

#: Stands for the secret key that a caller passes.
DEMO_KEY = b"pseudonym key of the registered query"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(conversations.unionByName(probe)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(F.col("probability") * 10000).cast("long").alias("probability_bp"), "sampled", F.floor(F.col("residual") * 10000).alias("residual_bp"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main_text.extract(pages, html_main_text.train(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language_id.identify(documents, language_id.train(documents))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scan, op2_near_dedup, op3_top_k, op4_chat_format, op5_quality_rules, op6_mixing, op7_html_main_text, op8_language_id, op9_byte_bpe, op10_pseudonyms, op11_lexical_search, op12_importance, op13_exact_dedup]
    return {f.__name__: f for f in found}


_ESCAPED = "replace({0}, chr(92), chr(92) || chr(92))"
for _control in chat_format.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}' || chr(92) || '{_control[1:]}')"

_OP3 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
WHERE rank <= 5
"""

_OP4 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(chat_format.TURN) + len(chat_format.SAY) + len(chat_format.END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP5 = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), n AS (
  SELECT row_number() OVER () AS r, *, len(words)::BIGINT AS n_words FROM t
), w AS (
  SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win, n_words
  FROM (SELECT r, n_words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM n)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w WHERE i <= n_words - 7) WHERE c > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(lead_i - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM twice) GROUP BY r
), s AS (
  SELECT n.doc_id, n.source, n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM n LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 4 * n_symbols > word_chars AS symbols, 2 * n_dup_lines > n_lines AS copied FROM s
), h AS (
  SELECT source, count(*) AS n, count_if(short) AS a, count_if(repeats) AS b, count_if(symbols) AS c, count_if(copied) AS d FROM f WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT avg(1 / n) AS share, avg(a / n) AS ma, var_pop(a / n) AS va, avg(b / n) AS mb, var_pop(b / n) AS vb, avg(c / n) AS mc, var_pop(c / n) AS vc, avg(d / n) AS md, var_pop(d / n) AS vd FROM h
), s2 AS (
  SELECT ma, mb, mc, md, CASE WHEN share < 1 THEN (va - ma * (1 - ma) * share) / (1 - share) ELSE 0 END AS sa, CASE WHEN share < 1 THEN (vb - mb * (1 - mb) * share) / (1 - share) ELSE 0 END AS sb,
    CASE WHEN share < 1 THEN (vc - mc * (1 - mc) * share) / (1 - share) ELSE 0 END AS sc, CASE WHEN share < 1 THEN (vd - md * (1 - md) * share) / (1 - share) ELSE 0 END AS sd FROM m
), p AS (
  SELECT ma, mb, mc, md,
    CASE WHEN sa > 0 THEN least(greatest(ma * (1 - ma) / sa - 1, 1), 1000) ELSE 1000 END AS wa, CASE WHEN sb > 0 THEN least(greatest(mb * (1 - mb) / sb - 1, 1), 1000) ELSE 1000 END AS wb,
    CASE WHEN sc > 0 THEN least(greatest(mc * (1 - mc) / sc - 1, 1), 1000) ELSE 1000 END AS wc, CASE WHEN sd > 0 THEN least(greatest(md * (1 - md) / sd - 1, 1), 1000) ELSE 1000 END AS wd FROM s2
), bad AS (
  SELECT source, greatest((a + ma * wa) / (n + wa), (b + mb * wb) / (n + wb), (c + mc * wc) / (n + wc), (d + md * wd) / (n + wd)) > 0.5 AS host_failed FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed,
  NOT (short OR repeats) AND NOT coalesce(host_failed, false) AS kept
FROM f LEFT JOIN bad USING (source)
"""


def _op6() -> str:
    parts = [
        r"""d AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), m AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 50 THEN 'note' WHEN (length(text) - length(replace(text, chr(10), ''))) * 40 > n_tokens THEN 'listing' ELSE 'prose' END AS topic FROM d
), c0 AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM m GROUP BY ALL HAVING sum(n_tokens) > 0
)"""
    ]
    for name in mixing.DIMENSIONS:
        parts.append(f"t_{name} AS (SELECT {name}, p / sum(p) OVER () AS share_{name} FROM (SELECT {name}, pow(sum(tokens), {mixing.TEMPERS[name]}) AS p FROM c0 GROUP BY {name}))")
    parts.append("s0 AS (SELECT *, tokens AS weight FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    step, last = f"SELECT * FROM s WHERE residual > {mixing.RESIDUAL!r} AND residual < before * (1 - {mixing.NO_FALL!r})", "weight"
    for name in mixing.DIMENSIONS:
        step = f"SELECT *, abs(held_{name} - share_{name}) AS off_{name}, {last} * share_{name} / held_{name} AS w_{name} FROM (SELECT *, sum({last}) OVER (PARTITION BY {name}) AS held_{name} FROM ({step}))"
        last = f"w_{name}"
    kept = "source, lang, topic, tokens, share_source, share_lang, share_topic"
    off = ", ".join(f"max(off_{name}) OVER ()" for name in mixing.DIMENSIONS)
    parts.append(f"s AS (SELECT 0 AS r, 1e308::DOUBLE AS before, 1e300::DOUBLE AS residual, {kept}, weight FROM s0 UNION ALL SELECT r + 1, residual, greatest({off}), {kept}, {last} FROM ({step}))")
    parts.append("r AS (SELECT source, lang, topic, weight / tokens / max(weight / tokens) OVER () AS rate, floor(residual * 10000)::BIGINT AS residual_bp FROM s WHERE r = (SELECT max(r) FROM s))")
    parts.append("j AS (SELECT m.*, CASE WHEN n_tokens = 0 THEN 1.0::DOUBLE ELSE coalesce(rate, 0.0)::DOUBLE END AS p, residual_bp FROM m LEFT JOIN r USING (source, lang, topic))")
    draw = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '?') || '/{mixing.SEED}'), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(p * 10000)::BIGINT AS probability_bp, {draw} < p AS sampled, residual_bp FROM j"


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), m AS (
  SELECT r, doc_id, 50 + (50 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0
), scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""

_OP12 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS byte
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), placed AS (
  SELECT side, r, unnest(words) AS a, unnest(words[2:] || [NULL]) AS b, unnest(words[3:] || [NULL, NULL]) AS c FROM split WHERE len(words) > 0
), runs AS (
  SELECT side, r, a AS run FROM placed UNION ALL SELECT side, r, a || ' ' || b FROM placed WHERE b IS NOT NULL UNION ALL SELECT side, r, a || ' ' || b || ' ' || c FROM placed WHERE b IS NOT NULL AND c IS NOT NULL
), hexed AS (
  SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs)
), hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, byte[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc
), told AS (
  SELECT side, r, bucket, count(*) AS n FROM runs JOIN hashed USING (run) GROUP BY ALL
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS t FROM told GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM counts
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM told JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, len(words) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) END AS rank, 5 * count(*) FILTER (WHERE fit) OVER () // 100 AS wanted FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN rank END AS rank FROM ranked
"""

_OP13 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": _OP3, "op4_chat_format": _OP4, "op5_quality_rules": _OP5, "op6_mixing": _op6(), "op11_lexical_search": _OP11, "op12_importance": _OP12, "op13_exact_dedup": _OP13}

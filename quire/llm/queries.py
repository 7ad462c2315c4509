"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import ann, collocations, fingerprints, interaction, lattice, media, mixing, packing, perplexity, simhash, substring, toolcalls, toxicity
from quire.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.of_conversations(table(spark, sf_dir, "conversations"))


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op4_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op6_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_digest(table(spark, sf_dir, "documents"))


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_of(table(spark, sf_dir, "embeddings"))


def op13_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_tool_call_linking, op2_lattice_likelihood, op3_golay_simhash, op4_bottom_k_fingerprints, op5_substring_dedup, op6_signature_sniffing, op7_counterfactual_toxicity, op8_sainte_lague_mixing, op9_best_fit_packing, op10_kneser_ney_quality, op11_filter_interaction_audit, op12_cross_polytope_search, op13_collocation_mining)}
#: SQL for DuckDB over the same tables, where SQL can say what an operator returns.
ORACLE_SQL: dict[str, str] = {
    "op1_tool_call_linking": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), calls AS (
  SELECT conv_id, 'call_' || turn::VARCHAR AS call_id, turn, text FROM turns WHERE role = 'user'
), numbered AS (
  SELECT *, '{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '}' AS arguments, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, '{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '}') AS place FROM calls
), steps AS (
  SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM (SELECT DISTINCT conv_id, turn FROM calls) t
), chained AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM steps
), answers AS (
  SELECT conv_id, 'call_' || (turn - 1)::VARCHAR AS call_id, count(*) AS n, min(turn) AS t FROM turns WHERE role = 'assistant' GROUP BY 1, 2
), answered AS (
  SELECT a.conv_id, a.call_id, a.n, min(t.text) AS text FROM answers a JOIN turns t ON t.conv_id = a.conv_id AND t.turn = a.t AND t.role = 'assistant' GROUP BY 1, 2, 3
)
SELECT c.conv_id, c.call_id, c.turn, 'ask' AS name, o.level::BIGINT AS level,
       c.arguments,
       length(c.text) > 0 AS valid, CASE WHEN length(c.text) > 0 THEN 0 ELSE 1 END::BIGINT AS n_problems,
       c.place > 1 AS repeated, coalesce(a.n, 0)::BIGINT AS n_results,
       CASE WHEN a.n IS NOT NULL THEN '{"content":' || to_json(a.text)::VARCHAR || '}' END AS result, a.n IS NOT NULL AS linked
FROM numbered c JOIN chained o ON o.conv_id = c.conv_id AND o.turn = c.turn
LEFT JOIN answered a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
""",
    "op5_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), spots AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words WHERE len(ws) >= 13
), runs AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS run FROM spots
), firsts AS (
  SELECT run, min(doc_id) AS first_doc FROM runs GROUP BY run
), bad AS (
  SELECT doc_id, list(i) AS hits FROM runs JOIN firsts USING (run) WHERE first_doc < doc_id GROUP BY doc_id
), covered AS (
  SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda j: range(j, j + 13)))) AS gone FROM bad
), kept AS (
  SELECT w.doc_id, len(w.ws) AS n_words, coalesce(len(c.gone), 0) AS n_removed,
         CASE WHEN c.gone IS NULL THEN w.ws
              ELSE list_transform(list_filter(range(1, len(w.ws) + 1), lambda k: NOT list_contains(c.gone, k)), lambda k: w.ws[k]) END AS ws
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(ws, ' '), '')) AS kept_sha256 FROM kept
""",
    "op11_filter_interaction_audit": r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_doc FROM docs GROUP BY text
), failing AS (
  SELECT d.doc_id, d.part,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text))::INT
         + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(f.first_doc < d.doc_id, false)::INT AS mask
  FROM docs d JOIN firsts f ON f.text = d.text
), known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failing LEFT JOIN known USING (doc_id) GROUP BY part, mask
), filters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
""",
    "op13_collocation_mining": r"""
WITH pieces AS (
  SELECT lang, piece, list_filter(string_split_regex(body, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, doc_id AS piece, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents
  ) t
), grams AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, k
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k) u
), counts AS MATERIALIZED (
  SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM grams GROUP BY lang, phrase, k
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), found AS MATERIALIZED (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 10
), halves AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail FROM (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM found) t
), often AS MATERIALIZED (
  SELECT lang, phrase, f FROM counts WHERE f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, 1000000::HUGEINT * c.a * c.a // (x.f * y.f) AS score
  FROM halves c JOIN often x ON x.lang = c.lang AND x.phrase = c.head JOIN often y ON y.lang = c.lang AND y.phrase = c.tail
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM found WHERE k = 3
  ) t GROUP BY lang, phrase
), kept AS (
  SELECT p.* FROM lowest p LEFT JOIN inside i ON i.lang = p.lang AND i.phrase = p.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * p.a
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT p.lang, p.rank, p.phrase, p.a::BIGINT AS a, p.l::BIGINT AS l, p.r::BIGINT AS r, s.n, p.score::BIGINT AS score FROM placed p JOIN sizes s ON s.lang = p.lang WHERE p.rank <= 2000
""",
}

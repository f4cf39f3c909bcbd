"""Registered queries of the text operators, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillwise.llm import (
    bpe,
    chat,
    decontaminate,
    langid,
    merkle,
    mixing,
    neighbours,
    repair,
    secrets,
    simhash,
    spelling,
    substrings,
    toxicity,
)
from tillwise.llm.common import held_out
from tillwise.session import shared_scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 5: mixing -----------------------------------------------------------------------

MIX_SQL = r"""WITH docs AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
        FROM docs GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER w - source_size AS size_before,
         sum(weight) OVER w - weight AS weight_before,
         sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight
  FROM src WINDOW w AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST
                        ROWS UNBOUNDED PRECEDING)),
lev AS (
  SELECT CAST(all_words - 3 * size_before AS DOUBLE) AS words,
         CAST(all_weight - weight_before AS DOUBLE) AS weights
  FROM filled
  WHERE (all_words - 3 * size_before) * weight <= 3 * source_size * (all_weight - weight_before)
  ORDER BY weight_before LIMIT 1),
target AS (
  SELECT source, source_size, weight,
         least(CAST(3 * source_size AS DOUBLE), weight * words / weights) AS target
  FROM src, lev),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, floor(floor(target) / greatest(source_size, 1)) AS rounds FROM placed),
took AS (
  SELECT *, CAST(rounds * size + greatest(0, least(size, floor(target) - rounds * source_size - before))
                 AS BIGINT) AS taken FROM taking),
timed AS (
  SELECT *, CASE weight WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END AS a,
         CASE weight WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 ELSE 1.0 END AS slope,
         CASE WHEN target > 0 THEN before / target ELSE 1 END AS share
  FROM took)
SELECT doc_id, size, source_size, target, taken,
       round(CASE WHEN taken = 0 THEN 1.0
            ELSE least(1.0, 2 * share / (a + sqrt(greatest(0, a * a + 2 * slope * share)))) END, 6) AS position
FROM timed"""


@query("op5_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixing.curriculum_order(mixed).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position")
    )


# --- 2: decontamination ----------------------------------------------------------------

CLEAN_SQL = r"""WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
found AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n))
  JOIN item_windows USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op2_decontaminate", CLEAN_SQL)
def decontaminate_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark_spans(documents, table(spark, folder, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("_spans"))
    ids = F.array_sort(F.transform("_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, F.col("_n_words")).alias("contaminated"),
    )


# --- 1: near-duplicates ------------------------------------------------------------------


@query("op1_simhash_components")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


# --- 8: token ids ------------------------------------------------------------------------


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_repair_token_ids")
def repair_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return repair.encode_documents(documents, shared_scratch(spark, "token-ids"), tokenizer_path())


# --- 7: language -------------------------------------------------------------------------


@query("op7_byte_network_language")
def byte_network_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    net = langid.train(documents)
    found = langid.identify(documents.select("doc_id", "text"), net)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


# --- 10: repeated passages -----------------------------------------------------------------

REPEATS_SQL = r"""WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT phrase, min(doc_id) AS first FROM windows GROUP BY phrase HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
  FROM windows JOIN firsts USING (phrase) WHERE first < doc_id),
lost AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w
              ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(places, k)), lambda k: w[k]) END, ' '))
         AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)"""


@query("op10_cut_repeats", REPEATS_SQL)
def cut_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.cut_repeats(table(spark, folder, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


# --- 3: secrets ----------------------------------------------------------------------------


@query("op3_markov_secrets")
def markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = secrets.fit(secrets.labelled_samples(documents))
    found = secrets.find_secrets(documents.select("doc_id", "text"), model)
    counts = [secrets.count_of("_base", kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select(
        "doc_id", *counts,
        F.sha2(secrets.as_text("_base"), 256).alias("base_sha256"),
        secrets.as_text("_spans").alias("spans"),
    )


# --- 4: toxicity ---------------------------------------------------------------------------


@query("op4_subsequence_toxicity")
def subsequence_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    machine = toxicity.train(documents, table(spark, folder, "labels"))
    found = toxicity.score_documents(documents, machine)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


# --- 9: nearest neighbours -----------------------------------------------------------------


@query("op9_nn_descent_search")
def nn_descent_search(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), every=20)


# --- 6: chat formatting --------------------------------------------------------------------

CHAT_SQL = """WITH conv AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
last AS (SELECT conv_id, max(turn) AS answer FROM conv WHERE role = 'assistant' GROUP BY conv_id),
pairs AS (
  SELECT a.conv_id AS pair_id, a.answer, b.conv_id AS other, b.answer AS other_answer
  FROM last a JOIN last b ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
turns AS (
  SELECT pair_id, true AS chosen, turn, role, text FROM conv JOIN pairs ON conv_id = pair_id WHERE turn <= answer
  UNION SELECT pair_id, false, turn, role, text FROM conv JOIN pairs ON conv_id = pair_id WHERE turn < answer
  UNION SELECT pair_id, false, answer, role, text FROM conv JOIN pairs ON conv_id = other
  WHERE turn = other_answer AND role = 'assistant'),
sides AS (
  SELECT pair_id, turn, role, text, bool_or(chosen) AS l, bool_or(NOT chosen) AS r
  FROM turns GROUP BY ALL),
firsts AS (SELECT pair_id, min(turn) AS differs FROM sides WHERE NOT (l AND r) GROUP BY pair_id),
placed AS (
  SELECT t.*, differs IS NULL OR turn < differs AS common
  FROM turns t LEFT JOIN firsts USING (pair_id)),
lines AS (
  SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
         replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS tail
  FROM placed WHERE NOT common OR chosen)
SELECT pair_id, CASE WHEN common THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part,
       turn, role, head || tail AS rendered,
       CASE WHEN role = 'assistant' AND NOT common THEN CAST(length(head) AS INTEGER) ELSE 0 END AS mask_start,
       CASE WHEN role = 'assistant' AND NOT common THEN CAST(length(head || tail) AS INTEGER) ELSE 0 END AS mask_end
FROM lines"""


@query("op6_preference_pairs", CHAT_SQL)
def preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return chat.preference_segments(chat.answer_pairs(table(spark, folder, "conversations")))


# --- 11: byte-pair encoding ----------------------------------------------------------------


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_prefix_bpe")
def prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = byte_tokenizer_path()
    encoded = bpe.encode_documents(table(spark, folder, "documents"), path)
    decoded = bpe.decode_documents(encoded, path)
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


# --- 12: dataset manifest ------------------------------------------------------------------

#: CRC-32 of a list of bytes, given the table of a byte's remainders.
CRC_TABLE_SQL = """crc_rows AS (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_rows)"""
CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _field_sql(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf_sql(count: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", count, "text"))) + ")"


MERKLE_SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL},
docs AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {CRC_SQL.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 7 = 0
              THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS altered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM docs),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM uppers WHERE n > 1 GROUP BY level, pos // 2, n),
upper_path AS (
  SELECT s.lang, list(CASE WHEN u.digest IS NULL THEN 'N' WHEN (s.pos >> l.level) % 2 = 1 THEN 'L' || u.digest
                           ELSE 'R' || u.digest END ORDER BY l.level) AS path
  FROM subroots s JOIN (SELECT DISTINCT level FROM uppers WHERE n > 1) l ON true
  LEFT JOIN uppers u ON u.level = l.level AND u.pos = xor(s.pos >> l.level, 1) GROUP BY s.lang),
lower_levels AS (SELECT DISTINCT lang, level FROM nodes WHERE n > 1),
lower_path AS (
  SELECT p.lang, p.pos, list(CASE WHEN u.digest IS NULL THEN 'N' WHEN (p.pos >> l.level) % 2 = 1 THEN 'L' || u.digest
                                  ELSE 'R' || u.digest END ORDER BY l.level) AS path
  FROM placed p JOIN lower_levels l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN nodes u ON u.lang IS NOT DISTINCT FROM p.lang AND u.level = l.level AND u.pos = xor(p.pos >> l.level, 1)
  GROUP BY p.lang, p.pos),
proofs AS (
  SELECT p.*, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
  FROM placed p LEFT JOIN lower_path a ON a.lang IS NOT DISTINCT FROM p.lang AND a.pos = p.pos
  LEFT JOIN upper_path b ON b.lang IS NOT DISTINCT FROM p.lang),
folds AS (
  SELECT p.*, s.subroot, (SELECT digest FROM uppers WHERE n = 1) AS root,
         sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(altered, path), lambda d, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || d)
                     WHEN 'R' THEN sha256(d || x[2:]) ELSE sha256(d) END) AS folded_root
  FROM proofs p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds"""


@query("op12_merkle_octopus", MERKLE_SQL)
def merkle_octopus(spark: SparkSession, folder: str) -> DataFrame:
    tampered = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = F.when(chosen, merkle.leaf_digest(*tampered)).alias("altered")
    made = merkle.manifest(table(spark, folder, "documents"), F.struct("doc_id", altered))
    leaf = F.coalesce("payload.altered", "digest")
    found = made.prove().select("*", F.lit(made.root).alias("root"), merkle.folded(leaf, "steps").alias("folded_root"))
    return found.select(
        F.col("payload.doc_id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        merkle.proof_digest("steps").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# --- 13: spelling variants -----------------------------------------------------------------

# A letter beyond ASCII is two bytes of UTF-8.
UTF8_SQL = """list_concat(id_bytes, flatten(list_transform(string_split(run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
         ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)))"""

SPELLING_SQL = rf"""WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, n, list_transform(string_split(CAST(doc_id AS VARCHAR) || ':', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS id_bytes
  FROM runs),
hashed AS (SELECT run, n, {CRC_SQL.format(bytes=UTF8_SQL)} AS h FROM bytes, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (
  SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.rest FROM less a JOIN words b ON b.word = a.rest
  UNION SELECT a.rest, a.word FROM less a JOIN words b ON b.word = a.rest),
ranked AS (
  SELECT a.word, w.n AS form_n, a.near AS form, count(*) OVER (PARTITION BY a.word) AS n_near,
         row_number() OVER (PARTITION BY a.word ORDER BY w.n DESC, a.near) AS place
  FROM near a JOIN words w ON w.word = a.near),
chosen AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.form_n >= 2 * w.n THEN r.form END AS form,
         CASE WHEN r.form_n >= 2 * w.n THEN r.form_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS here, 0 AS step FROM chosen
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN chosen f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN ends USING (word)"""


@query("op13_gram_spelling", SPELLING_SQL)
def gram_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(table(spark, folder, "documents")))

"""The registered queries of this package; none has SQL that gives its rows unless named."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import decode_ids, encode_texts
from graphloom.llm.chat import format_turns, link_calls
from graphloom.llm.decontaminate import is_contaminated, scan_benchmark
from graphloom.llm.exact_topk import exact_topk
from graphloom.llm.hard_negatives import hard_negatives
from graphloom.llm.language_id import predict_language
from graphloom.llm.lm_score import score_texts
from graphloom.llm.merkle import build_manifest, field_digest, fold_path, proof_digest
from graphloom.llm.ngram_join import near_copies
from graphloom.llm.quality import score_quality
from graphloom.llm.secrets import scan_secrets
from graphloom.llm.substring_dedup import repeated_intervals
from graphloom.llm.token_files import token_round_trip

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode_ids(encode_texts(docs, WORD_BPE).drop("text"), WORD_BPE)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(n: int) -> Column:
    """crc32 of the document's id as text, modulo n; -1 for a row without id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def taught_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may teach: those of documents that are not held out."""
    return table(spark, sf_dir, "labels").filter(remainder(4) != 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = score_quality(docs, taught_labels(spark, sf_dir))
    return seen.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return near_copies(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = scan_benchmark(docs, table(spark, sf_dir, "benchmark")).drop("text")
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hits = F.size("hit_words").cast("long")
    return seen.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        is_contaminated(hits, F.col("n_words")).alias("contaminated"),
    )


def derived_calls(turns: DataFrame) -> DataFrame:
    """A call for each assistant turn: it asks for the turn's first word.  The table has no calls
    of its own, so arguments, faults and needs come from the turns themselves."""
    asked = turns.filter("role = 'assistant'")
    limit = F.length("text")
    word = F.to_json(F.struct(F.split_part("text", F.lit(" "), F.lit(1)).alias("query")))
    word = F.left(word, F.length(word) - 1)
    number = F.when(limit % 7 == 0, F.concat(F.lit('"'), limit, F.lit('"'))).otherwise(limit.cast("string"))
    need = F.concat(F.lit(',"after":{"$call":"c'), "conv_id", F.lit("-"), F.col("turn") - 2, F.lit('"}'))
    arguments = F.concat(
        word, F.lit(',"limit":'), number, F.when(F.col("turn") % 4 == 3, need).otherwise(""), F.lit("}"),
    )
    return asked.select(
        "conv_id", "turn", F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("call_id"),
        F.lit("search").alias("name"), arguments.alias("arguments"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a line, with the calls of assistant turns linked to the user's next turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    results = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"),
    )
    tools = spark.createDataFrame(
        [("search", {"query": "string", "limit": "integer", "after": "object"}, ["query", "limit"])],
        "name string, fields map<string,string>, required array<string>",
    )
    return format_turns(turns, link_calls(derived_calls(turns), results, tools))


_CHAT_SQL = """
WITH calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id,
         length(text) % 7 <> 0 AS valid,
         CASE WHEN turn % 4 = 3 THEN '"after":{"$call":"c' || conv_id || '-' || (turn - 2) || '"},' ELSE '' END
         || '"limit":' || CASE WHEN length(text) % 7 = 0 THEN '"' || length(text) || '"' ELSE '' || length(text) END
         || ',"query":' || CAST(to_json(split_part(text, ' ', 1)) AS VARCHAR) AS arguments,
         CASE WHEN turn % 4 = 3 THEN turn - 2 END AS need
  FROM conversations WHERE role = 'assistant'
), deep AS (
  SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.need)
                   THEN 1 ELSE 0 END AS depth,
         (SELECT min(u.turn) FROM conversations u
          WHERE u.role = 'user' AND u.conv_id = c.conv_id AND u.turn = c.turn + 1) AS result_turn
  FROM calls c
)
SELECT t.conv_id, t.turn, t.role, d.call_id, CAST(d.depth AS INTEGER) AS depth,
       coalesce(d.valid, FALSE) AS valid, d.result_turn IS NOT NULL AS linked,
       '{"content":' || CAST(to_json(t.text) AS VARCHAR) || ',"role":"' || t.role || '"'
       || CASE WHEN d.call_id IS NULL THEN '' ELSE
            ',"tool_call":{"arguments":{' || d.arguments || '},"depth":' || d.depth || ',"id":"' || d.call_id
            || '","name":"search"' || CASE WHEN d.result_turn IS NULL THEN '' ELSE ',"result_turn":' || d.result_turn END
            || ',"valid":' || CASE WHEN d.valid THEN 'true' ELSE 'false' END || '}' END
       || ',"turn":' || t.turn || '}' AS line
FROM conversations t LEFT JOIN deep d ON t.conv_id = d.conv_id AND t.turn = d.turn
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose remainder by 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.filter(remainder(5) != 0)
    seen = predict_language(docs.select("doc_id", "text"), train, WORD_BPE)
    return seen.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document, learned from those whose remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(7) == 2
    scored = score_texts(docs, ~held_out, WORD_BPE)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of every document, read back."""
    read = token_round_trip(table(spark, sf_dir, "documents"), WORD_BPE)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document, with a digest of the redacted text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    seen = scan_secrets(docs)
    secrets = F.filter("findings", lambda c: c["secret"])
    return seen.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.array_max(F.transform("findings", lambda c: c["score"])).alias("top_score"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


_HARD_SQL = """
WITH good AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS at,
         CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
  FROM good
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.at = c.at AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0
  GROUP BY ALL
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM positives p JOIN scored s
  ON s.anchor_id = p.anchor_id AND s.label <> s.own
 AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a tree per language, and which tampered rows it tells."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields]
    leaves = docs.select(
        "doc_id", "lang", field_digest(*map(F.col, fields)).alias("leaf"),
        F.when(remainder(7) == 0, field_digest(*changed)).alias("tampered"),
    )
    made = build_manifest(leaves, "lang", ["doc_id"])
    made = made.withColumn("folded_root", fold_path(F.coalesce("tampered", "leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _told(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_told, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_MERKLE_SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                                                     lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN crc % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS shown
  FROM numbered
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place FROM leaves
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n
), walks AS (
  SELECT doc_id, lang, leaf, place, 0 AS level, shown AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.place // 2, w.level + 1,
         sha256(CASE WHEN w.place % 2 = 0 THEN w.digest || coalesce(s.digest, '') ELSE s.digest || w.digest END),
         w.proof || coalesce(s.digest, '')
  FROM walks w
  JOIN nodes o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.place = w.place AND o.n > 1
  LEFT JOIN nodes s
    ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.place = xor(w.place, 1)
), subroots AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM upper_nodes WHERE n > 1 GROUP BY level, place // 2, n
), upper_walks AS (
  SELECT w.doc_id, w.leaf, r.subroot, r.place, 0 AS level, w.digest, w.proof
  FROM walks w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang AND r.height = w.level
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.place // 2, w.level + 1,
         sha256(CASE WHEN w.place % 2 = 0 THEN w.digest || coalesce(s.digest, '') ELSE s.digest || w.digest END),
         w.proof || coalesce(s.digest, '')
  FROM upper_walks w
  JOIN upper_nodes o ON o.level = w.level AND o.place = w.place AND o.n > 1
  LEFT JOIN upper_nodes s ON s.level = w.level AND s.place = xor(w.place, 1)
)
SELECT w.doc_id, w.leaf, w.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256,
       w.digest AS folded_root, w.digest = t.digest AS verified
FROM upper_walks w JOIN upper_nodes t ON t.n = 1 AND t.level = w.level
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of earlier documents."""
    seen = repeated_intervals(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["begin"])
    return seen.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s : s + size - 1], ' ')) AS h
  FROM (SELECT doc_id, w, least(5, len(w)) AS size, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s
        FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
), reached AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT w.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN reached r ON r.doc_id = w.doc_id
GROUP BY w.doc_id
"""

_DEDUP_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words)
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, s + k AS place
  FROM windows JOIN firsts USING (h), unnest(range(50)) AS u(k) WHERE first < doc_id
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM words)
  ANTI JOIN gone USING (doc_id, place)
  GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def _benchmark_words(column: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(coalesce({column}, ''), '{upper}', '{upper.lower()}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_BENCHMARK_SQL = f"""
WITH docs AS (SELECT doc_id, {_benchmark_words("text")} AS w FROM documents),
items AS (SELECT item_id, {_benchmark_words("text")} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, size, md5(array_to_string(w[s : s + size - 1], ' ')) AS h
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
        FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, s, size, md5(array_to_string(w[s : s + size - 1], ' ')) AS h
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, sizes)
), hits AS (
  SELECT d.doc_id, d.s, d.size, i.item_id FROM doc_windows d JOIN item_windows i ON i.size = d.size AND i.h = d.h
), hit_words AS (
  SELECT doc_id, count(DISTINCT s + k) AS n FROM hits, unnest(range(size)) AS u(k) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""

_TOPK_SQL = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(range(len(embedding))) AS at,
         CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
  FROM good
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.at = c.at AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat": op5_chat,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_token_files": op8_token_files,
    "op9_exact_topk": op9_exact_topk,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_substring_dedup": op13_substring_dedup,
}
#: The others have no SQL here: tests hold them against plain code on small tables.
CHECKS = {
    "op3_ngram_join": _NEAR_SQL,
    "op4_decontaminate": _BENCHMARK_SQL,
    "op5_chat": _CHAT_SQL,
    "op9_exact_topk": _TOPK_SQL,
    "op11_hard_negatives": _HARD_SQL,
    "op12_merkle": _MERKLE_SQL,
    "op13_substring_dedup": _DEDUP_SQL,
}

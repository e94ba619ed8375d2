"""Queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import bpe, centroids, chat, decontamination, embedding_dedup, jaccard_join, license_scan, quality, sharding, suffix_dedup, toxicity, vector_codes, warc
from panelyard.llm.common import new_folder

RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The table has no paths: a document lies in source/lang/d<id / 200>/p<id / 20>; the first of
    each folder of either depth that begins there is that folder's licence file."""
    docs = _table(spark, folder, "documents")
    base = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.floor(F.col("doc_id") / 200)))
    deep = F.concat_ws("/", base, F.concat(F.lit("p"), F.floor(F.col("doc_id") / 20)))
    path = F.when(F.col("doc_id") % 200 == 1, F.concat(base, F.lit("/LICENSE"))).when(
        F.col("doc_id") % 20 == 2, F.concat(deep, F.lit("/LICENSE"))
    ).otherwise(F.concat(deep, F.lit("/doc"), F.col("doc_id"), F.lit(".txt")))
    return license_scan.scan(docs.withColumn("path", path))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = tokenizer()
    ids = bpe.encode(_table(spark, folder, "documents"), path, pattern)
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.grade(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_resharding(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = sharding.reshard(spark, f"{folder}/documents.parquet", new_shards=8, old_shards=5)
    return rows.select(
        "row.doc_id", sharding.row_size(F.col("row.text")).alias("size"), F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, folder, "documents"), width=4, percent=85)


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"), threshold=0.98)


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"), least=100)
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = warc.numbered(_table(spark, folder, "pages"))
    archives = new_folder(spark, "warc")
    warc.write_archives(pages, warc.resolve(pages), archives)
    found = warc.joined_revisits(warc.read_archives(spark, archives))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(rows.union(more))
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.loss_texts(F.col("recovered")), "")
    return made.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows, books = vector_codes.compress(_table(spark, folder, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return vector_codes.with_label_error(rows).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256")
    )


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(_table(spark, folder, "embeddings"), k=16, rounds=3, scale=64, dim=64).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_license_scan, op3_bpe, op4_toxicity, op5_resharding, op6_jaccard_join, op7_embedding_dedup, op8_suffix_dedup, op9_warc, op10_chat_format,
        op11_vector_codes, op12_quality, op13_centroids,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATOR = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_COMPONENTS = """
reach(node, other) AS (
    SELECT node, node FROM nodes
    UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a
)"""

# Vectors as integers; products of integers below 2^53 are exact in double precision.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARED = "(list_dot_product(x.e, x.e) - 2 * list_dot_product(x.e, y.e) + list_dot_product(y.e, y.e))::BIGINT"


def _integer_rounds(rounds: int, by: str) -> str:
    """CTEs a0, c1, a1, ...: nearest entries of ``x`` (r, {by}, e) among c0 (c, {by}, e), and the next entries."""
    out = []
    for n in range(rounds + 1):
        on = f"USING ({by})" if by else ""
        join, keys = (f"JOIN c{n} y {on}", f"{by}, ") if by else (f"CROSS JOIN c{n} y", "")
        out.append(f"""a{n} AS MATERIALIZED (
    SELECT r, {keys}c, d, e FROM (SELECT x.r, {keys}y.c, x.e, {_SQUARED} AS d, row_number() OVER (PARTITION BY x.r{", " + by if by else ""} ORDER BY {_SQUARED}, y.c) AS k FROM x {join}) WHERE k = 1
)""")
        if n < rounds:
            out.append(f"""c{n + 1} AS MATERIALIZED (
    SELECT c, {keys}coalesce(m.e, o.e) AS e FROM c{n} o LEFT JOIN (
        SELECT c, {keys}list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM (
            SELECT c, {keys}i, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT c, {keys}unnest(e)::BIGINT AS v, unnest(range(len(e))) AS i FROM a{n}) GROUP BY c, {keys}i
        ) GROUP BY {keys}c
    ) m USING ({keys}c)
)""")
    return ",\n".join(out)


ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_SEPARATOR}') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_SEPARATOR}') AS w FROM benchmark
), wins AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins),
spots AS (
    SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lens WHERE len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, s, x.n, item_id FROM spots x JOIN wins y ON x.phrase = y.phrase AND x.n = y.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op6_jaccard_join": f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * i >= 85 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), nodes AS (SELECT DISTINCT a AS node FROM both_ways),{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) r ON d.doc_id = r.node""",
    "op7_embedding_dedup": f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), both_ways AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98
), nodes AS (SELECT DISTINCT a AS node FROM both_ways),{_COMPONENTS},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a), found AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON vec_id = a LEFT JOIN found ON vec_id = node""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (
    SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS x FROM p
), d AS (
    SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT)) & 31)::BIGINT, 1)), '') AS payload_digest FROM h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS m FROM d)""",
    "op10_chat_format": r"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), m AS (SELECT *, regexp_matches(role || text, '\\|<s>|</s>') OR contains(role, chr(10)) AS hard FROM r),
c AS (SELECT *, bool_or(hard) OVER (PARTITION BY conv_id) AS esc FROM m),
e AS (
    SELECT *, CASE WHEN esc THEN replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'),
        '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') ELSE text END AS shown FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(8 + length(role) + length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_vector_codes": f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS e FROM embeddings WHERE {_FINITE}
), x AS MATERIALIZED (
    SELECT r, p, vec_id, e[1 + p * len(e) // 4:(p + 1) * len(e) // 4] AS e FROM (SELECT *, unnest(range(4)) AS p FROM v)
), c0 AS MATERIALIZED (
    SELECT c, p, e FROM (SELECT row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, p, e FROM x) WHERE c < 256
), {_integer_rounds(4, "p")},
books AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c4),
coded AS (SELECT r, string_agg(lower(printf('%02x', c)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), books""",
    "op13_centroids": f"""
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}
), c0 AS MATERIALIZED (
    SELECT c, e FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM x) WHERE c < 16
), {_integer_rounds(3, "")}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c3.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c) JOIN x USING (r)""",
}

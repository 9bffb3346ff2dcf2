"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, exact, extraction, fim, jaccard, language, mixing, nearest, pii, prefix_trie, sharding, tokens
from .common import scratch, staged

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vocabulary = public_tokenizer("piece_bpe_32k.model")
    held_out = language.held_out(F.col("doc_id"))
    model = language.learn(docs.filter(~held_out), vocabulary)
    found = language.identify(docs.select("doc_id", "text"), model, vocabulary, keep=["doc_id"])
    return found.select("record.doc_id", "lang_pred", "score").withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs, shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.read_back(staged(chat.format_conversations(rows.unionByName(planted)), "formatted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    n_secret, n_found = F.size("secrets").cast("long").alias("n_secret"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_found")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), n_secret, joined("secrets").alias("secrets"), n_found)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark):
        shards = sharding.write_shards(sharding.two_pass_shuffle(docs, shards=SHARDS))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return shards.select("record.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # longer documents weigh more, up to twice as much
    weight = 1 + F.least(F.coalesce(F.length("text"), F.lit(0)), F.lit(4000)) / 4000
    mixed = mixing.mix_sources(docs, weight=weight)
    return mixed.select("record.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokens.write_tokens(docs, public_tokenizer("byte_bpe_50k.json"))
    return read_tokens(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    def each(reader, start):
        for doc_id, ids in reader.documents():
            yield {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
            start += len(ids)

    return tokens.map_files(manifest, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact.exact_groups(docs)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.conversation_trie(turns, block=100)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.build_index(vectors, k=20).search(vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_token_output": op9_token_output,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_nearest": op13_nearest,
}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

ORACLES = {
    "op8_mixing": rf"""
        WITH d AS (SELECT doc_id, source, {WORDS} AS size, (('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
            pow(2.0::DOUBLE, round(16 * log2(1 + least(coalesce(length(text), 0), 4000) / 4000.0::DOUBLE)) / 16.0::DOUBLE) AS w FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        sw AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
        f AS (SELECT *, row_number() OVER o AS rn, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
              FROM sw WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)),
        g AS (SELECT arg_min(level, rn) AS final FROM f WHERE cap / w > level),
        t AS (SELECT source, source_size, CASE WHEN final IS NULL OR cap <= final * w THEN cap ELSE final * w END AS target FROM f, g),
        b AS (SELECT source, w, sum(size)::BIGINT AS words FROM d GROUP BY source, w),
        lv AS (SELECT b.source, b.w, (target - 2 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(b.w * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
               FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY b.source ORDER BY b.w DESC)),
        rt AS (SELECT source, arg_max(level, w) AS rate FROM lv WHERE level * w <= 2 GROUP BY source),
        e AS (SELECT d.*, source_size, target, least(2.0::DOUBLE, coalesce(rate, 'infinity'::DOUBLE) * w) AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN rt ON d.source IS NOT DISTINCT FROM rt.source),
        p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
        r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS budget FROM p),
        c AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id) AS through FROM r)
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rank IS NOT NULL AND 2 * through - size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_fill_in_middle": fim.forms_sql("documents") + fim.DIGESTS_SQL,
    # a depth-d node is the list of its first d turns; CRC-32 is folded bit by bit
    "op12_prefix_trie": r"""
        WITH own AS (SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, turns, (xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, byte:
                list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, byte)), 4294967295::BIGINT)) % 6)::BIGINT AS h FROM own),
        rebuilt AS (SELECT h.c, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
        prefixes AS (SELECT c, turns[1:d] AS node, d, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
        nodes AS (SELECT node, any_value(d) AS depth, min(c) AS low, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY node),
        tree AS (SELECT n.*, p.low AS parent, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS n_children FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]),
        up AS (SELECT node[1:d] AS node, sum((n_children = 0)::BIGINT) AS leaves, sum(saved) AS saved FROM (SELECT node, n_children, CASE WHEN depth > 0 THEN (n - 1) * length(node[-1].text) ELSE 0 END AS saved, unnest(range(0, depth + 1)) AS d FROM tree) GROUP BY 1)
        SELECT low AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, n_children, leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, ends_sha256 FROM tree JOIN up USING (node)""",
}

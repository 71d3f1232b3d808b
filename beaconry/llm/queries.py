"""The registered queries of this package: thin digests of the operators' results."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles; null where the vector is null or holds a null or non-finite component."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.when(~bad, vector).alias("vector"))


def is_query() -> Column:
    return F.col("vec_id") % 100 == 0


def kept_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.language import fit_language, held_out, identify_language

    docs = documents(spark, sf_dir)
    model = fit_language(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)))
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.topk import top_k_inner_product

    scaled = F.transform("vector", lambda x: F.floor(x * 1024)).alias("vector")
    return top_k_inner_product(embeddings(spark, sf_dir).select("vec_id", scaled), is_query())


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.substrings import remove_repeated_windows

    out = remove_repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", kept_digest(F.col("text")).alias("kept_sha256"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    import public_tokenizers

    from beaconry.llm.pieces import PieceModel, decode_pieces, encode_pieces

    model = PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = decode_pieces(encode_pieces(documents(spark, sf_dir).select("doc_id", "text"), model), model)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        kept_digest(F.col("decoded")).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))).alias("round_trip"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: the smallest doc_id among its near duplicates."""
    from beaconry.llm.minhash import near_duplicate_classes

    return near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.lines import drop_frequent_lines

    out = drop_frequent_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", kept_digest(F.col("text")).alias("kept_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.neighbours import nearest_neighbours

    return nearest_neighbours(embeddings(spark, sf_dir), is_query())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.language import held_out
    from beaconry.llm.toxicity import fit_toxicity, score_toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 3, 1)))
    return score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.suffixes import remove_repeated_bytes

    # n_repeated also counts passages of more than 50 words that take fewer than 400 bytes.
    out = remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"), passage_words=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from beaconry.llm.packing import pack_power_of_two

    pieces = pack_power_of_two(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.lexical import rank_documents

    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.pages import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from beaconry.llm.alignment import align_tokenizers

    return align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_topk": op2_topk,
    "op3_substrings": op3_substrings,
    "op4_pieces": op4_pieces,
    "op5_minhash": op5_minhash,
    "op6_lines": op6_lines,
    "op7_neighbours": op7_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_suffixes": op9_suffixes,
    "op10_packing": op10_packing,
    "op11_lexical": op11_lexical,
    "op12_pages": op12_pages,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

_VECTORS = """
    vectors AS (
        SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    )"""

ORACLES: dict[str, str] = {
    "op2_topk": f"""
        WITH {_VECTORS},
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT)) AS score
            FROM (SELECT vec_id, min(v) AS v FROM vectors WHERE vec_id % 100 = 0 GROUP BY 1) q
            JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY 1, 2
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op6_lines": r"""
        WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (
            SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM numbered
        ),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ),
        frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY r""",
    "op11_lexical": r"""
        WITH item_terms AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
                FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY 1)
            ) GROUP BY 1, 2
        ),
        doc_terms AS (
            SELECT r, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
        ),
        sizes AS (SELECT r, doc_id, count(*) AS n FROM doc_terms GROUP BY 1, 2),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        counted AS (SELECT r, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY 1, 2),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM counted CROSS JOIN corpus GROUP BY 1
        ),
        impacts AS (
            SELECT r, doc_id, term, w, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS impact
            FROM counted JOIN weights USING (term) JOIN sizes USING (r) CROSS JOIN corpus
        ),
        scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM item_terms JOIN impacts USING (term) GROUP BY 1, 2, 3),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    # The supplied pages mark their text as <article>, of headings, paragraphs and inline tags.
    "op12_pages": r"""
        WITH article AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
        bare AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS a FROM article),
        decoded AS (
            SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(a, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#39;?|&#x27;?', chr(39), 'g'), '&amp;?', '&', 'g') AS a
            FROM bare
        ),
        texts AS (SELECT page_id, url, coalesce(trim(regexp_replace(a, '\s+', ' ', 'g')), '') AS text FROM decoded)
        SELECT page_id, url, text, length(text) AS n_chars FROM texts""",
}

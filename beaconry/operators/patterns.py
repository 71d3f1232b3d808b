"""Log-template mining with a fixed-depth tree: (token count, first token) buckets.

Within a bucket, texts join the most similar template (at least half of the positions
equal or wildcard, first wins), widening it where they differ, or start a new one. Only
the order of first sighting matters, and a text that already fits a template completely
changes nothing, now or later, because templates only ever widen. So:

* bodies are reduced to distinct masked texts before anything else;
* each round takes the earliest texts of every bucket, a bounded number, through the
  sequential step. Only known templates that are the best of one of these texts enter with
  them: no other can win, as templates gain likeness only by being chosen. The best is
  found in blocks of texts against slices of templates, so neither a bucket's texts nor its
  templates ever enter one task whole;
* remaining texts that fit a template completely are dropped, by an equi-join where a
  bucket's templates have few sets of wildcard positions, by the same blocks otherwise.

Where bodies hardly repeat, tables of texts or templates would be as large as the bodies. There,
a bucket that one round holds is mined and matched in one task, which returns only where templates
blank the texts that are not their own template. Rows blank their own text. Crowded buckets take the rounds.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from beaconry.functions.columns import as_column
from beaconry.functions.masking import WILDCARD, mask_body, normalized, pattern_id
from beaconry.plans.grouped import map_groups
from beaconry.plans.lineage import cut
from beaconry.plans.sizing import broadcast_if_small, is_small
from beaconry.plans.skew import join_unique

SIMILARITY = 0.5
TEXTS_PER_ROUND = 10_000
# Tokens of one block of texts, or of one slice of templates.
BLOCK_TOKENS = 4_000_000
# Buckets up to which their names are broadcast, to leave rows of all others where they are.
MAX_BUCKETS = 500_000
# Rows looked at, and how many are enough, to see whether bodies repeat; distinct texts then hold this share of all characters, or less.
SAMPLED, ENOUGH_ROWS, REPEATING = 0.01, 500, 0.1
# Sets of wildcard positions up to which a bucket's texts are blanked once for each.
FEW_SHAPES = 32
SLICES = 32
BUCKET = ["n_tokens", "first_token"]

CLUSTERS = T.StructType([
    T.StructField("n_tokens", T.IntegerType()), T.StructField("first_token", T.StringType()),
    T.StructField("ordinal", T.IntegerType()), T.StructField("template", T.StringType()),
])


def _tokens(text="text") -> Column:
    return F.split(text, " ", -1)


def _blanked(w: str = "w") -> Column:
    """``text`` with wildcards where ``w`` is true."""
    return F.array_join(F.transform(_tokens(), lambda t, i: F.when(F.get(w, i), WILDCARD).otherwise(t)), " ")


def _digest() -> Column:
    """128 bits for ``text``."""
    return F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))


def masked_texts(logs: DataFrame, body: str = "Body", max_chars: int | None = None) -> DataFrame:
    return logs.withColumn("text", normalized(mask_body(body, max_chars)))


def _bucketed(logs: DataFrame, body: str, time: str, max_chars: int | None) -> DataFrame:
    """(first_seen, plain, bucket): unmasked texts of all rows that have one. Masks neither hold nor add blanks, so they change no number of tokens."""
    head = as_column(body) if max_chars is None else F.substring(as_column(body), 1, max_chars)
    # A condition on ``plain`` would be pushed below it and normalize every body twice.
    return logs.where(head.rlike(r"(?U)\S")).select(as_column(time).alias("first_seen"), normalized(F.coalesce(head, F.lit(""))).alias("plain")).select(
        "first_seen", "plain", F.size(_tokens("plain")).alias("n_tokens"), mask_body(F.substring_index("plain", " ", 1)).alias("first_token"))


def distinct_texts(logs: DataFrame, body: str = "Body", time: str = "Timestamp", max_chars: int | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """Distinct masked texts with bucket, first sighting and number of rows, materialized once. Only those of ``buckets``, a small table, if given."""
    rows = _bucketed(logs, body, time, max_chars)
    if buckets is not None:
        rows = rows.join(F.broadcast(buckets), BUCKET)
    texts = rows.select(mask_body("plain").alias("text"), "first_seen").groupBy("text").agg(
        F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("rows")
    )
    return cut(texts.select(
        "text", "first_seen", "rows", F.size(_tokens()).alias("n_tokens"), F.substring_index("text", " ", 1).alias("first_token")
    ))


def _coded(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Token numbers, 0 for the wildcard, and the tokens in number order. Tokens stay in Arrow: one Python text each takes several times its bytes."""
    tokens = pc.split_pattern(pa.array(texts, pa.large_string()), " ").flatten()
    words = pa.concat_arrays([pa.array([WILDCARD], pa.large_string()), tokens]).dictionary_encode()
    codes = words.indices.to_numpy()[1:].astype(np.int32, copy=False)
    return codes.reshape(len(texts), -1), words.dictionary


def _most_similar(templates: np.ndarray, row: np.ndarray) -> tuple[int, int]:
    """The first template (column) that agrees with ``row`` in most positions, and in how many."""
    agree = templates == row[:, None]
    agree |= templates == 0
    counts = agree.sum(axis=0, dtype=np.int32)
    best = int(counts.argmax())
    return best, int(counts[best])


def _mined(coded: np.ndarray, n_known: int, similarity: float) -> np.ndarray:
    """The templates, a column each, after all rows of ``coded``, of which the first ``n_known`` are templates already."""
    width = coded.shape[1]
    # A column per template: one text meets all templates position by position.
    templates = np.empty((width, n_known + 16), dtype=np.int32)
    templates[:, :n_known] = coded[:n_known].T
    size = n_known
    for row in coded[n_known:]:
        if size:
            best, agree = _most_similar(templates[:, :size], row)
            if agree / width >= similarity:
                templates[templates[:, best] != row, best] = 0
                continue
        if size == templates.shape[1]:
            templates = np.concatenate([templates, np.empty_like(templates)], axis=1)
        templates[:, size] = row
        size += 1
    return templates[:, :size]


def _mine_bucket(similarity: float):
    def mine(columns, first, last, out):
        n_known = sum(columns["known"][first:last])
        coded, words = _coded(columns["text"][first:last])
        templates = _mined(coded, n_known, similarity)
        created = range(columns["created"][first], columns["created"][first] + templates.shape[1] - n_known)
        for ordinal, template in zip([*columns["ordinal"][first:first + n_known], *created], templates.T):
            out["n_tokens"].append(columns["n_tokens"][first])
            out["first_token"].append(columns["first_token"][first])
            out["ordinal"].append(ordinal)
            out["template"].append(" ".join(words.take(pa.array(template)).to_pylist()))

    return mine


BLANKS = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("_w", T.ArrayType(T.BooleanType()))])


def _blank_bucket(similarity: float):
    def blank(columns, first, last, out):
        if last - first == 1:  # its own template
            return
        coded, _ = _coded(columns["text"][first:last])
        templates = _mined(coded, 0, similarity)
        for key, row in zip(columns["_key"][first:last], coded):
            best, _ = _most_similar(templates, row)  # a template that agrees everywhere: the first that fits
            blanked = templates[:, best] != row
            if blanked.any():
                out["_key"].append(key)
                out["_w"].append(blanked.tolist())

    return blank


_SCORES = T.StructType([
    *CLUSTERS.fields[:2], T.StructField("text", T.StringType()), T.StructField("agree", T.IntegerType()), T.StructField("ordinal", T.IntegerType()),
])


def _score_block(similarity: float):
    def score(columns, first, last, out):
        n_known = sum(columns["known"][first:last])
        coded, _ = _coded(columns["text"][first:last])
        templates, width = np.ascontiguousarray(coded[:n_known].T), coded.shape[1]
        for i, row in enumerate(coded[n_known:] if n_known else (), first + n_known):
            best, agree = _most_similar(templates, row)
            if agree / width >= similarity:
                for name, value in (("n_tokens", columns["n_tokens"][i]), ("first_token", columns["first_token"][i]), ("text", columns["text"][i]),
                                    ("agree", agree), ("ordinal", columns["ordinal"][first + best])):
                    out[name].append(value)

    return score


def _rows(limit: int) -> Column:
    """Texts or templates of a bucket that one task takes: ``limit``, fewer where they are long."""
    return F.greatest(F.lit(1), F.least(F.lit(limit), F.floor(F.lit(BLOCK_TOKENS) / F.col("n_tokens")).cast("int")))


def _sized(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """``df`` with the columns of one row per bucket; rows of other buckets go."""
    return df.join(F.broadcast(sizes), BUCKET) if is_small(sizes) else join_unique(df, sizes, BUCKET, "inner")


def best_templates(texts: DataFrame, clusters: DataFrame, similarity: float = SIMILARITY, limit: int = TEXTS_PER_ROUND) -> DataFrame:
    """(bucket, text, ordinal): the most similar template of each text, the earliest of equals, if similar enough.

    Every block of a bucket's texts meets every slice of its templates in a task of its own.
    """
    sizes = cut(
        clusters.groupBy(*BUCKET).agg(F.max("ordinal").alias("last"))
        .join(texts.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")), BUCKET)
        .select(*BUCKET, "last", F.ceil(F.col("n") / _rows(limit)).cast("int").alias("blocks"))
    )
    null = lambda kind: F.lit(None).cast(kind)
    sliced = _sized(clusters, sizes).select(
        *BUCKET, F.floor(F.col("ordinal") / _rows(limit)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("template").alias("text"), "ordinal", F.lit(True).alias("known"), F.lit(0).alias("turn"),
    )
    blocks = _sized(texts, sizes).select(
        *BUCKET, F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / _rows(limit)).cast("int"))).alias("slice"),
        F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("block"), "text", null("int").alias("ordinal"), F.lit(False).alias("known"), F.lit(1).alias("turn"),
    )
    scores = map_groups(sliced.unionByName(blocks), [*BUCKET, "slice", "block"], ["turn", "ordinal"], _score_block(similarity), _SCORES)
    best = F.max(F.struct("agree", (-F.col("ordinal")).alias("o")))["o"]
    return scores.groupBy(*BUCKET, "text").agg((-best).alias("ordinal"))


def _first_fits(texts: DataFrame, clusters: DataFrame, limit: int = TEXTS_PER_ROUND) -> DataFrame:
    """(text, ordinal, template): the first template, in order of creation, that each text fits completely.

    A text fits when it equals the template after the template's wildcard positions are
    blanked in it. Where a bucket has few distinct sets of positions, texts are blanked once for
    each and equi-joined on the result; texts of other buckets meet the templates in blocks.
    """
    shapes = clusters.select(*BUCKET, F.transform(_tokens("template"), lambda t: t == WILDCARD).alias("w")).distinct()
    counts = shapes.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).head()[0] or 0
    if most <= FEW_SHAPES:
        return _blanked_fits(texts, clusters, shapes)
    crowded = broadcast_if_small(cut(counts.where(F.col("n") > FEW_SHAPES).select(*BUCKET)))
    split = lambda df, how: df.join(crowded, BUCKET, how)
    blocks = best_templates(split(texts, "left_semi"), split(clusters, "left_semi"), 1.0, limit).join(clusters, [*BUCKET, "ordinal"])
    return blocks.select("text", "ordinal", "template").unionByName(
        _blanked_fits(split(texts, "left_anti"), split(clusters, "left_anti"), split(shapes, "left_anti")))


def _blanked_fits(texts: DataFrame, clusters: DataFrame, shapes: DataFrame) -> DataFrame:
    shapes = shapes.groupBy(*BUCKET).agg(F.collect_set("w").alias("shapes"))
    if is_small(clusters):  # and so are the shapes, a projection of the clusters
        shaped, clusters = texts.join(F.broadcast(shapes), BUCKET), F.broadcast(clusters)
    else:
        shaped = join_unique(texts, shapes, BUCKET, "inner")
    candidates = shaped.select("text", *BUCKET, F.explode("shapes").alias("w")).withColumn("template", _blanked())
    fits = candidates.join(clusters, [*BUCKET, "template"])
    first = F.min(F.struct("ordinal", "template"))
    return fits.groupBy("text").agg(first.alias("f")).select("text", "f.ordinal", "f.template")


def drain_templates(texts: DataFrame, known: DataFrame | None = None, similarity: float = SIMILARITY,
                    texts_per_round: int = TEXTS_PER_ROUND) -> DataFrame:
    """Templates of ``distinct_texts`` rows, on top of already ``known`` ones.

    Returns (n_tokens, first_token, ordinal, template), ordinals in order of creation.
    """
    pending = texts.select("text", "first_seen", *BUCKET)
    clusters = known
    if clusters is not None:
        pending = cut(_unmatched(pending, clusters, texts_per_round))
    while True:
        sizes = pending.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))
        last_round = sizes.where(F.col("n") > _rows(texts_per_round)).isEmpty()
        chunk = pending if last_round else cut(_earliest(pending, texts_per_round))
        entering = chunk.select("text", "first_seen", *BUCKET, F.lit(0).alias("ordinal"), F.lit(False).alias("known"))
        created = F.lit(0).alias("created")
        if clusters is None:
            mined = map_groups(entering.select("*", created), BUCKET, ["first_seen", "text"], _mine_bucket(similarity), CLUSTERS)
            clusters = mined = cut(mined)
        else:
            chosen = best_templates(chunk, clusters, similarity, texts_per_round).select(*BUCKET, "ordinal").distinct()
            entering = entering.unionByName(clusters.join(chosen, [*BUCKET, "ordinal"]).select(
                F.col("template").alias("text"), F.lit(None).cast(entering.schema["first_seen"].dataType).alias("first_seen"),
                *BUCKET, "ordinal", F.lit(True).alias("known"),
            ))
            counts = clusters.groupBy(*BUCKET).agg((F.max("ordinal") + 1).alias("created"))
            numbered = entering.join(counts, BUCKET, "left").fillna(0, ["created"])
            # Known templates come first (turn 0), in their own order.
            turned = numbered.withColumn("turn", F.when(F.col("known"), 0).otherwise(1))
            mined = cut(map_groups(turned, BUCKET, ["turn", "first_seen", "ordinal", "text"], _mine_bucket(similarity), CLUSTERS))
            clusters = cut(clusters.select(*CLUSTERS.names).join(mined, [*BUCKET, "ordinal"], "left_anti").unionByName(mined))
        if last_round:
            return clusters
        # Earlier templates that did not change have met these texts before.
        pending = cut(_unmatched(pending.join(chunk.select("text"), "text", "left_anti"), mined, texts_per_round))


def _earliest(pending: DataFrame, limit: int) -> DataFrame:
    """The earliest texts of every bucket, found in slices so that no task ranks a whole bucket."""
    sliced = pending.withColumn("slice", F.pmod(F.hash("text"), F.lit(SLICES)))
    order = ["first_seen", "text"]
    for keys in ([*BUCKET, "slice"], BUCKET):
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        sliced = sliced.withColumn("turn", turn).where(F.col("turn") <= _rows(limit)).drop("turn")
    return sliced.drop("slice")


def _unmatched(texts: DataFrame, clusters: DataFrame, limit: int) -> DataFrame:
    return texts.join(_first_fits(texts, clusters, limit).select("text"), "text", "left_anti")


def assign_templates(texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(text, template): the first template, in order of creation, that each text fits."""
    return _first_fits(texts, clusters).select("text", "template")


def _repeating(logs: DataFrame, body: str, time: str, max_chars: int | None) -> bool:
    """Whether a table of distinct texts is a small part of the bodies, by a sample. It decides the plan only."""
    lengths = _bucketed(logs.sample(SAMPLED, seed=1), body, time, max_chars).select(mask_body("plain").alias("text")).groupBy("text").agg(
        F.count(F.lit(1)).alias("n")).select("n", F.length("text").cast("double").alias("c"))
    seen = lengths.agg(F.sum("n").alias("rows"), F.sum("c").alias("distinct"), F.sum(F.col("c") * F.col("n")).alias("all")).head()
    return (seen["rows"] or 0) >= ENOUGH_ROWS and seen["distinct"] <= REPEATING * seen["all"]


def _mined_blanks(logs: DataFrame, body: str, time: str, max_chars: int | None, limit: int) -> DataFrame:
    """(_key, _w) of the texts that are not their own template: their digest, and where their template blanks them.

    Buckets of one text need no work. Buckets whose rows fit one round are mined and matched in
    a task each; only their texts are shuffled. The others, few because each has many rows, take
    the rounds of :func:`drain_templates`.
    """
    rows = _bucketed(logs, body, time, max_chars)
    # Two seeds: buckets count as one text where 128 bits agree.
    hashes = {"a": F.xxhash64("plain"), "b": F.xxhash64(F.lit(1), "plain")}
    sizes = cut(rows.select(*BUCKET, *[h.alias(c) for c, h in hashes.items()]).groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("n"), *[(F.min(c) != F.max(c)).alias(f"{c}_differ") for c in hashes]
    ).select(*BUCKET, (F.col("n") > _rows(limit)).alias("crowded"), (F.col("a_differ") | F.col("b_differ")).alias("mixed")))
    crowded = sizes.where("mixed AND crowded").select(*BUCKET)
    mixed = sizes.where("mixed AND NOT crowded").select(*BUCKET)
    # Joins that keep rows by columns of the right side: semi and anti joins would be pushed below the bucket and compute it twice.
    if is_small(mixed, max_rows=MAX_BUCKETS):
        shared = rows.join(F.broadcast(mixed), BUCKET)
    else:
        shared = rows.join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), BUCKET, "left").where(F.col("crowded").isNull())
    # The aggregation and the groups find the rows dealt by bucket already.
    texts = shared.select(*BUCKET, mask_body("plain").alias("text"), "first_seen").repartition(*BUCKET).groupBy(*BUCKET, "text").agg(F.min("first_seen").alias("first_seen"))
    table = map_groups(texts.withColumn("_key", _digest()), BUCKET, ["first_seen", "text"], _blank_bucket(SIMILARITY), BLANKS)
    if crowded.isEmpty():
        return table
    many = distinct_texts(logs, body, time, max_chars, crowded)
    differs = F.zip_with(_tokens(), _tokens("template"), lambda t, u: t != u)
    rest = assign_templates(many, drain_templates(many, texts_per_round=limit)).where(F.col("text") != F.col("template"))
    return table.unionByName(rest.select(_digest().alias("_key"), differs.alias("_w")))


def annotate_patterns(logs: DataFrame, body: str = "Body", time: str = "Timestamp", enabled: bool = True,
                      max_chars: int | None = None, clusters: DataFrame | None = None,
                      texts_per_round: int = TEXTS_PER_ROUND) -> DataFrame:
    """Logs with PatternId and PatternTemplate (``''`` for empty bodies or when disabled).

    With ``clusters`` given, rows are matched against those templates only.
    """
    logs = logs.drop("PatternId", "PatternTemplate")
    if not enabled:
        return logs.withColumns({"PatternId": F.lit(""), "PatternTemplate": F.lit("")})
    # Long texts are joined by digest; rows of one frequent text stay spread over tasks when
    # the table is small enough to broadcast, and are split by AQE otherwise.
    keyed = masked_texts(logs, body, max_chars).withColumn("_key", _digest())
    if clusters is None and not _repeating(logs, body, time, max_chars):
        table = _mined_blanks(logs, body, time, max_chars, texts_per_round)
        template = F.when(F.col("_w").isNull(), F.col("text")).otherwise(_blanked("_w"))
    else:
        texts = distinct_texts(logs, body, time, max_chars)
        if clusters is None:
            clusters = drain_templates(texts, texts_per_round=texts_per_round)
        table = assign_templates(texts, clusters).select(_digest().alias("_key"), F.col("template").alias("_t"))
        template = F.coalesce("_t", F.lit(""))
    joined = keyed.join(broadcast_if_small(cut(table)), "_key", "left")
    return joined.withColumn("PatternTemplate", template).drop("text", *table.columns).withColumn("PatternId", pattern_id("PatternTemplate"))

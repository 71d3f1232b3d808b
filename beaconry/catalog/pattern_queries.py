"""Registered queries over log templates."""

from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.functions.masking import mask_body, pattern_id
from beaconry.operators import patterns as ops

QUERIES, ORACLES = {}, {}


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def documents(spark, d):
    """Documents as log bodies, in id order of arrival."""
    return t.read(spark, d, "documents").select(
        F.col("doc_id").alias("EventId"), F.col("text").alias("Body"),
        F.col("doc_id").alias("Timestamp"),
    )


register(
    "p1_mask_body",
    lambda spark, d: t.logs(spark, d).select("EventId", mask_body("Body").alias("Masked")),
    "logs",
    # No hex word of six or more digits occurs in these bodies, and every number is delimited.
    r"""SELECT EventId, regexp_replace(Body, '\b\d+(\.\d+)?\b', '<*>', 'g') AS Masked FROM logs""",
)
def ids(spark, d):
    """Bodies with UUIDs, hex words with and without a digit, short ones, and decimal numbers."""
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return t.read(spark, d, "events").select(F.col("event_id").alias("EventId"), F.concat_ws(
        " ", F.lit("req"), uuid, F.concat(F.lit("h="), part(1, 8)), part(9, 6), part(15, 5), F.upper(part(20, 7)), F.lit("decade facade"),
        F.concat("event_id", F.lit("."), "user_id"), F.concat(F.lit("x"), "user_id"), F.concat(F.lit("v"), part(2, 9), F.lit("-1")),
    ).alias("Body"))


# SQL has no look-ahead: a hex word with a digit is spelt out by the place of its first digit.
HEX_WORD = "|".join(rf"[a-fA-F]{{{n}}}[0-9][0-9a-fA-F]{{{5 - n},}}" for n in range(5)) + "|[a-fA-F]{5,}[0-9][0-9a-fA-F]*"
register(
    "p1_mask_ids",
    lambda spark, d: ids(spark, d).select("EventId", mask_body("Body").alias("Masked")),
    "",
    rf"""WITH h AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
    b AS (SELECT event_id AS EventId, concat_ws(' ', 'req', concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12)),
      'h=' || substr(h,1,8), substr(h,9,6), substr(h,15,5), upper(substr(h,20,7)), 'decade facade', concat(event_id, '.', user_id),
      concat('x', user_id), concat('v', substr(h,2,9), '-1')) AS Body FROM h)
    SELECT EventId, regexp_replace(regexp_replace(regexp_replace(Body, '\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\b', '<*>', 'g'),
      '\b({HEX_WORD})\b', '<*>', 'g'), '\b\d+(\.\d+)?\b', '<*>', 'g') AS Masked FROM b""",
)
register(
    "p1_mask_documents",
    lambda spark, d: documents(spark, d).select("EventId", F.length(mask_body("Body")).alias("MaskedLength")),
)
# Bodies of one event type differ in at most two of seven tokens, so every bucket is one
# template: the tokens all its bodies share, wildcards elsewhere.
MINED = r"""+m AS (SELECT EventId, string_split(regexp_replace(Body, '\b\d+(\.\d+)?\b', '<*>', 'g'), ' ') AS w FROM logs),
    b AS (SELECT CAST(len(w) AS INT) AS n, w[1] AS f, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM m),
    p AS (SELECT n, f, i, CASE WHEN count(DISTINCT tok)=1 THEN min(tok) ELSE '<*>' END AS tok FROM b GROUP BY 1,2,3),
    tp AS (SELECT n, f, string_agg(tok, ' ' ORDER BY i) AS template FROM p GROUP BY 1,2)"""
register(
    "p2_drain_templates",
    lambda spark, d: ops.drain_templates(ops.distinct_texts(t.logs(spark, d))),
    "logs",
    MINED + " SELECT n AS n_tokens, f AS first_token, CAST(0 AS INT) AS ordinal, template FROM tp",
)
# Five families in one bucket. Two of them agree in three of twelve tokens and in both variable ones,
# five twelfths, just below the half that would join them.
FAMILIES = {
    "click": "evt open page main left top bar menu item link", "signup": "evt open page form user mail name pass code send",
    "view": "evt read feed text long view auto play next stop", "error": "evt fail disk full sync lost node down warn halt",
    "purchase": "evt paid cart sum tax ship home fast gift wrap",
}


def families(spark, d):
    words = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[F.col("event_type")]
    color, switch = (F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % len(names) + 1).cast("int")) for names in (("red", "green", "blue"), ("on", "off")))
    return t.read(spark, d, "events").select(
        F.col("event_id").alias("EventId"), F.col("ts").alias("Timestamp"), F.concat_ws(" ", words, color, switch).alias("Body"))


FAMILY_SQL = "WITH f AS (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + """ END AS words FROM events),
    b AS (SELECT *, concat_ws(' ', words, ['red','green','blue'][user_id % 3 + 1], ['on','off'][user_id % 2 + 1]) AS body FROM f),
    x AS (SELECT words, body, min(ts) AS seen FROM b GROUP BY 1,2),
    o AS (SELECT words, row_number() OVER (ORDER BY min((seen, body))) - 1 AS ordinal FROM x GROUP BY 1)"""
register(
    "p2_drain_families",
    lambda spark, d: ops.drain_templates(ops.distinct_texts(families(spark, d))),
    "", FAMILY_SQL + " SELECT CAST(12 AS INT) AS n_tokens, 'evt' AS first_token, CAST(ordinal AS INT) AS ordinal, words || ' <*> <*>' AS template FROM o",
)
register(
    "p4_annotate_families",
    lambda spark, d: ops.annotate_patterns(families(spark, d)).select("EventId", "PatternId", "PatternTemplate"),
    "", FAMILY_SQL + " SELECT event_id AS EventId, words || ' <*> <*>' AS PatternTemplate, substr(sha256(words || ' <*> <*>'),1,16) AS PatternId FROM b",
)
register("p2_drain_documents", lambda spark, d: ops.drain_templates(ops.distinct_texts(documents(spark, d))))
register(
    "p3_pattern_id",
    lambda spark, d: t.read(spark, d, "documents").select("doc_id", pattern_id("text").alias("PatternId")),
    "", "SELECT doc_id, CASE WHEN text='' THEN '' ELSE substr(sha256(text),1,16) END AS PatternId FROM documents",
)
register(
    "p4_annotate_patterns",
    lambda spark, d: ops.annotate_patterns(t.logs(spark, d)).select("EventId", "PatternId", "PatternTemplate"),
    "logs",
    MINED + """ SELECT EventId, template AS PatternTemplate, substr(sha256(template),1,16) AS PatternId
    FROM m JOIN tp ON len(w)=n AND w[1]=f""",
)
register("p4_annotate_documents", lambda spark, d: ops.annotate_patterns(documents(spark, d)).select("EventId", "PatternId", "PatternTemplate"))

"""Near-duplicate classes by ProbMinHash, banding and verification.

Every text is a bag of word shingles weighted by their counts. ProbMinHash lets each shingle
arrive at exponential times, faster the larger its weight, at random components; the first
arrival at a component is its value, and a shingle stops once its next arrival is later than
all components'. Components agree with the probability Jaccard similarity of two bags.
Texts that share a band of components are candidates. Every bucket has a leader, the text with
the most bucket mates over all its bands, which is where a group of copies has its centre. Every
text meets the strongest leader of its buckets first, then those leaders it hangs together with
not yet. So a group of copies costs about one comparison a text, not one a pair. Only where a bucket is then left with several classes, texts of different classes meet each other: their
sketches chunk by chunk, which leaves the texts that are near to one of another class at all, then
those with their bags, and only links leave those tasks. Candidates are verified on their whole
bags, and links become classes by label propagation with pointer jumping, over links that shrink
from round to round to those between what is still apart. Only texts with a
bucket mate are shuffled as texts, once, whatever the size of the table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from beaconry.llm.text import bounded_batches, hash_spans, joined, mix, ranges, rolling, slices, word_spans
from beaconry.plans.lineage import scratch_path

SHINGLE, SIMILARITY = 5, 0.8
COMPONENTS, BANDS, ROWS = 256, 24, 4
# A sketch has two bits of each component. Of two texts with similarity 0.8, 51.2 of its 512 bits differ
# on average, with deviation 8.2; candidates differ in no more than 5.3 deviations above.
SKETCH_WORDS, FAR_BITS = 8, 95
# Sketches, and bytes of text, of a chunk where a whole group has to be compared.
CHUNK_TEXTS, CHUNK_BYTES = 4096, 1 << 20
_GOLD, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of all texts; a shorter text with words is one shingle of all its words."""
    buf, offsets = joined(texts)
    starts, ends, docs = word_spans(buf, offsets)
    hashes = hash_spans(buf, starts, ends)
    words = np.diff(docs)
    grams = rolling(hashes, size)
    counts = np.maximum(0, words - size + 1)
    of, value = [np.repeat(np.arange(len(words)), counts)], [grams[ranges(docs[:-1], counts)]]
    for short in np.flatnonzero((words > 0) & (words < size)):
        of.append(np.array([short]))
        value.append(rolling(hashes[docs[short]:docs[short + 1]], int(words[short])))
    of, value = np.concatenate(of), np.concatenate(value)
    # Sorting one mixed key groups equal (text, shingle) pairs.
    _, first, times = np.unique(value ^ mix(of.astype(np.uint64) + _GOLD), return_index=True, return_counts=True)
    return of[first], value[first], times


def signatures(of: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """(n, components): hash of the shingle that arrives first at each component; 0 for empty bags."""
    times = np.full(n * components, np.inf)
    winner = np.zeros(n * components, np.uint64)
    time = np.zeros(len(of))
    rate = weight.astype(float)
    step = np.zeros(1, np.uint64)
    while len(of):
        step += _GOLD
        random = mix(value + step)
        # The k-th arrival of a shingle depends on its hash and k alone, so equal shingles arrive alike.
        time = time - np.log((random >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        at = of * components + (mix(random ^ _SALT) % np.uint64(components)).astype(np.int64)
        np.minimum.at(times, at, time)
        first = time == times[at]
        winner[at[first]] = value[first]
        last = times.reshape(n, components).max(1)
        more = time < last[of]
        of, value, rate, time = of[more], value[more], rate[more], time[more]
    return winner.reshape(n, components)


def probability_jaccard(x: tuple, y: tuple) -> float:
    """Of two bags, each (sorted distinct hashes, counts). Two empty bags are alike."""
    (hx, cx), (hy, cy) = x, y
    if not len(hx) or not len(hy):
        return float(len(hx) == len(hy))
    if (cx == cx[0]).all() and (cy == cy[0]).all():
        at = np.searchsorted(hx, hy)
        at[at == len(hx)] = 0
        common = int((hx[at] == hy).sum())
        return common / (len(hx) + len(hy) - common)
    _, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    a, b = cx[ix].astype(float), cy[iy].astype(float)
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    # Shingles of x alone have ratio 0 and count first, those of y alone come last.
    below = float(cx.sum() - a.sum()) + np.cumsum(a[order])
    above = float(cy.sum()) - np.cumsum(b[order])
    # Equal ratios count as not above each other.
    last = np.searchsorted(ratio[order], ratio[order], "right") - 1
    return float((1 / (below[last] / a[order] + above[last] / b[order])).sum())


def _bags(texts: pa.Array, size: int) -> list:
    of, value, times = shingles(texts, size)
    order = np.lexsort((value, of))
    of, value, times = of[order], value[order], times[order]
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(value[a:b], times[a:b]) for a, b in zip(edges, edges[1:])]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: joins on it can be split by AQE, and nothing is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_node(text: Column) -> Column:
    """16 bytes that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(node, buckets, sketch) of each distinct text."""

    def sign(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 3 << 20):
                part = batch.slice(a, b - a)
                of, value, times = shingles(part.column(1), size)
                sig = signatures(of, value, times, b - a)
                mixed = mix(sig)
                bits = np.packbits(np.concatenate([mixed & np.uint64(1), mixed >> np.uint64(1) & np.uint64(1)], axis=1).astype(np.uint8), axis=1).view("<i8")
                bands = np.zeros((b - a, BANDS), np.uint64)
                for row in range(ROWS):
                    bands = mix(bands + sig[:, row:BANDS * ROWS:ROWS] + np.arange(BANDS, dtype=np.uint64) * _SALT)
                lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists(bands.view(np.int64), BANDS), lists(bits, SKETCH_WORDS)], names=["node", "buckets", "sketch"])

    return docs.mapInArrow(sign, "node binary, buckets array<bigint>, sketch array<bigint>").dropDuplicates(["node"])


def _near(x: str, y: str) -> Column:
    differ = [F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(SKETCH_WORDS)]
    return sum(differ[1:], differ[0]) <= FAR_BITS


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The (u, v) whose bags are similar enough. ``texts`` has (node, text), one row per text."""

    def check(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), 2 << 20):
                part = batch.slice(a, b - a)
                left, right = (_bags(part.column(i), size) for i in (2, 3))
                keep = [probability_jaccard(x, y) >= similarity - 1e-12 for x, y in zip(left, right)]
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")).hint("merge"), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")).hint("merge"), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(check, "u binary, v binary")


def _dealt(members: DataFrame, chunks: Column) -> DataFrame:
    """``members`` of each group ``g`` dealt into chunks, once for every two chunks ``a`` <= ``b`` that meet."""
    sizes = _stored(members.groupBy("g").agg(F.greatest(F.lit(1), chunks).cast("int").alias("chunks")), "groups")
    dealt = members.join(sizes.hint("merge"), "g").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("chunks", "other")


def _met(table: pa.Table):
    """For the rows of two chunks: each of the first with those of the second (behind it, if they are one) that are near and of another class."""
    chunk, sketch = table["chunk"].to_numpy(), table["sketch"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).view(np.uint64)
    roots = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    same = table["a"][0] == table["b"][0]
    left = np.flatnonzero(chunk == table["a"][0].as_py())
    right = left if same else np.flatnonzero(chunk == table["b"][0].as_py())
    for n, x in enumerate(left):
        other = right[n + 1:] if same else right
        other = other[roots[other] != roots[x]]
        yield x, other[np.bitwise_count(sketch[other] ^ sketch[x]).sum(1) <= FAR_BITS]


def _remaining_links(members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The links (u, v) between texts of different classes, within each group ``g`` of ``members``.

    A group is dealt into chunks, and every two chunks meet in a task of their own, so a group of any
    size is spread. Sketches meet first; texts that are far from all of other classes go no further.
    """

    def near(table: pa.Table) -> pa.Table:
        found = np.zeros(table.num_rows, bool)
        for x, others in _met(table):
            found[others] = True
            found[x] |= len(others) > 0
        return table.select(["g", "node"]).filter(pa.array(found))

    def link(table: pa.Table) -> pa.Table:
        nodes, bags = table["node"].to_pylist(), _bags(table["text"].combine_chunks(), size)
        found = [(nodes[x], nodes[y]) for x, others in _met(table) for y in others if probability_jaccard(bags[x], bags[y]) >= similarity - 1e-12]
        return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    sketches = _dealt(members.select("g", "node", "root", "sketch"), F.ceil(F.count(F.lit(1)) / CHUNK_TEXTS))
    close = _stored(sketches.groupBy("g", "a", "b").applyInArrow(near, "g binary, node binary").distinct(), "close")
    whole = _stored(members.join(close.hint("merge"), ["g", "node"]).join(texts.hint("merge"), "node"), "members")
    dealt = _dealt(whole, F.ceil(F.sum(F.octet_length("text")) / CHUNK_BYTES))
    return dealt.groupBy("g", "a", "b").applyInArrow(link, "u binary, v binary")


def _flat(hooks: DataFrame) -> DataFrame:
    """(node, root) with ``root`` the end of the way from each node over ``root`` to ``root``; three steps at a time."""
    while True:
        way = hooks
        for step in range(2):
            way = way.withColumn("before", F.col("root")).join(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
            way = way.select("node", "before", F.col("next").alias("root"))
        way = _stored(way.select("node", "root", (F.col("root") != F.col("before")).alias("moved")), "ways")
        hooks = way.select("node", "root")
        if way.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (u, v): the smallest node each can be reached from.

    In each round every node follows its smallest neighbour as far as that leads, and links are carried over
    to where their ends have come. Those whose ends meet go, so a link within a group is looked at once or
    twice, not in every round, and at least half of the nodes that still have links are done with.
    """
    ordered = lambda u, v: [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]
    edges, labels = _stored(links.select(*ordered("u", "v")).distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))
        hooks = _flat(_stored(hooks, "hooks"))
        of = lambda name, value: hooks.select(F.col("node").alias(name), F.col("root").alias(value))
        if labels is None:
            labels = hooks
        else:
            labels = _stored(labels.join(of("root", "on"), "root", "left").select("node", F.coalesce("on", "root").alias("root")), "labels")
        apart = edges.where("u != v").join(of("v", "b"), "v").join(of("u", "a"), "u").where("a != b")
        edges = _stored(apart.select(*ordered("a", "b")).distinct(), "links")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(node, root): the class of every distinct text, both as 16 bytes (see ``text_node``).

    Texts belong to one class if their bags of word shingles have a probability Jaccard
    similarity of at least ``similarity``, directly or through others. Words are as in
    [^ \\t-\\r]+, unchanged; a text of fewer than ``shingle`` words is one shingle, and texts
    without words (null and empty ones too) are alike. Texts without a partner are their own root.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(text_node(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = _stored(_signed(texts, shingle), "signed")
    banded = signed.select("node", F.explode("buckets").alias("bucket"))
    sizes = _stored(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = _stored(banded.join(sizes.hint("merge"), "bucket"), "shared")
    weights = _stored(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    strongest = F.max(F.struct("weight", "node")).alias("l")
    leaders = _stored(shared.join(weights, "node").groupBy("bucket").agg(strongest).select("bucket", "l.weight", F.col("l.node").alias("leader")), "leaders")
    led = shared.select("bucket", "node").join(leaders.hint("merge"), "bucket").where("node != leader")
    first = led.groupBy("node").agg(F.max(F.struct("weight", "leader")).getField("leader").alias("leader"))
    ordered = (F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v"))
    # Texts with a bucket mate, for all that follows.
    held = _stored(texts.join(weights.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        sketch = lambda name, value: signed.select(F.col("node").alias(name), F.col("sketch").alias(value))
        near = pairs.join(sketch("u", "su"), "u").join(sketch("v", "sv"), "v").where(_near("su", "sv")).select("u", "v")
        return _stored(_verified(_stored(near, "star"), held, shingle, similarity), "linked")

    met = _stored(first.select(*ordered).distinct(), "met")
    linked = links(met)
    labels = components(linked)
    root = lambda name, value: labels.select(F.col("node").alias(name), F.col("root").alias(value))
    rest = led.select("node", "leader").distinct().join(root("node", "r"), "node", "left").join(root("leader", "s"), "leader", "left")
    rest = rest.where(F.coalesce("r", "node") != F.coalesce("s", "leader")).select(*ordered).distinct().join(met, ["u", "v"], "left_anti")
    linked = linked.unionByName(links(_stored(rest, "rest")))
    labels = components(linked)

    # Buckets of more than two texts that still hold several classes, and what hangs together through them.
    rooted = shared.where("n > 2").join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    rooted = _stored(rooted, "rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("node").alias("v")).where("a != b")
    open_ = _stored(rooted.join(_stored(mixed.select("bucket", "v"), "mixed").hint("merge"), "bucket").select(F.col("node").alias("u"), "v", "root"), "open")
    if not open_.isEmpty():
        groups = components(open_.select("u", "v").distinct()).withColumnRenamed("root", "g")
        members = open_.select(F.col("u").alias("node"), "root").distinct().join(groups, "node").join(signed.select("node", "sketch"), "node")
        labels = components(linked.unionByName(_stored(_remaining_links(_stored(members, "members"), held, shingle, similarity), "linked")))
    nodes = signed.select("node").join(labels, "node", "left")
    return nodes.select("node", F.coalesce("root", "node").alias("root"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, node, class_id) of every row: class_id is the smallest id of its class, null if none has one."""
    roots = _stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "roots")
    rows = docs.select(F.col(id_col).alias(id_col), text_node(F.col(text_col)).alias("node"))
    rows = _stored(rows.join(roots.hint("merge"), "node"), "rooted-rows")
    classes = _stored(rows.groupBy("root").agg(F.min(id_col).alias("class_id")), "classes")
    return rows.join(classes.hint("merge"), "root").select(id_col, "node", "class_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, of equal ids the one with the smallest node.

    A class without ids keeps the row with the smallest node; of rows equal in both, one stays.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), text_node(F.col(text_col)).alias("node"))
    roots = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    rows = _stored(packed.select("i", "node").groupBy("i", "node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node"), "kept-rows")
    best = rows.groupBy("root").agg(F.min_by(F.struct("i", "node", "n"), F.struct(F.col("i").isNull(), F.col("i"), F.col("node"))).alias("best")).select("best.*")
    best = _stored(best, "kept")
    out = packed.join(best.withColumnsRenamed({"i": "bi", "node": "bn"}), F.col("i").eqNullSafe(F.col("bi")) & (F.col("node") == F.col("bn")))
    once = out.where("n = 1").select("row.*")
    if best.where("n > 1").isEmpty():
        return once
    # Rows that repeat id and text: one of them.
    return once.unionByName(out.where("n > 1").dropDuplicates(["i", "node"]).select("row.*"))

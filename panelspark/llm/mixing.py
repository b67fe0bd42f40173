"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame operations only.

A source's documents are dealt by a hash into about sqrt(n) blocks. Its share of the mix is some whole passes over the
blocks and a last pass that ends when its target is met, inside one document if need be. The blocks to be drawn, as bare
counts by source, are split in halves again and again (each half a draw without replacement, so the counts of
the sources follow the multivariate hypergeometric law and add up exactly) until every output shard has its quota
of each source. The shards then take consecutive, disjoint runs of the source's blocks in permuted order, and each
shard is shuffled by a hash. Windows run over blocks, never over all documents of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import WORD, read_table, scratch_table

# The weights that the sources take in turn, and the size of the mix.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SHARD_BYTES = 1 << 26


def word_count(text):
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text), F.lit(WORD))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, ...) one row a source -> with target: ``share`` of all sizes by weight, at most ``most`` times
    the source's size each, what is above shared among the others by weight. Sources in code point order, null last.

    With weight w and ceiling c, a source is at its ceiling when c / w is at most the level that the rest of the mix
    reaches over the sources of that c / w and above.
    """
    every = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                  ((F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    line = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("level", (F.col("total") - F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, -1)).cast("double"))
                               / F.sum("w").over(line.rowsBetween(0, W.unboundedFollowing))) \
        .withColumn("level", F.coalesce("level", F.col("total") / F.sum("w").over(every)))
    full = F.col("cap") <= F.col("level") * F.col("w")
    # the level of the first that is not at its ceiling holds for all of those
    ranked = ranked.withColumn("at", F.row_number().over(line))
    ranked = ranked.withColumn("rest", F.min(F.when(~full, F.struct("at", "level"))).over(every)["level"])
    return ranked.withColumn("target", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("rest") * F.col("w")))) \
        .drop("w", "cap", "total", "level", "at", "rest")


def quotas(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, ordinal) blocks to draw -> (source, shard, first, last): each shard's run of ordinals, by the splitting tree.

    ``shards`` is a power of two. A node's blocks are counted out to its halves in random order; only the counts by
    source are kept.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    tree = units.withColumn("node", F.lit(0).cast("long"))
    for level in range(shards.bit_length() - 1):
        node = W.partitionBy("node")
        place = F.row_number().over(node.orderBy(F.xxhash64("source", "ordinal", F.lit(level), F.lit(seed)), "source", "ordinal"))
        tree = tree.withColumn("place", place).withColumn("half", F.floor(F.count(F.lit(1)).over(node) / 2)) \
            .select("source", "ordinal", (F.col("node") * 2 + (F.col("place") > F.col("half")).cast("long")).alias("node"))
    counts = tree.groupBy("source", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))
    upto = F.sum("quota").over(W.partitionBy("source").orderBy("shard"))
    return counts.select("source", F.col("shard").cast("int").alias("shard"), (upto - F.col("quota")).alias("first"), (upto - 1).alias("last"))


def mix_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = 32, seed: int = 0) -> DataFrame:
    """(source, size, draw, ...) one row a document, ``draw`` its random 64-bit number -> with source_size, target, taken and
    shards (array<int>: where its passes go, the last pass's part last). taken: words the mix takes, repeats counted.

    Takes as many words of each source as its target rounded; a document is taken at most ``ceil(most)`` times.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = targets(per, weights, share, most).withColumn("words", F.round("target").cast("long")) \
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("int")) \
        .withColumn("extra", F.col("words") - F.col("passes") * F.col("source_size")) \
        .withColumn("n_blocks", F.ceil(F.sqrt("n_docs")))
    per = scratch_table(per, "sources", narrow=True)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    dealt = sized.alias("d").join(per.select("source", "n_blocks", "source_size", "target").alias("s"), same("d", "s")) \
        .select("d.*", "s.source_size", "s.target", F.pmod("d.draw", "s.n_blocks").alias("block"))
    dealt = scratch_table(dealt, "dealt")
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    draws = blocks.alias("b").join(per.alias("s"), same("b", "s")) \
        .select("b.source", "b.block", F.col("b.words").alias("block_words"), "s.extra", "s.passes", F.explode(F.sequence(F.lit(0), "s.passes")).alias("pass"))
    order = W.partitionBy("source", "pass").orderBy(F.xxhash64("source", "block", "pass", F.lit(seed)), "block")
    draws = draws.withColumn("before", F.sum("block_words").over(order) - F.col("block_words")) \
        .withColumn("room", F.when(F.col("pass") < F.col("passes"), F.col("block_words")).otherwise(F.greatest(F.lit(0), F.least("block_words", F.col("extra") - F.col("before"))))) \
        .filter((F.col("room") > 0) | (F.col("pass") < F.col("passes")))
    draws = draws.withColumn("ordinal", F.row_number().over(W.partitionBy("source").orderBy("pass", "before", F.xxhash64("source", "block", "pass", F.lit(seed)), "block")) - 1)
    draws = scratch_table(draws, "draws", narrow=True)
    runs = scratch_table(quotas(draws.select("source", "ordinal"), shards, seed), "quotas", narrow=True)
    placed = draws.alias("b").join(runs.alias("q"), same("b", "q") & F.col("b.ordinal").between(F.col("q.first"), F.col("q.last")))
    placed = placed.groupBy("b.source", "b.block").agg(
        F.max("b.passes").alias("passes"), F.max(F.when(F.col("b.pass") == F.col("b.passes"), F.col("b.room"))).alias("room"),
        F.max("b.block_words").alias("block_words"), F.transform(F.array_sort(F.collect_list(F.struct("b.pass", "q.shard"))), lambda x: x["shard"]).alias("shards"))
    placed = scratch_table(placed, "placed", narrow=True)
    both = dealt.alias("d").join(placed.alias("p"), same("d", "p") & (F.col("d.block") == F.col("p.block")), "left")
    both = both.select("d.*", F.coalesce("p.passes", F.lit(0)).alias("passes"), F.coalesce("p.room", F.lit(0)).alias("room"),
                       F.coalesce("p.block_words", F.lit(0)).alias("block_words"), F.coalesce("p.shards", F.array().cast("array<int>")).alias("shards"))
    # the one block of each source that the last pass leaves unfinished is cut document by document
    cut = (F.col("room") > 0) & (F.col("room") < F.col("block_words"))
    whole = both.filter(~cut).withColumn("last", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0)))
    line = W.partitionBy("source", "block").orderBy("draw", "size")
    part = both.filter(cut).withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("room") - (F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")))))
    out = whole.union(part)
    return out.withColumn("taken", F.col("passes") * F.col("size") + F.col("last")) \
        .withColumn("shards", F.when(F.col("taken") == 0, F.array().cast("array<int>")).when(F.col("last") > 0, F.col("shards")).otherwise(F.slice("shards", 1, F.greatest("passes", F.lit(0))))) \
        .drop("block", "passes", "room", "block_words")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """draw: from doc_id, or from the text where there is none."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))).alias("draw"))


def source_mix(docs: DataFrame, shards: int = 32, seed: int = 0, **rule) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of ``docs`` (doc_id, text, source; others are ignored).

    Null and empty texts have size 0 and are never taken; a null source is a source. Rows are drawn one by one, repeated
    or not; a run with the same rows and seed gives the same mix. An empty table gives an empty mix.
    """
    sized = scratch_table(_sized(docs, seed), "sized")
    return mix_plan(sized, shards=shards, seed=seed, **rule).select("doc_id", "size", "source_size", "target", "taken", "shards")


def shards_for(docs: DataFrame, share: float = SHARE, shard_bytes: int = SHARD_BYTES) -> int:
    """The power of two that gives the mix of ``docs`` shards of at most about ``shard_bytes`` bytes of text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return 1 << max(0, -(-int(share * size) // shard_bytes) - 1).bit_length()


def draw_mix(docs: DataFrame, shards: int | None = None, seed: int = 0, name: str | None = "mix_shard", **rule) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is drawn, each shard in random order; last its shard, as ``name``
    (None: not given). Without a number of ``shards`` it follows from the bytes of the texts.

    The pass that ends inside a document takes its first words, with the white space before each. Columns keep their
    names, whatever they are, and their values, but for text; a column called ``name`` gives way to the shard. Rows that
    agree in doc_id (without one: in text), size and source are told apart by their texts. Null and empty texts are
    never drawn; an empty table gives an empty one. A very long text is held once by each task that handles its row.
    """
    shards = shards or shards_for(docs, rule.get("share", SHARE))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)))
    plan = mix_plan(scratch_table(_sized(docs, seed), "sized"), shards=shards, seed=seed, **rule)
    # rows that share a draw number share doc_id (or text): one plan row for each (draw, size, source), numbered among equals
    twin = W.partitionBy("draw", "size", "source").orderBy(F.col("taken").desc())
    plan = scratch_table(plan.withColumn("twin", F.row_number().over(twin)), "plan").filter("taken > 0")
    # the row but for its text as one struct, so that no column of docs can be taken for one of the plan's
    rest = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), key.alias("draw"), word_count("text").alias("size"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("body"))
    rows = rows.withColumn("twin", F.row_number().over(W.partitionBy("draw", "size", "source").orderBy(F.xxhash64("body"))))
    found = rows.alias("r").join(plan.alias("p"), (F.col("r.draw") == F.col("p.draw")) & (F.col("r.size") == F.col("p.size")) & F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.twin") == F.col("p.twin")))
    drawn = found.select("r.row", "r.body", "p.size", "p.taken", F.posexplode("p.shards").alias("pass", "mix_shard"), "p.draw")
    words = F.least("size", F.col("taken") - F.col("pass") * F.col("size"))
    text = F.when(words >= F.col("size"), F.col("body")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("body", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, words.cast("int")), ""))
    out = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns if name is None or c.lower() != name.lower()]
    drawn = drawn.repartition(shards, "mix_shard").sortWithinPartitions("mix_shard", F.xxhash64("draw", "pass", F.lit(seed + 1)))
    return drawn.select(*out, *([] if name is None else [F.col("mix_shard").alias(name)]))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return source_mix(read_table(spark, sf_dir, "documents"))

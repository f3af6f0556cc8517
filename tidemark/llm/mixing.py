"""Mixing sources to target weights: exact block quotas down a tree of output shards, as DataFrame operations only.

Each source is cut into blocks of documents. A source whose target is more than its size passes whole as often as it
fits, and the rest comes from one more pass that stops at the target. The blocks of all passes are dealt to the output
shards by a splitting tree: at each node the number of blocks of every source that go left is one draw from the
multivariate hypergeometric distribution of the node's quotas, so each shard gets its exact number of blocks and each
source keeps its exact quota. A shard then takes the next blocks of a permutation of the source, so shards are disjoint. Documents are taken whole: the pass that stops at the target ends with
the document that leaves the source's words nearest to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import WORD, row_key, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2.0
#: Documents that a block holds on average.
BLOCK_DOCS = 256
#: Blocks that an output shard holds on average.
SHARD_BLOCKS = 64
SEED = 20_240_229
#: Standard deviations around the mode inside which a draw is made; what lies outside has no weight in double precision.
TAIL = 12

_TOP = 1 << 62


def word_count(text: Column | str = "text") -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, *cols: Column | str) -> Column:
    """Non-negative 62-bit hash of columns."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(_TOP - 1)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_PASSES) -> DataFrame:
    """Add ``target`` (double) to ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, take the weights in turn. Together they get ``share`` times all sizes, by
    weight; a source gets ``cap`` times its size at most, and the excess goes to the others by weight. That ends at one
    level for all that are not at their cap: sorted by cap over weight, it is the first level below its own cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("*", weight.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    by = [(F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*by).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(everything) * float(share)
    level = (whole - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    rows = rows.select("*", level.alias("level"))
    rows = rows.select("*", F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(everything).alias("at"))
    target = F.least("most", F.coalesce(F.col("at") * F.col("w"), F.col("most")))
    return rows.select(*sizes.columns, target.alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """A draw: of ``total`` blocks, ``good`` of a kind, ``drawn`` are taken; how many of the kind (u in [0, 1)).

    Weights relative to the mode, by the ratio of neighbouring terms outwards; the draw inverts their running sum.
    """
    total_d = F.greatest(total, F.lit(1)).cast("double")
    lowest, highest = F.greatest(F.lit(0).cast("long"), drawn + good - total), F.least(good, drawn)
    mode = F.floor((drawn + 1.0) * (good + 1.0) / (total_d + 2.0)).cast("long")
    mode = F.least(F.greatest(mode, lowest), highest)
    sd = F.sqrt(F.greatest(F.lit(0.0), drawn * (good / total_d) * (1 - good / total_d) * (total - drawn) / total_d))
    reach = (F.ceil(sd * TAIL) + 2).cast("long")
    given = F.struct(
        good.alias("good"), drawn.alias("drawn"), (total - good - drawn).alias("rest"), mode.alias("mode"),
        (F.least(highest, mode + reach) - mode).alias("up"), (mode - F.greatest(lowest, mode - reach)).alias("down"),
    )

    def draw(p: Column) -> Column:
        def walk(acc: Column, step: Column) -> Column:
            # Steps 0..up go up from the mode, later ones down from it.
            k = F.when(step <= p["up"], p["mode"] + step).otherwise(p["mode"] - step + p["up"])
            up_ratio = (p["good"] - k + 1.0) * (p["drawn"] - k + 1.0) / (k * (p["rest"] + k + 0.0))
            down_ratio = (k + 1.0) * (p["rest"] + k + 1.0) / ((p["good"] - k + 0.0) * (p["drawn"] - k + 0.0))
            w = (
                F.when(step == 0, F.lit(1.0))
                .when(step <= p["up"], acc["w"] * up_ratio)
                .when(step == p["up"] + 1, down_ratio)
                .otherwise(acc["w"] * down_ratio)
            )
            return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), k.alias("k"))

        def step_on(acc: Column, step: Column) -> Column:
            def settled(x: Column) -> Column:
                pick = F.when((acc["pick"] < 0) & (x["sum"] > acc["goal"]), x["k"]).otherwise(acc["pick"])
                return F.struct(x["w"].alias("w"), x["sum"].alias("sum"), x["k"].alias("k"), pick.alias("pick"), acc["goal"].alias("goal"))

            return _let(walk(acc, step), settled)

        steps = F.sequence(F.lit(0).cast("long"), p["up"] + p["down"])
        none = F.lit(-1).cast("long")
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), none.alias("k"))
        goal = u * F.aggregate(steps, start, walk, lambda acc: acc["sum"])
        begin = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), none.alias("k"), none.alias("pick"), goal.alias("goal"))
        return F.aggregate(steps, begin, step_on, lambda acc: F.when(acc["pick"] < 0, acc["k"]).otherwise(acc["pick"]))

    return _let(given, draw)


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(shard, source_no, quota, before)`` from ``quotas(source_no, quota)``: the splitting tree.

    ``shards`` is a power of two. ``before`` counts the source's blocks in earlier shards. Each level of the tree is a
    table of (node, source) rows; the sources of a node are drawn one after another, each from what is left.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    pair = F.struct("source_no", "quota")
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(pair)).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    levels = shards.bit_length() - 1
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        nodes = nodes.select("node", "q", total.alias("total"))
        nodes = nodes.select("*", (F.col("total") - F.shiftright("total", 1)).alias("half"))
        zero = F.struct(
            F.col("total").alias("total"), F.col("half").alias("left"), F.array().cast("array<bigint>").alias("taken")
        )

        salt = F.lit(level)

        def draw(acc: Column, x: Column) -> Column:
            u = _hash(seed, salt, F.col("node"), x["source_no"]) / float(_TOP)

            def left_over(k: Column) -> Column:
                taken = F.concat(acc["taken"], F.array(k))
                return F.struct((acc["total"] - x["quota"]).alias("total"), (acc["left"] - k).alias("left"), taken.alias("taken"))

            return _let(_hypergeometric(x["quota"], acc["total"], acc["left"], u), left_over)

        nodes = nodes.select("node", "q", F.aggregate("q", zero, draw, lambda acc: acc["taken"]).alias("taken"))
        left = F.zip_with("q", "taken", lambda x, k: F.struct(x["source_no"].alias("source_no"), k.alias("quota")))
        right = F.zip_with("q", "taken", lambda x, k: F.struct(x["source_no"].alias("source_no"), (x["quota"] - k).alias("quota")))
        nodes = nodes.select("node", F.posexplode(F.array(left, right)).alias("side", "q")).select(
            (F.col("node") * 2 + F.col("side")).alias("node"), "q"
        )
    rows = nodes.select(F.col("node").alias("shard"), F.inline("q"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", F.coalesce(F.sum("quota").over(earlier), F.lit(0)).alias("before"))


def _running(rows: DataFrame, by: list[str], key: str, values: dict[str, str]) -> DataFrame:
    """Add sums of columns over the earlier rows of a group in order of a hash: ``values`` is {new: column}.

    Two levels, so that no group is sorted in one task: sums of 1024 ranges of the hash, then sums inside a range.
    """
    rows = rows.withColumn("range", F.shiftright(key, 52))
    parts = rows.groupBy(*by, "range").agg(*(F.sum(c).alias(f"{new}_part") for new, c in values.items()))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    for new in values:
        parts = parts.withColumn(f"{new}_base", F.coalesce(F.sum(f"{new}_part").over(earlier), F.lit(0)))
    parts = parts.select(*by, "range", *(f"{new}_base" for new in values))
    inside = Window.partitionBy(*by, "range").orderBy(key, "block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, [*by, "range"])
    sums = [(F.col(f"{new}_base") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(new) for new, c in values.items()]
    return rows.select("*", *sums).drop("range", *(f"{new}_base" for new in values))


def _sized(docs: DataFrame, *payload: Column, seed: int) -> DataFrame:
    spot = _hash(seed, row_key())
    return docs.select("doc_id", "source", word_count("text").alias("size"), spot.alias("spot"), *payload)


def _copy_of() -> Column:
    """Key that rows of one source share if they repeat each other."""
    return F.xxhash64("spot", "source").alias("copy_of")


class Mix:
    """The plan of a mix over ``docs(doc_id, text, source)``: targets, block quotas, and the shard of each drawn block."""

    def __init__(
        self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_PASSES,
        block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
    ):
        self.docs, self.seed = docs, seed
        sized = stored(_sized(docs.select("doc_id", "text", "source"), seed=seed), "mix-sizes")
        self.repeated = stored(sized.groupBy(_copy_of()).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mix-repeated")
        self.any_repeated = not self.repeated.isEmpty()
        self.sized = self.spread(sized)
        totals = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
        words = F.round("target").cast("long")
        sources = source_targets(totals, weights, share, cap).select(
            "source", "source_size", "target", no.alias("source_no"),
            F.ceil(F.col("n") / block_docs).cast("long").alias("blocks"),
            F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
            words.alias("words"),
        )
        sources = sources.withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
        self.sources = stored(sources, "mix-sources")
        blocks = self.placed(self.sized).groupBy("source_no", "block").agg(F.sum("size").alias("words"))
        blocks = stored(blocks, "mix-blocks")
        # Blocks without a row are never drawn: a pass has as many ordinals as the source has blocks with rows.
        present = blocks.groupBy("source_no").agg(F.count("*").alias("present"))
        passes = blocks.join(self.sources.join(present, "source_no").select("source_no", "whole", "rest", "present"), "source_no")
        passes = passes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "whole")).alias("pass"))
        passes = passes.where("pass < whole or rest > 0")
        passes = passes.select("*", _hash(seed, F.lit("order"), "source_no", "pass", "block").alias("order"), F.lit(1).alias("one"))
        passes = _running(passes, ["source_no", "pass"], "order", {"sum": "words", "rank": "one"})
        drawn = passes.where("pass < whole or sum < rest").select(
            "source_no", "block", "pass", (F.col("pass") * F.col("present") + F.col("rank")).alias("ordinal"),
            F.when(F.expr("pass = whole and sum + words > rest"), F.col("rest") - F.col("sum")).alias("most"),
        )
        self.drawn = stored(self.ended(drawn), "mix-drawn")
        self.quotas = self.drawn.groupBy("source_no").agg(F.count("*").alias("quota"))
        self.shards = 1 << max(0, (self.drawn.count() // shard_blocks - 1).bit_length())

    def ended(self, drawn: DataFrame) -> DataFrame:
        """Drawn blocks with ``last`` in place of ``most``: the spot of the last document taken of a source's last block.

        Documents of that block go by spot; the one that reaches the target is taken if that is nearer to it than to stop
        ahead of it. Without a last spot all of a block is taken.
        """
        cut = drawn.where("most is not null").select("source_no", "block", "most")
        rows = self.placed(self.sized).select("source_no", "block", "spot", "size").join(cut, ["source_no", "block"])
        # One block of a source at most.
        earlier = Window.partitionBy("source_no", "block").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("left", F.col("most") - F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        last = F.max(F.when(F.expr("left > 0 and 2 * left >= size"), F.col("spot")))
        ends = rows.groupBy("source_no", "block").agg(F.coalesce(last, F.lit(-1)).cast("long").alias("end"))
        drawn = drawn.join(ends, ["source_no", "block"], "left")
        return drawn.select("source_no", "block", "pass", "ordinal", F.when(F.col("most").isNotNull(), F.col("end")).alias("last"))

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows with the spots of repeated rows told apart: copy 0 keeps its spot, the others get spots of their own.

        Copies are numbered in ranges of a written table, so that no task holds all copies of a row.
        """
        if not self.any_repeated:
            return rows
        rows = rows.withColumn("copy_of", _copy_of())
        once = rows.join(self.repeated, "copy_of", "left_anti")
        many = stored(rows.join(self.repeated, "copy_of", "left_semi"), "mix-copies")
        many = many.select(
            "*", F.col("_metadata.file_path").alias("file"), F.shiftright("_metadata.row_index", 12).alias("range"),
            F.col("_metadata.row_index").alias("at"),
        )
        part = ["copy_of", "file", "range"]
        ahead = Window.partitionBy("copy_of").orderBy("file", "range").rowsBetween(Window.unboundedPreceding, -1)
        parts = many.groupBy(*part).agg(F.count("*").alias("n"))
        parts = stored(parts.select(*part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "mix-copy-ranges")
        no = F.col("base") + F.row_number().over(Window.partitionBy(*part).orderBy("at")) - 1
        many = many.join(parts, part).withColumn("no", no)
        spot = F.when(F.col("no") > 0, _hash(self.seed, F.lit("copy"), "spot", "no")).otherwise(F.col("spot"))
        return once.unionByName(many.withColumn("spot", spot).select(*once.columns)).drop("copy_of")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's number and their block: sources join null-safely."""
        s = self.sources.select(F.col("source").alias("of"), "source_no", "source_size", "target", "blocks")
        rows = rows.join(s, rows["source"].eqNullSafe(s["of"])).drop("of")
        return rows.withColumn("block", F.col("spot") % F.col("blocks")).drop("blocks")

    def shard_of_block(self) -> DataFrame:
        """``(source_no, ordinal, shard)``: shard quotas spread to one row for each block of a source's permutation."""
        quotas = shard_quotas(self.quotas, self.shards, self.seed).where("quota > 0")
        return quotas.select("source_no", "shard", F.explode(F.expr("sequence(before, before + quota - 1)")).alias("ordinal"))

    def dealt(self) -> DataFrame:
        """``(source_no, block, dealt array<struct<pass, shard, last>>)``, a row for each block that is drawn: a written
        table, so that Spark knows its size and rows of documents are only shuffled to it where it is large."""
        rows = self.drawn.join(self.shard_of_block(), ["source_no", "ordinal"])
        rows = rows.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "last"))).alias("dealt"))
        return stored(rows, "mix-dealt")

    def draws(self, rows: DataFrame) -> DataFrame:
        """Rows with ``draws array<struct<pass, shard, last>>``: each time a document enters the mix, whole."""
        rows = self.placed(rows).join(self.dealt(), ["source_no", "block"], "left")
        none = F.array().cast("array<struct<pass:bigint,shard:bigint,last:bigint>>")
        taken = F.filter(F.coalesce("dealt", none), lambda d: d["last"].isNull() | (F.col("spot") <= d["last"]))
        return rows.withColumn("draws", taken).drop("dealt")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, n_draws)`` for every row of ``docs(doc_id, text, source, ...)``.

    ``taken`` counts the words the mix takes of the row, repeats included: a source's taken words differ from its target
    by half the size of one of its documents at most, no row gives more than ``cap`` times its size, and every run agrees.
    Null text has size 0 and is never taken. A null source is a source of its own, after all others. Repeated rows are
    spread over blocks and each counted. Other columns are not read. An empty table gives an empty result.
    """
    mix = Mix(docs, **options)
    times = F.when(F.col("size") > 0, F.size("draws")).otherwise(0).cast("long")
    return mix.draws(mix.sized).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * times).alias("taken"), times.alias("n_draws"),
    )


def mixed(docs: DataFrame, with_shard: bool = False, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, always whole.

    ``with_shard`` adds ``shard`` and ``place``: sorted by both, a shard's documents are in shuffled order. Rows without a
    word go with the block they are in.
    """
    mix = Mix(docs, **options)
    rows = mix.draws(mix.spread(_sized(docs, F.struct(*docs.columns).alias("kept_row"), seed=mix.seed)))
    rows = rows.select("kept_row", "spot", F.explode("draws").alias("d"))
    out = [F.col(f"kept_row.`{c}`") for c in docs.columns]
    if with_shard:
        out += [F.col("d.shard").alias("shard"), _hash(mix.seed, F.lit("place"), "d.shard", "d.pass", "spot").alias("place")]
    return rows.select(*out)


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """The rows of `mixed`, each shard in one partition and there in shuffled order."""
    rows = mixed(docs, with_shard=True, **options).repartition("shard").sortWithinPartitions("shard", "place")
    return rows.drop("shard", "place")

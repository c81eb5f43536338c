"""Mixing sources to target weights, with DataFrame functions only.

A source's weight is its token share to the power ``tau``, normalised.  ``tau`` in
[0, 1] is searched so that the mix meets a target entropy, or so that no source is
repeated more often than a limit.  The weights become token budgets: whole epochs
are copies of every document; the rest is taken from a permutation of the source's
documents in blocks, up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dockcast.llm.text import SPACES, checkpointed, count_words, single_blanks, sized_broadcast

BLOCK_TOKENS = 1 << 16
SPAN_BLOCKS = 4096  # blocks of a source that one task sums up
ARMS, ROUNDS = 32, 6  # the exponent is found to 32 ** -6


def _moments(totals: DataFrame, taus: list[float]) -> list[tuple[float, float, float]]:
    """(tau, entropy in nats, largest weight to share ratio) for each exponent."""
    t = F.explode(F.array(*map(F.lit, taus)))
    rows = totals.select("share", t.alias("tau")).withColumn("w", F.pow("share", "tau"))
    sums = rows.groupBy("tau").agg(
        F.sum("w").alias("z"),
        F.sum(F.col("w") * F.log("w")).alias("wl"),
        F.max(F.col("w") / F.col("share")).alias("ratio"),
    )
    cols = sums.select("tau", (F.log("z") - F.col("wl") / F.col("z")).alias("h"), (F.col("ratio") / F.col("z")).alias("r"))
    return sorted((r.tau, r.h, r.r) for r in cols.collect())


def find_exponent(totals: DataFrame, budget_share: float, repetition_limit: float | None, target_entropy: float | None) -> float:
    """Section search over [0, 1], ``ARMS`` exponents for each pass over the
    sources.  Entropy falls and repetition falls as tau rises: with a limit the
    smallest tau that meets it is taken (1 if none does); with a target entropy
    the largest tau that still reaches it (0 if none does)."""
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give either repetition_limit or target_entropy")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        taus = [low + (high - low) * i / ARMS for i in range(ARMS + 1)]
        got = _moments(totals, taus)
        if not got:
            return 1.0
        if repetition_limit is not None:
            ok = [budget_share * r <= repetition_limit for _, _, r in got]
            k = next((i for i, x in enumerate(ok) if x), None)
            if k is None:
                return 1.0
            if k == 0:
                return got[0][0]
        else:
            ok = [h < target_entropy for _, h, _ in got]
            k = next((i for i, x in enumerate(ok) if x), None)
            if k is None:
                return got[-1][0]
            if k == 0:
                return got[0][0]
        low, high = got[k - 1][0], got[k][0]
    return high if repetition_limit is not None else low


def _key(c: Column) -> Column:
    """Null sources are a source of their own."""
    return F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("name"))


def plan_mix(
    counted: DataFrame, *, budget_share: float = 1.0, repetition_limit: float | None = None, target_entropy: float | None = None
) -> DataFrame:
    """Per source: n_docs, tokens, share, tau, weight, budget, epochs, whole, part.

    ``counted`` has columns __source (key) and __tokens.  ``budget_share`` is the
    token budget as a share of all tokens.  Sources without tokens get no weight.
    """
    totals = counted.groupBy("__source").agg(F.count("*").alias("n_docs"), F.sum("__tokens").alias("tokens"))
    totals = checkpointed(totals)
    live = totals.where("tokens > 0")
    whole = live.agg(F.sum("tokens")).first()[0] or 0
    live = live.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))
    tau = find_exponent(live, budget_share, repetition_limit, target_entropy)
    z = live.agg(F.sum(F.pow("share", F.lit(tau)))).first()[0] or 1.0
    return (
        live.withColumn("tau", F.lit(tau))
        .withColumn("weight", F.pow("share", F.lit(tau)) / F.lit(z))
        .withColumn("budget", F.floor(F.col("weight") * F.lit(budget_share * whole) + F.lit(1e-6)).cast("long"))
        .withColumn("epochs", F.col("budget") / F.col("tokens"))
        .withColumn("whole", F.floor("epochs").cast("int"))
        .withColumn("part", F.col("budget") - F.col("whole") * F.col("tokens"))
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_share: float = 1.0,
    repetition_limit: float | None = None,
    target_entropy: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: its decision.

    Columns: doc_id, source, n_tokens, weight, epochs, copies, block, place.
    ``copies``: how often the document occurs in the mix.  ``place``: tokens of
    the source before it in the permutation.  With ``carry`` the row keeps all
    columns of ``docs`` and gains ``__copies`` only.

    Null texts have no tokens; documents without tokens take no budget and go
    with their source's whole epochs, plus one if their place is inside the part.
    A source without any token gets copies 0, weight 0.  A null source is a source
    of its own.  Repeated rows are documents of their own.  Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cols = [
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("__source"),
        count_words(single_blanks(text, SPACES)).alias("__tokens"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("__order"),
    ]
    # the texts are counted once; what follows works on a few numbers for each
    counted = checkpointed(docs.select(*cols))
    mixed = plan_mix(
        counted, budget_share=budget_share, repetition_limit=repetition_limit, target_entropy=target_entropy
    ).select(
        F.col("__source").alias("__s"), "weight", "epochs", "whole", "part",
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("__blocks"),
    )
    mixed = sized_broadcast(checkpointed(mixed))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(mixed, rows["__source"] == mixed["__s"], "left").drop("__s")
        return rows.withColumn("__block", F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 1), "__order"), "__blocks"), F.lit(0)))

    # a carried row is one struct, so its column names clash with nothing
    rows = dealt(docs.select(F.struct(*docs.columns).alias("__row"), *cols) if carry else counted)
    # blocks in permuted order: their numbers are hashed anew.  What lies before a block
    # is summed in two levels, so that no task holds all blocks of a source
    per_block = dealt(counted).groupBy("__source", "__block").agg(F.sum("__tokens").alias("t"))
    per_block = per_block.withColumn("__turn", F.xxhash64(F.lit(seed + 2), "__block"))
    spans = F.greatest(F.lit(1), F.ceil(F.count("*") / SPAN_BLOCKS)).cast("double")
    spans = checkpointed(per_block.groupBy(F.col("__source").alias("__s")).agg(spans.alias("__spans")))
    blocks = per_block.join(sized_broadcast(spans), F.col("__source") == F.col("__s")).drop("__s")
    # ranges of the turn, as many as the source needs
    blocks = checkpointed(blocks.withColumn("__span", F.floor((F.col("__turn") / 2.0**64 + 0.5) * F.col("__spans"))))
    whole = blocks.groupBy("__source", "__span").agg(F.sum("t").alias("t"))
    before = lambda *keys: Window.partitionBy(*keys)
    past = Window.unboundedPreceding
    whole = whole.select(
        F.col("__source").alias("__s"), F.col("__span").alias("__p"),
        F.coalesce(F.sum("t").over(before("__source").orderBy("__span").rowsBetween(past, -1)), F.lit(0)).alias("__base"),
    )
    inner = before("__source", "__span").orderBy("__turn", "__block").rowsBetween(past, -1)
    starts = blocks.withColumn("__inner", F.coalesce(F.sum("t").over(inner), F.lit(0)))
    starts = starts.join(whole, (F.col("__source") == F.col("__s")) & (F.col("__span") == F.col("__p"))).select(
        "__s", F.col("__block").alias("__b"), (F.col("__base") + F.col("__inner")).alias("__start")
    )
    rows = rows.join(starts, (rows["__source"] == starts["__s"]) & (rows["__block"] == starts["__b"]))
    inside = Window.partitionBy("__source", "__block").orderBy("__order", "doc_id", "__tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__place", F.col("__start") + F.coalesce(F.sum("__tokens").over(inside), F.lit(0)))
    extra = F.when(F.col("__place") + F.col("__tokens") <= F.col("part"), 1).otherwise(0)
    rows = rows.withColumn("__copies", F.coalesce(F.col("whole") + F.when(F.col("part") > 0, extra).otherwise(0), F.lit(0)))
    if carry:
        return rows.select("__row", "__copies")
    return rows.select(
        "doc_id", "source", F.col("__tokens").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("epochs", F.lit(0.0)).alias("epochs"), F.col("__copies").cast("int").alias("copies"),
        F.col("__block").alias("block"), F.col("__place").alias("place"),
    )


def realise(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every document as often as decided, its columns unchanged."""
    mixed = mix_sources(docs, carry=True, **params).where("__copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")

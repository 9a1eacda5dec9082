"""Mixing sources to target weights: temperature, bisected, then realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent from 0 to 1,
normalised. The exponent is bisected: it is the largest at which the weights' entropy
reaches ENTROPY of the most possible, or the least at which no source is repeated more than
REPEATS times, whichever is larger. A source's quota is its weight times the budget. It is
filled by whole passes over the source, each a permutation of its own, and a last pass that
ends before the quota would be exceeded. A permutation is cut into blocks of about
BLOCK_ROWS documents by the range of their hash, so that no task holds a source: sums of
blocks, added up by spans of blocks, place a block in its pass, and a window orders the documents
inside it. Words are counted into a narrow table first, which shares and sums are made of.

Tokens are words. Documents without a word cost nothing and are in every pass. A null source
is a source of its own, with a null name. With a single source or without tokens the exponent is 1 and
every document is taken once if the budget is all tokens. Repeated rows and ids all stay; rows of one id
are ordered by a hash of all their columns, so that only equal rows can change places. Columns of the
input named as those of the result are replaced; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm._spark import checkpoint, small, unused

ENTROPY, REPEATS = 0.95, 4.0
#: Halvings of the exponent's range: PASSES jobs of HALVINGS each.
HALVINGS, PASSES = 5, 4
BLOCK_ROWS, SPAN, SEED = 1000, 1000, "mix"
BROADCAST_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def hash01(*parts: Column | str) -> Column:
    """A number from 0 up to but not 1, from the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[(F.lit(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def exponent(sources: DataFrame, budget_share: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for `sources`, which has the column `p` of positive shares."""
    kinds = sources.count()
    if kinds < 2:
        return 1.0

    def measured(points: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy as a share of the most possible, and the most repetitions, at each point."""
        rows = sources.select("p", F.explode(F.array(*map(F.lit, points))).alias("e"))
        rows = rows.groupBy("e").agg(F.sum(F.pow("p", "e")).alias("s"), F.sum(F.pow("p", "e") * F.log("p")).alias("l"), F.max(F.pow("p", F.col("e") - 1)).alias("r"))
        ratio = (F.log("s") - F.col("e") * F.col("l") / F.col("s")) / F.log(F.lit(float(kinds)))
        return {r["e"]: (r["h"], r["r"]) for r in rows.select("e", ratio.alias("h"), (F.col("r") * budget_share / F.col("s")).alias("r")).collect()}

    def largest_flat() -> float:
        if measured([1.0])[1.0][0] >= entropy:
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
            found = measured(points)
            fits = [x for x in points if found[x][0] >= entropy]
            width = (high - low) / 2**HALVINGS
            low = max(fits, default=low)
            high = low + width
        return low

    def least_spared() -> float:
        if measured([0.0])[0.0][1] <= repeats:
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
            found = measured(points)
            fits = [x for x in points if found[x][1] <= repeats]
            width = (high - low) / 2**HALVINGS
            high = min(fits, default=high)
            low = high - width
        return high

    return max(largest_flat(), least_spared())


def source_weights(rows: DataFrame, budget: float | None, entropy: float, repeats: float) -> DataFrame:
    """For each `name` of a source: tokens, rows, weight, quota, and the passes and the tokens of the last that fill it."""
    found = checkpoint(rows.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    total = found.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    shares = found.filter("tokens > 0").select((F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    power = exponent(shares, budget / max(total, 1), entropy, repeats)
    norm = shares.agg(F.sum(F.pow("p", F.lit(power)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(power)) / F.lit(norm), 9)).otherwise(0.0)
    found = found.withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * F.lit(budget) + 0.5))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0)
    found = found.withColumn("passes", passes.cast("int")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    return found.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int"))


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_name(source: str) -> Column:
    """A name that tells a null source from all others."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))


def block_of(hashed: Column, blocks: Column) -> Column:
    return F.floor(hashed * blocks).cast("int")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    budget: float | None = None,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    seed: str = SEED,
    tokens: str | None = None,
) -> DataFrame:
    """The rows of `docs` that fill the budget (all tokens if None), with n_tokens, weight, epoch, block and slot.

    `epoch`, `block` and `slot` give the order inside a source. A row stands once for each pass that takes it.
    With `tokens`, that column of `docs` has the words of each row, and texts are not read.
    """
    count = F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")) if tokens else words_in(text)
    rows = checkpoint(docs.select(source_name(source).alias("name"), F.col(key).alias("key"), count.alias("tokens")))
    weights = checkpoint(source_weights(rows, budget, entropy, repeats).select("name", "weight", "passes", "rest", "blocks"))
    before = tokens_before(rows, weights, seed)
    own = [c for c in ("n_tokens", "weight", "epoch", "block", "slot") if c not in (key, source, text, tokens)]
    docs = docs.drop(*own)
    name, passes, rest, blocks, weight, epoch, hashed, place, upto, earlier, tie = unused(docs.withColumns(dict.fromkeys(own, F.lit(0))), "name", "passes", "rest", "blocks", "own_weight", "own_epoch", "hashed", "place", "upto", "earlier", "tie")
    whole = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    out = docs.withColumns({name: source_name(source), "n_tokens": count, tie: F.xxhash64(*whole)})
    out = out.join(small(weights.toDF(name, weight, passes, rest, blocks), BROADCAST_SOURCES), name)
    out = out.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(passes)))).withColumn(hashed, hash01(seed, F.col(epoch), F.col(key)))
    out = out.withColumn(place, block_of(F.col(hashed), F.col(blocks)))
    inside = Window.partitionBy(name, epoch, place).orderBy(hashed, key, tie)
    out = out.withColumns({"slot": F.row_number().over(inside), upto: F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.join(small(before.toDF(name, place, earlier), BROADCAST_SOURCES), [name, place], "left")
    fits = F.coalesce(earlier, F.lit(0)) + F.col(upto) <= F.col(rest)
    out = out.filter((F.col(epoch) < F.col(passes)) | fits | (F.col("n_tokens") == 0))
    return out.withColumns({"weight": F.col(weight), "epoch": F.col(epoch), "block": F.col(place)}).select(*docs.columns, *[c for c in ("n_tokens", "weight", "epoch", "block", "slot") if c not in docs.columns])


def tokens_before(rows: DataFrame, weights: DataFrame, seed: str) -> DataFrame:
    """For each `name` and block of its last pass, the tokens in the blocks before: sums over spans of SPAN blocks, then inside a span."""
    last = rows.join(small(weights, BROADCAST_SOURCES), "name").withColumn("place", block_of(hash01(seed, F.col("passes"), F.col("key")), F.col("blocks")))
    sums = checkpoint(last.groupBy("name", "place").agg(F.sum("tokens").alias("tokens")).withColumn("span", F.floor(F.col("place") / SPAN)))
    earlier = lambda *keys, order: F.coalesce(F.sum("tokens").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.groupBy("name", "span").agg(F.sum("tokens").alias("tokens")).select("name", "span", earlier("name", order="span").alias("spans"))
    inside = sums.select("name", "place", "span", earlier("name", "span", order="place").alias("inside"))
    return checkpoint(inside.join(spans, ["name", "span"]).select("name", "place", (F.col("spans") + F.col("inside")).alias("earlier")))

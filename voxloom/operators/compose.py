"""Splits, pools, groups of utterances and the parameters of their mixtures, all from hashes of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.hashing import hash01, split_by_hash, uniform
from voxloom.operators.relational import global_number
from voxloom.plans.cluster import small


def assign_pool(df: DataFrame, single: float, ov2: float, ov3: float, key: Column | None = None) -> DataFrame:
    """Pools by plain ratios; what is left to 1 goes to overlap2. The key is utt_id, else the path."""
    single, ov2, ov3 = max(0.0, single), max(0.0, ov2), max(0.0, ov3)
    ov2 += max(0.0, 1.0 - (single + ov2 + ov3))
    total = single + ov2 + ov3
    if total <= 0:
        raise ValueError("the ratios add up to 0")
    key = F.coalesce(F.nullif(F.trim("utt_id"), F.lit("")), F.col("audio_path")) if key is None else key
    x = hash01(key)
    return df.withColumn("pool", F.when(x < single / total, "single").when(x < single / total + ov2 / total, "overlap2").otherwise("overlap3"))


def assign_pool_weighted(df: DataFrame, single: float, ov2: float, ov3: float, key: str = "utt_id") -> DataFrame:
    """Pools by ratios of mixtures, so by ratios times speakers of utterances."""
    weights = [max(0.0, r) * n for n, r in enumerate((single, ov2, ov3), 1)]
    total = sum(weights)
    if total <= 0:
        raise ValueError("the ratios add up to 0")
    x = hash01(F.concat(F.col(key), F.lit("__pool_assign")))
    return df.withColumn("pool", F.when(x < weights[0] / total, "single").when(x < weights[0] / total + weights[1] / total, "overlap2").otherwise("overlap3"))


def mix_counts(df: DataFrame, ov2: float, single: float) -> DataFrame:
    """Mixtures of each type from `total`, rounded half to even; the rest is overlap3."""
    one = F.bround(F.col("total") * single).cast("bigint")
    two = F.bround(F.col("total") * ov2).cast("bigint")
    return df.withColumns({"single": one, "overlap2": two}).withColumn("overlap3", F.greatest(F.lit(0), F.col("total") - F.col("single") - F.col("overlap2")))


def split_train_only(df: DataFrame, train: float, val: float, disjoint: bool = False) -> DataFrame:
    """New splits for the datasets that have training rows only: by speaker if `disjoint`, else by utterance."""
    has = df.groupBy("dataset").agg(F.max(F.col("split").isin("val", "test")).alias("_has"))
    fresh = split_by_hash(hash01("speaker_id" if disjoint else "utt_id"), train, val)
    return df.join(small(has), "dataset").withColumn("split", F.when(F.col("_has"), F.col("split")).otherwise(fresh)).drop("_has")


def split_speakers(df: DataFrame, train: float, val: float, seed: str = "split", speaker: str = "speaker_id") -> DataFrame:
    """Speakers in exact shares, by the order of their hashes."""
    order = df.select(speaker).distinct().withColumn("_h", F.md5(F.concat_ws("__", F.lit(seed), F.col(speaker).cast("string"))))
    placed = global_number(order, ["_h", speaker], "_n")
    n = placed.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    split = F.when(F.col("_n") <= a, "train").when(F.col("_n") <= b, "val").otherwise("test")
    return df.drop("split").join(small(placed.select(speaker, split.alias("split"))), speaker)


def weighted_pick(df: DataFrame, key: str, weights: DataFrame, salt: str = "pick") -> DataFrame:
    """One dataset for each row, as likely as its weight: the least -ln(u) / w. `weights` is a table of datasets, bounded by its size check."""
    table = [(r["dataset"], float(r["weight"])) for r in weights.filter("weight > 0").orderBy("dataset").limit(1001).collect()]
    if len(table) > 1000:
        raise ValueError("over 1000 datasets")
    drawn = [F.struct((-F.log(F.greatest(uniform(F.col(key), f"{salt}_{d}"), F.lit(1e-12))) / w).alias("p"), F.lit(d).alias("d")) for d, w in table]
    return df.withColumn("dataset", F.array_min(F.array(*drawn))["d"])


def compose_disjoint(df: DataFrame, k: int, speaker: str = "speaker_id", key: str = "utt_id", seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Groups of k rows with different speakers, each row in one group at most, and the rows that fit in none.

    Rows are dealt to n // k groups in the order of their speakers, so that a speaker with at most n // k rows is in no group
    twice. Rows of larger speakers beyond that, and what is left over, are the rest; groups that they would have filled go too.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("__", F.lit(seed), F.col(key).cast("string"))))
    m = df.count() // k
    if not m:
        return df.withColumns({"group": F.lit(0), "slot": F.lit(0)}).filter("false"), df
    own = hashed.groupBy(speaker).agg(F.count("*").alias("_rows"), F.min("_h").alias("_first"))
    kept = hashed
    if own.filter(F.col("_rows") > m).limit(1).count():
        large = own.filter(F.col("_rows") > m).select(speaker, F.lit(True).alias("_large"), "_rows")
        kept = hashed.join(small(large), speaker, "left")
        inside = F.row_number().over(Window.partitionBy(speaker).orderBy("_h", key))
        few = kept.filter("_large").withColumn("_n", inside).filter(F.col("_n") <= m).drop("_n")
        kept = kept.filter("_large is null").unionByName(few).drop("_large", "_rows")
    placed = global_number(kept, [speaker, "_h", key], "_p")
    groups = placed.count() // k
    whole = placed.filter(F.col("_p") <= groups * k)
    dealt = whole.withColumns({"group": ((F.col("_p") - 1) % groups).cast("int"), "slot": F.floor((F.col("_p") - 1) / groups).cast("int")}).drop("_h", "_p")
    twice = dealt.groupBy("group").agg(F.countDistinct(speaker).alias("_s"), F.count("*").alias("_n")).filter((F.col("_s") < k) | (F.col("_n") < k)).select("group")
    good = dealt.join(small(twice), "group", "left_anti")
    rest = df.join(good.select(key), key, "left_anti")
    return good, rest


def compose_each(df: DataFrame, k: int, speaker: str = "speaker_id", key: str = "utt_id", seed: str = "each") -> DataFrame:
    """A group for each row, in which each row stands once at each place: place j is the row j shifts on, in the order of speakers.

    A shift is the rows of the largest speaker, so that speakers differ where k shifts fit into all rows; groups in which they don't are flagged.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("__", F.lit(seed), F.col(key).cast("string"))))
    placed = global_number(hashed, [speaker, "_h", key], "_p").select((F.col("_p") - 1).alias("_p"), key, speaker)
    n = placed.count()
    most = df.groupBy(speaker).count().agg(F.max("count")).first()[0] or 1
    shift = most if k * most <= n else max(1, n // k)
    slots = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = slots.select(((F.col("_p") - F.col("slot") * shift + F.lit(n) * k) % F.lit(n)).cast("long").alias("group"), "slot", key, speaker)
    same = out.groupBy("group").agg((F.countDistinct(speaker) < k).alias("repeats_speaker"))
    return out.join(same, "group")


def compose_n(df: DataFrame, k: int, length: int, speaker: str = "speaker_id", key: str = "utt_id", seed: str = "n", most_speakers: int = 100_000) -> DataFrame:
    """`length` groups of k different speakers; group i is the same for any larger length.

    The j-th speaker of a group is found by a hash among the speakers that are left, then an utterance of that speaker by a hash.
    The numbered speakers are joined, so that no group is held against all speakers.
    """
    people = global_number(df.select(speaker).distinct(), [speaker], "_n")
    n = people.count()
    if n < k:
        raise ValueError(f"{n} speakers are under {k}")
    sizes = df.groupBy(speaker).agg(F.count("*").alias("_size"))
    people = people.join(sizes, speaker).select((F.col("_n") - 1).alias("_n"), speaker, "_size")
    rows = df.select(key, speaker).withColumn("_u", F.row_number().over(Window.partitionBy(speaker).orderBy(F.md5(F.col(key).cast("string")), key)) - 1)
    groups = df.sparkSession.range(length).withColumnRenamed("id", "group")
    chosen = F.array().cast("array<bigint>")
    for j in range(k):
        draw = F.floor(hash01(F.concat_ws("__", F.lit(seed), F.col("group").cast("string"), F.lit(str(j)))) * F.lit(n - j - 1e-9)).cast("bigint")
        place = F.aggregate(F.array_sort(chosen), draw, lambda at, taken: F.when(taken <= at, at + 1).otherwise(at))
        chosen = F.concat(chosen, F.array(place))
        groups = groups.withColumn("_chosen", chosen)
        chosen = F.col("_chosen")
    slots = groups.select("group", F.posexplode("_chosen").alias("slot", "_n")).join(small(people, most_speakers), "_n")
    pick = F.floor(hash01(F.concat_ws("__", F.lit(seed), F.col("group").cast("string"), F.lit("utt"), F.col("slot").cast("string"))) * (F.col("_size") - 1e-9)).cast("int")
    return slots.withColumn("_u", pick).join(rows, [speaker, "_u"]).select("group", "slot", key, speaker)


def compose_variable(df: DataFrame, sizes: Sequence[int], group: str = "group", slot: str = "slot", seed: str = "size") -> DataFrame:
    """Groups cut to a size drawn for each from `sizes`."""
    size = F.element_at(F.array(*map(F.lit, sizes)), (F.floor(hash01(F.concat_ws("__", F.lit(seed), F.col(group).cast("string"))) * (len(sizes) - 1e-9)) + 1).cast("int"))
    return df.withColumn("size", size).filter(F.col(slot) < F.col("size"))


def anchor_compose(df: DataFrame, anchor: str, k: int, speaker: str = "speaker_id", key: str = "utt_id", seed: str = "anchor") -> DataFrame:
    """Groups of one row of the anchor dataset and k - 1 rows of others, joined on their places."""
    first = df.filter(F.col("dataset") == anchor).withColumn("_h", F.md5(F.concat_ws("__", F.lit(seed), F.col(key).cast("string"))))
    first = global_number(first, ["_h", key], "_n").select((F.col("_n") - 1).cast("int").alias("group"), F.lit(0).alias("slot"), key, "dataset", speaker)
    if k == 1:
        return first
    if k == 2:
        others = df.filter(F.col("dataset") != anchor).withColumn("_h", F.md5(F.concat_ws("__", F.lit(seed), F.col(key).cast("string"))))
        others = global_number(others, ["_h", key], "_n").select((F.col("_n") - 1).cast("int").alias("group"), F.lit(1).alias("slot"), key, "dataset", speaker)
    else:
        others, _ = compose_disjoint(df.filter(F.col("dataset") != anchor), k - 1, speaker, key, seed)
        others = others.select("group", (F.col("slot") + 1).alias("slot"), key, "dataset", speaker)
    both = first.unionByName(others)
    whole = both.groupBy("group").agg(F.count("*").alias("_n"), F.countDistinct(speaker).alias("_s")).filter((F.col("_n") == k) & (F.col("_s") == k)).select("group")
    return both.join(whole, "group", "left_semi")


def overlap_starts(df: DataFrame, kind: str, key: str = "mix_id") -> DataFrame:
    """Where the second and the third utterance of a mixture start, in whole samples of `num_samples`."""
    n = lambda i: F.get("num_samples", i)
    u = lambda salt, a, b: uniform(F.col(key), salt, a, b)
    if kind == "overlap2":
        overlap = (F.least(n(0), n(1)) * u("ov", 0.30, 0.70)).cast("long")
        return df.withColumn("starts", F.array(F.lit(0).cast("long"), F.greatest(F.lit(0), n(0) - overlap)))
    return df.withColumn("starts", F.array(F.lit(0).cast("long"), (n(0) * u("s2", 0.30, 0.60)).cast("long"), (n(0) * u("s3", 0.45, 0.75)).cast("long")))


def offsets(df: DataFrame, mode: str, key: str = "example_id", constant: int = 0) -> DataFrame:
    """Offsets of the sources of `num_samples`: constant; random where shorter ones fit beside the longest; or one after the other with a part of overlap."""
    n, x = F.col("num_samples"), F.col(key).cast("string")
    spot = lambda i: hash01(F.concat(x, F.lit("__offset"), i.cast("string")))
    if mode == "constant":
        out = F.transform(n, lambda _: F.lit(constant).cast("long"))
    elif mode == "random":
        out = F.transform(n, lambda s, i: F.floor((F.array_max(n) - s + 1) * spot(i) * F.lit(1 - 1e-9)))
    elif mode == "partial":
        out = F.transform(n, lambda s, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.floor(F.get(n, 0) * (0.3 + 0.4 * spot(i)))))
    else:
        raise ValueError(mode)
    return df.withColumn("offset", out)


def log_weights(df: DataFrame, mode: str, low: float = -2.5, high: float = 2.5, weights: Sequence[float] = (), key: str = "example_id", size: str = "num_speakers") -> DataFrame:
    """Gains of the sources, uniform or the first of `weights`, with their mean taken off."""
    spots = F.sequence(F.lit(0), F.col(size) - 1)
    if mode == "uniform":
        raw = F.transform(spots, lambda i: low + (high - low) * hash01(F.concat(F.col(key).cast("string"), F.lit("__gain"), i.cast("string"))))
    else:
        raw = F.slice(F.array(*[F.lit(float(w)) for w in weights]), 1, F.col(size))
    df = df.withColumn("_raw", raw)
    mean = F.aggregate("_raw", F.lit(0.0), lambda s, w: s + w) / F.size("_raw")
    return df.withColumn("log_weights", F.transform("_raw", lambda w: w - mean)).drop("_raw")


def snr(df: DataFrame, low: float, high: float, key: str = "example_id") -> DataFrame:
    return df.withColumn("snr", uniform(F.col(key), "snr", low, high))


def sample_hist(df: DataFrame, h: DataFrame, bin_size: float, key: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """A draw from a histogram for each row: the bin by the running probability, the place in it by the rest; the range may be cut.

    The bins are collected: they are bounded by the range over the bin size, checked here.
    """
    bins = sorted((r["bin"], r["prob"]) for r in h.limit(10_001).collect())
    if len(bins) > 10_000:
        raise ValueError("over 10,000 bins")
    parts = []
    for centre, p in bins:
        a, b = centre - bin_size / 2, centre + bin_size / 2
        x, y = max(a, low if low is not None else a), min(b, high if high is not None else b)
        if y > x:
            parts.append((x, y, p * (y - x) / bin_size))
    total, before, rows = sum(p for *_, p in parts), 0.0, []
    for x, y, p in parts:
        rows.append((x, y, before / total, p / total))
        before += p
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(r, ("x", "y", "before", "p"))]) for r in rows])
    u = hash01(F.concat(F.col(key).cast("string"), F.lit("__hist")))
    spot = F.element_at(F.filter(table, lambda r: r["before"] <= u), -1)
    df = df.withColumn("_bin", spot)
    return df.withColumn("draw", F.col("_bin.x") + (F.col("_bin.y") - F.col("_bin.x")) * F.least(F.lit(1.0), (u - F.col("_bin.before")) / F.col("_bin.p"))).drop("_bin")


def assign_rir(df: DataFrame, rirs: DataFrame, index: str = "idx", rate: int = 1) -> DataFrame:
    """The impulse response of each example: its index modulo their number."""
    n = rirs.count()
    numbered = rirs.withColumnRenamed("idx", "_rir")
    return df.withColumn("_rir", F.col(index) % max(1, n)).join(small(numbered), "_rir").drop("_rir")


def assign_noise(df: DataFrame, noise: DataFrame, p: float, low: float, high: float, seed: str = "noise", key: str = "id") -> DataFrame:
    """With probability p a noise item and its ratio to the signal; `noise` has `noise_idx` from 0."""
    n = max(1, noise.count())
    has = uniform(F.col(key), f"{seed}_on") < p
    spot = F.floor(uniform(F.col(key), f"{seed}_item") * (n - 1e-9)).cast("int")
    marked = df.withColumns({"noise_idx": F.when(has, spot), "noise_snr": F.when(has, uniform(F.col(key), f"{seed}_snr", low, high))})
    return marked.join(small(noise.withColumn("noise_idx", F.col("noise_idx").cast("int"))), "noise_idx", "left")


def augment_variants(df: DataFrame, variants: Sequence[str] = ("clean", "rir", "noise", "rir_noise"), key: str = "id") -> DataFrame:
    """A row for each variant, its id with the variant's name but for `clean`."""
    out = df.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    return out.withColumn(key, F.when(F.col("variant") == "clean", F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), F.col("variant"))))


#: Samples a second of planned mixtures.
RATE = 16000
#: Rows of a bucket that are filled into batches together, about.
PIECE_ROWS = 1000


#: Rows of 10,000 that an approximate percentile may be off, several times over.
MARGIN = 5e-4


def exact_edges(df: DataFrame, column: str, parts: int) -> DataFrame:
    """One row with `_edges`: the values at the ranks that cut the rows into `parts` like parts, of n rows the ceil(n * i / parts)-th smallest.

    Approximate percentiles bracket each edge; values inside the brackets are counted one by one, those between them together.
    """
    value = F.col(column)
    shares = [i / parts for i in range(1, parts)]
    low = [F.min(value) if p <= MARGIN else F.percentile_approx(value, p - MARGIN, 10_000) for p in shares]
    high = [F.max(value) if p >= 1 - MARGIN else F.percentile_approx(value, p + MARGIN, 10_000) for p in shares]
    marks = df.agg(F.array(*low).alias("_low"), F.array(*high).alias("_high"), F.count(value).alias("_n"))
    found = df.filter(value.isNotNull()).select(value.alias("_v")).join(F.broadcast(marks))
    inside = F.exists(F.arrays_zip("_low", "_high"), lambda m: F.col("_v").between(m["_low"], m["_high"]))
    place = F.size(F.filter("_low", lambda m: m < F.col("_v"))).alias("_place")
    counts = found.groupBy("_n", place, F.when(inside, F.col("_v")).alias("_own")).agg(F.count("*").alias("_rows"), F.min("_v").alias("_v"))
    upto = counts.withColumn("_upto", F.sum("_rows").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    return upto.agg(F.array(*[F.min(F.when(F.col("_upto") * parts >= F.col("_n") * i, F.col("_v"))) for i in range(1, parts)]).alias("_edges"))


def plan_batches(df: DataFrame, most_sec: float, buckets: int, key: str = "id", duration: str = "duration_sec", drop_last: bool = False) -> DataFrame:
    """Batches of rows of like length, none over `most_sec` unless it is a single row that is.

    Buckets are cut by length, then into pieces of about PIECE_ROWS rows by hash. The rows of a piece are taken by their hash: a
    batch is closed when the next row would make it too long. A piece's last batch is short, as no row came to close it; with `drop_last` it goes.
    """
    marked = df.join(F.broadcast(exact_edges(df, duration, buckets))).withColumn("bucket", F.size(F.filter("_edges", lambda e: e < F.col(duration))) if buckets > 1 else F.lit(0)).drop("_edges")
    pieces = marked.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PIECE_ROWS)).alias("_pieces"))
    marked = marked.join(F.broadcast(pieces), "bucket").withColumn("_piece", F.floor(hash01(key) * (F.col("_pieces") - 1e-9)).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct(F.md5(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"), F.col(duration).cast("double").alias("d"))))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0.0).cast("double").alias("fill"), F.array().cast("array<int>").alias("out"))

    def fill(done: Column, row: Column) -> Column:
        fits = (done["fill"] + row["d"] <= most_sec) | (F.size(done["out"]) == 0)
        batch = F.when(fits, done["batch"]).otherwise(done["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, done["fill"] + row["d"]).otherwise(row["d"]).alias("fill"), F.concat(done["out"], F.array(batch)).alias("out"))

    filled = marked.groupBy("bucket", "_piece").agg(rows.alias("_rows")).withColumn("_done", F.aggregate("_rows", start, fill))
    placed = filled.select("bucket", "_piece", F.col("_done.batch").alias("_last"), F.explode(F.arrays_zip(F.col("_rows"), F.col("_done.out").alias("_out"))).alias("r"))
    placed = placed.select(F.col("r._rows.k").alias(key), "_last", F.col("r._out").alias("_fill"), F.concat_ws("-", "bucket", "_piece", F.col("r._out")).alias("batch"))
    if drop_last:
        placed = placed.filter(F.col("_fill") < F.col("_last"))
    return marked.drop("_pieces", "_piece").join(placed.select(key, "batch"), key)


def plan_mixtures(df: DataFrame, kind: str, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Mixtures and their sources: groups of a pool's rows, starts and joined texts. Times are whole samples, divided once."""
    k = {"single": 1, "overlap2": 2, "overlap3": 3}[kind]
    groups, _ = compose_disjoint(df, k, seed=seed)
    groups = groups.withColumn("mix_id", F.format_string(f"{kind}_%08d", F.col("group"))).withColumn("_n", F.floor(F.col("duration_sec") * RATE))
    samples = F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col("_n").alias("n")))), lambda s: s["n"])
    starts = groups.groupBy("mix_id").agg(samples.alias("num_samples"))
    starts = starts.withColumn("starts", F.array(F.lit(0).cast("long"))) if k == 1 else overlap_starts(starts, kind)
    sources = groups.join(starts.select("mix_id", "starts"), "mix_id").withColumn("_start", F.get("starts", "slot"))
    seconds = {"start_sec": F.col("_start"), "duration_sec": F.col("_n"), "end_sec": F.col("_start") + F.col("_n")}
    sources = sources.select("mix_id", F.format_string("%s_seg%02d", "mix_id", "slot").alias("seg_id"), "dataset", "speaker_id", "utt_id", "audio_path", *[(n / RATE).alias(c) for c, n in seconds.items()], "text")
    ordered = F.array_sort(F.collect_list(F.struct("start_sec", "seg_id", "text")))
    mixes = sources.groupBy("mix_id").agg(F.count("*").cast("int").alias("num_speakers"), F.max("end_sec").alias("duration_sec"), F.array_join(F.transform(ordered, lambda s: s["text"]), " | ").alias("text"))
    return mixes.withColumn("mix_type", F.lit(kind)), sources

"""Expressions over names: files, splits, speakers, ids and times in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPLITS = {"train": "train", "validation": "val", "val": "val", "dev": "val", "test": "test"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize_name(name: Column | str, longest: int = 180) -> Column:
    """Other characters than letters, digits, `.`, `_` and `-` become `_`; runs and ends of them go."""
    safe = F.regexp_replace(F.trim(F.coalesce(_c(name), F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    return F.substring(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), 1, longest)


def wav_name(name: Column | str, fallback: Column | str) -> Column:
    """A safe file name that ends in `.wav`."""
    base = sanitize_name(F.regexp_extract(F.coalesce(_c(name), F.lit("")), r"([^/\\]*)$", 1))
    base = F.when(base == "", sanitize_name(fallback)).otherwise(base)
    return F.concat(F.regexp_replace(base, r"(?i)\.(wav|mp3|flac|ogg|m4a)$", ""), F.lit(".wav"))


def normalize_split(split: Column | str, default: str = "train") -> Column:
    low = F.lower(F.trim(F.coalesce(_c(split), F.lit(""))))
    out = F.when(low.isNull(), default)
    for name, to in SPLITS.items():
        out = out.when(low == name, to)
    return out.otherwise(default)


def split_from_filename(name: Column | str, default: str = "unknown", anywhere: bool = False) -> Column:
    """The split that a file's name begins with, or has anywhere in it."""
    low = F.lower(F.regexp_extract(_c(name), r"([^/\\]*)$", 1))
    has = low.contains if anywhere else low.startswith
    return F.when(has("train"), "train").when(has("test"), "test").when(has("val") | has("dev"), "val").otherwise(default)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def speaker_of(dataset: Column | str, utt_id: Column | str, path: Column | str) -> Column:
    """The speaker as each dataset writes it into ids and file names; else the id."""
    ds, uid, stem = F.lower(_c(dataset)), F.coalesce(_c(utt_id), F.lit("")), F.upper(_stem(F.coalesce(_c(path), F.lit(""))))
    parts = F.split(uid, "__")
    last = F.element_at(parts, -1)
    third = F.get(parts, 2)
    two = lambda x, sep: F.array_join(F.slice(F.split(x, sep), 1, 2), sep)
    in_stem = F.regexp_extract(stem, r"(VI_[^_]*)", 1)
    own = F.when(uid != "", uid).otherwise(stem)
    viet = F.when(third.startswith("VI_"), F.upper(two(third, "_"))).when(in_stem != "", in_stem).otherwise(own)
    giga = F.when(F.size(F.split(last, "-")) >= 2, two(last, "-")).otherwise(last)
    return F.when(ds == "vietspeech", viet).when(ds == "vivos", F.upper(F.get(F.split(last, "_"), 0))).when(ds == "gigaspeech2_vi", giga).otherwise(own)


def audio_path_of(root: str, split: Column | str, utt_id: Column | str) -> Column:
    """`root/split/a/b/a-b-c.wav` for ids of three parts, a level less for two, none for one."""
    parts = F.split(_c(utt_id), "-")
    folders = F.slice(parts, 1, F.greatest(F.lit(0), F.least(F.lit(2), F.size(parts) - 1)))
    return F.concat_ws("/", F.lit(root), _c(split), folders, F.concat(_c(utt_id), F.lit(".wav")))


def row_utt_id(dataset: Column | str, split: Column | str, part: Column | str, row: Column | str) -> Column:
    """`dataset__split__pNNNNN__rNNNNNNNN`."""
    return F.format_string("%s__%s__p%05d__r%08d", _c(dataset), _c(split), _c(part).cast("bigint"), _c(row).cast("bigint"))


def sid_utt_id(dataset: Column | str, split: Column | str, sid: Column | str, row: Column | str) -> Column:
    """`dataset__split__sid`; without a sid, `r` and the row's eight digits stand for it."""
    own = F.nullif(F.coalesce(_c(sid).cast("string"), F.lit("")), F.lit(""))
    return F.concat_ws("__", _c(dataset), _c(split), F.coalesce(own, F.format_string("r%08d", _c(row).cast("bigint"))))


def path_utt_id(dataset: Column | str, split: Column | str, path: Column | str) -> Column:
    """`dataset__split__stem__` and the first eight digits of the path's md5."""
    return F.concat_ws("__", _c(dataset), _c(split), sanitize_name(_stem(_c(path))), F.substring(F.md5(_c(path)), 1, 8))


def parse_seg_times(name: Column | str) -> Column:
    """(start, end) in seconds from names like `x_12.50_15.75.wav`; null where there are none."""
    at = lambda k: F.regexp_extract(_c(name), r"_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)\.[A-Za-z0-9]+$", k).try_cast("double")
    return F.struct(at(1).alias("start_sec"), at(2).alias("end_sec"))


def parse_dataset_name(name: Column | str) -> Column:
    """(dataset, seed) from `name_rngN`; test sets with a seed raise an error, as they must not vary."""
    seed = F.regexp_extract(_c(name), r"_rng(\d*)$", 1)
    base = F.regexp_replace(_c(name), r"_rng\d*$", "")
    seeded = _c(name).rlike(r"_rng\d*$")
    refused = seeded & (base.contains("test") | base.contains("eval"))
    seed = F.when(seeded & (seed == ""), F.lit(0)).when(seeded, seed.try_cast("bigint"))
    return F.when(F.assert_true(~refused, F.lit("test sets take no seed")).isNull(), F.struct(base.alias("dataset"), seed.alias("seed")))

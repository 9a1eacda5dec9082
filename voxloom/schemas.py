"""Fixed schemas of the tables, and the projection that makes a table fit one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


MANIFEST = ("utt_id string, dataset string, split string, audio_path string, text string, text_path string, source_file string, source_row bigint, source_audio_path string")
WIDE_MANIFEST = (
    "utt_id string, dataset string, split string, audio_path string, text string, text_path string, source_file string, source_row bigint, source_audio_path string, "
    "speaker_id string, recording_id string, start_sec double, end_sec double, duration_sec double, sample_rate int, num_samples bigint"
)
VAD_SEGMENTS = ("src string, segment_path string, duration_sec double")
DENOISED_SEGMENTS = ("src string, segment_path string, denoised_path string, start_sec double, end_sec double, duration_sec double")
VOTES = (
    "src string, segment_path string, denoised_path string, start_sec double, end_sec double, duration_sec double, zipformer_text string, zipformer_tokens array<string>, "
    "zipformer_timestamps array<double>, gipformer_text string, zipformer_norm string, gipformer_norm string, decision_reason string, accepted boolean, final_wav string, final_text string"
)
ACCEPTED = ("final_wav string, final_text string, duration_sec double, src string, start_sec double, end_sec double")
RUN = ("start_time double, end_time double, duration double, text string, start_word_idx int, end_word_idx int")
TIMED_WORD = ("raw string, norm string, start double, end double")
MIXTURE = ("mix_id string, dataset string, split string, mix_type string, num_speakers int, audio_path string, metadata_path string, text string")
MIX_SOURCE = ("seg_id string, dataset string, speaker_id string, utt_id string, audio_path string, start_sec double, duration_sec double, end_sec double, text string")
MIX_METADATA = f"{MIXTURE}, sources array<struct<{MIX_SOURCE}>>, _corrupt_record string"
SUPERVISION = ("id string, recording_id string, start double, duration double, channel int, text string, speaker string")
RECORDING = ("id string, sources array<struct<type:string,channels:array<int>,source:string>>, sampling_rate int, num_samples bigint, duration double")
CUT = (
    f"id string, start double, duration double, channel int, recording struct<{RECORDING}>, supervisions array<struct<{SUPERVISION}>>, "
    f"tracks array<struct<cut:struct<supervisions:array<struct<{SUPERVISION}>>>>>"
)
VOCABULARY = ("token string, id int")
LEDGER = ("timestamp timestamp, name string, source_dir string, compressed_bytes bigint, sha256 string, parts int, status string")


def conform(df: DataFrame, schema: str | T.StructType, keep: bool = False) -> DataFrame:
    """The columns of `schema` in its order and types: what is missing is null, what cannot be cast too; other columns stay only if `keep`."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    own = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return df.select(*own, *[F.col(f"`{c}`") for c in df.columns if keep and c not in schema.names])

"""Secret scan: three patterns, and a token-efficiency test for random strings.

Random strings take many tokens for their length under a byte-pair vocabulary: a run of
letters and digits with fewer than `MAX_RATIO` characters a token is a secret, unless it
is a known digest or identifier. Parts between separators are judged too: a form of names,
paths or slugs excuses a run only if each part is plain, that is a short number or a word of
one case that is itself token-efficient, and stretches of parts that are not plain are held
against the vocabulary by themselves. Runs of under MIN_RUN characters are not judged. The vocabulary file is read once on the driver and goes
to the tasks as a broadcast of its bytes, whose size is bounded.

Null and empty texts have no spans. Runs of any length are judged whole. Repeated rows
and ids all stay. Spans are in code points, the end exclusive; spans of the patterns stay
as they are, and a random string inside one of them is not told again; what they leave of a run is judged like a run.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm._spark import map_texts, unused

VOCABULARY = os.environ.get("VOXLOOM_TIKTOKEN", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Vocabularies over this size are not broadcast but refused.
MAX_VOCABULARY_BYTES = 16_000_000
#: How words, numbers, marks and spaces are told apart before pairs are merged.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RATIO, MIN_RUN = 2.2, 20
REDACTED = "[SECRET]"

# Kinds in the order of their listing, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ASSIGN_HINTS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
PART = re.compile(r"[A-Za-z0-9]+")
#: A part that may be plain: a short number, or a word of one case, maybe with a short number behind it.
PLAIN = re.compile(r"[0-9]{1,14}|([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,6}")
#: Words up to this length are plain whatever their tokens.
SHORT = 3
#: Digests by their length in hexadecimal, and identifiers by their form.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
KNOWN = re.compile(
    r"""(?ix: [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}   # UUID
    | [0-9+/_=-]+                                                            # numbers, dates, telephone numbers
    | (?:19|20)[0-9]{2}-?[0-9]{2}-?[0-9]{2}T[0-9-]+Z?                        # time stamps
    )"""
)


def assignments(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, "assign") for a, b in assignments(text)]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of MIN_RUN characters or more that hold a letter, of what the sorted spans in `taken` leave of a text."""
    first = 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while first < len(taken) and taken[first][1] <= at:
            first += 1
        own, place = [], first
        while place < len(taken) and taken[place][0] < end:
            own.append((at, taken[place][0]))
            at = max(at, taken[place][1])
            place += 1
        for a, b in (*own, (at, end)):
            if b - a >= MIN_RUN and any(c.isalpha() for c in text[a:b]):
                yield a, b


def is_known(run: str) -> bool:
    """A digest of a usual length, or an identifier of a usual form."""
    bare = run.strip("+/_=-")
    return bool(DIGEST.fullmatch(bare) and len(bare) in DIGEST_LENGTHS) or bool(KNOWN.fullmatch(bare))


def is_dense(run: str, encoder: tiktoken.Encoding) -> bool:
    """Fewer than MAX_RATIO characters a token."""
    return len(run) < MAX_RATIO * len(encoder.encode_ordinary(run))


def is_plain(part: str, encoder: tiktoken.Encoding) -> bool:
    """A short number, or a word of one case that takes few tokens."""
    m = PLAIN.fullmatch(part)
    return bool(m) and (not m[1] or len(m[1]) <= SHORT or not is_dense(m[1], encoder))


def random_spans(run: str, encoder: tiktoken.Encoding) -> list[tuple[int, int]]:
    """The whole run, or the stretches of its parts, that are neither known nor plain and take many tokens."""
    if is_known(run):
        return []
    stretches: list[list[int]] = []
    joins = False
    for m in PART.finditer(run):
        plain = is_plain(m[0], encoder)
        if not plain and joins:
            stretches[-1][1] = m.end()
        elif not plain:
            stretches.append([*m.span()])
        joins = not plain
    if not stretches:
        return []
    if is_dense(run, encoder):
        return [(0, len(run))]
    return [(a, b) for a, b in stretches if b - a >= MIN_RUN and not is_known(run[a:b]) and is_dense(run[a:b], encoder)]


def spans_of(text: str | None, encoder: tiktoken.Encoding) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    if not text:
        return []
    found = base_spans(text)
    taken = sorted((a, b) for a, b, _ in found)
    for a, b in runs(text, taken):
        found += [(a + x, a + y, "random") for x, y in random_spans(text[a:b], encoder)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """`text` with each span, or group of overlapping spans, replaced by REDACTED."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder_of(vocabulary: bytes) -> tiktoken.Encoding:
    """The encoder of a vocabulary in tiktoken's format, built once a worker."""
    key = hashlib.md5(vocabulary).hexdigest()
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding(key, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def read_vocabulary(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


def scan_secrets(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, redacted: bool = False) -> DataFrame:
    """`docs` with `secrets`, an array of (start, end, kind); with `redacted`, the text has them replaced.

    Without `redacted` the text is left out. A column `secrets` of the input is replaced.
    """
    carried = [c for c in docs.columns if c not in (text, "secrets")]
    (raw,) = unused(docs, "raw")
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text).alias(raw))
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    types = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), *[f"`{text}` string"] * redacted, "secrets array<struct<start:bigint,end:bigint,kind:string>>"])

    def scanned(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        texts = batch.column(raw).to_pylist()
        found = [spans_of(t, encoder) for t in texts]
        own = [batch.column(c) for c in carried]
        if redacted:
            own.append(pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string()))
        own.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], kind))
        return [pa.RecordBatch.from_arrays(own, names=[*carried, *[text] * redacted, "secrets"])]

    return map_texts(source, raw, scanned, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, joined spans and the hash of the patterns' spans, from `secrets`."""
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("secrets")).alias("spans"))

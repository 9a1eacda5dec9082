"""Line-first cleaning: three rules judge each line, failing lines go, and documents that lose too many words go too.

A document is also rejected by its base measures: fewer than `MIN_WORDS` words, or more
than half of its words inside three-word windows that occur twice or more.

Null, empty and odd input: a null text has no words and counts as an empty one; both fail
the base measures and have an empty cleaned text. Lines without a word are dropped and
count as no loss. Repeated rows and ids all stay; other columns are carried through by
`clean_documents` unless their names are those of its results, which replace them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm._spark import map_texts, unused

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Share of its words that a document may lose with its failing lines.
MAX_LOST = 0.3
#: Symbols and repeated marks a word at most, in a line.
MAX_MARKS_A_WORD = 0.25
#: Separators a word at most, in a line; words of a line that needs no sentence end.
MAX_SEPARATORS_A_WORD, FEW_WORDS = 0.15, 3

# Fixed values.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»•·"
ENDS = (".", "!", "?", "…", ":", ";", '"', "”", "»", ")", "'", "’", "。", "！", "？")
PHRASES = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot password", "log in", "privacy policy",
    "read more", "share on", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use", "we use cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "nutzungsbedingungen", "wir verwenden cookies", "zum inhalt springen",
    "cliquez ici", "conditions d'utilisation", "lire la suite", "mentions légales", "nous utilisons des cookies", "politique de confidentialité", "tous droits réservés",
    "aviso legal", "haga clic aquí", "leer más", "política de cookies", "política de privacidad", "términos de uso", "todos los derechos reservados", "utilizamos cookies",
)


def marks(line: str) -> int:
    """Symbols, and `!` or `?` beyond one a sentence: those followed by their like."""
    return sum(map(line.count, SYMBOLS)) + line.count("!!") + line.count("??")


def line_fault(line: str) -> str | None:
    """The first rule that a line with a word breaks: punctuation, navigation or boilerplate."""
    words = len(line.encode().split())
    bare = line.strip(SPACE)
    if sum(map(bare.count, SEPARATORS)) > MAX_SEPARATORS_A_WORD * words or (words <= FEW_WORDS and not bare.endswith(ENDS)):
        return "navigation"
    if marks(bare) > MAX_MARKS_A_WORD * words or not any(c.isalnum() for c in bare):
        return "punctuation"
    low = bare.lower()
    if words <= 40 and any(p in low for p in PHRASES):
        return "boilerplate"
    return None


def measure(text: str | None) -> dict:
    """All columns of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, c in Counter(windows).items() if c > 1} if len(set(windows)) < len(windows) else ()
    repeated, covered = 0, 0
    if often:
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    lines = [x for x in text.split("\n") if x.encode().split()]
    kept, lost, faults = [], 0, Counter()
    for line in lines:
        if fault := line_fault(line):
            faults[fault] += 1
            lost += len(line.encode().split())
        else:
            kept.append(line)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "n_lines": len(lines),
        "n_navigation": faults["navigation"],
        "n_punctuation": faults["punctuation"],
        "n_boilerplate": faults["boilerplate"],
        "lost_words": lost,
        "kept": not base_failed and lost <= MAX_LOST * n,
        "cleaned": "\n".join(kept),
    }


COLUMNS = {
    **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "long"),
    "base_failed": "boolean",
    **dict.fromkeys(("n_lines", "n_navigation", "n_punctuation", "n_boilerplate", "lost_words"), "long"),
    "kept": "boolean",
    "cleaned": "string",
}


def clean_documents(docs: DataFrame, text: str = "text", cleaned: bool = True) -> DataFrame:
    """`docs` with the columns of COLUMNS; `cleaned` (the text without failing lines) only if asked for."""
    added = {k: v for k, v in COLUMNS.items() if cleaned or k != "cleaned"}
    carried = [c for c in docs.columns if c not in added and (cleaned or c != text)]
    (raw,) = unused(docs, "raw")
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text).alias(raw))
    types = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), *(f"{k} {v}" for k, v in added.items())])

    def measured(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        rows = [measure(x) for x in batch.column(raw).to_pylist()]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        own = [batch.column(c) for c in carried] + [pa.array([r[k] for r in rows], kinds[v]) for k, v in added.items()]
        return [pa.RecordBatch.from_arrays(own, names=[*carried, *added])]

    return map_texts(source, raw, measured, schema)

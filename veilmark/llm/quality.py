"""Line-first quality rules: lines that fail a rule go, then documents that lost too much of their text.

Line rules, each on one line with at least one word:

* ``navigation``: ``SEPARATORS`` or more single-character separators between words (menus, breadcrumbs, tables of links)
  that make up a fifth of its words or more.
* ``boilerplate``: the line is a licence, copyright or site notice (``NOTICES``) and has at most ``NOTICE_WORDS`` words.
* ``punctuation``: no sentence end anywhere in it, though it has ``PLAIN_WORDS`` words or more; or more than 30 % of its
  characters are ASCII symbols and digits; or one character is repeated ``RUN`` times or more.

A document is kept if it passes the base rules (50 words or more, at most half of them in repeated three-word
windows) and its failing lines hold at most ``MAX_LOST`` of its word characters.  ``clean`` is the text without the
failing lines, its other lines unchanged.

Null texts count as empty: no words, not kept.  Ids may be null; repeated rows are judged each on its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import mapped

SEPARATORS, PLAIN_WORDS, NOTICE_WORDS, RUN, MAX_LOST = 3, 40, 25, 24, 0.5

NOTICES = re.compile(
    rb"(?i)all rights reserved|\blicen[sc]ed? under\b|\breleased under\b|\bcopyright\b|\bterms of (?:use|service)\b|\bprivacy policy\b|\bcookies?\b.*\b(?:accept|use|consent)|\bjavascript\b.*\b(?:enable|required)|\bsubscribe (?:now|to our)\b|\bclick here\b|\b(?:log|sign) in\b.*\bregister\b"
)
_SEPARATOR = {b"|", b">", b"\xc2\xbb", b"/", b"\xc2\xb7", b"\xe2\x80\xa2"}
_END = re.compile(rb"[.!?:;]|\xe2\x80\xa6|\xe3\x80\x82")
_ODD = bytes(c for c in range(33, 127) if not chr(c).isalpha() and chr(c) not in ".,;:!?'\"()-")
_RUN = re.compile(rb"(\S)\1{%d}" % (RUN - 1))

_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_chars long, clean string"


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with these words fails, if any."""
    if NOTICES.search(line) and len(words) <= NOTICE_WORDS:
        return "boilerplate"
    bars = sum(w in _SEPARATOR for w in words)
    if bars >= SEPARATORS and 5 * bars >= len(words):
        return "navigation"
    size = sum(map(len, words))
    if len(words) >= PLAIN_WORDS and not _END.search(line):
        return "punctuation"
    if size >= 20 and 10 * (size - len(line.translate(None, _ODD + b" \t\n\r\v\f"))) > 3 * size:
        return "punctuation"
    return "punctuation" if _RUN.search(line) else None


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) < 2_000_000:  # three ids fit in 63 bits
        code = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pair = np.unique(np.stack((ids[:-2], ids[1:-1])), axis=1, return_inverse=True)[1]
        code = np.unique(np.stack((pair, ids[2:])), axis=1, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    return int(hit.sum())


def judge(text: str | None) -> tuple:
    """The values of ``_OUT`` for a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words: list[bytes] = []
    seen: set[bytes] = set()
    n_dup = n_lines = n_failed = lost = 0
    good: list[bytes] = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        words += own
        if line_fails(line, own):
            n_failed += 1
            lost += len(b"".join(own).decode("utf-8", "surrogatepass"))
        else:
            good.append(line)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    n, again = len(words), repeat_words(words)
    failed = n < 50 or 100 * again > 50 * n
    return n, chars, len(raw) - len(raw.translate(None, b"#*$%&|<>")), n_dup, again, failed, not failed and lost <= MAX_LOST * chars, n_lines, n_failed, lost, b"\n".join(good).decode("utf-8", "surrogatepass") if n_failed else text


def judged(batches: Iterator[pa.RecordBatch], clean: bool) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in _OUT.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows = [judge(x) for x in part.column(b.num_columns - 1).to_pylist()]
            cols = list(zip(*rows, strict=True))
            own = [(n, pa.array(c, kinds[k])) for (n, k), c in zip(fields, cols, strict=True) if clean or n != "clean"]
            yield pa.record_batch([*part.columns[:-1], *[a for _, a in own]], names=[*part.schema.names[:-1], *[n for n, _ in own]])


def quality(docs: DataFrame, clean: bool = True) -> DataFrame:
    """doc_id and the measures and verdicts of the module's text; ``clean``: the cleaned text as well."""
    out = _OUT if clean else _OUT.removesuffix(", clean string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(src, judged, f"doc_id long, {out}", clean=clean)


def cleaned(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows that are kept, with the clean text in column ``text``."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows = [judge(x) for x in part.column(text).to_pylist()]
            columns = list(part.columns)
            columns[text] = pa.array([r[10] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array([r[6] for r in rows], pa.bool_()))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all their columns, with the lines that fail gone from ``text``."""
    src = docs.withColumn("text", F.col("text").cast("string"))
    return mapped(src, cleaned, src.schema, text=src.columns.index("text"))

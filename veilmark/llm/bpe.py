"""BPE with word ends: encoding by forced boundaries, and decoding.

A merge can only join two neighbouring symbols if the bytes that meet there also meet somewhere inside a vocabulary
token.  ``never[a, b]`` marks the byte pairs that no token holds: between such bytes every encoding has a cut.  A word is
split at those cuts, its fragments are encoded independently by the merge list (the last one carries the word's
end), and their ids are concatenated.  Fragments and words are remembered up to a fixed number, so memory is bounded.

``encode`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` for a file with NFC, white-space and lower-case
normalisation, a splitting pattern and byte-level symbols; ``decode`` gives ``Tokenizer.decode(ids,
skip_special_tokens=False)``.  Files of another make are refused.  Texts with characters on which Unicode versions may differ are
normalised and split by the library; special tokens in a text become their ids, as the library has it.

Null texts count as empty: no ids.  Ids of documents may be null; repeated rows are encoded each on its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import mapped
from veilmark.llm.tokens import byte_chars

CACHE = 400_000
_BYTES = byte_chars()
_MAP = dict(enumerate(_BYTES))
#: ASCII and Latin letters, digits and signs; text outside goes through the library's normaliser and splitter.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
#: Letters, digits and the rest of those characters; MICRO SIGN and ordinals are letters, superscripts and fractions numbers.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class WordBpe:
    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        if spec["normalizer"] != {"type": "Sequence", "normalizers": _NORMAL} or spec["decoder"] is not None or model["continuing_subword_prefix"] or model["dropout"]:
            raise ValueError(f"{path}: another kind of tokenizer than this operator encodes")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.ids_of = {a + b: self.vocab[a + b] for a, b in merges}
        self.never = self._never()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.cache = cache
        self.words = _Words(self)
        self.known: dict[str, tuple[int, ...]] = {}

    def _never(self) -> set[str]:
        """Pairs of symbols that occur in no token: the forced boundaries."""
        inside = set()
        for t in self.vocab:
            body = t.removesuffix(self.end) if len(t) > len(self.end) else t
            inside.update(body[i : i + 2] for i in range(len(body) - 1))
        return {a + b for a in _BYTES for b in _BYTES} - inside

    def fragments(self, word: str) -> list[str]:
        """A word of byte symbols, cut at its forced boundaries."""
        never, out, at = self.never, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] in never:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """Ids of a fragment's symbols, by the merge list: the earliest merge first, all its places left to right."""
        rank, far = self.rank, len(self.rank)
        if len(symbols) > 64:
            return self._merge_long(symbols)
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: rank.get(p, far))
            if best not in rank:
                break
            a, b = best
            out, i, n = [], 0, len(symbols)
            while i < n:
                if i < n - 1 and symbols[i] == a and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return [self.vocab[s] for s in symbols]

    def _merge_long(self, symbols: list[str]) -> list[int]:
        """The same with a heap over a linked list, for long fragments."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank, len(symbols)
        sym: list[str | None] = list(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapify(heap)
        while heap:
            _, i, (a, b) = heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (sym[k], sym[after[k]])) in rank:
                    heappush(heap, (rank[p], k, p))
        out, i = [], 0
        while i >= 0:
            out.append(self.vocab[sym[i]])
            i = after[i]
        return out

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word, given as it stands in the normalised text."""
        parts = self.fragments(word.encode().decode("latin-1").translate(_MAP))
        out: list[int] = []
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            key = part + self.end if last else part
            ids = self.known.get(key)
            if ids is None:
                symbols = list(part)
                if last:
                    symbols[-1] += self.end
                ids = tuple(self.merge(symbols))
                if len(part) <= 32 and len(self.known) < self.cache // 4:
                    self.known[key] = ids
            out += ids
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not _PLAIN.search(text):
            return _SPLIT.findall(text.lower())
        normal = self.tok.normalizer.normalize_str(text)
        # the splitter works on byte symbols after cutting; offsets give back what was cut
        return [normal[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as packed 32-bit integers, decoded text without the blank that joins texts)."""
        words = self.words
        if not self.specials.search(text):
            got = list(map(words.__getitem__, self.split(text)))
            return b"".join([x for x, _ in got]), " ".join([y for _, y in got])
        ids, out = [], []
        for part in self.specials.split(text):
            if part in self.special:
                ids.append(array("I", [self.special[part]]).tobytes())
                out.append(part)
            elif part:
                for x, y in map(words.__getitem__, self.split(part)):
                    ids.append(x)
                    out.append(y)
        return b"".join(ids), " ".join(out)

    def decode(self, ids: bytes) -> str:
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


class _Words(dict):
    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.bpe.word_ids(word)
        got = array("I", ids).tobytes(), " ".join([self.bpe.token[i] for i in ids])
        if len(word) <= 48 and len(self) < self.bpe.cache:
            self[word] = got
        return got


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            ids = [np.frombuffer(bpe.encode(x or "")[0], "<u4") for x in part.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.record_batch([part.column(0), lists], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            n, ids_, texts = [], [], []
            for x in part.column(1).to_pylist():
                ids = bpe.encode(x or "")[0]
                text = bpe.decode(ids)
                n.append(len(ids) // 4)
                ids_.append(hashlib.sha256(ids).hexdigest())
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>)."""
    return mapped(_source(docs), encode_batches, "doc_id long, ids array<int>", path=tokenizer)


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return mapped(ids.select("doc_id", "ids"), decode_batches, "doc_id long, text string", path=tokenizer)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Each text encoded and decoded again: number of ids, and digests of ids and text."""
    return mapped(_source(docs), digest_batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path=tokenizer)

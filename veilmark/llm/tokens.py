"""Byte-level BPE of a ``tokenizers`` file, with the pieces of a text looked up in a bounded cache."""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

#: Characters on which every Unicode version agrees; other texts are given to the tokenizers library whole.
_SAFE = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F))]


UNSAFE = re.compile("[^" + "".join(re.escape(c) for c in _SAFE) + "]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


_BYTES = "".join(byte_chars())


def text_ids(tok, path: str):
    """A function from a text to its ids.

    Where the file's merges are numbered as its tokens are, lower ids merge first and tiktoken's merge loop gives
    the same ids several times faster than the tokenizers library, which serves any other file.
    """
    spec = json.loads(Path(path).read_text())
    model = spec["model"]
    vocab, merges = model["vocab"], [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    singles = {vocab.get(c) for c in _BYTES}
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and None not in singles and max(singles) < 256 and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)):
        import tiktoken

        back = {c: b for b, c in enumerate(_BYTES)}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary, plain
    return lambda text: tok.encode(text, add_special_tokens=False).ids, plain


#: Where a space follows white space, cutting a text before its spaces may not keep the pieces.
IRREGULAR = re.compile(r"\s\x20")


class _Chunks(dict):
    """Packed ids of a space and the characters up to the next space; the first ``limit`` stay in memory."""

    def __init__(self, ids, code: str, limit: int):
        super().__init__()
        self.ids, self.code, self.limit = ids, code, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = array(self.code, self.ids(" " + chunk)).tobytes()
        if len(chunk) <= 32 and len(self) < self.limit:
            self[chunk] = ids
        return ids


class ByteBpe:
    """``encode(text)``: the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as packed integers.

    The ids of the first ``cache`` words met are remembered; they hold the frequent ones.
    """

    def __init__(self, path: str, cache: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype, self.code = ("<u2", "H") if size <= 65536 else ("<u4", "I")
        self.width = int(self.dtype[-1])
        self.ids, self.plain = text_ids(self.tok, path)
        self.chunks = _Chunks(self.ids, self.code, cache)
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def encode(self, text: str) -> bytes:
        if not self.plain or UNSAFE.search(text) or (self.special and self.special.search(text)):
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if IRREGULAR.search(text):
            return array(self.code, self.ids(text)).tobytes()
        first, *rest = text.split(" ")
        return array(self.code, self.ids(first)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]

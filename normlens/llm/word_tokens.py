"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A tokenizer that lower-cases, drops white space and never merges across it
gives a text the ids of its white-space separated words in a row.  For such a
file (``splits_at_white_space``) the distinct words of a block are looked up in
a bounded table that a Python worker keeps from task to task.  Words of ASCII
and accented Latin characters are split here by the file's own pattern and only
merged by the library's model; every other word goes through the whole library.
Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from normlens.llm.common import ragged_index

# fixed values: pre-token pattern and special-token mark of the lower-casing word BPE file
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = "<|"
LATIN = "a-zß-öø-ÿ"
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")


def _byte_letters() -> dict[int, int]:
    """Byte -> letter of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Words(dict):
    """Word -> number of its entry in the flat table of ids; misses are encoded."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.flat, self.start, self.pieces = array("I"), array("q", [0]), {}

    def _piece(self, piece: str) -> array:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(letters)])
        return ids

    def __missing__(self, word: str) -> int:
        if word.isascii() and word.isalpha():  # one piece of the pattern
            self.flat.extend(self._piece(word.lower()))
        elif PLAIN.fullmatch(word) and MARK not in word:
            for p in PIECES.findall(word.lower()):
                self.flat.extend(self._piece(p))
        else:
            self.flat.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
        n = self[word] = len(self.start) - 1
        self.start.append(len(self.flat))
        return n


#: Word tables of this worker by tokenizer file; each is dropped when it outgrows its bound.
_TABLES: dict[str, _Words] = {}


class Encoder:
    """Encodes blocks of texts into one flat array of ids with offsets."""

    def __init__(self, path: str, table_words: int = 1_000_000):
        self.path, self.tokenizer, self.limit = path, Tokenizer.from_file(path), table_words
        self.by_words = self.splits_at_white_space(path)

    @staticmethod
    def splits_at_white_space(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        split = pre[0]
        return (norm == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split"
                and split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("invert") is True
                and split.get("behavior") == "Removed" and len(pre) == 2 and pre[1].get("type") == "ByteLevel"
                and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
                and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")
                and spec["model"].get("dropout") is None
                and all(t["content"].startswith(MARK) for t in spec.get("added_tokens", [])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of strings without nulls: ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        if not self.by_words:
            out = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            off = np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64))).astype(np.int64)
            return np.fromiter((i for x in out for i in x), np.uint32, int(off[-1])), off
        table = _TABLES.get(self.path)
        if table is None or len(table) > self.limit:
            table = _TABLES[self.path] = _Words(self.tokenizer)
        # splits at ASCII white space only, which the pattern drops; an empty word has no ids
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        entry = np.fromiter(map(table.__getitem__, known), np.int64, len(known))
        if len(known):
            entry = entry[words.indices.to_numpy(zero_copy_only=False)]
        flat = np.frombuffer(table.flat, np.uint32) if len(table.flat) else np.zeros(0, np.uint32)
        start = np.frombuffer(table.start, np.int64)
        first, n = start[entry], start[entry + 1] - start[entry]
        at = split.offsets.to_numpy().astype(np.int64)
        cum = np.concatenate(([0], np.cumsum(n)))
        return flat[ragged_index(first, n)], cum[at - at[0]]

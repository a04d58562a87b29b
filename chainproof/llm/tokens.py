"""Token ids of whole texts by the tokenizers library, and where they are stored."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from itertools import chain
from operator import add

import numpy as np

#: Id appended to each document.
END_ID = 1
#: Pieces of text kept with their ids in a task; beyond these the memory starts anew. Words encoded at once.
PIECES, WORDS = 500_000, 20_000
#: Punctuation that ends a word.
_TAIL = ".,;:!?"

#: Letters that are alike in every version of Unicode.
_letters = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

#: A piece of ASCII without the apostrophes of short forms, white space, or the signs that special tokens hold, and its words.
_ascii = re.compile(r"[!-&(-;=-{}~]+").fullmatch
_runs = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+").findall

#: What a tokenizer file of the kind of word_bpe_49k.json does to texts before it merges letters. Of words of
#: small plain letters with blanks between, this leaves the words.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes with one tokenizer file of the kind of word_bpe_49k.json, which drops white space,
    lower-cases, parts runs of letters from runs of punctuation, and ends each word's last token
    with a mark. The ids of a text are then those of its pieces between blanks, end to end, and
    those of a piece of letters and final punctuation are those of its parts; each different part
    has to be encoded once only.

    Blanks and line feeds alone separate pieces here: both are white space to the tokenizer, and
    no special token of it holds either. Other white space stays inside a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = self.words = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}:
            self.words = Tokenizer(self.tokenizer.model)  # the same model, without the steps that leave plain words as they are
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"] or ()}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {"": b""}

    def _learn(self, new: set[str]) -> None:
        """Adds pieces, and their words without case and punctuation, which are pieces too."""
        known = self.pieces
        letters, other, runs = set(), set(), []
        whole, smalls, tails = [], [], []  # pieces, and what they are of
        for p in new:
            w = p.rstrip(_TAIL)
            if w.isalpha() and (w.isascii() or _letters(w)):
                small = w.lower()
                if small not in known:
                    letters.add(small)
                if small != p:
                    whole.append(p)
                    smalls.append(small)
                    tails.append(p[len(w) :])
            elif self.words is not self.tokenizer and _ascii(p):
                runs.append((p, _runs(p.lower())))
            else:
                other.add(p)
        letters.update(set(tails).difference(known), set(chain.from_iterable(r for _, r in runs)).difference(known))
        words = list(letters)
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # not of the kind above
                other.update(part)
                continue
            cuts = (4 * cuts).tolist()
            known.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        words = list(other)
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        get = known.__getitem__
        known.update(zip(whole, map(add, map(get, smalls), map(get, tails)), strict=True))
        for p, r in runs:
            known[p] = b"".join(map(get, r))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text, with the end id; null counts as empty."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.pieces)
        if len(self.pieces) + len(new) > PIECES:
            self.pieces = {"": b""}
            new = set(chain.from_iterable(split))
        self._learn(new)
        end = np.array([END_ID], dtype="<u4").tobytes()
        get = self.pieces.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + end, dtype="<u4") for words in split]


def encoder(name_or_path: str) -> Encoder:
    """This task's encoder for a tokenizer file, given by path or by public name."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = name_or_path if os.path.sep in name_or_path else tokenizer_path(name_or_path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_pieces() -> None:
    """At the end of a task, as the worker may be used for other stages next. The tokenizers stay: they take 18 MB each,
    and loading one again as long as encoding half a megabyte."""
    for e in _encoders.values():
        e.pieces = {"": b""}

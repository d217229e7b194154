"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

A text is cut where the tokenizer itself always cuts, before a space that
follows a non-space or at white space that it drops, so ids of the parts
joined are ids of the text. Texts where that can't be told are encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex

#: Encoder per tokenizer file of this Python worker.
_LOADED: dict[str, "Encoder"] = {}

_SPACED = re.compile(r"\s ")
_ODD = "\x1c\x1d\x1e\x1f\x85"
#: Longest part that is remembered; its ids take four bytes for each byte of text at most.
MEMO_CHARS = 48


def encoder(path: str) -> "Encoder":
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    Only parts of up to ``MEMO_CHARS`` characters are remembered, so ``limit``
    entries bound the memo's bytes too: beyond it the entries of the last
    generation stay for one more, and the ones before them go. Longer parts
    (unspaced scripts, whole texts of one word) are encoded where they stand.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.memo, self.older, self.heads = limit, {}, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        flags = np.zeros(max(names.values()) + 1, bool)
        self.mode, self.pieces = "whole", None
        if model["type"] == "BPE" and not model.get("dropout"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
                self.mode = "space"
                flags[[i for t, i in names.items() if t.startswith("Ġ")]] = True
            elif model.get("end_of_word_suffix") == "</w>" and self._word_split(pre) and self._plain(norm):
                self.mode, self.pieces = "word", regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
                flags[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.flags = flags

    @staticmethod
    def _word_split(pre: dict) -> bool:
        parts = pre.get("pretokenizers") or [{}]
        return parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and bool(parts[0].get("invert"))

    @staticmethod
    def _plain(norm: dict | None) -> bool:
        return norm is not None and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def _single(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, missing: set[str]) -> None:
        prefix, older, memo = " " if self.mode == "space" else "", self.older, self.memo
        new = missing.difference(older)
        known = missing - new
        memo.update(zip(known, map(older.__getitem__, known)))
        missing = new
        if self.mode == "space":
            odd = [w for w in missing if not w or w[-1].isspace()]
            memo.update((w, self._single(prefix + w)) for w in odd)
            plain = list(missing.difference(odd))
        else:
            # A letter whose lower case has a mark only adds a piece, which the count below shows.
            plain = [w for w in missing if w.isalpha()]
            mixed = list(missing.difference(plain))
            find = self.pieces.findall
            counts = [1] * len(plain) + [len(find(unicodedata.normalize("NFC", w).lower())) for w in mixed]
            plain += mixed
        for at in range(0, len(plain), 2000):
            group = plain[at : at + 2000]
            ids = self._joined(prefix + " ".join(group))
            marks, raw = np.flatnonzero(self.flags[ids]), ids.tobytes()
            if self.mode == "space":
                good = len(marks) == len(group) and (not len(marks) or marks[0] == 0)
                bounds = [*(4 * marks).tolist(), len(raw)]
            else:
                ends = np.concatenate([[0], np.cumsum(counts[at : at + 2000])])
                good = ends[-1] == len(marks)
                bounds = (4 * np.concatenate([[0], marks + 1])[ends]).tolist() if good else []
            if good:
                memo.update(zip(group, map(raw.__getitem__, map(slice, bounds, bounds[1:]))))
            else:
                memo.update((w, self._single(prefix + w)) for w in group)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) + len(self.heads) > self.limit:
            self.older, self.memo, self.heads = self.memo, {}, {}
        split, missing = [], set()
        for text in texts:
            parts = None
            if not text:
                parts = []
            elif self.mode == "space" and not _SPACED.search(text):
                parts = text.split(" ")
                missing.update(set(parts[1:]).difference(self.memo))
            elif self.mode == "word" and not any(c in text for c in _ODD):
                parts = text.split()
                missing.update(set(parts).difference(self.memo))
            split.append(parts)
        long = {w for w in missing if len(w) > MEMO_CHARS}
        self._learn(missing - long)
        prefix = " " if self.mode == "space" else ""
        out = []
        for text, parts in zip(texts, split):
            if parts is None:
                out.append(self._single(text))
            elif not parts:
                out.append(b"")
            elif self.mode == "word":
                out.append(self._look(parts, long, prefix))
            else:
                out.append(self._head(parts[0]) + self._look(parts[1:], long, prefix))
        return out

    def _look(self, parts: list[str], long: set[str], prefix: str) -> bytes:
        if long and not long.isdisjoint(parts):
            return b"".join([self._single(prefix + w) if w in long else self.memo[w] for w in parts])
        return b"".join(map(self.memo.__getitem__, parts))

    def _head(self, part: str) -> bytes:
        if len(part) > MEMO_CHARS:
            return self._single(part)
        if part not in self.heads:
            self.heads[part] = self._single(part)
        return self.heads[part]

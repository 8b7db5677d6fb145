"""Encoding with the tokenizers library, each white-space-separated unit once per Python worker.

Both public vocabularies split a text at white space before any merge, so a text's ids are its units' ids in a row. A
unit is encoded by the library when it is first met and then kept; texts for which the cut at white space is not
certain (runs of white space where that matters, control tokens in the text, odd separators) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from docspark.llm.common import turn

#: Units kept by a worker in each of two generations; when the young one is full it replaces the old one.
KEEP = 500_000
#: A control character as a boundary between units in one call, for vocabularies that drop white space.
MARK = "\x01"
#: What str.split() takes for white space and the vocabularies do not.
ODD = "\x1c\x1d\x1e\x1f"
#: Latin letters and punctuation that are composed already, and whose lower case is one composed letter that does not
#: depend on its neighbours: lower-casing them commutes with NFC. All other texts are lower-cased by the library alone.
PLAIN = re.compile("[\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f\u2010-\u2027\u20ac]*")
#: White space other than single spaces and line feeds.
RUNS = ("  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


class UnitEncoder:
    """encode(texts) gives each text's ids as bytes of ``dtype``, equal to those of Tokenizer.encode()."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(self.vocab.values()) < 2**16 else np.dtype("<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.mode = self._mode(spec)
        self.lowers = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.mode == "prefix":
            self.starts = np.zeros(max(self.vocab.values()) + 1, dtype=bool)
            self.starts[[i for t, i in self.vocab.items() if t[0] in "ĠĊ"]] = True  # byte-level space, line feed
        elif self.mode == "drop":
            ids = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            self.mark = ids[0] if len(ids) == 1 else None
            if self.mark is None:
                self.mode = "whole"
        # full stop and comma are pre-tokens of their own after a letter
        self.ends = {c: self._whole("a" + c)[len(self._whole("a")) :] for c in ".,"} if self.mode != "whole" else {}

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
            return "prefix"  # white space starts the unit that follows
        first = (pre.get("pretokenizers") or [{}])[0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in (first.get("pattern") or {}).get("Regex", ""):
            return "drop"  # white space separates units and leaves nothing
        return "whole"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _units(self, text: str) -> list[str] | None:
        """A text's units, or None if it has to go whole. With mode "prefix" the first unit stands for itself, and each
        other for a space and itself, or for itself alone if it begins with a line feed."""
        if MARK in text or any(s in text for s in self.special):
            return None
        if self.mode == "drop":
            if any(c in text for c in ODD):
                return None
            if self.lowers:
                low = text.lower()
                if any(s in low for s in self.special):
                    return None
                if text.isascii() or PLAIN.fullmatch(text):
                    text = low
            return text.split()
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in RUNS):
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return [self._whole(t) for t in texts]
        units = [self._units(t) for t in texts]
        firsts: list[bytes] = []
        if self.mode == "prefix":
            firsts = [self._whole(u[0]) if u else b"" for u in units]
            for u in units:
                if u:
                    del u[0]
        get = self.young.get
        found = [us if us is None else list(map(get, us)) for us in units]
        rows, places, missing = [], [], []
        for us, f in zip(units, found, strict=True):
            if f and None in f:
                own = [k for k, v in enumerate(f) if v is None]
                rows += [f] * len(own)
                places += own
                missing += [us[k] for k in own]
        if missing:
            new = set(missing)
            if len(self.young) + len(new) > KEEP:
                self.old, self.young = self.young, {}
            old, young = self.old, self.young
            for u in new:
                if u in old:
                    young[u] = old[u]
            self._learn([u for u in new if u not in young])
            for f, k, u in zip(rows, places, missing, strict=True):
                f[k] = young[u]
        out = []
        for i, f in enumerate(found):
            if f is None:
                out.append(self._whole(texts[i]))
            else:
                out.append((firsts[i] if firsts else b"") + b"".join(f))
        return out

    def _learn(self, units: list[str]) -> None:
        young, ends = self.young, self.ends
        # a word and its full stop or comma are told apart, so that the word is encoded once
        cut = [u for u in units if u[-1] in ends and u[-2:-1].isalpha() and u[-2:-1].isascii()]
        whole = set(units).difference(cut)
        todo = list(whole.union([u[:-1] for u in cut]).difference(young))
        for at in range(0, len(todo), 8192):
            self._encode_units(todo[at : at + 8192])
        for u in cut:
            young[u] = young[u[:-1]] + ends[u[-1]]

    def _encode_units(self, part: list[str]) -> None:
        if self.mode == "prefix":
            text = "".join([u if u[0] == "\n" else " " + u for u in part])
        else:
            text = f" {MARK} ".join(part)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        if self.mode == "prefix":
            bounds = np.flatnonzero(self.starts[ids]).tolist()
        else:
            at = np.flatnonzero(ids == self.mark)
            ids = np.delete(ids, at)
            bounds = [0, *(at - np.arange(len(at))).tolist()]
        if len(bounds) != len(part):  # cannot be told apart: one by one
            self.young.update((u, self._whole(u if self.mode == "drop" or u[0] == "\n" else " " + u)) for u in part)
            return
        raw, w = ids.tobytes(), self.dtype.itemsize
        at = [b * w for b in bounds]
        at.append(len(raw))
        self.young.update(zip(part, map(raw.__getitem__, map(slice, at, at[1:])), strict=True))


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file, kept until another operator's task begins."""
    turn("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]

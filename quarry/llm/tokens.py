"""Encoding whole texts with a public tokenizer, with the ids of repeated words kept in a bounded table."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import pairwise

import numpy as np

#: Added behind every document.
END_ID = 1
#: Words whose ids are kept; the table starts anew when it is full.
KEPT_WORDS = 400_000
#: One of these, being one id by itself, stands between words that are encoded together.
SEPARATORS = "®©°§±¶×"
#: White space for Python's split() that the tokenizers' patterns don't take for white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"[ \t\n\r]+")
#: A single blank between two characters that are surely no white space: a boundary of byte-level pre-tokens.
BOUNDARY = re.compile("(?<=[!-~¡-ᙿ])(?= [!-~¡-ᙿ])")


#: Not among the characters whose class and lower case no version of Unicode disputes; texts with one go through tokenizers itself.
UNSETTLED = re.compile("[^\x00-\x1b -\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


#: The pre-tokens of a word-level file, and of byte-level ones.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of(entry: str, end: str | None) -> bytes:
    """The bytes that a vocabulary entry spells; the end of a word is a blank."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these stand for themselves, the others for characters from 256 on
    if not hasattr(_bytes_of, "table"):
        _bytes_of.table = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
    ends = bool(end) and entry.endswith(end)
    return bytes(_bytes_of.table[c] for c in (entry[:-len(end)] if ends else entry)) + b" " * ends


class Settled:
    """The ids of texts whose characters are all settled, by tiktoken: a byte-level file, or one of lower-case words with ends.

    tiktoken merges the adjacent pair whose bytes rank first. For words, a blank
    is the end of a word, and a last byte merges with it before all else; so
    blanks are put around everything that is no letter, and the regular
    expression only has to find what a blank ends.
    """

    def __init__(self, spec: dict):
        import tiktoken
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        special = {t["content"] for t in spec.get("added_tokens", ())}
        entries = {w: i for w, i in model["vocab"].items() if w not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = set(merged)
        single = [w for w in entries if w not in made]
        self.words = bool(end)
        order = sorted(single, key=lambda w: (len(_bytes_of(w, end)), entries[w])) + merged
        ranks = {_bytes_of(w, end): r for r, w in enumerate(order)}
        self.ids = np.array([entries[w] for w in order], np.uint32)
        if self.words:
            if b" " not in ranks:  # every byte needs a rank; a blank by itself never comes out
                ranks[b" "] = len(order)
                self.ids = np.append(self.ids, np.uint32(0))
            self.ranks = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            kinds = {c: unicodedata.category(chr(c))[0] for c in range(0x250)}
            number = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "N")
            letter = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "L")
            self.other = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{number}]|[^\\s{letter}{number}]+")
        else:
            self.ranks = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def of(path: str) -> Settled | None:
        """For a file of one of these two forms, else None."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        steps = [p.get("type") for p in pre.get("pretokenizers", [pre])]
        byte_level = (pre.get("pretokenizers") or [pre])[-1]
        if byte_level.get("type") != "ByteLevel" or byte_level.get("add_prefix_space"):
            return None
        if steps == ["ByteLevel"]:
            return Settled(spec) if byte_level.get("use_regex") and not spec.get("normalizer") and not model.get("end_of_word_suffix") else None
        split = pre["pretokenizers"][0]
        lower = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
        same = split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("invert") and split.get("behavior") == "Removed"
        return Settled(spec) if steps == ["Split", "ByteLevel"] and lower and same and not byte_level.get("use_regex") and model.get("end_of_word_suffix") else None

    def encode(self, text: str) -> np.ndarray:
        if self.words:
            text = text.lower()
            for c in "\t\n\x0b\x0c\r\x85\xa0":
                text = text.replace(c, " ")
            text = self.other.sub(r" \g<0> ", text) + " "
        return self.ids[self.ranks.encode_to_numpy(text, disallowed_special=())]


class Encoder:
    """ids of texts as tokenizers gives them (no special tokens added; their strings in a text are ordinary text).

    Where tiktoken can give the same ids (see Settled), it does so several times
    faster. Elsewhere words are encoded once and looked up from then
    on, where pre-tokens can't cross a boundary between words; words not seen
    yet are encoded together, with a separator between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        self.drops_space = one("a b") == one("a  b\n")
        self.glue, self.mark = next(((c, one(f" {c}")[0]) for c in SEPARATORS if len(one(f" {c}")) == 1), (None, -1))
        self.known: dict[str, bytes] = {}
        self.fast = Settled.of(path)

    def _words(self, text: str) -> list[str]:
        if self.drops_space:
            return text.split() if not ODD_SPACE.search(text) else SPACE.split(text)
        return BOUNDARY.split(text)

    def _learn(self, words: list[str]) -> None:
        """Encode ``words`` into the table."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known.clear()
        together = [w for w in words if self.glue and self.glue not in w and (self.drops_space or w[:1] == " ")]
        alone = set(words) - set(together)
        for w in alone:
            self.known[w] = np.array(self.tok.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        for i in range(0, len(together), 2000):
            part = together[i:i + 2000]
            joint = f" {self.glue} " if self.drops_space else f" {self.glue}"
            ids = np.array(self.tok.encode(joint.join(part), add_special_tokens=False).ids, np.uint32)
            cut = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]]).tolist()
            for w, (a, b) in zip(part, pairwise(cut), strict=True):
                self.known[w] = ids[a + 1:b].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, END_ID included."""
        end = np.array([END_ID], np.uint32).tobytes()
        if self.fast:
            slow = iter(self._encode_words([t for t in texts if UNSETTLED.search(t)]))
            return [next(slow) if UNSETTLED.search(t) else self.fast.encode(t).tobytes() + end for t in texts]
        return self._encode_words(texts)

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        end, out = np.array([END_ID], np.uint32).tobytes(), []
        at = 0
        while at < len(texts):
            size, stop = 0, at
            while stop < len(texts) and (stop == at or size < 2_000_000):
                size += len(texts[stop])
                stop += 1
            split = [self._words(t) for t in texts[at:stop]]
            fresh = {w for words in split for w in words} - self.known.keys()
            if fresh:
                if len(self.known) + len(fresh) > KEPT_WORDS:  # the table is cleared: all words of these texts
                    fresh = {w for words in split for w in words}
                self._learn(sorted(fresh))
            out += [b"".join(map(self.known.__getitem__, words)) + end for words in split]
            at = stop
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)

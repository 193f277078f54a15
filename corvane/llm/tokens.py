"""Token ids of whole texts by a tokenizer file, with the ids of words remembered.

Both public tokenizers split a text before they merge symbols, so that a word's ids do not depend on its neighbours. A
text is cut where the tokenizer would cut too, each distinct word is encoded once by the tokenizers library, many at a
time, and the ids are joined. Texts in which a blank follows another, or which hold a
mark like <|endoftext|>, are not cut but encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain, takewhile

import numpy as np

#: Words that a worker remembers (about 200 MB); further ones are encoded again for each batch.
REMEMBERED = 1_000_000
#: Marks a word that begins a text; texts that hold this character are encoded whole.
_FIRST = "\x01"
#: Marks that may stand behind a word; no apostrophe, which may begin an ending of its own.
_MARKS = ".,;:!?|)(\"*%#&$-/"
#: Stands between words that are encoded together, where their ids do not show where one ends.
_BETWEEN = "~"
_loaded: dict = {}


class Encoder:
    """encode(texts): each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        pre, norm = head.get("pre_tokenizer") or {}, head.get("normalizer")
        split = (pre.get("pretokenizers") or [{}])[0]
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.mode = "spaced"
        elif split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "[^\\s" in split.get("pattern", {}).get("Regex", ""):
            self.mode = "bare"
        # the same merges, for texts of words of lower-case or any letters, each after a space
        blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "MergedWithNext", "invert": False} if self.mode == "spaced" else {"type": "WhitespaceSplit"}
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        head |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, bytes_only]}}
        self._letters = Tokenizer.from_str(json.dumps(head))
        vocabulary = self.tokenizer.get_vocab()
        self._begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.mode == "spaced":
            self._begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        elif self.mode == "bare":
            self._begins[self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids] = True
        # marks with ids of their own, which the tokenizer finds before it parts a text
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # texts of bare words are cut in lower case, so marks in capitals, which are plain text, count there as well
        self.lower_marks = self.mode == "bare" or any(t.normalized for t in added)
        self.marks = [t.content.lower() if self.lower_marks else t.content for t in added]
        # what each begins with before its first letter, which is the same in either case
        self.heads = {"".join(takewhile(lambda c: not c.isalpha(), m)) for m in self.marks}
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _text_of(self, word: str) -> str:
        """The part of a text that a word stands for."""
        if self.mode == "bare" or word[0] == "\n":
            return word
        return word[1:] if word[0] == _FIRST else " " + word

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words. Letters and the marks behind them are encoded apart, as the tokenizer parts them too."""
        spaced, known = self.mode == "spaced", self.known
        out: dict[str, bytes] = {}
        letters, parted, single = set(), {}, []
        for w in words:
            core = w if w.isalpha() else w.rstrip(_MARKS)
            if not core.isalpha() or not (spaced or core.islower()):
                single.append(w)
                continue
            if core is not w and core != w:
                tail = w[len(core) :]
                parted[w] = core, tail
                single.append(_FIRST + tail if spaced else tail)
            if core not in known:
                letters.add(core)
        some = list(letters)
        for at in range(0, len(some), 5_000):
            out.update(self._joined(some[at : at + 5_000]))
        single = [w for w in {*single, *(letters - out.keys())} if w not in known]
        out.update(zip(single, self._whole([self._text_of(w) for w in single]), strict=True))
        for w, (core, tail) in parted.items():
            tail = _FIRST + tail if spaced else tail
            out[w] = (out.get(core) or known[core]) + (out.get(tail) or known[tail])
        return out

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of letters, encoded as one text, whose ids show where each begins; nothing if they don't."""
        spaced = self.mode == "spaced"
        text = " " + " ".join(words) if spaced else f" {_BETWEEN} ".join(["", *words])
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if len(words) == 1:
                return {}
            plain = [w for w in words if all(c < "\u0100" for c in w)]
            return self._joined(plain) if plain and len(plain) < len(words) else {}
        ids = np.array(self._letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self._begins[ids])
        if len(at) != len(words):
            return {}
        raw, skip = ids.tobytes(), 0 if spaced else 4
        return {w: raw[a:b] for w, a, b in zip(words, (at * 4 + skip).tolist(), [*(at[1:] * 4).tolist(), len(raw)], strict=True)}

    def _cut(self, text: str) -> list[str]:
        if self.mode == "bare":
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
            return text.lower().split()
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = _FIRST + parts[0]
        return parts

    def _marked(self, text: str) -> bool:
        """Whether a text holds a mark, in any letter case if texts are cut in lower case."""
        if not any(head in text for head in self.heads):
            return False
        text = text.lower() if self.lower_marks else text
        return any(m in text for m in self.marks)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return self._whole(texts)
        marked = [self._marked(t) for t in texts]
        cut = [self._cut(t) if t and not m else [] for t, m in zip(texts, marked, strict=True)]
        known = self.known
        missing = set(chain.from_iterable(cut)).difference(known)
        if self.mode == "spaced":
            # a word that is empty or ends with a blank stands before another blank
            unsafe = {w for w in missing if not w or w[-1].isspace() or w == _FIRST}
            odd = [k for k, t in enumerate(texts) if marked[k] or _FIRST in t or (unsafe and not unsafe.isdisjoint(cut[k]))]
        else:
            # blanks to Python, but not to the tokenizer
            odd = [k for k, t in enumerate(texts) if marked[k] or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t]
        whole = dict(zip(odd, self._whole([texts[k] for k in odd]), strict=True)) if odd else {}
        if odd:
            for k in odd:
                cut[k] = []
            left = set(chain.from_iterable(cut))
            missing = [w for w in missing if w in left]
        new = self._words(missing)
        room = REMEMBERED - len(known)
        known.update(new)
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        if len(new) > room:
            for w in list(new)[max(room, 0) :]:
                del known[w]
        for k, ids in whole.items():
            out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; workers keep it from task to task."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]

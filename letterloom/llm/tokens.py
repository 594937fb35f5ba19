"""Token ids of whole texts, as a tokenizer library gives them, at a bounded price per distinct word.

A text is cut at spaces and line ends that stand alone between other characters. A tokenizer whose pre-tokenizer
starts a new word at every one of them (both families below) gives the same ids for the parts one by one as for
the whole text, so a part is encoded by the library once per worker while it is remembered (see ``Memory``).
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread per Spark core

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Beyond the Latin blocks Unicode versions may differ; the capital I with a dot grows in lower case.
_UNSETTLED = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Marks that neither begin a contraction nor stand in a special string.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_SETTLED_WORD = frozenset(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)))


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts(text: str) -> list[str]:
    """Cut a text before line ends and at spaces, between characters that are no white space; those spaces are left out.

    Texts with any other white space, or with some at an end or next to other, are cut at the spaces alone that have none beside them.
    """
    words = text.split()
    if " ".join(words) != text.replace("\n", " "):
        return _BETWEEN.split(text)
    return text.replace("\n", " \n").split(" ") if "\n" in text or not words else words


def loosened(text: str) -> str:
    """A text whose parts, cut at its spaces, are those for a vocabulary that drops white space and ignores case."""
    if "<|" not in text and (text.isascii() or not _UNSETTLED.search(text)):
        text = text.lower()  # not where it could make a special string, or differ from the library's lower case
    return text.replace("\n", " ")


def loose_parts(text: str) -> list[str]:
    return loosened(text).split(" ")


class Memory:
    """Values of the parts met lately: of ``limit`` or a few more that are recent, and of as many before them.

    Parts met again after they had become older are ``common``: the next recent ones begin with them, up to a
    quarter of ``limit``, so that frequent parts are not missed whenever the recent ones become older.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.recent: dict = {}
        self.older: dict = {}
        self.common: dict = {}

    def get(self, part: str):
        value = self.recent.get(part)
        return self.older.get(part) if value is None else value

    def again(self, parts: list[str]) -> dict:
        """Those of ``parts``, none of them recent, that are older."""
        found = {x: self.older[x] for x in parts if x in self.older}
        self.common.update(found)
        return found

    def add(self, values: dict) -> None:
        self.recent.update(values)
        if len(self.recent) > self.limit:
            if len(self.common) > self.limit // 4:
                self.common = {}
            self.older, self.recent = self.recent, self.common.copy()


class PartEncoder:
    """Values of texts from values of their parts: ``of_parts`` gets the strings not yet known.

    Values can be added. A run of marks behind a settled letter or digit is a pre-token of its own in both
    families, so such a part has the value of the rest and of the run.
    """

    def __init__(self, of_parts, lead: str, cut=parts, limit: int = 200_000, spaced=None):
        """``spaced``, where there is no ``lead``: makes a text of which the parts stand between single spaces."""
        self.of_parts, self.lead, self.cut, self.spaced = of_parts, lead, cut, spaced
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        """Give back the memory of what was met; the next texts are worked out anew."""
        self.marks: dict = {}
        self.first = Memory(self.limit)
        self.later = self.first if not self.lead else Memory(self.limit)
        pa.default_memory_pool().release_unused()

    def _values(self, known: Memory, asked: list[str], lead: str) -> list:
        """Values of parts, repeats included; each different one is looked up, or worked out, once."""
        values = list(map(known.recent.get, asked))
        at = [i for i, v in enumerate(values) if v is None]
        new = dict.fromkeys([asked[i] for i in at])
        found = known.again(list(new))
        new = [x for x in new if x not in found]
        stems = {x: stem for x in new if (stem := x.rstrip(_MARKS)) != x and stem[-1:] in _SETTLED_WORD}
        runs = {x[len(stem) :] for x, stem in stems.items()}
        if unknown := [r for r in runs if r not in self.marks]:
            if len(self.marks) > 10_000:
                self.marks, unknown = {}, list(runs)
            self.marks.update(zip(unknown, self.of_parts(unknown), strict=True))
        ask = [x for x in new if x not in stems]
        for stem in set(stems.values()).difference(ask):
            value = known.get(stem)
            if value is None:
                ask.append(stem)
            else:
                found[stem] = value
        found.update(zip(ask, self.of_parts([x if x[:1] == "\n" else lead + x for x in ask]), strict=True) if ask else ())
        for x, stem in stems.items():
            found[x] = found[stem] + self.marks[x[len(stem) :]]
        for i in at:
            values[i] = found[asked[i]]
        known.add(found)
        return values

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text, the values of its parts in order."""
        cut = list(map(self.cut, texts))
        first = self._values(self.first, [c[0] for c in cut], "")
        later = self._values(self.later, [x for c in cut for x in c[1:]], self.lead)
        out, at = [], 0
        for value, c in zip(first, cut, strict=True):
            out.append([value, *later[at : at + len(c) - 1]])
            at += len(c) - 1
        return out

    def joined(self, texts: list[str]) -> list[bytes]:
        """For each text, its parts' values (bytes) in order, as one.

        Where the parts stand between spaces, Arrow cuts the texts and tells the different parts, so that only those are looked up.
        """
        if self.spaced is None:
            return [b"".join(values) for values in self(texts)]
        cut = pc.split_pattern(pa.array(list(map(self.spaced, texts)), pa.large_string()), " ")
        told = cut.flatten().dictionary_encode()
        values = pa.array(self._values(self.first, told.dictionary.to_numpy(zero_copy_only=False).tolist(), self.lead), pa.large_binary()).take(told.indices)
        data = values.buffers()[2].to_pybytes() if len(values) else b""
        ends = np.frombuffer(values.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist() if len(values) else [0] * (len(texts) + 1)
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class PartLibrary:
    """The library's ids of many short strings in few calls.

    Strings are joined into one text where that cannot change their ids and where the ids show which is whose: for
    a byte-level vocabulary, a space (or line end) and a word without white space, of which only the first id
    begins with the space; for a vocabulary with word ends, one run of settled letters, of which only the last id
    ends a word. All others, and a text whose ids don't show as many strings as went in, are encoded one by one.
    """

    def __init__(self, tok, at_once: int = 100):
        self.tok, self.at_once = tok, at_once
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.lead = " " if keeps_space(tok) else ""
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        # how a byte-level vocabulary writes the space and the line end
        self.edges = {k: np.array([n.startswith(c) for n in names], bool) for k, c in ((" ", "\u0120"), ("\n", "\u010a"))}
        self.last = np.array([n.endswith("</w>") for n in names], bool)

    def _kind(self, s: str) -> str | None:
        """With what kind of strings ``s`` can be joined."""
        if not self.lead:
            return "word" if s.isalpha() and not _UNSETTLED.search(s) else None
        plain = s[1:]
        return s[0] if s[:1] in self.edges and s[:1] and plain.split() == [plain] and not any(a in s for a in self.added) else None

    def _kinds(self, strings: list[str]) -> list[str | None]:
        """``_kind`` of each; where all are a space or line end and a word, one look at them together shows it."""
        line = "".join(strings) if self.lead else ""
        if line and line.split() == [s[1:] for s in strings] and not any(a in line for a in self.added):
            first = [s[0] for s in strings]
            if self.edges.keys() >= set(first):
                return first
        return list(map(self._kind, strings))

    def _each(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def __call__(self, strings: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each string, without added special tokens."""
        out: list = [None] * len(strings)
        kinds: dict[str | None, list[int]] = {}
        for k, kind in enumerate(self._kinds(strings)):
            kinds.setdefault(kind, []).append(k)
        alone = kinds.pop(None, [])
        for kind, of_kind in kinds.items():
            runs = [of_kind[at : at + self.at_once] for at in range(0, len(of_kind), self.at_once)]
            texts = [(" " if kind == "word" else "").join([strings[k] for k in run]) for run in runs]
            for run, e in zip(runs, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = np.append(0, np.flatnonzero(self.last[ids]) + 1) if kind == "word" else np.append(np.flatnonzero(self.edges[kind][ids]), len(ids))
                if len(cuts) != len(run) + 1 or cuts[0]:
                    alone += run
                    continue
                data, ends = ids.tobytes(), (4 * cuts).tolist()
                for k, a, b in zip(run, ends[:-1], ends[1:], strict=True):
                    out[k] = data[a:b]
        for k, ids in zip(alone, self._each([strings[k] for k in alone]), strict=True):
            out[k] = ids
        return out


@functools.lru_cache(maxsize=1)
def id_encoder(path: str, limit: int = 200_000) -> PartEncoder:
    """Ids as little-endian uint32 bytes, without added special tokens. A worker keeps it, and what it remembers unless a task forgets it, from task to task."""
    tok = load(path)
    if keeps_space(tok):  # a byte-level vocabulary keeps the space with the word behind it
        return PartEncoder(PartLibrary(tok), " ", limit=limit)
    ignores_case = tok.encode("Ab", add_special_tokens=False).ids == tok.encode("ab", add_special_tokens=False).ids
    if ignores_case:
        return PartEncoder(PartLibrary(tok), "", loose_parts, limit, loosened)
    return PartEncoder(PartLibrary(tok), "", lambda t: t.split(" "), limit, str)


def keeps_space(tok) -> bool:
    return tok.encode(" b", add_special_tokens=False).ids != tok.encode("b", add_special_tokens=False).ids

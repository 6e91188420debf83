"""Exact, fast token ids from the public tokenizer files.

The tokenizers library gives every id. A text is cut at spaces where a cut
can't change the ids, each distinct piece is encoded once by a worker and its
ids are kept; texts in which such a cut isn't sure are encoded whole. So are
texts that hold the string of an added token, which has an id of its own. Texts
are split, pieces numbered and their ids laid end to end by Arrow, so Python
sees distinct pieces only.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker, about 130 bytes each: half of them new, half of them from before the new ones.
KEPT = 800_000
#: Bytes of text that are encoded at once beside a writer of files, which needs memory too.
BULK = 3 << 20
#: Whether an array of unsigned integers has the layout that ids are kept in.
NATIVE = array("I").itemsize == 4 and sys.byteorder == "little"
#: Stands for the ids of a piece that isn't kept.
NEW = object()
_ENCODERS: dict = {}
#: Letters that are split, composed and lower-cased alike everywhere, and punctuation but for the apostrophe, which
#: may begin a token with letters in it. Each run of one kind is a pre-token; other text takes the long way.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIGNS = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
WORD = re.compile(f"[{LETTERS}]+")
#: A word with signs after it, and perhaps a line's end and another such word.
WORDS = re.compile(f"([{LETTERS}]+)([{SIGNS}]*)(?:\n([{LETTERS}]+)([{SIGNS}]*))?")


def _visible_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes in turn
    for the characters from U+0100 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


VISIBLE = _visible_bytes()


def _with(texts: pa.Array, part: bytes) -> np.ndarray:
    """Which of the texts hold these bytes."""
    return pc.match_substring(texts, part).to_numpy(zero_copy_only=False)


class PieceEncoder:
    """Text bytes to ids, as little-endian unsigned 32-bit integers.

    ``spaced`` says what the tokenizer does with a space. True: a single space
    between two other characters begins the token after it (byte-level BPE), so
    a piece is encoded with its space. False: white space is dropped and no
    token spans it.
    """

    def __init__(self, name: str, spaced: bool, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name
        if not os.path.exists(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tok = Tokenizer.from_file(path)
        # in any case: lower-casing a text must not make one
        self.added = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced, self.kept = spaced, kept
        #: Bytes that the largest id takes.
        self.width = 2 if max(self.tok.get_vocab().values(), default=0) < 1 << 16 else 4
        self.lead = VISIBLE[32] if spaced else ""
        self.signs: dict[str, bytes] = {"": b""}
        self.line = self.whole(["\n"])[0]
        self.first: dict[bytes, bytes | None] = {}
        self.rest: dict[bytes, bytes | None] = {}
        #: What was kept before ``first`` and ``rest`` were begun anew; what is met again moves over.
        self.before: tuple[dict[bytes, bytes | None], dict[bytes, bytes | None]] = ({}, {})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, lead: str) -> bytes:
        """The ids of a run of letters, straight from the model: it is one pre-token."""
        if not self.spaced:
            word = word.lower()
        if not word.isascii():
            word = "".join([VISIBLE[b] for b in word.encode()])
        return _bytes([t.id for t in self.tok.model.tokenize(lead + word)])

    def _run(self, signs: str) -> bytes:
        """The ids of a run of signs."""
        ids = self.signs.get(signs)
        if ids is None:
            ids = self.signs[signs] = self.whole([signs])[0]
        return ids

    def _learn(self, kept: dict[bytes, bytes | None], pieces: list[bytes], lead: str) -> None:
        """Keeps the ids of new pieces, or None where a cut isn't sure."""
        word, words, some, rest = WORD.fullmatch, WORDS.fullmatch, [], []
        tokenize, lower = self.tok.model.tokenize, not self.spaced
        for p in pieces:
            t = p.decode("utf-8", "replace")
            if t.isascii() and t.isalpha():
                kept[p] = _bytes([x.id for x in tokenize(lead + (t.lower() if lower else t))])
            elif word(t):
                kept[p] = self._word(t, lead)
            else:
                some.append((p, t))
        for p, t in some:
            m = words(t)
            if m is None:
                rest.append((p, t))
                continue
            a, x, b, y = m.groups()
            ids = (kept.get(a.encode()) or self._word(a, lead)) + self._run(x)
            if b:
                ids += self.line + ((self.first if self.spaced else kept).get(b.encode()) or self._word(b, "")) + self._run(y)
            kept[p] = ids
        kept.update((p, None) for p, _ in rest)
        if self.spaced:
            # a cut is sure only between characters that aren't white space
            rest = [(p, t) for p, t in rest if t and not t[-1].isspace() and not (lead and t[0].isspace())]
        found = self.whole([(" " if lead else "") + t for _, t in rest])
        kept.update(zip([p for p, _ in rest], found, strict=True))

    def _ids(self, kept: dict[bytes, bytes | None], before: dict[bytes, bytes | None], pieces: pa.Array, lead: str) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The ids of pieces end to end, where each begins and the last ends, and how many up to each weren't sure."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        values = list(map(kept.get, names, repeat(NEW)))
        new = [i for i, v in enumerate(values) if v is NEW]
        if before:
            for i in new:
                if (v := before.get(names[i], NEW)) is not NEW:
                    kept[names[i]] = values[i] = v
            new = [i for i in new if values[i] is NEW]
        self._learn(kept, [names[i] for i in new], lead)
        for i in new:
            values[i] = kept[names[i]]
        found = pa.array(values, pa.large_binary())
        unsure = found.is_null().take(coded.indices).to_numpy(zero_copy_only=False)
        own = found.take(coded.indices)
        raw = own.buffers()[2]
        at = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1] if len(own) else np.zeros(1, np.int64)
        return memoryview(raw) if raw is not None else memoryview(b""), at, np.concatenate([[0], np.cumsum(unsure)])

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        if len(self.rest) + len(self.first) > self.kept // 2:
            self.before = (self.first, self.rest)
            self.first, self.rest, self.signs = {}, {}, {"": b""}
        own = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()), b"")
        if not len(own):
            return []
        text = own.view(pa.string())
        low = pc.ascii_lower(text)
        apart = np.zeros(len(own), bool)
        for token in self.added:
            apart |= _with(low, token)
        if not self.spaced:
            # what lowers every text anyway gets it in lower case, so that fewer pieces differ;
            # not with combining marks: some compose with a small letter only
            marks = _with(own, b"\xcc") | _with(own, b"\xcd")
            text = pc.if_else(pa.array(marks), text, low)
        lists = pc.split_pattern(text, " ")
        flat, ends = lists.flatten().view(pa.binary()), lists.offsets.to_numpy()
        ends = ends - ends[0]
        if self.spaced:
            head, head_at, head_unsure = self._ids(self.first, self.before[0], flat.take(pa.array(ends[:-1])), "")
            inner = np.ones(len(flat), bool)
            inner[ends[:-1]] = False
            flat, ends = flat.filter(pa.array(inner)), ends - np.arange(len(ends))
        data, at, unsure = self._ids(self.rest, self.before[1], flat, self.lead)
        unsure = unsure[ends[1:]] > unsure[ends[:-1]]
        cut = at[ends].tolist()
        out = [data[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        if self.spaced:
            first = head_at.tolist()
            out = [head[x:y].tobytes() + o for x, y, o in zip(first[:-1], first[1:], out, strict=True)]
            unsure |= np.diff(head_unsure) > 0
        todo = np.flatnonzero(apart | unsure).tolist()
        for i, ids in zip(todo, self.whole([own[i].as_py().decode("utf-8", "replace") for i in todo]), strict=True):
            out[i] = ids
        return out


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if NATIVE else np.array(ids, "<u4").tobytes()


def forget() -> None:
    """Frees what the worker's encoders keep, once its next work needs none."""
    _ENCODERS.clear()


def encoder(name: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder of this file."""
    if (name, spaced) not in _ENCODERS:
        _ENCODERS[name, spaced] = PieceEncoder(name, spaced)
    return _ENCODERS[name, spaced]

"""Token ids of whole texts by a public vocabulary file, with a memo of chunks.

The ids are those of the tokenizers library for the whole text, with its defaults: the strings of
special tokens in a text become these tokens. Byte-level and word-level BPE
never join characters across some places, whatever stands around them, so the chunks between
such places are encoded once per worker and looked up after that:

* word-level files cut a text into runs of letters, digits, runs of symbols and endings; texts below U+0100 are cut
  alike here, others at their white space;
* byte-level files attach a single space to the word behind it and make a single newline a token
  of its own. Texts with any other white space are encoded whole.

A column of a byte-level file is cut into chunks and looked up in Arrow, so that only new chunks meet Python.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.words import worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks in a generation of the memo; a worker keeps this one and the last. Results don't depend on it.
MEMO = 300_000
#: White space that byte-level chunking leaves to the library.
OTHER_SPACE = re.compile(r"[^\S \n]|[ \n]{2}|\A[ \n]|[ \n]\Z")


#: Columns are cut at this character after it is put between chunks; texts that hold it are left to the library.
CUT = "\x01"
OTHER_CHARACTER = re.compile(r"[^\S \n]")
#: Chunks of columns that a worker keeps; beyond it the half that was found more often stays. Results don't depend on it.
TABLE = 1_000_000

#: Chunks that are known from the start. No other chunk of a byte-level file has a newline.
KNOWN = ["", "\n", ".", ","]


#: Letters and symbols below U+0100 that normalization keeps, and that make runs of their own whatever stands beside
#: them. An apostrophe may start an ending and isn't among them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
SYMBOLS = r"!-&(-/:-@\[-`{-~"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
ONE = re.compile(f"[{LETTERS}]+|[{SYMBOLS}]+|[0-9]|{ENDINGS}")
AROUND = re.compile(f"([{SYMBOLS}]*)([{LETTERS}]+)([{SYMBOLS}]*)")
#: The runs of a word-level file in a text below U+0100, as its pre-tokenizer states them: endings, letters, single digits, anything but white space.
NUMBERS = "0-9²³¹¼½¾"
RUNS = re.compile(rf"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+")


def _binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Ids, one after the other, as a binary column with n ids a row."""
    ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


class Table:
    """Chunks of a byte-level file, their ids, and how often each was found: flat arrays, of which a worker can keep many."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        # white space in a row, or at an end of a text, leaves a chunk without a word: it has no ids, which tells such texts
        self.chunks = pa.array([" ", *KNOWN], pa.string())
        self.ids = pa.array([b"", *encoder.whole(KNOWN)], pa.binary())
        self.uses = np.ones(len(self.chunks), np.int64)

    def find(self, chunks: pa.Array) -> pa.Array:
        at = pc.index_in(chunks, value_set=self.chunks)
        if at.null_count:
            new = chunks.filter(pc.is_null(at)).dictionary_encode()
            where = np.empty(len(chunks), np.int64)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            where[known] = at.drop_null().to_numpy()
            where[~known] = new.indices.to_numpy() + len(self.chunks)
            self.chunks = pa.concat_arrays([self.chunks, new.dictionary])
            self.ids = pa.concat_arrays([self.ids, self.encoder.chunk_ids(new.dictionary)])
            at = pa.array(where)
        found = self.ids.take(at)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.chunks) - len(self.uses), np.int64)]) + np.bincount(at.to_numpy(), minlength=len(self.chunks))
        if len(self.chunks) > TABLE:
            first = np.arange(len(KNOWN) + 1)
            most = np.argpartition(-self.uses[len(first) :], TABLE // 2)[: TABLE // 2] + len(first)
            keep = np.concatenate([first, most])
            self.chunks, self.ids, self.uses = self.chunks.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.uses[keep] // 2
        return found


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = words
        # texts that hold a token of the file's own as a string are encoded whole; without any, nothing matches
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        vocab = self.tokenizer.get_vocab()
        #: Whether an id ends a run of a word-level file, or begins a chunk of a byte-level one, whose names for space and newline these are.
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if words else t.startswith(("Ġ", "Ċ")))]] = True
        self.newline = -1 if words else vocab["Ċ"]
        self.memo: dict[str, bytes] = dict(zip(KNOWN, self.whole(KNOWN)))
        self.old: dict[str, bytes] = {}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: Strings of special tokens if each lies in one chunk, else None: columns are then encoded as lists.
        self.strings = None if words or any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in added) else [t.content for t in added]
        self.table: Table | None = None

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _chunks(self, text: str) -> list[str]:
        if self.words:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:  # what normalization does with these letters is left to the library
                return text.replace("\n", " ").split(" ")
            return RUNS.findall(text.lower())
        parts = []
        for line in text.split("\n"):
            # a word behind a space is looked up with a mark, its chunk has the space
            words = line.replace(" ", " \0").split(" ")
            parts += words
            parts.append("\n")
        parts.pop()
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One item per text; a null text has no ids."""
        lists: list[list[str] | None] = []
        odd: list[str] = []
        for text in texts:
            if not text:
                lists.append([])
            elif self.added.search(text) or not self.words and ("\0" in text or OTHER_SPACE.search(text)):
                lists.append(None)
                odd.append(text)
            else:
                lists.append(self._chunks(text))
        chunks = set().union(*filter(None, lists))
        new = chunks.difference(self.memo)
        if new and len(self.memo) + len(new) > MEMO:
            self.memo, self.old = {c: self.memo[c] for c in KNOWN}, self.memo
            new = chunks.difference(KNOWN)
        self._learn(new)
        rest, ids = iter(self.whole(odd)), self.memo.__getitem__
        return [next(rest) if x is None else b"".join(map(ids, x)) for x in lists]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number for each text."""
        if self.strings is None or not len(texts):
            found = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.table = self.table or Table(self)
        texts = pc.fill_null(texts, "")
        marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", f"{CUT}\n{CUT}")
        lists = pc.split_pattern(marked, CUT)
        found = self.table.find(lists.flatten())
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
        n = np.diff(ends)
        first = np.cumsum(size := pc.list_value_length(lists).to_numpy()) - size  # each text has a chunk at least
        counts = np.add.reduceat(n, first, dtype=np.int64) // 4
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4", int(counts.sum()))
        odd = np.logical_or.reduceat(n == 0, first) & (pc.binary_length(texts).to_numpy() > 0)
        odd = np.flatnonzero(odd | pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False))
        if not len(odd):
            return ids, counts
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for k, x in zip(odd.tolist(), self.whole(texts.take(pa.array(odd)).to_pylist()), strict=True):
            pieces[k] = np.frombuffer(x, "<u4")
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))

    def chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of chunks that differ; of those that a text may not be cut into, no ids."""
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        odd = np.zeros(len(names), bool)
        for x in self.strings:
            odd |= pc.match_substring(chunks, x, ignore_case=True).to_numpy(zero_copy_only=False)
        if OTHER_CHARACTER.search("".join(names)):
            odd |= np.fromiter((bool(OTHER_CHARACTER.search(c)) for c in names), bool, len(names))
        plain = [c for c, o in zip(names, odd.tolist()) if not o] if odd.any() else names
        n, out = np.zeros(len(names), np.int64), []
        plain_n = []
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            # as in _encode, with the space as a chunk's first character
            text = "".join([c if c[0] == " " else "\n" + c for c in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            own = ids != self.newline
            plain_n.append(np.bincount((np.cumsum(self.edge[ids]) - 1)[own], minlength=len(some)))
            out.append(ids[own])
        if out:
            n[~odd] = np.concatenate(plain_n)
        return _binary(np.concatenate([*out, np.empty(0, "<u4")]), n)

    def _parts(self, chunk: str) -> tuple[str, ...]:
        """The chunk, or the runs that it falls into; the first one has the chunk's mark."""
        mark = "" if self.words or chunk[0] != "\0" else "\0"
        found = AROUND.fullmatch(chunk, len(mark))
        if not found:
            return (chunk,)
        runs = [x for x in found.groups() if x]
        return (mark + runs[0], *runs[1:])

    def _learn(self, new: set[str]) -> None:
        """Encode chunks, each of their runs once, after a look at the last generation."""
        old, memo = self.old, self.memo
        if old:
            memo.update([(c, old[c]) for c in new if c in old])
            new = new.difference(old)
        parts = {c: p for c in new if not ONE.fullmatch(c) and len(p := self._parts(c)) > 1}
        runs = new.difference(parts).union(*parts.values()).difference(memo)
        if old:
            memo.update([(c, old[c]) for c in runs if c in old])
            runs = runs.difference(old)
        if self.words:
            one = [c for c in runs if ONE.fullmatch(c)]
            self._encode(one)
            self._encode_by_place(list(runs.difference(one)))
        else:
            self._encode(list(runs))
        memo.update([(c, b"".join(map(memo.__getitem__, p))) for c, p in parts.items()])

    def _encode(self, chunks: list[str]) -> None:
        """Encode chunks, many of them in one text; ids themselves tell where a chunk begins or ends.

        The last id of a run is one with the mark of word ends, if the file has them. A byte-level chunk stands behind
        its space, which only its first id can have, or behind a newline, whose own id is left out.
        """
        for k in range(0, len(chunks), 4000):
            some = chunks[k : k + 4000]
            text = " ".join(some) if self.words else "".join(" " + c[1:] if c[0] == "\0" else "\n" + c for c in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edge = self.edge[ids]
            of = np.cumsum(edge) - (edge if self.words else 1)
            own = ids != self.newline
            self._keep(some, ids[own], of[own])

    def _encode_by_place(self, chunks: list[str]) -> None:
        """As _encode, for chunks of any number of runs: what an id belongs to is told by its last character."""
        for k in range(0, len(chunks), 4000):
            some = chunks[k : k + 4000]
            length = np.fromiter(map(len, some), np.int64, len(some)) + 1
            found = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            at = np.fromiter((b - 1 for _, b in found.offsets), np.int64, len(found.ids))
            self._keep(some, np.array(found.ids, "<u4"), np.searchsorted(np.cumsum(length) - length, at, "right") - 1)

    def _keep(self, chunks: list[str], ids: np.ndarray, of: np.ndarray) -> None:
        raw, ends = ids.tobytes(), (4 * np.cumsum(np.bincount(of, minlength=len(chunks)))).tolist()
        self.memo.update((c, raw[a:b]) for c, a, b in zip(chunks, [0, *ends], ends, strict=False))


def encoder(path: str, words: bool) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return worker(f"{path}:{words}", lambda: Encoder(path, words))

"""Token counts at every prefix of a text, by dynamic programming over the merges of a word BPE.

For a BPE whose merges run in rank order, two facts make the counts a prefix recurrence:

* a chain of tokens is the encoding of its string exactly if each neighbouring pair is (``Merges.joins``);
* the encoding of a prefix therefore ends in one token t, and what stands before t is the encoding of the
  shorter prefix. So ``last[i]`` and ``count[i]`` follow from ``last[i - len(t)]`` and ``count[i - len(t)]``.

A word's final symbol carries the end mark, so each prefix has two states: open (more of the word follows)
and closed (the text ends here). Across words counts add up, since no merge crosses a word. Truncation and
budget questions read the stored counts; nothing is encoded again.

Positions are code points of the text as it is: where normalising composes, lowers or collapses code points, a prefix
counts as the library counts that prefix alone. The table of a text (``steps``) holds, for each code point, by how much the
count changes there, one signed byte each; sums of it answer every question. Texts are cut at ASCII white space, which
tokens never cross, so the steps of a run are found once per worker and looked up afterwards.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tamis.llm.common import only

#: Entries of a worker's chunk table (about 200 MB); a full table starts anew, which costs time and no exactness.
CHUNKS = 1_000_000
MARK = "</w>"
#: Letters of Latin-1, then ASCII signs but the apostrophe, which can start a contraction.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
#: Runs of ASCII white space, kept by a split.
BLANKS = re.compile(rb"([\x20\x09-\x0D]+)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else spare))
        spare += b not in shown
    return letters


class Merges:
    """The merge table of a word BPE, with the test whether two tokens can stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((left, right), rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (left, right), rank
        self._sound: dict[int, bool] = {}
        self.known: dict[int, bool] = {}

    def joins(self, a: int, b: int) -> bool:
        """Whether the encoding of a's string followed by b's is [a, b].

        Merges are undone from the last to the first. The pair fails if, at some moment, the symbols that face
        each other would have merged before a neighbour on the far side took one of them; at equal rank the
        leftmost merge runs first.
        """
        known = self.known.get(a << 32 | b)
        if known is not None:
            return known
        x, y, before, or_equal, fits = a, b, None, False, True
        while True:
            rank = self.pair.get((x, y))
            if rank is not None and (before is None or rank < before or or_equal and rank == before):
                fits = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                before, or_equal, x = rx, False, self.parts[x][1]
            else:
                before, or_equal, y = ry, True, self.parts[y][0]
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[a << 32 | b] = fits
        return fits

    def sound(self, t: int) -> bool:
        """Whether a token's own string encodes to that token."""
        known = self._sound.get(t)
        if known is None:
            parts = self.parts.get(t)
            if parts is None:
                known = True
            else:
                known = self.sound(parts[0]) and self.sound(parts[1]) and self._unites(t, *parts)
            self._sound[t] = known
        return known

    def _unites(self, t: int, a: int, b: int) -> bool:
        """Whether a and b, each whole, face each other until their own merge runs."""
        x, y, before, or_equal = a, b, self.rank[t], False
        while True:
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                before, or_equal, x = rx, False, self.parts[x][1]
            else:
                before, or_equal, y = ry, True, self.parts[y][0]
            rank = self.pair.get((x, y))
            if rank is not None and (rank < before or or_equal and rank == before):
                return False


class PrefixCounter:
    """Token counts of every prefix under the tokenizer file at path (a word BPE with an end mark)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"])
        sound = {s: t for s, t in vocab.items() if self.merges.sound(t)}
        self.open = {s: t for s, t in sound.items() if not s.endswith(MARK)}
        self.closed = {s[: -len(MARK)]: t for s, t in sound.items() if s.endswith(MARK)}
        self.strings = ahocorasick.Automaton()
        for x in {*self.open, *self.closed}:
            self.strings.add_word(x, (len(x), self.open.get(x, -1), self.closed.get(x, -1)))
        self.strings.make_automaton()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.letters = byte_letters()
        self.words: dict[str, int] = {}
        self.chunks = _Counts(self)
        self.stepped = _Steps(self)
        self.pieces: dict[str, bytes] = {}

    # words -----------------------------------------------------------------------------------------

    def word(self, s: str) -> list[int]:
        """Closed counts of all of a word's prefixes, by symbol; s in byte letters.

        The vocabulary's strings are found by one automaton, at each place the longest first; a prefix's state is the
        first of them that can follow the state before it.
        """
        joins, known, n = self.merges.joins, self.merges.known.get, len(s)
        last, count, ended = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for at, (m, t, closed) in self.strings.iter(s):
            i, j = at + 1, at + 1 - m
            before = last[j]
            if closed >= 0 and not ended[i]:
                fits = j == 0 or known(before << 32 | closed)
                if fits or fits is None and joins(before, closed):
                    ended[i] = count[j] + 1
            if t >= 0 and not count[i]:
                fits = j == 0 or known(before << 32 | t)
                if fits or fits is None and joins(before, t):
                    last[i], count[i] = t, count[j] + 1
        if 0 in ended[1:]:
            raise ValueError("the vocabulary lacks a symbol")
        return ended

    def whole(self, s: str) -> int:
        """The closed count of the whole word, from a table of the words met before."""
        known = self.words.get(s)
        if known is None:
            known = 1 if s in self.closed else self.word(s)[-1]
            if len(s) <= 64:
                if len(self.words) >= CHUNKS // 2:
                    self.words.clear()
                self.words[s] = known
        return known

    def shown(self, s: str) -> str:
        return s if s.isascii() and s.isprintable() and " " not in s else "".join(map(self.letters.__getitem__, s.encode()))

    def _words(self, text: str) -> list[str]:
        """The words, in byte letters, of a text without special strings."""
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def chunk(self, data: bytes) -> int:
        """Tokens of a run without ASCII white space."""
        text = data.decode()
        plain = PLAIN.fullmatch(text)
        if plain and "<|" not in text:
            return sum(self.whole(self.shown(w)) for w in (plain[1].lower(), plain[2]) if w)
        total, at = 0, 0
        for m in self.split_special.finditer(text):
            total += 1 + sum(self.whole(w) for w in self._words(text[at : m.start()]))
            at = m.end()
        return total + sum(self.whole(w) for w in self._words(text[at:]))

    # texts -----------------------------------------------------------------------------------------

    def count(self, data: bytes) -> int:
        """Tokens of a whole text in UTF-8: the chunks' counts, summed."""
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        return sum(map(self.chunks.__getitem__, (data if b"<|" in data else data.lower()).split()))

    def steps(self, data: bytes) -> bytes:
        """By how much the count changes with each code point of a whole text in UTF-8, as signed bytes."""
        if len(self.stepped) > CHUNKS // 2:
            self.stepped.clear()
        return b"".join(map(self.stepped.__getitem__, BLANKS.split(data if b"<|" in data else data.lower())))

    def prefix_counts(self, text: str) -> list[int]:
        """counts[p]: tokens of the first p code points; the last one is the whole text's."""
        return counts_of(self.steps(text.encode())).tolist()

    def piece(self, text: str) -> bytes:
        """The steps of a word of lower-case Latin-1 letters, or of ASCII signs."""
        known = self.pieces.get(text)
        if known is None:
            counts = self.word(self.shown(text))
            if not text.isascii():
                ends = [0]
                for c in text:
                    ends.append(ends[-1] + (1 if c < "\x80" else 2))
                counts = [counts[k] for k in ends]
            known = changes(counts)
            if len(text) <= 64:
                if len(self.pieces) >= CHUNKS // 2:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    def run(self, text: str) -> list[int]:
        """The counts of all prefixes of a run without ASCII white space. A prefix that ends inside a special string counts it as plain text."""
        counts, total, at = [0], 0, 0
        for m in self.split_special.finditer(text):
            plain = self._plain(text[at : m.end()])
            counts += [total + c for c in plain[1:-1]]
            total += plain[m.start() - at] + 1
            counts.append(total)
            at = m.end()
        return counts + [total + c for c in self._plain(text[at:])[1:]]

    def _plain(self, text: str) -> list[int]:
        """The same for a run without special strings, or with one of them as plain text."""
        if unicodedata.is_normalized("NFC", text):
            clusters = list(text)
        else:
            clusters = _clusters(text)
        # What a cluster becomes by itself is what it becomes in the text, since nothing composes across its ends.
        shown = [unicodedata.normalize("NFC", c) for c in clusters]
        normal = [self._lower(c) for c in shown]
        ends = np.cumsum([0, *map(len, normal)]).tolist()
        whole = "".join(normal)
        by_end = self._counts(whole)
        counts = [0]
        for k, c in enumerate(clusters):
            for j in range(1, len(c)):
                # Inside a cluster the text so far may end otherwise: its last words are counted anew.
                begin = self._word_start(whole, ends[k])
                counts.append(by_end[begin] + self._counts(whole[begin : ends[k]] + self._lower(unicodedata.normalize("NFC", c[:j])))[-1])
            counts.append(by_end[ends[k + 1]])
        return counts

    def _lower(self, text: str) -> str:
        return "".join(" " if c.isspace() and not "\x1c" <= c <= "\x1f" else c.lower() for c in text)

    def _word_start(self, text: str, at: int) -> int:
        """A place before which words end whatever follows ``at``: the start of the word there, or of the one before an apostrophe."""
        begin = at
        for _ in range(2):
            while begin and text[begin - 1].isalnum():
                begin -= 1
            while begin and not text[begin - 1].isalnum() and not text[begin - 1].isspace():
                begin -= 1
        return begin

    def _counts(self, normal: str) -> list[int]:
        """The counts of all prefixes of a normalised run."""
        counts, total, at = [0], 0, 0
        for mapped, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            counts += [total] * (start - at)
            piece = normal[start:end]
            if piece[0] == "'" and len(piece) > 1 and piece[1:].isalpha():
                inner = [sum(self.whole(w) for w in self._words(piece[:k])) for k in range(1, len(piece))]
                inner.append(self.whole(mapped))
            else:
                by_symbol, ends, k = self.word(mapped), [], 0
                for c in piece:
                    k += len(c.encode())
                    ends.append(k)
                inner = [by_symbol[k] for k in ends]
            counts += [total + c for c in inner]
            total += inner[-1]
            at = end
        return counts + [total] * (len(normal) - at)

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most budget tokens."""
        return fits(self.steps(text.encode()), budget)


def changes(counts: list[int]) -> bytes:
    """The steps of counts; one more code point moves a count by less than a token's length, so a step beyond a signed byte is an error."""
    return array("b", [b - a for a, b in pairwise(counts)]).tobytes()


def counts_of(steps: bytes) -> np.ndarray:
    """counts[p] of the first p code points, from a stored table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, "int8"), dtype="int64")])


def fits(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens, from a stored table."""
    return int(np.flatnonzero(counts_of(steps) <= budget)[-1]) if budget >= 0 else 0


def _clusters(text: str) -> list[str]:
    """The text cut before every code point that composes with nothing before it."""
    found: list[str] = []
    for c in text:
        if found and (unicodedata.combining(c) or c in _seconds()):
            found[-1] += c
        else:
            found.append(c)
    return found


_SECONDS: set[str] = set()


def _seconds() -> set[str]:
    """Code points that can compose with the one before: second parts of canonical decompositions, and Hangul vowels and finals."""
    if not _SECONDS:
        parts = (unicodedata.decomposition(chr(i)) for i in range(0x110000))
        _SECONDS.update(chr(int(p.split()[1], 16)) for p in parts if p and p[0] != "<" and " " in p)
        _SECONDS.update(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
    return _SECONDS


class _Counts(dict):
    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, data: bytes) -> int:
        n = self[data] = self.counter.chunk(data)
        return n


class _Steps(dict):
    """A run of white space or of other code points -> its steps."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, data: bytes) -> bytes:
        if not data or data[0] in b" \t\n\v\f\r":
            found = bytes(len(data))
        else:
            text = data.decode()
            plain = PLAIN.fullmatch(text)
            if plain and "<|" not in text:
                found = b"".join(self.counter.piece(x) for x in (plain[1].lower(), plain[2]) if x)
            else:
                found = changes(self.counter.run(text))
        if len(data) <= 64:
            self[data] = found
        return found


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, and with prefixes the table of its prefixes; narrow, with no shuffle.

    prefix_steps holds for each code point by how much the token count changes there (signed bytes): the sum of the
    first p is the exact count of the first p code points (``counts_of``). n_tokens is the sum of all; fits_chars, the
    code points of the longest prefix of at most limit tokens, is read from it too (``fits`` answers any other budget).

    tokenizer: path of the vocabulary file, present on every machine. Null texts count as empty ones (0 bytes, 0
    tokens); null ids and repeated rows come back as they are; texts of any length are taken whole; other columns of
    docs take no part, whatever their names.
    """
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()} | ({"fits_chars": pa.int64(), "prefix_steps": pa.binary()} if prefixes else {})
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean" + (", fits_chars bigint, prefix_steps binary" if prefixes else "")

    def counted(batches):
        c = counter(tokenizer)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            tables = [c.steps(x) for x in texts] if prefixes else []
            counts = [int(np.frombuffer(x, "int8").sum(dtype="int64")) for x in tables] if prefixes else [c.count(x) for x in texts]
            columns = [batch.column(0), [len(x) for x in texts], counts, [n > limit for n in counts]]
            if prefixes:
                columns += [[fits(x, limit) if n > limit else len(x) for x, n in zip(tables, counts, strict=True)], tables]
            yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(x, kind) for x, kind in zip(columns[1:], list(kinds.values())[1:], strict=True))], names=list(kinds))

    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(counted, schema)

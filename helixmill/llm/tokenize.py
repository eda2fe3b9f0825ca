"""Token ids of texts by a public byte-level BPE vocabulary (problem 8), by a streaming transducer.

Every word of a text goes through the transducer, which reads its bytes once, left to right, with two facts of merge lists:

* The tokens of a prefix end with the one token t for which t follows the last token before it validly: merging the bytes of
  the two again gives just these two. An automaton of all tokens names those that end at a byte, the longest first.
* The last tokens of the prefixes form a tree. Any longer text ends in one of the MAX_TOKEN latest prefixes or grows out of
  them, so the tokens that all of these have in common are final and go out. MAX_TOKEN, the most bytes of any token, is the
  sufficient lookahead; what is kept of a word doesn't grow with its length.

Long texts come in pieces. Of each only what a longer text could still change is held back: an unfinished word stays open in
the transducer and grows with the next piece; at most three characters wait (the last blank of a run, a started contraction).
What the transducer gave for a word, or for a stretch between blanks, is kept in tables of bounded size. Ids go back to text by
a machine that holds at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The fixed pattern of this vocabulary that parts a text into words; blanks are those with the property White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: How each kind of open word goes on: letters, numbers, blanks, anything else.
GOES_ON = {"L": r"\p{L}*", "N": r"\p{N}*", "B": r"\p{White_Space}*", "O": r"[^\p{White_Space}\p{L}\p{N}]*"}
#: Blanks, the same as in PATTERN, with what follows them.
STRETCH = r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+"
PIECE = 1 << 16
#: Bytes of a word between two looks for what is final.
STEP = 4096
#: Entries of each table of results, and the most characters of an entry.
KEPT, KEPT_CHARS = 200_000, 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Word:
    """One word on its way through the transducer."""

    def __init__(self, t: Transducer):
        self.t = t
        self.last = [t.start]  # the last token of each live prefix, -1 where none ends; the first belongs to what is out
        self.matches = t.automaton.iter("")
        self.read = 0  # bytes read; the automaton counts ends from the first
        self.out = 0  # bytes whose tokens are out

    def push(self, data: bytes) -> list[int]:
        """The ids that these further bytes make final."""
        out: list[int] = []
        for lo in range(0, len(data), STEP):
            part = data[lo : lo + STEP]
            self._advance(part)
            if len(self.last) > STEP:
                out += self._final()
        return out

    def _advance(self, part: bytes) -> None:
        t, last = self.t, self.last
        self.matches.set(part.decode("latin-1"), False)
        shift = 1 - self.out
        known, pair = t.pairs.get, t.pair
        for end, (size, token) in self.matches:
            n = end + shift
            have = len(last)
            if n < have:
                continue  # a longer token ends here
            while have < n:
                last.append(-1)
                have += 1
            before = last[n - size]
            if before >= 0:
                ok = known((before, token))
                if ok or (ok is None and pair(before, token)):
                    last.append(token)
        self.read += len(part)
        last += [-1] * (self.read - self.out + 1 - len(last))

    def _final(self) -> list[int]:
        last, sizes = self.last, self.t.sizes
        n = len(last) - 1
        live = {p for p in range(max(0, n - self.t.lookahead), n + 1) if last[p] >= 0}
        for p in range(n, 0, -1):  # down to the prefix that all live ones grew out of
            if len(live) <= 1:
                break
            if p in live:
                live.remove(p)
                live.add(p - sizes[last[p]])
        return self._emit(max(live)) if live else []

    def _emit(self, upto: int) -> list[int]:
        last, sizes, ids, p = self.last, self.t.sizes, [], upto
        while p > 0:
            ids.append(last[p])
            p -= sizes[last[p]]
        del last[:upto]
        self.out += upto
        return ids[::-1]

    def close(self) -> list[int]:
        """The remaining ids."""
        return self._emit(len(self.last) - 1)


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.lookahead = max(map(len, ranks))
        self.text = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.start = max(self.sizes) + 1
        self.automaton = ahocorasick.Automaton()
        for k, v in ranks.items():
            self.automaton.add_word(k.decode("latin-1"), (len(k), v))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile(STRETCH).findall
        self.goes_on = {k: regex.compile(p) for k, p in GOES_ON.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int, int]]] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that the merge list joins last into this one; None if it never makes it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        rank = self.ranks.get
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
            if not found:
                return None
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1])

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """What stands at the token's right or left end while it is merged: (text, rank at which it comes, rank at which it goes)."""
        if (got := self.spines.get((token, right), 0)) == 0:
            got, t, goes = [], self.text[token], self.start
            while True:
                comes = self.ranks[t] if len(t) > 1 else -1
                got.append((t, comes, goes))
                if len(t) == 1:
                    break
                halves = self._halves(t)
                if halves is None:
                    got = None
                    break
                goes, t = comes, halves[right]
            if len(self.spines) >= KEPT:
                self.spines.clear()
            self.spines[token, right] = got
        return got

    def pair(self, a: int, b: int) -> bool:
        """Whether token b follows token a validly; a may be the start of a word.

        It does unless some merge over the line between them comes while both its sides stand at the line: before the left
        side goes into a larger token, and not after the right side does, as of equal ranks the leftmost pair comes first.
        """
        y = self._spine(b, False)
        ok = y is not None
        if ok and a != self.start:
            x, rank = self._spine(a, True), self.ranks.get
            ok = x is not None and not any(s0 < g1 and s1 < g0 and (r := rank(t0 + t1)) is not None and r < g0 and r <= g1 for t0, s0, g0 in x for t1, s1, g1 in y)
        if len(self.pairs) >= 5 * KEPT:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    # -- texts -----------------------------------------------------------------------------------------------------------
    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word of any length whose bytes come in chunks; emitted once no continuation can change them."""
        w = Word(self)
        for c in chunks:
            yield from w.push(c)
        yield from w.close()

    def word(self, text: str) -> tuple[int, ...]:
        if (got := self.words.get(text)) is None:
            got = tuple(self.stream((text.encode("utf-8", "replace"),)))
            if len(text) <= KEPT_CHARS:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[text] = got
        return got

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a whole number of words."""
        got = tuple(chain.from_iterable(map(self.word, self.pattern.findall(text))))
        if len(text) <= KEPT_CHARS:
            if len(self.stretches) >= KEPT:
                self.stretches.clear()
            self.stretches[text] = got
        return got

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """Ids of a text, stretch by stretch: blanks and what follows up to the next blank. Words never go on over that line."""
        if len(text) > PIECE:
            return list(self.pieces(text[i : i + PIECE] for i in range(0, len(text), PIECE)))
        known, stretch = self.stretches.get, self.stretch
        return [known(s) or stretch(s) for s in self.cut(text)]

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, self.parts(text) if len(text) <= PIECE else self.pieces(text[i : i + PIECE] for i in range(0, len(text), PIECE))))

    def encode(self, pieces: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in pieces, cut anywhere between code points."""
        return chain.from_iterable(self.pieces(pieces))

    def pieces(self, pieces: Iterable[str]) -> Iterator[tuple[int, ...]]:
        held, open_, kind = "", None, ""
        for piece in pieces:
            if not piece:
                continue
            text, held, at = held + piece, "", 0
            if open_ is not None:
                end = self.goes_on[kind].match(text).end()
                own = end - 1 if kind == "B" else end  # the last blank may belong to the next word
                yield tuple(open_.push(text[:own].encode("utf-8", "replace")))
                if end == len(text):
                    held = text[own:]
                    continue
                yield tuple(open_.close())
                open_, at = None, own
            spans = [m.span() for m in self.pattern.finditer(text, at)]
            lo, hi = spans[-1]
            w = text[lo:hi]
            if len(spans) > 1 and w in ("r", "v", "l") and text[slice(*spans[-2])] == "'":
                lo = spans[-2][0]  # a contraction may come
                held = text[lo:]
            elif w == "'" or (len(w) == 1 and self.goes_on["B"].fullmatch(w)):
                held = w
            elif w[0] == "'" and w[1].isalpha():
                lo = hi  # a whole contraction
            else:
                kind = next(k for k, p in self.goes_on.items() if p.fullmatch(w[-1]))
                open_ = Word(self)
                if kind == "B":
                    w, held = w[:-1], w[-1]
            for a, b in spans:
                if a < lo:
                    yield self.word(text[a:b])
            if open_ is not None:
                yield tuple(open_.push(w.encode("utf-8", "replace")))
        if open_ is not None:
            yield tuple(open_.push(held.encode("utf-8", "replace")))
            yield tuple(open_.close())
        else:
            yield from map(self.word, self.pattern.findall(held))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, a piece per id; bytes of an unfinished character wait for the next."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield machine.decode(self.text[i])
        yield machine.decode(b"", True)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(load_ranks(path))


def id_lists(t: Transducer, texts: list[str | None]) -> pa.ListArray:
    parts = [t.parts(x) if x else [] for x in texts]
    sizes = np.array([sum(map(len, p)) for p in parts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(parts)), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row. Null and empty texts have the empty list; special tokens' strings are plain text."""
    src = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column("k"), id_lists(t, part.column("t").to_pylist())], names=[key, "ids"])

    return src.mapInArrow(run, f"`{key}` long, ids array<int>")


def texts_of_ids(ids: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids): the way back. An empty or null list is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(t.decode(x or ())) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` long, text string")


def token_counts(documents: DataFrame, columns: list[str], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """(*columns, n_tokens): how many tokens each text has; 0 for null and empty ones."""
    src = documents.select(*columns, F.col(text).cast("string").alias("text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            n = [t.count(x) for x in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    return src.mapInArrow(run, f"{kinds}, n_tokens long")

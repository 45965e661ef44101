"""Cut texts of too many tokens into overlapping pieces at natural boundaries.

Every possible cut of a text gets a strength (paragraph, line, sentence, clause, blank, inside a run of
characters). A sparse table of range maxima over the strengths answers for each piece which cut is the
strongest in the window of permissible lengths, the rightmost among equals; the next piece starts at the
strongest cut about ``overlap`` tokens before that end, of equally strong ones at that which comes nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import TOKENIZER_DIR, VOCABULARY, Encoder, Sent

LIMIT, OVERLAP = 2048, 128
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, NONE, INSIDE = 6, 5, 4, 3, 2, 1, 0
SENTENCE_ENDS, CLAUSE_ENDS, CLOSERS = frozenset(".!?…。！？؟।"), frozenset(",;:，；：、—–"), frozenset("\"'”’»)]}」』）")
#: A word of more tokens than this may be cut inside, between code points.
LONG_WORD = 16


class RangeMax:
    """Sparse table: the index of the largest value in a range, the rightmost among equals, in two look-ups.

    Ranges of at most ``longest`` values need no more than log2(longest) + 1 levels, and they come from left to right:
    the table holds a block of the values at a time and is built anew for the next, so a text of any length
    needs the memory of one block.
    """

    BLOCK = 1 << 16

    def __init__(self, values: np.ndarray, longest: int | None = None):
        self.values, self.n = values, len(values)
        self.longest = min(self.n, longest or self.n)
        self.start = self.stop = 0

    def _build(self, lo: int) -> None:
        self.start, self.stop = lo, min(self.n, lo + max(self.BLOCK, 2 * self.longest))
        level = self.values[lo : self.stop].astype(np.int64) * (self.n + 1) + np.arange(lo, self.stop)
        self.levels, width = [level], 1
        while 2 * width <= min(self.longest, self.stop - lo):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Over lo..hi, both included; at most ``longest`` values."""
        if lo < self.start or hi >= self.stop:
            self._build(lo)
        lo, hi = lo - self.start, hi - self.start
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1])) % (self.n + 1)


def _strength(before: str, earlier: str, word: str) -> int:
    """Of the cut between ``before`` (after ``earlier``) and ``word``."""
    if before.isspace():
        run = (earlier + before) if earlier.isspace() else before
        breaks = run.count("\n") or run.count("\r")
        if breaks:
            return PARAGRAPH if breaks > 1 else LINE
        before, blank = earlier, True
    else:
        blank = word[0].isspace()
        if blank and ("\n" in word or "\r" in word):
            return NONE  # the cut after the break is the better one
    end = before.rstrip("".join(CLOSERS))[-1:] or before[-1:]
    if end in SENTENCE_ENDS and (blank or end not in ".…!?"):
        return SENTENCE
    if end in CLAUSE_ENDS and (blank or end not in ",;:"):
        return CLAUSE
    return BLANK if blank else NONE


def cuts(words: list[str], enc: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each possible cut, the end included: character offset, tokens before it, strength. ``words``: the text as the encoder divides it."""
    at, tokens, strength = [], [], []
    pos = total = 0
    earlier = before = ""
    for word in words:
        ids = enc.words[word]
        at.append(pos)
        tokens.append(total)
        strength.append(_strength(before, earlier, word) if before else NONE)
        if len(ids) > LONG_WORD:
            starts = np.cumsum([0, *(len(c.encode("utf-8", "replace")) for c in word)])
            ends = np.cumsum([len(enc.pieces[i]) for i in ids])[:-1]
            where = np.searchsorted(starts, ends)
            for k in np.flatnonzero(starts[where] == ends):
                at.append(pos + int(where[k]))
                tokens.append(total + int(k) + 1)
                strength.append(INSIDE)
        pos += len(word)
        total += len(ids)
        earlier, before = before, word
    return np.array([*at, pos]), np.array([*tokens, total]), np.array([*strength, PARAGRAPH])


def _tokens(text: str, enc: Encoder, at: np.ndarray, tok: np.ndarray, strength: np.ndarray, s: int, e: int) -> int:
    """Tokens of the piece between two cuts, encoded by itself.

    Between cuts beside words only the white space at the end can be divided otherwise than in the whole text (it
    looks ahead); a piece that starts or ends inside a word is encoded anew.
    """
    if strength[s] == INSIDE or e < len(strength) - 1 and strength[e] == INSIDE:
        return enc.count(text[at[s] : at[e]])
    k = e
    while k > s and strength[k] != INSIDE and text[at[k - 1] : at[k]].isspace():
        k -= 1
    return int(tok[k] - tok[s]) + (enc.count(text[at[k] : at[e]]) if k < e else 0)


def _nearest(best: RangeMax, strength: np.ndarray, tok: np.ndarray, lo: int, hi: int, wanted: int) -> int:
    """Of the strongest cuts in lo..hi the one whose number of tokens is nearest to the wanted one."""
    equal = lo + np.flatnonzero(strength[lo : hi + 1] == strength[best.argmax(lo, hi)])
    return int(equal[np.argmin(np.abs(tok[equal] - wanted))])


def pieces(text: str, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP, words: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece in characters; one piece if the text keeps the limit, none if it's empty.

    Each piece encodes to at most ``limit`` tokens. Only a single code point of more tokens than the
    limit could break that; it then is a piece of its own.
    """
    if not text:
        return []
    at, tok, strength = cuts(enc.split(text) if words is None else words, enc)
    last = len(at) - 1
    if tok[last] <= limit:
        return [(0, len(text), int(tok[last]))]
    best, out, s = RangeMax(strength, limit + 2), [], 0  # cuts lie a token apart at least
    while True:
        hi = int(np.searchsorted(tok, tok[s] + limit, side="right")) - 1
        while True:
            hi = max(hi, s + 1)
            if hi >= last:
                e = last
            else:
                lo = max(s + 1, int(np.searchsorted(tok, tok[s] + limit // 2)))
                e = best.argmax(min(lo, hi), hi)
            n = _tokens(text, enc, at, tok, strength, s, e)
            if n <= limit or e == s + 1:
                break
            hi = e - 1
        out.append((int(at[s]), int(at[e]), n))
        if e == last:
            return out
        lo = int(np.searchsorted(tok, tok[e] - overlap * 5 // 4))
        hi = int(np.searchsorted(tok, tok[e] - overlap * 3 // 4, side="right")) - 1
        nxt = _nearest(best, strength, tok, lo, hi, tok[e] - overlap) if lo <= hi else int(np.searchsorted(tok, tok[e] - overlap, side="right")) - 1
        s = nxt if s < nxt < e else e


def split_oversized(
    df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP,
    folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, keep_small: bool = False,
) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: key, piece, start, end (characters), n_tokens, doc_tokens, text.

    A text can't have more tokens than bytes, so texts of at most ``limit`` bytes never leave the JVM, unless
    ``keep_small`` asks for the whole texts within the limit as pieces as well. Null and empty texts have no
    piece. Repeated keys are split each on its own; other columns are left out. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("k"), df[text].cast("string").alias("t")).filter(F.length("t") > 0)
    if not keep_small:
        picked = picked.filter(F.octet_length("t") > limit)

    sent = Sent(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.encoder()
        look = enc.words.__getitem__
        for b in batches:
            for key_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = enc.split(t)
                total = sum(map(len, map(look, words)))
                if total <= limit and not keep_small:
                    continue
                got = pieces(t, enc, limit, overlap, words)
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key_] * n, b.column(0).type), pa.array(range(n), pa.int32()), pa.array([a for a, _, _ in got], pa.int64()), pa.array([z for _, z, _ in got], pa.int64()),
                     pa.array([c for _, _, c in got], pa.int32()), pa.array([total] * n, pa.int64()), pa.array([t[a:z] for a, z, _ in got], pa.string())],
                    names=["k", "piece", "start", "end", "n_tokens", "doc_tokens", "text"],
                )

    out = picked.mapInArrow(run, f"k {kind}, piece int, start long, end long, n_tokens int, doc_tokens long, text string")
    return out.withColumnRenamed("k", key)

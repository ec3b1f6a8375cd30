"""Problem 9: oversized texts cut at natural boundaries into overlapping pieces.

Balanced targets: the fewest pieces that can hold the text get ends at equal
distances; every end snaps to the strongest boundary near it. When a piece
can't keep the limit, or its end had to go far from its target, what is left of
the text is planned anew, with a piece more if need be; what was cut stays, so
that the work grows as the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.boards import WS_CLASS, strip
from plyforge.llm.tokens import VOCABULARY, encoder, with_token_counts
from plyforge.session import map_arrow

LIMIT, OVERLAP = 2048, 128
#: Names of boundary strengths, the weakest first.
BOUNDARIES = ("inside a word", "word", "sentence", "line", "paragraph")
# What str.isspace() takes as white space, and what ends a sentence.
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
STOPS = np.array([ord(x) for x in ".!?…"], np.uint32)
CLOSERS = np.array([ord(x) for x in "\"')]}»”’"], np.uint32)


def _one_of(code: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which code points are among some, by a table."""
    table = np.zeros(int(some.max()) + 2, bool)
    table[some] = True
    return table[np.minimum(code, len(table) - 1)]


class Text:
    """A text with its token boundaries as places between characters, and the strength of each."""

    def __init__(self, text: str, enc, lengths: np.ndarray):
        self.text, self.enc = text, enc
        raw = text.encode()
        self.code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        ends = np.concatenate([[0], np.cumsum(lengths[np.array(enc.encode_ordinary(text), np.int64)])])
        self.n_tokens = len(ends) - 1
        # boundary t lies before token t; one inside a character counts as before that character
        self.at = np.searchsorted(np.append(starts, len(raw)), ends, "right") - 1
        self.space = _one_of(self.code, SPACES)
        self.strength = self._strengths()

    def _strengths(self) -> np.ndarray:
        """By place between characters: how good an end it is."""
        n, code, space = len(self.code), self.code, self.space
        line = (code == 10) | (code == 13)
        line[:-1] &= ~((code[:-1] == 13) & (code[1:] == 10))  # CR LF is one end
        solid = np.where(space, -1, np.arange(n))
        last = np.maximum.accumulate(solid) if n else solid  # last solid character up to here
        breaks = np.cumsum(line)
        s = np.zeros(n + 1, np.int8)
        before, after = space[: n - 1], space[1:]
        s[1:n][before | after] = 1
        closing = _one_of(code, CLOSERS)
        inner = np.where(space | closing, -1, np.arange(n))
        word_end = np.maximum.accumulate(inner) if n else inner
        ended = (last >= 0) & (word_end >= 0) & _one_of(code[np.maximum(word_end, 0)], STOPS)
        here = np.zeros(n + 1, bool)
        here[1:] = ended
        s[(s == 1) & here] = 2
        s[1:][line] = 3
        since = breaks - np.where(last >= 0, breaks[np.maximum(last, 0)], 0)
        s[1:][line & (since >= 2)] = 4
        s[0] = s[n] = 4
        return s

    def unbreakable(self, limit: int) -> bool:
        """Whether a stretch without white space has more than ``limit`` tokens of its own."""
        edges = np.flatnonzero(np.diff(np.concatenate([[True], self.space, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            # a token is at least a byte, and a character at most four
            if (b - a) * 4 > limit and len(self.enc.encode_ordinary(self.text[a:b])) > limit:
                return True
        return False

    def cut(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """(char_start, char_end, tokens, strength of the end, tokens shared with the piece before)."""
        n = self.n_tokens
        if n <= limit:
            return [(0, len(self.code), n, 4, 0)]
        out: list[tuple[int, int, int, int, int]] = []
        start, shared, pieces, failed = 0, 0, 0, 0
        while start + overlap < n or not out:
            fewest = max(1, -(-(n - overlap - start) // (limit - overlap)))
            got, left = self._cut_on(start, max(fewest, pieces), limit, overlap)
            for begin, end, tokens in got:
                a, b = int(self.at[begin]), int(self.at[end])
                out.append((a, b, tokens, int(self.strength[b]), shared))
                start, shared = end - overlap, overlap
                if end == n:
                    return out
            # a plan that failed at once gets a piece more, then two, then four
            failed = 0 if got else failed + 1
            pieces = left + 2 ** (failed - 1) if failed else 0
        return out

    def _cut_on(self, begin: int, pieces: int, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
        """((start, end, tokens) of pieces from token ``begin`` on, as long as a plan of so many pieces works; how many it had left)."""
        n, step = self.n_tokens, (self.n_tokens - overlap - begin) / pieces
        reach = max(1, min(int(step / 3), limit // 8))
        got, start = [], begin
        for i in range(1, pieces + 1):
            target = begin + overlap + round(i * step)
            top = min(start + limit, n - 1)
            for _ in range(8):
                end, far = (n, False) if i == pieces else self._end(start + overlap + 1, target, top, reach)
                if end < 0 or end - start > limit:
                    return got, pieces - i + 1
                tokens = len(self.enc.encode_ordinary(self.text[self.at[start] : self.at[end]])) if self.at[end] > self.at[start] else limit + 1
                if tokens <= limit:
                    break
                if i == pieces:
                    return got, 1
                top = end - 1  # a little shorter
            else:
                return got, pieces - i + 1
            got.append((start, end, tokens))
            start = end - overlap
            if far:
                return got, pieces - i
        return got, 0

    def _end(self, low: int, target: int, top: int, reach: int) -> tuple[int, bool]:
        """(token at which to end, whether it is far from the target): the strongest boundary near the target, else any natural one in reach of the limit, else the target; -1 if nothing is left."""
        near = np.arange(max(low, target - reach), min(target + reach, top) + 1)
        if len(near):
            strength = self.strength[self.at[near]]
            best = strength.max()
            if best > 0:
                good = near[strength == best]
                return int(good[np.argmin(np.abs(good - target))]), False
        every = np.arange(low, top + 1)
        good = every[self.strength[self.at[every]] > 0]
        if len(good):
            return int(good[np.argmin(np.abs(good - target))]), True
        return (int(near[np.argmin(np.abs(near - target))]), False) if len(near) else (-1, False)


def token_lengths(enc) -> np.ndarray:
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def cut_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, path: str = VOCABULARY) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens, in order.

    (``doc_id``, ``piece`` from 1, ``pieces``, ``char_start``, ``char_end``,
    ``n_tokens`` of the piece encoded alone, ``shared_tokens`` with the piece
    before, ``ends_at``, ``unbreakable``[, ``piece_text``]). Places count
    characters from 0; consecutive pieces share ``overlap`` tokens of the text
    as encoded whole (where a token boundary falls inside a character, the
    piece begins with that character). Every piece has at most ``limit``
    tokens. A text is cut inside a word only where no natural end lies within
    the piece's limit.

    Null, empty and shorter texts give no row; repeated rows give repeated
    pieces; extra columns are ignored. Texts are cut in the tasks that scan
    them: nothing is shuffled. A text of at most ``limit`` bytes can't have
    more tokens than that and isn't encoded.
    """
    if limit < 16 or not 0 <= overlap < limit // 2:
        raise ValueError("the limit must be at least 16, and the overlap less than half of it")
    schema = "doc_id bigint, piece int, pieces int, char_start int, char_end int, n_tokens int, shared_tokens int, ends_at string, unbreakable bigint" + (
        ", piece_text string" if with_text else ""
    )
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()] + [pa.string()] * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        lengths = token_lengths(enc)
        rows: list[tuple] = []
        held = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                t = Text(text, enc, lengths)
                if t.n_tokens <= limit:
                    continue
                cuts = t.cut(limit, overlap)
                whole = int(t.unbreakable(limit))
                doc = b.column(0)[i].as_py()
                for k, (a, z, n, strength, shared) in enumerate(cuts):
                    rows.append((doc, k + 1, len(cuts), a, z, n, shared, BOUNDARIES[strength], whole) + ((text[a:z],) if with_text else ()))
                held += len(text)
                if held > 4_000_000:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    long = docs.filter(F.octet_length("text") > limit).select("doc_id", "text")
    return map_arrow(long, run, schema)


def broken_rules(docs: DataFrame, pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY) -> DataFrame:
    """(``rule``, ``violations``) of pieces with their texts against the documents, told apart by ``doc_id``.

    ``text``: pieces that aren't what stands at their place. ``cover``: texts
    whose pieces don't follow each other from the first character to the last.
    ``limit``: pieces of too many tokens, counted anew. ``overlap``: pieces that
    don't share ``overlap`` tokens with the one before. ``natural``: pieces that
    end inside a word though white space lies between the end of the piece
    before, or the first ``overlap`` tokens, and their own. ``missing``: texts too long that weren't cut.
    """
    counted = with_token_counts(pieces.withColumn("text", F.col("piece_text")), out="again", path=path)
    # of a first piece, which can't end within its first tokens, what stands before its last white space
    inside = (F.col("piece") == 1) & (F.col("ends_at") == BOUNDARIES[0])
    front = F.when(inside, F.regexp_extract("piece_text", rf"(?s)\A(.*){WS_CLASS}", 1))
    counted = with_token_counts(counted.withColumn("front", front), "front", "front_tokens", path)
    counted = counted.join(docs.select("doc_id", "text"), "doc_id")
    before = F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("piece"))  # the pieces of one text
    p = counted.withColumn("before", before)
    last = F.col("piece") == F.col("pieces")
    here = F.substr(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    new = F.substr(F.col("text"), F.coalesce(F.col("before"), F.lit(0)) + 1, F.col("char_end") - F.coalesce(F.col("before"), F.lit(0)))
    start = F.when(F.col("piece") == 1, F.col("char_start") == 0).otherwise(
        (F.col("char_start") <= F.col("before")) & (F.col("before") < F.col("char_end"))
    )
    rules = {
        "text": here != F.col("piece_text"),
        "cover": ~F.coalesce(start, F.lit(False)) | (last != (F.col("char_end") == F.char_length("text"))),
        "limit": (F.col("again") > limit) | (F.col("again") != F.col("n_tokens")),
        "overlap": F.col("shared_tokens") != F.when(F.col("piece") == 1, 0).otherwise(overlap),
        "natural": ~last & (F.col("ends_at") == BOUNDARIES[0]) & F.when(
            F.col("piece") == 1, F.col("front_tokens") > overlap + 1
        ).otherwise(strip(new).rlike(WS_CLASS)),
    }
    counts = p.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    tall = counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in rules])).alias("x")
    ).select("x.*")
    long = with_token_counts(docs.select("doc_id", "text"), path=path).filter(F.col("n_tokens") > limit)
    missing = long.join(pieces.select("doc_id"), "doc_id", "left_anti").agg(F.lit("missing").alias("rule"), F.count(F.lit(1)).alias("violations"))
    return tall.unionByName(missing)

import random
import time

import pytest
from pyspark.sql import functions as F

from plyforge.llm import cutting
from plyforge.llm.tokens import encoder, with_token_counts

DOCS = "doc_id bigint, text string"


def words(n, seed=0):
    rng, out = random.Random(seed), []
    for _ in range(n):
        out.append(rng.choice(["rook", "Läufer", "игра", "e4", "nunca", "the", "1-0", "depth", "🙂"]))
        out.append(rng.choice([" ", " ", " ", " ", ". ", "\n", "\r\n", "\n\n", "! "]))
    return "".join(out)


TEXTS = [
    (1, words(9000)),
    (2, "x" * 50_000),
    (3, words(2000, 3) + "".join(random.Random(1).choice("abcXYZ0189+/") for _ in range(9000)) + " " + words(1500, 4)),
    (4, "short text"),
    (5, ""),
    (6, None),
    (7, "🙂" * 5000),
    (8, " chess" * 2048),
    (9, " chess" * 2049),
    (10, "\n" * 30_000),
    (11, "ü" * 9000 + "\n\n" + "word " * 3000),
    (12, words(200_000, 5)),
]


@pytest.fixture(scope="module")
def pieces(spark):
    df = spark.createDataFrame(TEXTS, DOCS).repartition(3).withColumn("piece", F.lit("x"))
    by = {}
    for r in cutting.cut_documents(df).collect():
        by.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece) for k, v in by.items()}


def test_only_oversized_texts_are_cut(pieces):
    enc = encoder()
    assert set(pieces) == {i for i, t in TEXTS if t and len(enc.encode_ordinary(t)) > cutting.LIMIT}
    assert 8 not in pieces and 9 in pieces


def test_pieces_are_places_in_the_text(pieces):
    text, enc = dict(TEXTS), encoder()
    for i, rows in pieces.items():
        assert [r.piece for r in rows] == list(range(1, len(rows) + 1)) and {r.pieces for r in rows} == {len(rows)}
        assert rows[0].char_start == 0 and rows[-1].char_end == len(text[i])
        for r in rows:
            assert r.piece_text == text[i][r.char_start : r.char_end]
            assert r.n_tokens == len(enc.encode_ordinary(r.piece_text)) <= cutting.LIMIT
        for a, b in zip(rows, rows[1:], strict=False):
            assert a.char_start < b.char_start <= a.char_end < b.char_end
            assert b.shared_tokens == cutting.OVERLAP
            shared = len(enc.encode_ordinary(text[i][b.char_start : a.char_end]))
            assert abs(shared - cutting.OVERLAP) <= 8


def test_few_balanced_pieces(pieces):
    enc = encoder()
    for i, t in TEXTS:
        if i in pieces:
            n = len(enc.encode_ordinary(t))
            least = -(-(n - cutting.OVERLAP) // (cutting.LIMIT - cutting.OVERLAP))
            assert least <= len(pieces[i]) <= least + max(2, least // 5)


def test_boundaries(pieces):
    assert {r.ends_at for r in pieces[1]} == {"paragraph"}
    assert "inside a word" in {r.ends_at for r in pieces[2]}
    text = dict(TEXTS)
    for rows in pieces.values():
        for r in rows[:-1]:
            before, after = text[r.doc_id][: r.char_end], text[r.doc_id][r.char_end :]
            if r.ends_at == "line":
                assert before.endswith(("\n", "\r"))
            elif r.ends_at == "paragraph":
                assert before[len(before.rstrip()) :].replace("\r\n", "\n").count("\n") >= 2
            elif r.ends_at in ("sentence", "word"):
                assert before[-1].isspace() or after[0].isspace()
            else:
                assert not before[-1].isspace() and not after[0].isspace()


def test_unbreakable(pieces):
    assert {i: v[0].unbreakable for i, v in pieces.items()} == {1: 0, 2: 1, 3: 1, 7: 1, 9: 0, 10: 0, 11: 1, 12: 0}


def test_stronger_boundaries_win():
    enc = encoder()
    text = "word " * 1300 + "\n\n" + "word " * 1300
    t = cutting.Text(text, enc, cutting.token_lengths(enc))
    cut = t.cut(2048, 128)
    assert len(cut) == 2 and text[: cut[0][1]].endswith("\n\n")


def pieces_of(text, limit=2048, overlap=128):
    enc = encoder()
    t = cutting.Text(text, enc, cutting.token_lengths(enc))
    return t, t.cut(limit, overlap)


def test_words_are_cut_only_where_no_natural_end_is_in_reach():
    """Stretches without white space of 500 to 1,900 tokens, wherever the targets fall."""
    rng = random.Random(3)
    parts = []
    for _ in range(60):
        parts.append("".join(rng.choice("abcXYZ0189+/") for _ in range(rng.randrange(800, 2800))))
        parts.append(" " + words(rng.randrange(5, 120), rng.random()))
    t, got = pieces_of("".join(parts))
    for a, b, n, strength, _ in got[:-1]:
        assert n <= 2048
        if strength == 0:
            at = list(t.at)
            begin = next(i for i, x in enumerate(at) if x == a)
            inside = [i for i in range(begin + 130, min(begin + 2030, len(at))) if t.strength[at[i]] > 0]
            assert not inside, (a, b)


def test_time_grows_as_the_text():
    unit = words(40_000, 8)
    took = []
    for times in (4, 40):
        text = unit * times
        began = time.perf_counter()
        t, got = pieces_of(text)
        took.append((time.perf_counter() - began) / len(text))
        assert got[0][0] == 0 and got[-1][1] == len(text) and max(n for _, _, n, *_ in got) <= 2048
        least = -(-(t.n_tokens - 128) // 1920)
        assert least <= len(got) <= least * 1.15 + 2
    assert took[1] < took[0] * 2.5


def test_other_limits_and_bad_ones(spark):
    df = spark.createDataFrame(TEXTS[:3], DOCS)
    out = cutting.cut_documents(df, limit=100, overlap=10, with_text=False).collect()
    assert max(r.n_tokens for r in out) <= 100
    assert cutting.cut_documents(df, limit=100, overlap=0).count() > 100
    with pytest.raises(ValueError):
        cutting.cut_documents(df, limit=100, overlap=60)


def test_counts_of_tokens(spark):
    df = spark.createDataFrame(TEXTS, DOCS).withColumn("n", F.lit(1))
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df).collect()}
    enc = encoder()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in TEXTS}


def test_empty(spark):
    assert cutting.cut_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_rules_tell_what_is_broken(spark):
    docs = spark.createDataFrame(TEXTS, DOCS)
    cuts = cutting.cut_documents(docs)
    broken = lambda p: {r.rule: r.violations for r in cutting.broken_rules(docs, p).collect()}
    assert set(broken(cuts).values()) == {0}
    assert broken(cuts.filter("doc_id <> 1"))["missing"] == 1
    assert broken(cuts.filter("piece <> 2 or doc_id <> 12"))["cover"] > 0
    assert broken(cuts.withColumn("char_start", F.greatest(F.lit(0), F.col("char_start") - 1)))["text"] > 0
    assert broken(cuts.withColumn("ends_at", F.lit("inside a word")))["natural"] > 0

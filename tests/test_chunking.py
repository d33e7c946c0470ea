import random

from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.functions.chunking import explode_chunks, split_text


def pieces_of(text, sep):
    """Pieces that each begin with their separator, by plain scanning."""
    if sep == "":
        return list(text)
    out, start, at = [], 0, text.find(sep)
    while at >= 0:
        out.append(text[start:at])
        start, at = at, text.find(sep, at + len(sep))
    out.append(text[start:])
    return [p for p in out if p]


def brute(text, size, overlap, seps=("\n\n", "\n", " ", "")):
    """Piece lists instead of offsets: merge greedily, drop from the left until the rest fits."""
    if not text:
        return []
    level = next(i for i, s in enumerate(seps) if s in text)
    chunks, queue = [], []

    def merge():
        held = []
        for p in queue:
            if held and sum(map(len, held)) + len(p) > size:
                chunks.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held = held[1:]
            held = [*held, p]
        if held:
            chunks.append("".join(held))
        queue.clear()

    for piece in pieces_of(text, seps[level]):
        if len(piece) < size:
            queue.append(piece)
        else:
            merge()
            rest = seps[level + 1:]
            chunks.extend(brute(piece, size, overlap, rest) if rest else [piece])
    merge()
    return [c.strip() for c in chunks if c.strip()]


texts = st.text(alphabet="ab \n\té", max_size=400)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(2, 30), st.integers(0, 12))
def test_equals_brute_force(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert split_text(text, size, overlap) == brute(text, size, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=600))
def test_whole_and_bounded(text):
    chunks = split_text(text, 40, 0)
    assert all(0 < len(c) <= 40 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_default_sizes_on_long_words_and_blank_lines():
    rng = random.Random(3)
    text = "\n\n".join(
        " ".join("w" * rng.choice([1, 5, 30, 250, 500]) for _ in range(30)) + "\n" + "x" * 199 + "\n" + "y" * 200
        for _ in range(5)
    )
    assert split_text(text) == brute(text, 200, 25)
    assert split_text(text, 4000, 200) == brute(text, 4000, 200)


def test_overlap_shares_whole_words():
    text = " ".join(f"word{i:03d}" for i in range(100))
    chunks = split_text(text)
    assert len(chunks[0]) <= 200 and chunks[1].startswith("word022 word023")
    assert chunks[0].endswith("word022 word023 word024")


def test_explode_keeps_columns_and_positions(spark):
    df = spark.createDataFrame([(1, "a " * 300), (2, ""), (3, None), (4, "short")], "id long, text string")
    rows = explode_chunks(df, "text").collect()
    got = sorted((r.id, r.chunk_no, r.text) for r in rows)
    assert got == [(1, i, c) for i, c in enumerate(split_text("a " * 300))] + [(4, 0, "short")]


def test_one_huge_text_is_streamed_out(spark):
    df = spark.createDataFrame([(1, "lorem ipsum dolor " * 200_000)], "id long, text string")
    out = explode_chunks(df, "text")
    assert out.count() == len(split_text("lorem ipsum dolor " * 200_000)) > 8192

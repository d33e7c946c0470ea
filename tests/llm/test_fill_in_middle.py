"""Boundary sets and the fill-in-middle transformation against plain Python strings."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import fim


def plain(doc_id, text):
    """The definition on code points."""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TEXTS = ["", "a", "é", "plain ascii " * 20_000, "日本語" * 50_000, "🙂x" * 40_000, "ab" * 32_768, "x" * 65_535, "x" * 65_536,
         ("é" * 7 + "abc" * 5000) * 9, "é" + "x" * 200_000, "é combining \x00 nul"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_boundaries_are_those_of_the_code_points(text):
    cuts = fim.BoundarySet(text.encode())
    sizes = np.array([len(c.encode()) for c in text], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    assert len(cuts) == len(text)
    for k in {*range(min(len(text), 40)), *np.linspace(0, len(text), 200).astype(int).tolist(), len(text)}:
        assert cuts.select(k) == offsets[k]


def test_all_three_kinds_of_container_are_used():
    kinds = {type(c) for t in TEXTS for c in fim.BoundarySet(t.encode()).containers}
    assert kinds == {fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer}
    flags = np.zeros(65_536, bool)
    for kind, members in ((fim.RunContainer, range(65_536)), (fim.ArrayContainer, range(0, 65_536, 97)),
                          (fim.BitmapContainer, range(0, 65_536, 3))):
        flags[:] = False
        flags[list(members)] = True
        made = fim.container(flags)
        assert type(made) is kind and len(made) == len(members)
        assert [made.select(k) for k in range(0, len(members), 501)] == list(members)[::501]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("a<PSM>é日🙂\x00\n"), max_size=60), st.integers(-5, 10**9))
def test_every_text_comes_back(text, doc_id):
    got = fim.transform(text.encode(), doc_id)
    assert (*got[:4], got[4].decode()) == plain(doc_id, text)
    assert fim.restore(got[4], got[1]).decode() == text


def test_rows(spark):
    docs = [(i, t) for i in range(40) for t in TEXTS[:6]] + [(3, "has <S> inside"), (3, None), (7, "twice"), (7, "twice")]
    table = spark.createDataFrame(docs + [(None, "no id")], "doc_id long, text string").withColumns(
        {"form": F.lit("x"), "output": F.lit(1), "restored": F.lit(2), "_bytes": F.lit(3), "n": F.lit(4)})
    got = fim.with_restored(fim.fill_in_middle(table)).collect()
    want = [(i, *plain("" if i is None else i, t or "")) for i, t in docs + [(None, "no id")]]
    assert sorted([(*r[:5], r.output.decode()) for r in got], key=repr) == sorted(want, key=repr)
    assert sorted(r.restored.decode() for r in got) == sorted(t or "" for _, t in docs + [(None, "no id")])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    empty = fim.with_restored(fim.fill_in_middle(table.limit(0)))
    assert empty.count() == 0 and empty.columns[-2:] == ["output", "restored"]


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = fim.fill_in_middle(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan

"""Properties of the kernels under arbitrary input."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_extract, packing, secret_scan, shingles
from tidemark.llm.common import utf8

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0abABzZ.,é日🙂"), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_shingles(texts):
    low = {i: i + 32 for i in range(65, 91)}
    plain = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]
    column = pa.array(texts, pa.string())
    hashed, bounds = shingles.word_hashes(*utf8(column))
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(flat)) == len(set(hashed.tolist())) == len(set(zip(flat, hashed.tolist(), strict=True)))
    for p, s in zip(plain, shingles.shingle_sets(column), strict=True):
        assert len(s) == (len({tuple(p[i : i + 5]) for i in range(len(p) - 4)}) if len(p) >= 5 else int(bool(p)))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 100))
def test_cuts(length, capacity):
    parts = packing.cut(length, capacity)
    assert sum(n for _, n in parts) == length and all(n == capacity for _, n in parts[1:])
    assert [s for s, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
    assert len(parts) == max(1, -(-length // capacity))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_packing_is_gapless_and_holds_everything(lengths):
    where, offset = packing.pack(np.array(lengths, int), 40)
    for k in set(where.tolist()):
        at = 0
        for o, n in sorted((int(offset[i]), lengths[i]) for i in range(len(lengths)) if where[i] == k):
            assert o == at
            at += n
        assert at <= 40


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abp div=\"'&;!-\n", max_size=120))
def test_any_markup_is_read(page):
    text = html_extract.extract(page)
    assert text == " ".join(text.split())


def holds(query, grams):
    if query == secret_scan.TRUE:
        return True
    if query[0] == "gram":
        return query[1] in grams
    return (all if query[0] == "and" else any)(holds(q, grams) for q in query[1:])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_every_match_satisfies_its_trigram_query(data):
    rule = data.draw(st.sampled_from(secret_scan.RULES))
    text = data.draw(TEXT) + data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII))) + data.draw(TEXT)
    low = text.lower()
    assert holds(secret_scan.trigram_query(rule.pattern), {low[i : i + 3] for i in range(len(low) - 2)})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=400).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=6))
def test_cells_hold_every_string_once(texts):
    from tidemark.llm.substring_dedup import GRAM, LENGTH, Slice

    data = np.frombuffer(b"".join(texts), np.uint8)
    s = Slice(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
    text, begin, last, anchor, gram = s.cells()
    starts = sorted(x for a, b in zip(begin.tolist(), last.tolist(), strict=True) for x in range(a, b + 1))
    assert starts == sorted(int(s.at[i]) + k for i, t in enumerate(texts) for k in range(len(t) - LENGTH + 1))
    grams = s.grams()
    assert np.array_equal(gram, grams[anchor])
    assert len(set(grams.tolist())) == len({data[i : i + GRAM].tobytes() for i in range(len(data) - GRAM + 1)})
    for a, b, x in zip(begin.tolist(), last.tolist(), anchor.tolist(), strict=True):
        for start in range(a, b + 1):
            inside = grams[start : start + LENGTH - GRAM + 1]
            assert start + int(inside.argmin()) == x

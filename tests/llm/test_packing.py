import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortframe.llm import packing
from cohortframe.llm.subwords import Subwords, vocabulary_path

from .conftest import text_of


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())        # as it comes: special strings in a text are special


TEXTS = ["", " ", "a", "  two  spaces ", "tabs\t\tand\nlines\r\n\n x", "don't we'll 'tis", "naïve café ÑANDÚ élan", "日本語 テキスト", "a b   c", "\x1c!\x1cx \x85y", "🙂🙃 ok", "<|endoftext|> x", "hello <|endoftext|> world", "a  <|endoftext|><|endoftext|>b.<|endoftext|>", "<|endoftext", "see<|endoftext|>!",
         "x,y;z!!! ... *** a1b2 12,345.67", "　wide", "é combining", "A" * 3000, "\n" * 500, " " * 5000 + "x"]


def test_chunks_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(4)
    alphabet = [*" \t\n,.'!aB1é \x1c\x85日", "'s", "'ll", " the", "word", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    from cohortframe.llm import subwords
    for segment, limit in ((1 << 20, 600_000), (50, 200)):
        monkeypatch.setattr(subwords, "SEGMENT", segment)
        monkeypatch.setattr(subwords, "LIMIT", limit)
        got = [np.frombuffer(b, "<u4").tolist() for b in Subwords(vocabulary_path()).encode(texts)]
        assert got == want


def test_a_repeated_chunk_is_looked_up_once_a_batch(tokenizer):
    class Counted(dict):
        looks = 0

        def get(self, key):
            Counted.looks += 1
            return super().get(key)

        def __getitem__(self, key):
            Counted.looks += 1
            return super().__getitem__(key)

    bpe = Subwords(vocabulary_path())
    bpe.known = Counted()
    text = "the same, words\nagain and again; "
    got = list(bpe.encode([text * 10] * 100))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(text * 10, add_special_tokens=False).ids] * 100
    assert Counted.looks < 50


def test_white_space_and_letters_of_more_bytes(tokenizer):
    rng = random.Random(8)
    alphabet = [*" \n\u3000\xa0\u2009\u1680\u202f\u205f\x85.,!|", "wörter", "×", "÷", "ÿ", "ɏ", "ɐ", "Āž", "а", "|>", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in Subwords(vocabulary_path()).encode(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, tokenizer, capacity):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in docs}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in own:
            assert r.start == at and (r.length == capacity or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packed(docs_of, odd_rows, tokenizer):
    docs = [(i, t) for i, t in enumerate([t for _, t in odd_rows] + TEXTS + [text_of(i, 20 + 7 * i) for i in range(150)])]
    for capacity in (2048, 100):
        bins, total = check(packing.packed(docs_of(docs), capacity=capacity).collect(), docs, tokenizer, capacity)
        assert bins <= total / capacity * 1.001 + 2


def test_rows_that_repeat_and_null_ids(docs_of, odd_rows):
    got = packing.packed(docs_of(odd_rows)).collect()
    assert sum(r.doc_id == 4 and r.piece == 0 for r in got) == 2 and sum(r.doc_id is None and r.piece == 0 for r in got) == 2
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == len(places)


def test_empty_table(docs_of):
    assert packing.packed(docs_of([(1, "x")]).where("doc_id = 2")).collect() == []


def best_sum(counts, room):
    sums = {0}
    for length, n in enumerate(counts):
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


def test_fullest_is_the_fullest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        room = int(rng.integers(1, 60))
        counts = rng.integers(0, 3, 40) * (rng.random(40) < 0.3)
        counts[0] = 0
        got = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == best_sum(counts.tolist(), room)


def test_plan_places_everything_and_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    few = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    for scale in (1, 1000):
        plan = packing.slack_plan({k: n * scale for k, n in few.items()}, 2048)
        placed = defaultdict(int)
        for bins, combo in plan:
            assert sum(k * n for k, n in combo.items()) <= 2048
            for k, n in combo.items():
                placed[k] += bins * n
        assert placed == {k: n * scale for k, n in few.items()}
        total = sum(k * n for k, n in few.items()) * scale
        assert sum(b for b, _ in plan) <= total / 2048 * 1.001 + 2
        assert len(plan) < 20_000

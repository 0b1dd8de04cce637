import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortframe.llm import lm
from cohortframe.llm.attention import CONTEXT, WINDOW, Attention, windows

from .conftest import text_of


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + [None]


def folded(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def test_base_scores_equal_brute_force(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, text_of(i, 30 + i)) for i in range(60)]
    got = lm.score_documents(docs_of(rows)).collect()
    count = Counter(t for d, x in rows if not folded(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, x in rows:
        own = tokens(x)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        want[(d, folded(d), len(own), sum(count[t] > 0 for t in own), n, round(base, 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_the_model_learns_more_than_counts():
    rng = np.random.default_rng(0)
    follow = rng.integers(0, 50, 50)        # each id has a likely successor

    def text(n):
        ids = [int(rng.integers(50))]
        for _ in range(n):
            ids.append(int(follow[ids[-1]]) if rng.random() < 0.8 else int(rng.integers(50)))
        return np.array([*ids, 50])

    train, test = [text(200) for _ in range(80)], [text(200) for _ in range(10)]
    counts = np.bincount(np.concatenate(train), minlength=51).astype(float)
    model = lm.Model(counts, classes=32)
    for _ in range(4):
        model.learn(train, 0.2)
    flat = np.concatenate(test)
    unigram = np.log10((counts + 1) / (counts.sum() + 51))[flat].sum()
    assert model.score(test).sum() > 0.7 * unigram


@pytest.fixture(scope="module")
def model():
    out = lm.Model(np.arange(1000, dtype=float))
    out.learn([np.random.default_rng(1).integers(0, 1000, 400) for _ in range(5)], 0.2)
    return out


def test_probabilities_sum_to_one(model):
    start = np.array([5, 800, 3, 42])
    total = sum(10 ** model.score([np.append(start, i)])[0] for i in range(1000))
    assert total == pytest.approx(10 ** model.score([start])[0], rel=1e-4)


def test_every_token_is_scored_once_and_never_by_what_follows(model):
    rng = np.random.default_rng(2)
    lengths = np.array([1, 2, CONTEXT, WINDOW - 1, WINDOW, WINDOW + 1, 100, 1000, 57])
    ids = [rng.integers(0, 1000, n) for n in lengths]
    _, _, valid, scored, of = model.laid(ids)
    assert np.bincount(of, scored.sum(1)).tolist() == lengths.tolist() and (scored <= valid).all()
    together = model.score(ids)
    assert np.allclose(together, [model.score([i])[0] for i in ids], rtol=1e-5)
    start, which = windows(lengths)
    assert len(start) == len(which) and (np.diff(start) > 0).all()
    # a text's score is the sum of its tokens' scores; later tokens do not change those of earlier ones
    long = ids[6]
    other = long.copy()
    other[-1] = (other[-1] + 1) % 1000
    symbols, target, _, once, _ = model.laid([long])
    symbols2, target2, _, _, _ = model.laid([other])
    a = model.net.log_classes(symbols, model.of_class[target], once)
    b = model.net.log_classes(symbols2, model.of_class[target2], once)
    assert (np.abs(a - b) > 1e-6).sum() <= 1


def test_slopes_equal_differences():
    net = Attention(12, 4, seed=1)
    rng = np.random.default_rng(3)
    s, t = rng.integers(0, 12, (3, WINDOW)), rng.integers(0, 4, (3, WINDOW))
    valid = rng.random((3, WINDOW)) < 0.8
    loss = lambda: -net.log_classes(s, t, valid).sum() / valid.sum()
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    before = {k: w.copy() for k, w in net.w.items()}
    net.g2 = {k: np.full(w.shape, 1e12) for k, w in net.w.items()}      # the step is then slope * rate / 1e6
    net.learn(s, t, valid, 1e6)
    for name, w in before.items():
        slope = w - net.w[name]
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        up, down = {k: x.copy() for k, x in before.items()}, {k: x.copy() for k, x in before.items()}
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        net.w = up
        high = loss()
        net.w = down
        assert slope[at] == pytest.approx((high - loss()) / 2e-3, rel=0.05, abs=1e-4)
        net.w = {k: x.copy() for k, x in before.items()}
        net.learn(s, t, valid, 1e6)


def test_a_symbol_adds_up_its_slopes_in_one_pass(monkeypatch):
    net = Attention(12, 4, seed=1)
    before = net.w["e"].copy()
    s = np.random.default_rng(3).integers(0, 9, (3, WINDOW))
    monkeypatch.setattr(np, "bincount", lambda *a: pytest.fail("a pass per column of the embeddings"))
    net.learn(s, s % 4, np.ones(s.shape, bool), 0.1)
    assert ((net.w["e"] != before).any(1) == np.isin(np.arange(12), s)).all()


def test_empty_table_and_no_training_rows(docs_of):
    docs = docs_of([(i, "a b") for i in range(60)])
    assert lm.score_documents(docs.where("doc_id = -1")).collect() == []
    held = [i for i in range(60) if folded(i)]
    got = lm.score_documents(docs.where(docs.doc_id.isin(held))).collect()
    assert len(got) == len(held) and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


def test_every_training_window_is_learned_from_once(docs_of, monkeypatch):
    """Also those of texts shorter than a window, of which a block holds many."""
    rows = lm.tokenised(docs_of([(i, text_of(i, 1 + i * 7 % 200)) for i in range(150)]), lm.vocabulary_path()).cache()
    sums, add = [], lm.summed
    monkeypatch.setattr(lm, "summed", lambda *a: sums.append(add(*a)) or sums[-1])
    lm.fit(rows, lm.subwords(lm.vocabulary_path()).tokenizer.get_vocab_size())
    lengths = np.array([r.n_ids for r in rows.where("NOT held_out").collect()])
    seen = [s[-1] for s in sums[1:]]
    assert sum(seen) == len(windows(lengths)[0]) and min(seen) > 0.2 * sum(seen)


def test_every_later_token_is_predicted_from_half_a_window(model):
    _, _, _, scored, of = model.laid([np.arange(n) % 1000 for n in (5, WINDOW, WINDOW + 1, 500)])
    later = np.append(False, of[1:] == of[:-1])
    assert later.any() and scored[later].argmax(1).min() >= WINDOW // 2


def test_every_id_is_a_target_once(model, monkeypatch):
    """Also where windows overlap; later windows look back at their first half and ask only about the second."""
    asked = []
    monkeypatch.setattr(Attention, "learn", lambda self, s, target, valid, rate: asked.append(valid))
    lengths = [1, 5, CONTEXT, WINDOW, WINDOW + 1, 500]
    model.learn([np.arange(n) % 1000 for n in lengths], 0.1)
    assert sum(int(v.sum()) for v in asked) == sum(lengths)
    assert all(v[:, 0].all() or not v[:, :CONTEXT].any() for v in asked) and len({bool(v[0, 0]) for v in asked}) == 2


@pytest.mark.parametrize("name", ["e", "p", "wq", "wk", "wv", "w1", "b1", "w2", "b2"])
def test_slopes_of_later_windows_equal_differences(name):
    net = Attention(12, 4, seed=1)
    rng = np.random.default_rng(4)
    s, t = rng.integers(0, 12, (3, WINDOW)), rng.integers(0, 4, (3, WINDOW))
    asked = (rng.random((3, WINDOW)) < 0.8) & (np.arange(WINDOW) >= CONTEXT)
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    before = {k: w.copy() for k, w in net.w.items()}
    net.g2 = {k: np.full(w.shape, 1e12) for k, w in net.w.items()}
    net.learn(s, t, asked, 1e6)
    slope = before[name] - net.w[name]
    at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
    loss = []
    for d in (1e-3, -1e-3):
        net.w = {k: w.copy() for k, w in before.items()}
        net.w[name][at] += d
        loss.append(-net.log_classes(s, t, asked).sum() / asked.sum())
    assert slope[at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05, abs=1e-4)


def test_later_windows_score_alike_alone_and_among_first_ones(model):
    symbols, target, _, scored, _ = model.laid([np.arange(n) * 7 % 1000 for n in (40, 300)])
    goal, later = model.of_class[target], ~scored[:, 0]
    every = np.full(scored.shape, np.nan)
    every[scored] = model.net.log_classes(symbols, goal, scored)
    assert np.allclose(every[later][scored[later]], model.net.log_classes(symbols[later], goal[later], scored[later]), rtol=1e-4)


def test_words_encoded_together_have_the_ids_of_each_alone(monkeypatch):
    odd = ["a\xa0", "　", "\x85b", "x y", "'s", "it's", "...", "1st", "é日", "<|endoftext|>", "a" * 5000, "\x1c", "!?", "ab,cd"]
    found = [w.encode() for w in odd + [f"w{i}" for i in range(200)]]
    bpe = lm.subwords(lm.vocabulary_path(), literal=True)
    bpe.words, bpe.older_words = {}, {}
    sent, batch = [], type(bpe.tokenizer).encode_batch_fast
    class Counted:
        def __getattr__(self, name):
            return getattr(bpe_tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return batch(bpe_tokenizer, texts, **options)
    bpe_tokenizer = bpe.tokenizer
    monkeypatch.setattr(bpe, "tokenizer", Counted())
    got = bpe.encode_words([[w] for w in found])
    assert got == [np.array(bpe_tokenizer.encode(" " + w.decode(), add_special_tokens=False).ids, "<u2").tobytes() for w in found]
    assert len(sent) < len(found) / 4

import hashlib
import random
import re

import pytest

from cohortframe.llm import automaton, pii, secrets
from cohortframe.llm.boosting import Trees, precise_threshold

from .conftest import text_of

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


def pieces(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


TOKENS = ["token", "=", ":", " ", '"', "'", "password", "PassWd", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH01234567", "é", "\n", "api_key", "apikey", "x", "==", "secret", "a", "0"]


def row(got, kinds, spans):
    own = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
    return own, hashlib.sha256(own.encode()).hexdigest(), [sum(s[1] == k for s in spans) for k in range(len(kinds))]


def test_secrets_equal_the_expressions(docs_of, odd_rows):
    texts = [t for _, t in odd_rows] + pieces(1, 1500, TOKENS) + ["x" * 300_000 + " token = 'abcdefgh' " + "0a" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(rows)).collect()}
    kinds = ["assign", "access", "hex"]
    for i, t in rows:
        spans, digest, counts = row(got, kinds, secret_spans(t or ""))
        assert (got[i].base_sha256, [got[i].n_assign, got[i].n_access, got[i].n_hex]) == (digest, counts)
        assert set(filter(None, spans.split(","))) <= set(got[i].spans.split(","))


def test_secrets_of_other_kinds():
    scanner = secrets.Scanner(secrets.RULES)
    said = ["ghp_" + "a1B2" * 9, "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOiIx." + "s" * 30, "nothing here", ""]
    assert [[scanner.rules[k].kind for _, k, _ in s] for s in scanner.scan([x.encode() for x in said])] == [
        ["github"], ["google"], ["private_key"], ["jwt"], [], []]


@pytest.mark.parametrize("patterns", [["a(b|c)*d", "[0-9]{3,}"], ["x{2,4}y?", "(ab?c)+"], ["[a-c]+x", "ab", "b"]])
def test_automaton_ends_equal_those_of_the_expressions(patterns):
    one = automaton.Automaton(patterns, search=True)
    import numpy as np
    for text in pieces(3, 400, list("abcdxy019")):
        want = [sum(1 << k for k, p in enumerate(patterns) if any(re.fullmatch(p, text[i:j]) for i in range(j))) for j in range(1, len(text) + 1)]
        for lanes in (1, 7):
            assert one.run(np.frombuffer(text.encode(), np.uint8), lanes).tolist() == want


def test_lanes_meet(monkeypatch):
    import numpy as np
    one = automaton.Automaton(["ab*c", "[0-9]+z"], search=True)
    text = np.frombuffer(("a" + "b" * 5000 + "c" + "1" * 9000 + "z" + "abc" * 700).encode(), np.uint8)
    assert (one.run(text, 64) == one.run(text, 1)).all()


def test_minimal():
    assert automaton.Automaton(["(a|b)*c|(b|a)*c"], search=False).states == 3      # start, accepting, dead


def personal_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


PARTS = ["+", "1", "42", "555", "4041", "8949", "(", ")", " ", " ", "-", ".", "@", "mail", "x.y", "é", "\n", "4041894974608795", "10.0.0.1", "+1 (415) 555-2671", "a@b.co"]


def planted(n):
    rng = random.Random(8)
    out = []
    for i in range(n):
        card = [4, *(rng.randrange(10) for _ in range(14))]
        total = sum(x * 2 - 9 * (x > 4) if k % 2 == 0 else x for k, x in enumerate(card))
        card.append(-total % 10)
        item = [f"u{i}.x@mail{i % 9}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", "".join(map(str, card)),
                f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"][i % 4]
        out.append((10_000 + i, text_of(i, 20) + " " + item + " " + text_of(i + 1, 20)))
    return out


def test_personal_data(docs_of, odd_rows):
    rows = [(i, t) for i, t in enumerate([t for _, t in odd_rows] + pieces(2, 800, PARTS) + ["9 " * 100_000])] + planted(800)
    rows += [(20_000, text_of(1, 9) + " write to jane (at) mail3 dot example dot com " + text_of(2, 9)), (20_001, "call +1 (269) 555-3296 4524132264652876 now")]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in pii.find_personal_data(docs, pii.fit_judge(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        spans, digest, counts = row(got, pii.KINDS, personal_spans(t or ""))
        r = got[i]
        assert (r.base_sha256, [r.n_email, r.n_ip, r.n_card, r.n_phone]) == (digest, counts)
        found = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for s in r.spans.split(",") if s]
        base = personal_spans(t or "")
        assert set(base) <= set(found) and found == sorted(found)
        added = sorted(set(found) - set(base))
        assert all(a[2] <= b[0] for a, b in zip(added, added[1:])) and not any(a[0] < b[2] and b[0] < a[2] for a in added for b in base)
    text = rows[-2][1]
    assert "jane (at) mail3 dot example dot com" in [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in got[20_000].spans.split(",") if s]
    assert "card:23:39" in got[20_001].spans            # the base expression reads phone and card as one number
    assert all(got[i].spans.count(":") == 2 for i, _ in planted(800))


def test_judge_without_examples_adds_nothing(docs_of, odd_rows):
    empty = docs_of(odd_rows).where("doc_id = 999")
    judge = pii.fit_judge(empty)
    assert judge.threshold == [1.1] * 4 and pii.find_personal_data(empty, judge).collect() == []
    assert secrets.find_secrets(empty).collect() == []


def test_boosting_learns_an_interaction_and_is_calibrated():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (4000, 5))
    p = np.where((x[:, 0] > 3) ^ (x[:, 1] > 3), 0.9, 0.2)
    y = (rng.random(4000) < p).astype(float)
    t = Trees().fit(x, y, np.arange(4000) % 4 == 0)
    q = t.probability(x)
    assert abs(q - p).mean() < 0.06
    assert abs(q[p > 0.5].mean() - 0.9) < 0.04
    assert precise_threshold(np.array([.9, .8, .7, .6]), np.array([1, 1, 0, 1.]), 0.9) == pytest.approx(0.75)
    assert precise_threshold(np.array([.9, .8]), np.array([0, 1.]), 0.9) == 1.1


def test_numbers_and_names_of_any_length(docs_of):
    texts = ["0" * 5000 + "1.1.1.1", "1." + "0" * 4400 + "255.3.4 x 256.1.1.1 1.2.3.0256", "9" * 6000 + ".1.1.1", "a" * 300 + " at mail.example.com", "b" * 70_000 + "@x.org " + "c" * 50_000 + " " + "d" * 9_000 + "(at)y.org"]
    assert [[s[1] for s in pii.base_spans(t)] for t in texts] == [[1], [1], [], [], [0]]
    judge = pii.Judge([])
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(list(enumerate(texts))), judge).collect()}
    assert [(got[i].n_email, got[i].n_ip) for i in range(5)] == [(0, 1), (0, 1), (0, 0), (0, 0), (1, 0)]
    assert (0, 0, 300 + len(" at mail.example.com")) in set(pii.candidates(texts[3]))
    assert {s for s in pii.candidates(texts[4]) if s[1] == 0} >= {(0, 0, 70_006), (70_007 + 50_001, 0, len(texts[4]))}


def test_sixteen_digits_in_many_groups_are_proposed_whole():
    said = "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"
    assert (0, 2, len(said)) in set(pii.candidates(said.replace(" ", ".")))


def test_sample_is_drawn_by_kind(docs_of, monkeypatch):
    rows = [(i, f"write to user{i}@mail{i}.example.com now") for i in range(400)] + [(1000 + i, f"host 10.{i}.3.{i} is up") for i in range(60)]
    seen = []
    monkeypatch.setattr(pii, "Judge", lambda windows: seen.extend(windows))
    pii.fit_judge(docs_of(rows), 50)
    assert sum(w[2] == 0 for w in seen) == 50 and sum(w[2] == 1 for w in seen) == 50

import random

import pytest

from tallyspark.llm.leakage import Matcher, find_leaks, least_cover, seed_length, word_spans, words_of

RNG = random.Random(2)
VOCAB = [f"w{i}" for i in range(4000)]


def item(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def noise(n):
    return [f"n{RNG.randrange(10_000)}" for _ in range(n)]


def spoil(words, errors):
    """Errors well inside the passage, spread evenly: replaced, dropped and added words in turn."""
    out = list(words)
    for k in sorted((int((j + 1) * len(words) / (errors + 1)) for j in range(errors)), reverse=True):
        kind = k % 3
        out[k : k + 1] = ["zz"] if kind == 0 else [] if kind == 1 else [out[k], "zz"]
    return out


ITEMS = [(i, item(110)) for i in range(12)]
ITEMS.append((99, ITEMS[0][1][20:70] + item(60)))  # shares a passage with item 0


@pytest.fixture(scope="module")
def matcher():
    return Matcher([(i, " ".join(w)) for i, w in ITEMS])


def test_bounds():
    assert seed_length(28, 10) == 7 and least_cover(28, 10) == 9 and seed_length(10, 100) == 10


@pytest.mark.parametrize(("length", "errors", "leaks"), [(28, 0, True), (28, 2, True), (30, 3, True), (60, 6, True), (110, 11, True), (27, 0, False), (26, 0, False), (40, 9, False), (110, 40, False)])
def test_length_and_error_rate(matcher, length, errors, leaks):
    for i, words in ITEMS[1:6]:
        at = RNG.randrange(110 - length + 1)
        doc = " ".join(noise(30) + spoil(words[at : at + length], errors) + noise(30))
        assert (i in {f[0] for f in matcher.find(doc)}) == leaks


def test_every_item_of_a_shared_passage(matcher):
    assert {f[0] for f in matcher.find(" ".join(ITEMS[0][1][25:65]))} == {0, 99}


def test_every_passage_of_an_item_is_reported(matcher):
    w, gap = ITEMS[4][1], noise(200)
    doc = w[0:40] + gap + w[50:90] + gap + w[0:40]
    assert sorted(f for f in matcher.find(" ".join(doc)) if f[0] == 4) == [(4, 0, 39, 40), (4, 240, 279, 40), (4, 480, 519, 40)]
    # one item over and over: every copy, in a text whose diagonals never end
    found = matcher.find(" ".join(w * 60))
    assert sum(f[3] for f in found) == 60 * 110 and len({f[1] for f in found}) == len(found)


def test_a_passage_grows_over_errors_that_pay(matcher):
    w = ITEMS[5][1]
    (found,) = matcher.find(" ".join(w[:50] + ["zz"] + w[51:110]))
    assert found == (5, 0, 109, 110)


@pytest.mark.parametrize("mark", ["<a href='" + "x" * 5_000 + "'>", "&" + "n" * 300 + ";", "&#" + "1" * 50 + ";", "\\n"])
def test_markup_of_any_length_is_no_word(matcher, mark):
    w = ITEMS[6][1][5:45]
    doc = "".join(x + (mark if k % 6 == 5 else " ") for k, x in enumerate(w))
    assert [f[0] for f in matcher.find(doc)] == [6]


def test_scattered_pieces_are_no_passage(matcher):
    w = ITEMS[3][1]
    assert matcher.find(" ".join(w[0:20] + noise(5) + w[40:60] + noise(5) + w[80:100])) == []


def test_brute_force_agreement(matcher):
    """Edit distance over all windows of one item, for passages around the limits."""

    def brute(words, doc):
        n = len(words)
        for a in range(n):
            row = [[0] * (len(doc) + 1)]  # a passage may start anywhere in the document
            for i in range(a, n):
                new = [i - a + 1]
                for j in range(1, len(doc) + 1):
                    new.append(min(row[-1][j - 1] + (words[i] != doc[j - 1]), row[-1][j] + 1, new[j - 1] + 1))
                row.append(new)
                if i - a + 1 >= 28 and min(new) * 10 <= i - a + 1 and words[a] in doc:
                    return True
        return False

    for _ in range(12):
        _, words = RNG.choice(ITEMS[:8])
        size = RNG.choice([26, 27, 28, 29, 31, 34])
        at = RNG.randrange(100 - size)
        doc = noise(4) + spoil(words[at : at + size], RNG.randrange(5)) + noise(4)
        got = bool([f for f in matcher.find(" ".join(doc)) if f[0] == next(i for i, w in ITEMS if w is words)])
        # an error may lie on the edge for the brute force, never for the operator: it may only find fewer
        assert not got or brute(words, doc)
        if size >= 31 and not brute(words, doc):
            assert not got


def test_normal_form_and_offsets():
    assert words_of("Zero​Width, so­ft <br/>TAG&nbsp;x \\nline É́") == ["zerowidth", "soft", "tag", "x", "line", "é́"]
    assert words_of(None) == words_of("") == words_of(" .,-_ ") == []
    text = "A <br/> b​c \\nd"
    assert [text[a:b] for a, b in word_spans(text)] == ["A", "b​c", "d"] and len(words_of(text)) == 3
    weird = "ǅ ﬁ １２ ß İ x"
    assert len(words_of(weird)) == len(word_spans(weird))


def test_table(frame):
    passage = ITEMS[2][1][10:50]
    hidden = ",​".join(w[0] + "‍" + w[1:].upper() for w in passage).replace(",", "<br/>\n")
    docs = frame([(1, "intro " + hidden + " end", "x"), (1, "intro " + hidden + " end", "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (5, "q " * 50_000, "x")], "doc_id long, text string, item_id string")
    items = frame([(i, " ".join(w)) for i, w in ITEMS] + [(50, None), (51, ""), (None, "a b"), (52, "too short")], "item_id long, text string")
    (r,) = find_leaks(docs, items).collect()
    text = "intro " + hidden + " end"
    assert (r.doc_id, r.item_id, r.item_words) == (1, 2, 40) and text[r.start_char : r.end_char] == hidden
    assert find_leaks(docs, items, max_chars=900).collect() == [r]  # several blocks
    assert find_leaks(docs.limit(0), items).collect() == [] == find_leaks(docs, items.limit(0)).collect()

"""Operators that read rows one by one: quality rules, personal data, HTML, classifier."""

import re
import zlib

import numpy as np
import pytest

from hearthline.llm import classifier, crf, html_text, pii, quality
from hearthline.llm.frames import NO_ID

GOOD = "The quick brown fox jumps over the lazy dog near the river bank, and then it rests.\n"
ODD = [(1, None), (2, ""), (3, "   \n\n"), (None, "a b c"), (4, "word " * 30_000), (4, "word " * 30_000), (5, "é日本 " * 60)]


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and further columns with names that operators use."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ODD], "doc_id long, text string, key string, id int, n_words int")


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    field = crf.Crf(rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([3, 1, 0, 5, 2])
    x = rng.normal(size=(lengths.sum(), 4))
    got, at = crf.viterbi(field, x, lengths), 0
    for n in lengths.tolist():
        if n:
            s = x[at:at + n] @ field.weight
            paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
            value = s[np.arange(n), paths].sum(1) + field.begin[paths[:, 0]] + sum(field.step[paths[:, i - 1], paths[:, i]] for i in range(1, n))
            assert got[at:at + n].tolist() == paths[value.argmax()].tolist()
        at += n


def test_fit_learns_a_chain():
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.5).astype(int)
    y[1::2] = y[::2]  # neighbours agree
    x = np.column_stack([np.ones(400), y + rng.normal(0, 1.2, 400)])
    lengths = np.full(200, 2)
    field = crf.fit(x, y, lengths, 2)
    alone = (x[:, 1] > 0.5).astype(int)
    assert (crf.viterbi(field, x, lengths) == y).mean() > (alone == y).mean() + 0.02
    assert field.step[0, 0] + field.step[1, 1] > field.step[0, 1] + field.step[1, 0]


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@pytest.mark.parametrize("text", ["", None, "a", "a b c a b c", "a a a a a", "x#y\nx#y\n\n\n z é", "one two three four one two three five two three five", "a\x0bb\x0cc\n \n \n"])
def test_base_counts(text):
    assert quality.base_counts((text or "").encode()) == brute_base(text)


def test_quality_of_odd_rows(spark):
    field = quality.fit_lines(odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.line_quality(odd_docs(spark), field).collect()
    assert len(rows) == len(ODD)
    assert [r for r in rows if r["id"] == 4][0]["base_failed"]  # repeats one window
    assert all(not r["kept"] and r["n_words"] == 0 for r in rows if r["id"] in (1, 2, 3))
    assert quality.line_quality(odd_docs(spark).limit(0), field).count() == 0


def test_quality_keeps_content_and_drops_boilerplate(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "so") for b in ("n", "ra", "de", "st", "ku")]

    def prose():
        return " ".join(rng.choice(vocabulary, 14)).capitalize() + "."

    def junk():
        return " ".join(w + "$$$" for w in rng.choice(vocabulary, 14))

    docs = [(i, "\n".join(prose() for _ in range(8)), 1) for i in range(40)] + [(100 + i, "\n".join(junk() for _ in range(8)), 0) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    field = quality.fit_lines(df, df.where("doc_id % 2 = 0"))
    kept = {r["id"]: r["kept"] for r in quality.line_quality(df, field).collect()}
    assert all(kept[i] for i in range(1, 40, 2)) and not any(kept[100 + i] for i in range(1, 40, 2))


def brute_spans(text):
    out = [(*m.span(), 0) for m in pii.EMAIL.finditer(text)]
    out += [(*m.span(), 1) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in pii.CARD.finditer(text) if 14 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    out += [(*m.span(), 3) for m in pii.PHONE.finditer(text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.mark.parametrize("text", [
    "", "a@b", "x.y@c.de, é@z a.b+c@d-e.f.g.", "a@b@c.de f@@g.hi", "1.2.3.4.5 256.1.1.1 001.002.003.0255", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (743) 555-3824 +123 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "+49 30 123456. 1.1.1.1@x.de"])
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.fixture(scope="module")
def shapes():
    return pii.fit_shapes()


def test_field_marks_other_spellings_and_leaves_clean_text_alone(shapes):
    found = lambda t: [(t[s:e], pii.KINDS[k]) for s, e, k in pii.more_spans(shapes, [t])[0]]
    assert found("please call (743) 555-3824 now") == [("(743) 555-3824", "phone")]
    assert found("reach john (at) site (dot) com, or else") == [("john (at) site (dot) com", "email")]
    for clean in ("version 2.0 of the licence", "on 2021-03-04 at 10:30", "was 4.2.1 in 1998, page 12", "Creative Commons BY-NC 4.0.", 'a token = "24be64439e3e49cf46b2"'):
        assert found(clean) == []


def test_personal_data_of_odd_rows(spark, shapes):
    rows = pii.personal_data(odd_docs(spark), shapes).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows)
    assert pii.personal_data(odd_docs(spark).limit(0), shapes).count() == 0


PAGE = ('<html><head><title>t</title></head><body><header><h1>Site</h1></header><div id="nav">x</div><div class="content"><h1>Title</h1>'
        "<p>One, two, three and a lot of words in here, so that it counts.</p><div class=\"ad\">Buy</div><p>Second <b>para</b>, with <a href=x>link</a> and "
        '&eacute;&#233; more,\n words.<ul><li>a<li>b</ul></div><div class="comments"><p>I agree, much, very, so, a long comment, indeed.</p></div><footer>c</footer></body></html>')


@pytest.mark.parametrize("page, want", [
    (PAGE, "Title\nOne, two, three and a lot of words in here, so that it counts.\nSecond para, with link and éé more, words.\na\nb"),
    ("", ""), ("just text", "just text"), ("<p>" * 5_000 + "x", "x"), ("<script>var a = '<p>no</p>';</script>", ""), ("<p>a<!-- <p>b</p> -->c", "ac"),
    ("<article><p>in</p></article><aside>out</aside>", "in"), ("<div><p>one</p><p hidden>two</p></div>", "one"), ("<p>a &lt;b&gt; c", "a <b> c")])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_pages_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>x", "t"), (1, "u", PAGE, "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"][:5] for r in html_text.extract_pages(df).collect()) == ["", "Title", "Title", "x"]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_isotonic_pools_falls():
    level = classifier.isotonic(np.array([0, 5, 1, 9.0]), np.array([5, 5, 5, 9.0]))
    assert (np.diff(level) >= 0).all() and level[1] == level[2] and level[0] < level[1] < level[3]


def test_classifier_learns_and_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, GOOD * (3 + i % 5) if i % 3 else "BUY!! NOW!! $$$ " * (10 + i % 7)) for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    true = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    wrong = spark.createDataFrame([(i, int(i % 3 > 0) if i not in held else int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    one = {r["id"]: r["score"] for r in classifier.quality_scores(docs, true).collect()}
    two = {r["id"]: r["score"] for r in classifier.quality_scores(docs, wrong).collect()}
    assert one == pytest.approx(two, abs=1e-9)
    assert min(one[i] for i in held if i % 3) >= 0.7 > max(one[i] for i in held if i % 3 == 0)


def test_classifier_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = classifier.quality_scores(odd_docs(spark), none).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and {r["id"] for r in rows} >= {NO_ID, 1}
    assert classifier.quality_scores(odd_docs(spark).limit(0), none).count() == 0

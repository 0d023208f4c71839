import collections
import re

from rillflow.llm.quality import BOILERPLATE, MARKERS, line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    three = list(zip(w, w[1:], w[2:]))
    n, at = collections.Counter(three), set()
    for i, x in enumerate(three):
        if n[x] > 1:
            at |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def figures(df):
    return sorted(repr(tuple(r)) for r in line_quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())


def test_base_figures(odd_docs):
    assert figures(odd_docs) == sorted(repr((r["doc_id"], *base(r["text"]))) for r in odd_docs.collect())


def test_repeats(spark, prose):
    texts = ["a b c a b c a b", "a a a a", "x\nx\n\nx \ny#|", "a b c\nd e f\na b c", prose(50, 1) + " " + prose(50, 1), prose(500, 2), "\x0b\x0c\x1f "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert figures(df) == sorted(repr((i, *base(t))) for i, t in enumerate(texts))


def test_verdicts(spark, prose):
    clean = ". ".join(prose(12, i).capitalize() for i in range(12)) + ".\nLicensed under the MIT License."
    menu = "\n".join(" | ".join(prose(9, i).split()) for i in range(12))
    noise = " ".join(w + "###" for w in prose(90, 4).split())
    shout = " ".join(w.upper() + "!!" for w in prose(90, 5).split())
    mixed = clean + "\nHome | About | Contact\nWe use cookies here. Read more."
    rows = {r["doc_id"]: r for r in line_quality(spark.createDataFrame(list(enumerate([clean, menu, noise, shout, mixed])), "doc_id long, text string")).collect()}
    assert [rows[i]["kept"] for i in range(5)] == [True, False, False, False, True]
    assert rows[0]["cleaned_text"] == clean and rows[4]["cleaned_text"] == clean and rows[0]["lost_share"] == 0


def test_plan_is_one_projection(odd_docs, no_docs):
    plan = line_quality(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert line_quality(no_docs).count() == 0


PHRASES = "We use cookies.|Cookie policy|Privacy Policy|Terms of use|Terms of Service|All rights reserved.|Log in to read|Sign in here|Login|Sign in|Sign up|sign up now|Subscribe|Subscribe to us|Our newsletter|Newsletter|Click here|Please enable JavaScript|Skip to main content|Back to top|Powered by X|Share this|Share on Y|Read more|Read more ...|Advertisement|- advertisements -|Cookies".split("|")
PROSE = "a new design in steel|the catalog in the library|baked a cookie|read more books|the newsletter that she wrote|a powered bicycle|they share this view|an advertisement for soap|to subscribe is to agree|the sign in the window|she took back to town".split("|")


def test_phrases_and_prose(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(PHRASES + PROSE)], "doc_id long, text string")
    got = {r["doc_id"]: r["cleaned_text"] for r in line_quality(df).collect()}
    assert [x for i, x in enumerate(PHRASES + PROSE) if (got[i] == "") != (i < len(PHRASES))] == []
    assert all(any(m in x.lower() for m in MARKERS) for x in PHRASES if re.search(BOILERPLATE, x.lower()))

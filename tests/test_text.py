import random
import re

import pytest
from pyspark.sql import functions as F

from folioscript.functions import text as X
from folioscript.functions.quote_scan import quote_pieces
from folioscript.operators import pack as P
from folioscript.operators import quotes as QT


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize("title,spoken", [
    ("CHAPTER I — Down the Rabbit-Hole", "Chapter 1. Down the Rabbit-Hole."), ("Section 3", None), ("Front Matter", None), ("  ", None),
    ("chapter mix", "Chapter 1009."), ("BOOK: iv The End:", "Book 4 The End."), ("Prologue", "Prologue."), ("Part Two", "Part Two."),
    ("CHAPTER 7", "Chapter 7.")])
def test_title_announcement(spark, title, spoken):
    assert one(spark, title, X.title_announcement) == spoken


@pytest.mark.parametrize("raw", ["_a_ b", "_a\n\nb_ c_ d_", "a_b", "__", "_a\nb_", "_" + "x" * 401 + "_ _y_", "_a_b_c_"])
def test_emphasis(spark, raw):
    """A pair around a blank line is kept and consumed, so its end opens nothing."""
    want = re.sub(r"_([^_]{1,400}?)_", lambda m: m.group(0) if "\n\n" in m.group(1) else m.group(1), raw)
    assert one(spark, raw, X.strip_emphasis) == want


def test_normalize(spark):
    assert one(spark, "﻿ a \t\r\n\r\r\r\n_b_ ", X.normalize) == "a\n\nb"


@pytest.mark.parametrize("name,title", [("dir/My_great--book.v2.txt", "My great book.v2"), ("x.md", "x"), (".hidden", ".hidden")])
def test_file_title(spark, name, title):
    assert one(spark, name, X.title_from_file_name) == title


def test_clean_chapter_drops_repeated_title(spark):
    df = spark.createDataFrame([("\n Down the rabbit hole!\nBody.", "I — Down the Rabbit-Hole"), ("Other\nBody", "Title")], "t string, title string")
    assert [r[0] for r in df.select(X.clean_chapter(F.col("t"), F.col("title"))).collect()] == ["Body.", "Other\nBody"]


def greedy(items, limit, test_sep, joiner, hard, drop_blank):
    out, cur = [], ""
    for p in items:
        if cur and len(cur) + len(p) + test_sep > limit:
            out.append(cur)
            cur = p
        else:
            cur = cur + joiner + p if cur else p
        while hard and len(cur) > limit:
            out.append(cur[:limit])
            cur = cur[limit:]
    if cur.strip() if drop_blank else cur:
        out.append(cur)
    return out


@pytest.mark.parametrize("p", [
    P.Packing(40, 2, "\n\n", r"\n\n+", hard=True), P.Packing(40, 0, "\n\n", r"\n\n+", whole=False), P.Packing(25, 2, "\n\n", r"\n\n+"),
    P.Packing(30, 1, " ", P.SENTENCE_GAP, hard=True, drop_blank=False)])
def test_packing_matches_a_plain_loop(spark, p):
    rng = random.Random(3)
    texts = ["\n\n".join(rng.choice(["x" * rng.randrange(1, 99), "Hi there. Oh! " * rng.randrange(1, 4), " "]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += ["", "\n\na", "a\n\n", "é" * 41]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", P.pack_text(F.col("t"), p)).collect()}
    split = (lambda t: re.split(r"(?<=[.!?…\"'”’])\s+", t)) if p.joiner == " " else (lambda t: re.split(r"\n\n+", t))
    for i, t in enumerate(texts):
        want = [t] if p.whole and len(t) <= p.limit else greedy(split(t), p.limit, p.test_sep, p.joiner, p.hard, p.drop_blank)
        assert got[i] == want, t


CASES = {
    "curly": "“Hi,” she said. “One\n\ntwo\n\nthree\n\nfour\n\nfive” x “ok”",
    "three breaks": "“a\n\nb\n\nc\n\nd” e “f”", "reopened": "“a\n\n“b” c", "missing close": "“a “b” c", "single": "‘a’ b ‘don't’ c 'd' 'e' o'clock",
    "straight": '"a" b "c\nd" e', "unclosed": '"a" b\n\n"c\n\nd "e"', "unclosed reopened": '"a\n\n "b" c', "open end": 'x "a" "b', "none": "plain 'x",
    "blank next": '"a" "b\n\n \n\n"c"', "lead": '\n\n"a" "b"', "trail": '"a" "b\n\n', "empty": "",
}


def test_spans_tile_and_native_agrees_with_scanner(spark):
    df = spark.createDataFrame(list(CASES.items()), "name string, text string")
    for r in QT.with_spans(df).collect():
        text = CASES[r["name"]]
        assert "".join(s["text"] for s in r["spans"]) == text
        assert all(text[s["start"]:s["end"]] == s["text"] for s in r["spans"])
        if r["style"] != "none":
            assert [(s["text"], s["kind"] == "quote", s["flagged"]) for s in r["spans"]] == quote_pieces(text, r["style"])


def test_quote_rules():
    quotes = lambda name, style: [(t, f) for t, q, f in quote_pieces(CASES[name], style) if q]
    assert quotes("curly", "curly") == [("“Hi,”", False), ("“One\n\ntwo\n\nthree\n\nfour", True), ("“ok”", False)]
    assert quotes("three breaks", "curly") == [("“a\n\nb\n\nc\n\nd”", False), ("“f”", False)]
    assert quotes("reopened", "curly") == [("“a", False), ("“b”", False)]
    assert quotes("missing close", "curly") == [("“a ", True), ("“b”", False)]
    assert quotes("unclosed", "straight") == [('"a"', False), ('"c', True), ('"e"', False)]
    assert quotes("unclosed reopened", "straight") == [('"a', False), ('"b"', False)]
    assert quotes("single", "single") == [("‘a’", False), ("‘don't’", False), ("'d'", False), ("'e'", False)]


def _chapter_times(spark, quotes):
    """Seconds for script, boundaries, blocks and passages of one chapter with so many quotes."""
    import time

    from folioscript.functions import assemble as A
    from folioscript.functions.quote_scan import quote_spans

    text = " ".join(f'He went on for a while. "Quote number {i}," she said.' + ("\n\n" if i % 5 == 0 else "") for i in range(quotes))
    started = time.process_time()
    spans = quote_spans(text, "straight")
    answers = [{"q": i, "found": i % 3 or None, "unknown": False, "is_dialogue": i % 7 != 0, "low": False} for i in range(quotes)]
    segments = A.segments_of(spans, answers, None)
    flags = A.boundaries_of(text, None, segments)
    bits = [{"kind": "para", "starts": f["para_break_before"], "space": f["space_before"], "text": s["text"]} for s, f in zip(segments, flags)]
    A.blocks_of(bits)
    A.passages_of(text, spans, [{"start": s["start"], "stop": s["end"]} for s in spans if s["kind"] == "quote"][::30], 400)
    return time.process_time() - started


def test_long_chapters_take_time_in_proportion(spark):
    _chapter_times(spark, 500)
    small, large = min(_chapter_times(spark, 2_000) for _ in range(3)), min(_chapter_times(spark, 16_000) for _ in range(2))
    assert large < 20 * small  # eight times the chapter; a quadratic pass takes 64 times


def test_finder_equals_find():
    import random

    from folioscript.functions.assemble import Finder

    rng = random.Random(9)
    text = "".join(rng.choice("abcd ") for _ in range(4000))
    f = Finder(text)
    for _ in range(3000):
        start = rng.randrange(len(text))
        at = rng.randrange(len(text))
        needle = text[at : at + rng.randrange(30)] + rng.choice(["", "", "x"])
        assert f.find(needle, start) == text.find(needle, start)
    assert f.places is not None

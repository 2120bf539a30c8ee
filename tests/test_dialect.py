"""The dialect reader: both readers agree on well-formed filings, any text can be read, repairs are told with their places."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.sources import dialect as D

WORDS = ["계약금액", "100", "a&amp;b", "&lt;x&gt;", "  ", "\n", "&#54620;", "<!-- no <P> -->", "<![CDATA[1 < 2 & 3]]>", "<?pi x?>", "plain words"]


def tree(rnd, depth=0):
    if depth > 4 or rnd.random() < 0.3:
        return rnd.choice(WORDS)
    tag = rnd.choice(["P", "TE", "TU", "TITLE", "SECTION-1", "SECTION-2", "TABLE", "TR", "TD", "B", "x:P", "section-3"])
    if rnd.random() < 0.1:
        return f"<{tag} A='x>y' B=\"1\"/>" if ":" not in tag else "<IMG/>"
    return f"<{tag} A='x>y'>" + "".join(tree(rnd, depth + 1) for _ in range(rnd.randint(0, 4))) + f"</{tag}>"


def test_both_readers_agree():
    rnd = random.Random(1)
    for _ in range(400):
        text = "<?xml version='1.0'?>\n<DOCUMENT xmlns:x='u'>" + "".join(tree(rnd) for _ in range(5)) + "</DOCUMENT>"
        one, errors = D.strict(text)
        other, repairs = D.recovered(text)
        assert not errors and not repairs, (text, errors, repairs)
        assert one.fragments() == other.fragments() and one.images == other.images


@given(st.text(alphabet="<>/&;abP TE\"'!-?[]=\n", max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text_is_read(text):
    filing, warnings = D.recovered(text)
    assert not filing.stack
    assert all(1 <= line <= text.count("\n") + 1 and col >= 1 for _, _, line, col in warnings)
    assert [w[2:] for w in warnings] == sorted(w[2:] for w in warnings)


def test_repairs_are_told():
    text = "<DOCUMENT>\n<SECTION-1><TITLE>I</TITLE>\n<P>one & two <B>three</P>\n</TU><P>4 < 5 &nosuch; &nbsp;&amp;</SECTION-1>"
    filing, warnings = D.recovered(text)
    assert warnings == [("ERROR", "unescaped &", 3, 8), ("ERROR", "unclosed B", 3, 22), ("ERROR", "end tag without start TU", 4, 1), ("ERROR", "unescaped <", 4, 11), ("ERROR", "unknown entity &nosuch;", 4, 15), ("ERROR", "unclosed P", 4, 35), ("ERROR", "unclosed DOCUMENT", 4, 47)]
    assert filing.fragments() == [("heading", "TITLE", ["I"], "I"), ("paragraph", "P", ["I"], "one & two three"), ("paragraph", "P", ["I"], "4 < 5 &nosuch; &")]
    assert D.strict(text)[1][0][:3] == ("FATAL", "not well-formed (invalid token)", 3)


def test_warnings_are_bounded_and_texts_long():
    filing, warnings = D.recovered("<P>" + "& < " * 50_000)
    assert len(warnings) == D.WARNINGS and len(filing.fragments()[0][3]) == 4 * 50_000 - 1
    filing, _ = D.recovered("<a " + "x='" * 100_000)
    assert filing.fragments() == []


@pytest.mark.parametrize("text", ["<a '" * 100_000, "<b>" * 60_000 + "</c>" * 60_000, "<b>" * 60_000 + "</b>" * 60_000, "<!" * 100_000, "&" * 100_000, "<a b=\"" * 100_000, "x <b>y" * 50_000])
def test_repairs_cost_their_length(text):
    start = time.time()
    D.recovered(text)[0].fragments()
    assert time.time() - start < 5


def test_nested_narrative_and_late_titles():
    filing, _ = D.strict("<D><SECTION-1><P>a<TE>b</TE>c</P><TITLE> </TITLE><TITLE>T</TITLE><TABLE><TR><TD><P>no</P></TD></TR></TABLE></SECTION-1><P>out</P></D>")
    assert filing.fragments() == [("paragraph", "P", ["T"], "a b c"), ("paragraph", "TE", ["T"], "b"), ("heading", "TITLE", ["T"], "T"), ("paragraph", "P", [], "out")]


@pytest.mark.parametrize("content, name", [
    (b"", "utf-8"), ("계약".encode(), "utf-8"), ("계약".encode("cp949"), "cp949"), (b"\xff", None), (b"x" * 8191 + "계".encode(), "utf-8"), (b"x" * 8191 + "계".encode("cp949"), "cp949"),
    (b"x" * 8192 + b"\xff\xff", "utf-8"), ("계".encode()[:2], "cp949"), (b"x" * 8190 + "계".encode()[:2], None),
])
def test_charset(content, name):
    if content == b"x" * 8190 + "계".encode()[:2]:  # it ends inside a character: whatever the decoders say, it is not UTF-8
        assert D.charset(content) != "utf-8"
    elif content == "계".encode()[:2]:
        assert D.charset(content) != "utf-8"
    else:
        assert D.charset(content) == name


def test_frames(spark):
    pages = spark.createDataFrame([(1, "<D><P>x</P></D>"), (2, "<D><P>x & y</D>"), (3, None), (4, "  ")], "page_id long, body string")
    statuses, warnings, fragments = D.read_filings(pages)
    assert {r["page_id"]: r["status"] for r in statuses.collect()} == {1: "success", 2: "recovered", 3: "failed", 4: "failed"}
    assert sorted((r["page_id"], r["phase"], r["message"]) for r in warnings.collect()) == [(2, "recovery", "unclosed P"), (2, "recovery", "unescaped &"), (2, "strict", "not well-formed (invalid token)")]
    assert {(r["page_id"], r["text"]) for r in fragments.collect()} == {(1, "x"), (2, "x & y")}
    assert D.read_filings(pages.filter("false"))[0].count() == 0

"""Newly written lines on mails of our own."""

import pytest

from quarrycast.llm import mail_text
from tests.conftest import rows

SCHEMA = "gmail_id string, thread_id string, from_addr string, body string, received_at string, seen_at timestamp, line_no string"
ANN, BOB = "Ann Ode <ann@x.example>", "Bob Ray <bob@y.example>"

CASES = {
    "prefixed quote": ("On Mon, 3 Mar 2025 at 10:00, Bob Ray <bob@y.example>\nwrote:\n> Hi Ann,\n>\n> see below\n\nFine with me.\n> one more\nYes.\n\nThanks,\nAnn", [7, 9]),
    "header block": ("Sure.\r\n\r\n-----Original Message-----\r\nFrom: Bob Ray <bob@y.example>\r\nSent: today\r\nTo: Ann\r\nSubject: x\r\n\r\nHello\r\n", [1]),
    "header without rule": ("Sure.\n\nVon: Bob Ray <bob@y.example>\nGesendet: heute\nAn: Ann\nBetreff: x\n\nHallo", [1]),
    "signature mark": ("Hi Bob,\n\nAll good.\n\n-- \nAnn Ode\nT: 00 555 123 456\nwww.x.example\nRecruiter | X\n\nPS: see you.", [1, 3, 11]),
    "closing and notice": ("Hi,\n- one\n1. two\n\nKind regards\n\nAnn Ode\nshe/her\n\n***\nThis message and its attachments are confidential and meant only for\nthe addressee.", [1, 2, 3]),
    "device": ("Ok\nSent from my phone", [1]),
    "traps": ("To: be clear, yes.\nFrom Monday on I am away.\nOriginal message or not, fine.\nThe subject: line is odd.\nPlease keep the salary range confidential until we publish it.\nI sent it from my phone, tell me.\nOn Friday Bob wrote the test, and it is ready.\nThanks for waiting.\nRegards to Bob, who called.\nBest of all was the talk.", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
    "other intros": ("Ja.\n\nAm 14.11.2024 um 13:38 schrieb Bob\nRay <bob@y.example>:\n> Hallo\n\nLe 23/05/2024 à 18:02, Bob Ray a écrit :\n>> Salut\n\n* Bob Ray [2024-11-29 21:05]:\n| Hi", [1]),
    "blank": (" \n\n\t", []),
    "one line": ("Yes", [1]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    body, want = CASES[name]
    kinds = mail_text.kinds_of(mail_text.lines_of(body), ANN)
    assert [i + 1 for i, k in enumerate(kinds) if k == "new"] == want


def test_operator_with_its_edges(spark):
    body = CASES["closing and notice"][0]
    data = [("a", "t", ANN, body, "2025-03-01T00:00:00+00:00", None, "x"), ("a", "t", ANN, body, "2025-03-01T00:00:00+00:00", None, "y"), ("b", "t", BOB, None, None, None, None), ("c", None, None, "Hello\n", None, None, None), ("d", "t", BOB, "", "bad", None, None), (None, "t", BOB, "x", None, None, None), ("e", "t", BOB, "word " * 100_000, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    want = [("a", 1), ("a", 2), ("a", 3), ("c", 1), ("e", 1)]
    assert rows(mail_text.written_lines(df)) == want
    assert rows(mail_text.written_lines(df, large=0, block=1)) == want
    assert mail_text.written_lines(df.where("false")).count() == 0


SENTENCES = [f"Point {i} of the long and careful plan that we made together last week in the old town was never as clear to me as it should have been, and nobody but the two of us will ever read it." for i in range(8)]


def wrapped(sentences, width=12):
    words = " ".join(sentences).split()
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


#: Unmarked quotes of one line, of three and of eight or more, above, between and below what is written anew.
UNMARKED = {
    "one line below": (["I agree.", "", SENTENCES[2]], [1]),
    "one line above": ([SENTENCES[2], "", "I agree."], [3]),
    "one line between": (["Hello,", "", SENTENCES[2], "", "I agree."], [1, 5]),
    "three lines between": (["Hello,", *wrapped(SENTENCES[3:4], 14).split("\n"), "I agree."], [1, 5]),
    "three lines above": ([*wrapped(SENTENCES[3:4], 14).split("\n"), "I agree."], [4]),
    "many lines above": ([*SENTENCES, "", "I agree."], [10]),
    "many lines between": (["Hello,", "", *SENTENCES, "", "I agree."], [1, 12]),
    "many lines below": (["I agree.", *wrapped(SENTENCES).split("\n")], [1]),
    "by someone else": (["Mine is this one, which holds as many words as any quote would hold and more, but which nobody has written before me in this thread or elsewhere, as far as I know."], [1]),
    "too short": (["I agree.", "", "Yes, that is so."], [1, 3]),
}


@pytest.mark.parametrize("name", UNMARKED)
def test_quotes_without_any_mark(name):
    """They go by the automaton alone, wherever they stand; without it they would stay."""
    lines, want = UNMARKED[name]
    first, second = "Hi Bob,\n\n" + "\n".join(SENTENCES) + "\n\nYes, that is so.", "\n".join(lines)
    thread = [((False, 1, "a"), ANN, first, True), ((False, 2, "b"), BOB, second, True)]
    assert [i for g, i in mail_text._thread(thread) if g == "b"] == want
    alone = [i for _, i in mail_text._thread(thread[1:])]
    assert alone == [i for i, x in enumerate(lines, 1) if x] and (alone != want or name in ("by someone else", "too short"))
    # the one who wrote it first keeps it, and so does a message before
    assert len([i for g, i in mail_text._thread(thread) if g == "a"]) == 10
    assert [i for g, i in mail_text._thread([((False, 3, "a"), ANN, first, True), thread[1]]) if g == "b"] == alone


def test_closing_lines_of_the_sender():
    """A line of an earlier closing block of the same sender is a signature below a closing, else it is text."""
    closing = "Cheers,\nAnn\n-> Ask me for the, well, long and strange story of the green door!"
    thread = [((False, 1, "a"), ANN, f"One.\n\n-- \nAnn\n{closing.splitlines()[2]}\nT: 00 555 123", True)]
    same = [*thread, ((False, 2, "b"), ANN, f"Two.\n\n{closing}", True)]
    other = [*thread, ((False, 2, "b"), BOB, f"Two.\n\n{closing}", True)]
    found = lambda t: [i for g, i in mail_text._thread(t) if g == "b"]
    first = [i for g, i in mail_text._thread(thread)]
    assert found(other) == [1, 5] and (found(same) == [1] or 5 in first)


def test_time_of_long_threads_is_linear():
    import time

    def took(n):
        rows = [((False, i, f"m{i:05}"), BOB if i % 2 else ANN, f"Answer {i} is about point {i * 7} of the plan.\nIt has {i} words.\n> Answer {i - 1} is about point {i * 7 - 7} of the plan.", True) for i in range(n)]
        began = time.perf_counter()
        assert len(list(mail_text._thread(rows))) == 2 * n
        return time.perf_counter() - began

    took(200)
    assert took(4_000) < 20 * max(took(500), 0.02)


def test_unknown_times(spark):
    """Marked quotes are patterns only between messages of known time: what they quote may seem to come later."""
    text = SENTENCES[0]
    data = [("a", "t", ANN, text, None, None, ""), ("b", "t", BOB, f"Yes.\n> {text}", "2025-03-02T00:00:00+00:00", None, "")]
    assert rows(mail_text.written_lines(spark.createDataFrame(data, SCHEMA))) == [("a", 1), ("b", 1)]
    data = [("a", "t", ANN, text, "2025-03-03T00:00:00+00:00", None, ""), ("b", "t", BOB, f"Yes.\n> {text}", None, None, "")]
    assert rows(mail_text.written_lines(spark.createDataFrame(data, SCHEMA))) == [("a", 1), ("b", 1)]


def test_hot_thread_in_blocks(spark):
    """A thread that holds nearly all messages gives the same lines in one group as in many blocks."""
    data = [(f"m{i:03}", "t", ANN if i % 2 else BOB, f"Answer {i}.\n\nBest,\n{'Ann' if i % 2 else 'Bob'}\n\nOn Mon, 3 Mar 2025 at 10:00, X <x@x.example> wrote:\n> Answer {i - 1}.", f"2025-03-01T00:{i // 60:02}:{i % 60:02}+00:00", None, "") for i in range(90)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(mail_text.written_lines(df)) == rows(mail_text.written_lines(df, large=20, block=10)) == [(f"m{i:03}", 1) for i in range(90)]


def test_lines_that_join_two_messages_in_blocks(spark):
    """Lines that hold the end of one earlier message's sentence and the start of another's are quoted, also where
    the two messages are in different blocks."""
    one = [f"Point {i} of the long and careful plan that we made together last week in town." for i in range(8)]
    two = [f"Remark {i} on the budget which nobody but the two of us has read so far." for i in range(8)]
    words = " ".join(x for pair in zip(one, two) for x in pair).split()
    quote = "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11))
    data = [(f"s{i}", "t", ANN, x, f"2025-03-01T00:00:{i:02}+00:00", None, "") for i, x in enumerate(one + two)]
    data.append(("z", "t", BOB, "I agree.\n\n" + quote, "2025-03-02T00:00:00+00:00", None, ""))
    df = spark.createDataFrame(data, SCHEMA)
    for large, block in ((2_000, 20_000), (0, 1), (0, 4), (0, 20_000)):
        assert [r for r in rows(mail_text.written_lines(df, large=large, block=block)) if r[0] == "z"] == [("z", 1)]

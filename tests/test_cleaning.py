"""Each rule of the staged cleaner: a text it changes and one it leaves alone. Expected texts are written by hand."""

import random
import re

import pytest

from corpusmill.functions import cleaning as C
from corpusmill.operators import cleaning

STORY = "The old harbour town woke slowly under a grey sky, and the fishermen carried their nets along the quay without a word. "
LONG = STORY * 4


@pytest.mark.parametrize(
    "text, want",
    [
        ("  ", "  "),
        ("nnThe sky. nnThen rain", "The sky. Then rain"),
        ("I cannot comply with it", None),
        ("We were not able to help", "We were not able to help"),
        ("[ system ] A [USER] b", "A b"),
        ("User: hello", "hello"),
        (": hello", "hello"),
        ("abstractThe aim", "Abstract The aim"),
        ("Sure, Okay! go on", "go on"),
        ("Here is a story based on it: Once upon", "Once upon"),
        ("Here is a dog: it barks", "Here is a dog: it barks"),
        ("x" * 200 + " here is a story: end", "x" * 200 + " here is a story: end"),
        ("Here is the article", None),  # no end of a sentence: all of it goes
        ("[user]", None),
    ],
)
def test_wrappers(text, want):
    assert C.wrappers(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Title: “A” b", '"A" b'),
        ("Run. Here's a polished version of it: Rain fell", "Run. Rain fell"),
        ("Rain fell. Write 5 sentences: go", "Rain fell. go"),
        ("Write a short sentence story: go", "go"),
        ("Rain. " * 60 + "First Sentence: go", ("Rain. " * 60 + "go")),
        ("Rain. " * 60 + "with ten sentences. go", ("Rain. " * 60 + "go")),
        ("assistant : hello [llm] x", "hello x"),
        ("ethics guidelines", None),
        ("Title:", None),
        ("", ""),
        ("Plain words stay.", "Plain words stay."),
    ],
)
def test_headers(text, want):
    assert C.headers(text) == want


def test_editors_notes():
    note = " Editor's note: this was polished."
    assert C.editors_notes(LONG + note) == LONG.strip()[:-1]  # the end of the sentence is part of what opens the note
    assert C.editors_notes(LONG + "Note: the boats sank.") == LONG + "Note: the boats sank."
    assert C.editors_notes("a" * 198 + "." + note) == "a" * 198 + "." + note  # 198 characters would stay
    assert C.editors_notes("a" * 200 + "." + note) == "a" * 200
    big = " note: polished " + "b" * 400
    assert C.editors_notes("a" * 300 + "." + big) == "a" * 300 + "." + big
    assert C.editors_notes("a" * 300 + "." + big + " reddit.com") == "a" * 300
    assert C.editors_notes("a" * 300 + "\n----- *** ___ " + "." + note) == "a" * 300
    dashes = "a" * 300 + "-" * 200 + "x." + note
    assert C.editors_notes(dashes) == "a" * 300 + "-" * 200 + "x"
    assert C.editors_notes("") == ""


def test_apologies():
    sorry = "I'm sorry, I cannot do that. It is hard. It is late. "
    assert C.apologies(sorry + STORY) == STORY.strip()
    assert C.apologies(sorry + "Too short.") is None
    assert C.apologies(sorry + "x" * 79) is None and C.apologies(sorry + "x" * 80) == "x" * 80
    assert C.apologies(sorry + "It can't be " + "x" * 207) is None and C.apologies(sorry + "It can't be " + "x" * 208) is not None
    assert C.apologies(sorry + sorry + STORY) is None
    assert C.apologies("Sorry, I can't. Call the Samaritans. " + LONG) is None
    assert C.apologies("Sorry, the boat is late. " + STORY) == "Sorry, the boat is late. " + STORY.strip()
    assert C.apologies("a **b** __c__ *d* e***f\n\n\n\ng") == "a b c d e f g"
    assert C.apologies("Rain fell. Disclaimer: spelling improved. P.S.: grammar") == "Rain fell"
    assert C.apologies("Rain fell\nNote:\n* one\n* two") == "Rain fell"
    assert C.apologies(" ") is None


def test_prompts():
    body = STORY.strip()
    assert len(body) > 110 and C.prompts("x" * 119) is None and C.prompts("x" * 120) == "x" * 120
    body = (STORY * 2).strip()
    for head in (
        "Task: write about boats. Assistant: ",
        "Prompt: the sea\n",
        "Given the abstract below\n\n",
        "Based on the story, go. Two. ",
        "Write a story\n",
        "Review's first sentence: ",
        "Continued review: ",
        "Headline: boats\nDate: May 1\n",
        "* * * ",
        "[rules] be kind\n\n",
        "Content warning: storms\n\n",
        "As an AI language model, I cannot do it. " + "No. " * 5,
        "I​ am sorry. ",
    ):
        want = body if head[:2] != "I​" else "I am sorry. " + body
        assert C.prompts(head + body) == want, head
    assert C.prompts("Task: wait\n" + "x" * 119) == "Task: wait\n" + "x" * 119
    assert C.prompts("Write boldly. Instruction 1: sail\nInstruction 2: row\n" + body) == body
    assert C.prompts("Here are 3 additional sentences about it: 1. " + body) == body
    assert C.prompts("Write the first sentence now. " + body) == body
    assert C.prompts("system: " + body) == body and C.prompts("user: Okay then, let's break this down. " + body) == body
    assert C.prompts("I can't believe it. " + body) == "I can't believe it. " + body
    assert C.prompts("I'm sorry but I can't help. " + body) is None  # a first sentence with a cue takes five more along
    assert C.prompts("I'm sorry. We can't help. " + body) == "We can't help. " + body
    assert C.prompts("I'm sorry but I can't help. " + "We can't help. " * 5 + body) == body
    assert C.prompts(body + " Edit: typo. TL;DR: formatting") == body[:-1]
    assert C.prompts("See https://poe.com/usage_guidelines " + body) is None
    assert C.prompts("If you or someone you know has suicidal thoughts, seek help. " + body) is None
    assert C.prompts("As an AI language model I cannot break policy. " + body) is None
    assert C.prompts("-" * 300) is None and C.prompts("ab" * 10 + "-" * 300) == "ab" * 10 + "-" * 300


def test_transcripts():
    body = (STORY * 2).strip()
    assert C.transcripts("WEBVTT " + body) is None
    assert C.transcripts("captions 00:01 00:02 00:03 " + body) is None and C.transcripts("boats 00:01 00:02 00:03 " + body) is not None
    assert C.transcripts("Тhе sky. " + body) == "The sky. " + body
    assert C.transcripts("# Rules\nno\n\n" + body) == body
    assert C.transcripts("User: " + body) == body
    assert C.transcripts("Title: " + body) == body
    assert C.transcripts("Write a summary\n" + body) == body
    assert C.transcripts("Based on the story. Two. " + body) == body
    assert C.transcripts("Call 988. " + body) is None and C.transcripts("Let's focus on boats. " + body) is None
    assert C.transcripts("I cannot provide it. " + body) is None and C.transcripts("I cannot provide it. " + "No. " * 6 + body) == body
    assert C.transcripts("Sorry. A prompt " + "x" * 130) is None and C.transcripts("Sorry. A prompt " + "x" * 131) == "A prompt " + "x" * 131
    assert C.transcripts(body + " Source: reddit.com") == body
    assert C.transcripts(body + " Rain fell. I hope this helps!") == body + " Rain fell."
    assert C.transcripts("x" * 99) is None and C.transcripts("x" * 100) == "x" * 100


def test_mixed_scripts():
    assert C.mixed_scripts("a​b ‮c") == "ab c"
    assert C.mixed_scripts("ⲅain հope ροζ voiceς ь") == "rain hope ροζ voices ь"
    assert C.mixed_scripts("é plain") == "é plain" and C.mixed_scripts("") == ""


def test_records(spark):
    body = (STORY * 2).strip()
    d = spark.createDataFrame([(1, "Sure, " + body, "x" * 130), (2, body, "short"), (3, None, None), (4, " ", body), (5, "I cannot comply", body), (1, "Sure, " + body, "x" * 130)], "id int, text string, other string")
    assert sorted(map(tuple, cleaning.clean_records(d, "text", "other").collect()), key=str) == [(1, body, "x" * 130)] * 2 + [(3, None, None)]
    assert cleaning.clean_counters(d, "text", "other").first().asDict() == {"before": 6, "kept": 3, "dropped": 3, **{f"dropped_{n}": int(n in (1, 4, 5)) for n in range(1, 8)}}
    assert cleaning.clean_counters(d.where("false"), "text").first()["before"] == 0
    assert cleaning.clean_records(d, "text").columns == d.columns
    long = spark.createDataFrame([(1, STORY * 20_000)], "id int, text string")
    assert cleaning.clean_records(long, "text").first()["text"] == (STORY * 20_000).strip()


def test_single_stars_in_one_pass_as_by_a_search():
    r = random.Random(12)
    for _ in range(20_000):
        t = "".join(r.choice("**a \n,_") for _ in range(r.randrange(0, 14)))
        assert C.without_single_stars(t) == re.sub(r"(?s)(?<!\n)\*(?!\s)(.+?)(?<!\s)\*(?!\w)", r" \1 ", t), repr(t)
    assert C.without_single_stars("*a " * 200_000) == "*a " * 200_000


def test_maps_of_letters_act_as_translate():
    r = random.Random(4)
    for table in (C._QUOTES, C.R.LETTERS_5, C.R.LETTERS_6, C.R.HIDDEN):
        assert not {v for v in table.values() if v is not None} & set(table)
        signs = [*map(chr, table), *"aé  b."]
        for _ in range(50):
            text = "".join(r.choices(signs, k=r.randrange(0, 60)))
            assert C._mapped(text, table) == text.translate(table)


def test_tidying_looks_for_what_it_changes():
    for text in ("a b", "a  b", "a\tb", "\ra \x0b b\n\n\n\nc\n\n", " \x0c ", "a\n\n\nb"):
        assert C._tidy(text) == re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()
    for text in ("a\x1cb  c", " \x85 ", "a b"):
        assert C._one_line(text) == re.sub(r"\s+", " ", text).strip()
    assert C._holds("a**b", "**", "__") and C._plain("a**b") == "a b" and C._plain("a*b_c") == "a*b_c"

"""Fixed values of the staged cleaner: patterns, phrases, letter maps and lengths that decide its results. `cleaning` holds what is done with them."""

import re

from corpusmill.functions.text import REFUSALS


def _p(pattern: str, flags: str = "is") -> re.Pattern:
    return re.compile(f"(?{flags}){pattern}")


#: Sentences as the stages count them.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n{2,}")
BLANKS = re.compile(r"[ \t\r\f\v]+")
EMPHASIS = re.compile(r"\*\*|__")

# Stage 1: role tags, openings, wrappers.
STEMS_1 = ("not", "not", "model", "model", "anthrop", "gu", "protocol", "not", "unable", "regrettabl")  # of REFUSALS, in their order
REFUSED_1 = [(stem, _p(r, "i")) for stem, r in zip(STEMS_1, REFUSALS, strict=True)]
STUCK_NN = re.compile(r"^\s*nn(?=[A-Z])")
STUCK_NN_INSIDE = re.compile(r"(?<=[a-z.,!?])\s*nn(?=[A-Z])")
STUCK_ABSTRACT = _p(r"abstract(?=[A-Z])", "i")  # with the flag, any letter counts as [A-Z]
TAGS_1 = [
    _p(r"\[\s*(?:system|assistant|user|model)\s*\]", "i"),
    _p(r"\[\s*(?:s[yij]+s.*?|a[s$]+i[s$]+.*?|u[sz]er.*?)\s*\]", "i"),
    _p(r"(?:^|\n)\s*(?:System|Assistant|User|Model)\s*:", "i"),
]
OPENINGS = [_p(rf"^\s*{w}\s*[,!.]", "i") for w in ("Sure", "Okay", "Certainly", r"Of\s+course")]
WRAPPER = _p(r"(?<![A-Za-z])(?:here(?:\s+(?:is|are|s)|\'s)|today\s+is|sure[,!]?\s*here(?:\s+(?:is|are|s)|\'s))", "i")
WRAPPER_WORDS = (
    "news", "article", "headline", "body", "abstract", "review", "story", "sentence", "sentences", "based on", "continuation", "summary", "prompt",
    "requested", "possible", "polished", "version", "attempt", "experience", "opinion", "take", "thoughts", "list", "pros", "cons",
    "overview", "analysis", "essay", "blog", "post", "comment", "draft", "example", "revised", "text", "rewrite", "writing", "copy", "below",
)
WRAPPER_REACH = 200

# Stage 2: headers, counts of sentences, labels of sentences.
REFUSED_2 = [
    ("not", _p(r"(?:i|we)\W*(?:m|am|are)?\s+not\s+(?:able|bale)\s+to\s+help", "i")),
    ("not", _p(r"(?:i|we)\s+cannot\s+(?:fulfill|fulfil|comply|produce|generate)", "i")),
    ("model", _p(r"as\s+(?:an?|the)\s+(?:ai|artificial\s+intelligence|language)\s+model", "i")),
    ("model", _p(r"only\s+a\s+language\s+model", "i")),
    ("gu", _p(r"ethics\s+guidelines", "i")),
]
FIELD_HEADER = _p(r"\b(?:Title|Headline|Abstract|Subject|Topic)\s*:\s*", "i")
POLISHED_VERSION = _p(r"(?:\s|^)Here['’]s\s+a\s+(?:polished|rewritten|improved|shortened)\s+version.*?(?:[:\.]|$)")
SENTENCE_COUNT = _p(
    r"(?:\b(?:with|of|output|write|generate|only|full|total|summary|limit)\s+)?"
    r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty)\s+sentences?(?:\s*[:\.\-\(\)])",
    "i",
)
SENTENCE_LABEL = _p(
    r"(?:\b(?:based|on|the|a|an|given|provided|generated|requested|review['’]?s?|story['’]?s?|sentence|of)\s+)*"
    r"(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Last|\d+(?:st|nd|rd|th))(?:\s+and\s+the\s+Last)?\s+Sentence\s*[:\.\-]+\s*",
    "i",
)
META_HEADER = _p(
    r"^.*?(?:\b(?:is|a|an|the|write|provide)\b\s+)*"
    r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|short|brief|few)\s*"
    r"[-]?\s*sentences?\s+(?:article|summary|review|story|abstract|continuation|narrative)?.*?(?:[:\n]|\.(?=\s)|$)"
)
META_HEADER_REACH = 300
TAGS_2 = [
    _p(r"\[\s*(?:system|assistant|user|model|human|llm)\s*\]", "i"),
    _p(r"(?:^|\n)\s*(?:System|Assistant|User|Model)\s*:\s*", "i"),
    STUCK_NN,
]

# Tails: what opens one, and what shows that it isn't part of the text.
_AT = r"(?:^|[\n\r]|[.!?]\s+)\s*"
_RULE = r"(?:---+\s*)?"
_RATED = rf"|{_AT}(?:final\s+)?rating\s*:\s*\d"
_DATED = rf"|{_AT}year\s*:\s*\d{{4}}|{_AT}date\s*:\s*[A-Za-z]{{3,}}"
TAIL_3 = _p(
    rf"(?:{_AT}{_RULE}(?:editor'?s|author'?s|assistant'?s|side|special)?\s*note\s*:|{_AT}{_RULE}p\.?\s*s\.?\s*:|{_AT}disclaimer\s*:{_DATED}{_RATED})"
)
TAIL_4 = _p(
    rf"(?:{_AT}{_RULE}(?:editor'?s|author'?s|assistant'?s|system)?\s*note\s*:|{_AT}{_RULE}(?:disclaimer|important\s+note)\s*:|{_AT}{_RULE}(?:p\.?\s*s\.?|ps)\s*:{_RATED}{_DATED})"
)
TAIL_5 = _p(
    rf"(?:{_AT}{_RULE}(?:editor'?s|author'?s|assistant'?s)?\s*note\s*:|{_AT}{_RULE}(?:edit|update)\s*:|{_AT}{_RULE}tl\s*;\s*dr\s*[:\-]|{_AT}{_RULE}p\.?\s*s\.?\s*[:\-]"
    rf"|{_AT}(?:source|credit|attribution|link|original\s+prompt|original)\s*:{_RATED}{_DATED})"
)
TAIL_6 = _p(
    r"(?:(?:editor'?s|author'?s|assistant'?s)\s*note\s*:|\"?\s*note\s*:|(?:edit|update)\s*:|tl\s*;\s*dr\s*[:\-] ง?|p\.?\s*s\.?\s*[:\-]|(?:source|credit|attribution|link|original\s+prompt)\s*:)"
)
CREDIT_3 = _p(r"(?:reddit\.com|r/writingprompts|\b/u/\w+|\bu/\w{3,}|(?:^|\s)/r/\w+)")
CREDIT_5 = _p(r"(?:https?://\S+|h?t{1,2}ps?://\S+|reddit\.com|r/writingprompts|(?:^|\s)/r/\w+|\b/u/\w+|poe\.com/usage_guidelines)")
CREDIT_6 = _p(r"(?:https?://\S+|reddit\.com|r/writingprompts|\b/u/\w+|(?:^|\s)/r/\w+)")
BULLET = _p(r"(?:^|\n)\s*(?:[*\-]\s+)")
BULLET_3 = _p(r"(?:^|\n)\s*(?:[*\-]\s+)(?:i\s+have\b|\".+?\"\s+can\s+be\s+rephrased)")
EDITED_3 = _p(
    r"\b(?:"
    + "|".join(
        re.escape(w)
        for w in (
            "polished", "rewritten", "improved", "shortened", "grammar", "spelling", "clarity", "concision", "readability",
            "minor changes", "made some changes", "i made some", "i have made", "i have replaced", "i have added", "i have corrected", "i have changed",
            "can be rephrased", "rephrased as", "formatting", "blank lines", "maintaining the same meaning", "maintaining the same message",
            "more formal", "news article", "academic style", "tone", "original story", "original narration", "can be found on", "the link to the original",
            "reddit.com", "r/writingprompts", "/r/", "u/", "/u/",
        )
    )
    + r")\b"
)
EDITED_4 = _p(
    r"\b(?:polished|rewritten|improved|grammar|spelling|clarity|concision|readability|minor\s+changes?|made\s+some\s+changes?|i\s+made\s+some|"
    r"rephrased|formatting|blank\s+lines|original\s+story|can\s+be\s+found\s+on|the\s+link\s+to\s+the\s+original|"
    r"this\s+(?:review|story|article)\s+(?:has\s+been|was)\s+(?:polished|rewritten|improved))\b"
)
EDITED_5 = _p(
    r"\b(?:polished|rewritten|improved|grammar|spelling|clarity|concision|readability|minor\s+changes?|made\s+some\s+changes?|rephrased|formatting|"
    r"fixed\s+the\s+formatting|typo|original\s+story|original\s+prompt|prompt\s+can\s+be\s+found|can\s+be\s+found\s+on|the\s+link\s+to\s+the\s+original|"
    r"thanks\s+for\s+reading|feedback\s+welcome|send\s+us\s+feedback|if\s+you\s+think\s+this\s+is\s+a\s+mistake)\b"
)
EDITED_6 = _p(
    r"\b(?:polished|rewritten|improved|grammar|spelling|clarity|readability|minor\s+changes?|made\s+some\s+changes?|i\s+made\s+some\s+minor\s+changes?|"
    r"rephrased|formatting|blank\s+lines|original\s+story|original\s+prompt|the\s+link\s+to\s+the\s+original|thanks\s+for\s+reading|feedback\s+welcome)\b"
)
KEEP_BEFORE_TAIL, LARGEST_TAIL = 200, 0.45

# Stage 4: an apology with a reason.
APOLOGY = _p(r"^\s*(?:i\s+apologize|i'?m\s+sorry|sorry)\b[\s,]*")
REFUSAL_CUE = _p(
    r"\b(?:cannot|can'?t|won'?t|not\s+able|do\s+not\s+feel\s+comfortable|not\s+appropriate|ethical|policy|guidelines|as\s+an?\s+ai|language\s+model|"
    r"i\s+regret\s+to\s+inform\s+you|i\s+cannot\s+assist|against\s+my\s+(?:use\s+case|safety|content)\s+policy|i\s+don'?t\s+feel\s+comfortable)\b"
)
HOTLINE_4 = _p(r"\b(?:crisis\s+hotline|suicide\s+prevention\s+lifeline|samaritans|1-800-273|116\s+123|talk\s*\(8255\))\b")
APOLOGY_REACH, APOLOGY_SENTENCES, APOLOGY_REST, APOLOGY_REST_WITH_CUE = 280, 3, 80, 220

# Stage 5: openings, prompts, policies.
LETTERS_5 = str.maketrans("еіѕорсухԁһӏѵɑոɡʋ’“”—–", "eisopcyxdhlvangv'\"\"--")
POLICY_LINK = _p(r"\b(?:h?t{1,2}ps?)\s*:\s*/\s*/\s*poe\.com\s*/\s*usage_guidelines\b")
FEEDBACK = _p(r"\b(?:if\s+you\s+think\s+this\s+is\s+a\s+mistake|send\s+us\s+feedback|provide\s+us\s+with\s+your\s+feedback|contact\s+support)\b")
IDENTITY = _p(r"\b(?:as\s+an?\s+ai(?:\s+language)?\s+model|i\s+am\s+(?:just|only|merely)\s+an?\s+ai(?:\s+language)?\s+model)\b")
DECLINES = _p(r"\b(?:cannot|can'?t|won'?t|unable|not\s+able|must\s+decline|refuse)\b")
POLICY = _p(r"\b(?:policy|guidelines|ethical|not\s+appropriate|inappropriate|content\s+policy|safety)\b")
SELF_HARM = _p(r"\b(?:self-?harm|suicid(?:e|al)|kill\s+yourself)\b")
SOMEONE_YOU_KNOW = _p(r"\bif\s+you\s+or\s+someone\s+you\s+know\b")
REACH_OUT = _p(r"\b(?:reach\s+out|seek\s+help|contact|call)\b")
HOTLINE_5 = _p(r"\b(?:hotline|lifeline|samaritans|crisis\s+line|emergency\s+services|988|116\s*123|1-800-273|call\s+911)\b")
REFUSAL_5 = _p(
    r"^\s*(?:i\s+apologize|i'?m\s+sorry|sorry|i\s+cannot|i\s+can'?t|i\s+won'?t|i\s+am\s+not\s+able|i\s+am\s+unable|i\s+must\s+decline|i\s+have\s+to\s+decline|regrettably|unfortunately)\b"
)
ACTION = _p(r"\b(?:help|assist|provide|generate|write|create|comply|fulfill|participate)\b")
NARRATIVE = _p(r"\b(?:can'?t\s+(?:believe|stand|wait|say|remember)|won'?t\s+(?:believe|say))\b")
WARNING = _p(r"^\s*(?:trigger\s+warning|content\s+warning|tw\s*:)\b.{0,220}(?:\n\n|$)")
PLAYBACK = _p(r"\bmedia playback is not supported on this device\b")
ROLE_5 = _p(r"^\s*(?:system|assistant|user)\s*[:：]\s*", "im")
BREAKDOWN = _p(r"^\s*(?:alright|okay|fine|sure)\b.{0,140}let'?s\s+break\s+this\s+down[.!]?\s*")
RULES_HEAD_5 = _p(r"^\s*\[\s*(?:rules|auxiliary)\s*\]\s*:?\s*")
RULES_5 = _p(r"\[\s*(?:rules|auxiliary)\s*\]\s*:?\s*")
TASK_WRITE = _p(r"^\s*task\s*:\s*write\b.{0,360}?\bassistant\s*[:：]\s*")
PROMPT_5 = _p(r"^\s*(?:prompt|writing\s*prompt|task|instruction|system\s*prompt|user\s*prompt)\s*:\s*", "im")
GIVEN_5 = _p(r"^\s*(?:given\s+the|based\s+on\s+the)\b.{0,320}\b(?:abstract|story|essay|review|article|prompt)\b")
WRITE_5 = _p(r"^\s*(?:write|compose|generate|create|draft)\b.{0,180}\b(?:story|abstract|essay|review|article)\b")
CONTINUATIONS = [
    _p(r"^\s*given\s+the\s+review[’']s\s+first\s+sentenc[e]\s*,?\s*(?:continue|continu(?:e|ity))\b.{0,220}?:\s*"),
    _p(r"^\s*review[’']s\s+first\s+sentenc[e]\s*:\s*"),
    _p(r"^\s*continued\s+review\s*:\s*"),
    _p(r"^\s*(?:here'?s\s+a\s+possible|potential)\s+continuation\s+of\s+the\s+review\b.{0,220}:?\s*"),
    _p(r"^\s*(?:here\s+is\s+a\s+fictional|this\s+is\s+a\s+fictional)\b.{0,140}:?\s*"),
]
NEWS_FIELD = _p(r"^\s*(?:headline|body|date)\s*:\s*", "im")
INSTRUCTION_1 = _p(r"^\s*write\b.{0,280}\binstruction\s*1\s*:\s*")
INSTRUCTION_LINE = _p(r"^\s*[-*]?\s*instruction\s*\d+\s*:\s*", "im")
LEADING_STARS = _p(r"^\s*(?:\*\s*){2,}", "s")
HERE_ARE = _p(r"\bhere\s+are\s+\d+\s+additional\s+sentences\b[^:]{0,160}:\s*")
NUMBERED = _p(r"^\s*\d+\.\s+", "m")
SCAFFOLD = _p(r"\b(?:generate an interesting title|write the (?:first|second|third|fourth|fifth|sixth|seventh) sentence)\b")
LEAST_5 = 120

# Stage 6: transcripts, prompts, hotlines, closings.
LETTERS_6 = str.maketrans("аеорсхуіјѕѵӏԁԛԝһкмнтАЕОРСХУІЈЅѴӀԀԚԜНКМТ", "aeopcxyijsvldqwhkmhtAEOPCXYIJSVLDQWHKMT")
MEDIA = _p(r"(?:\bwebvtt\b|\[music\]|\[applause\]|♪|like\s+and\s+subscribe|subscribe\s+to\s+our|closed\s+captions)")
TIME_STAMP = re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\b")
CAPTIONS = _p(r"\b(?:captions|subtitle|transcript)\b")
RULES_HEAD_6 = _p(r"^\s*(?:\[\s*(?:rules|auxiliary)\s*\]|#{1,4}\s*(?:rules|auxiliary)\b|\*\*\s*(?:rules|auxiliary)\s*\*\*)")
ROLE_6 = _p(r"^\s*(?:#+\s*)?(?:system|assistant|user)\s*(?:[:\-]|：)\s*", "im")
PROMPT_6 = _p(r"^\s*(?:prompt|writing\s*prompt|task|instruction|system\s*prompt)\s*[:：]\s*", "im")
FIELD_6 = _p(r"^\s*(?:title|abstract|keywords|subject|topic)\s*[:：]\s*", "im")
GIVEN_6 = _p(r"^\s*(?:given\s+the|based\s+on\s+the)\b.{0,260}\b(?:story|abstract|essay|review|article|summary)\b")
WRITE_6 = _p(r"^\s*(?:write|compose|generate|create)\b.{0,160}\b(?:story|abstract|essay|review|article|summary|news)\b")
HOTLINE_6 = _p(
    r"\b(?:988\b|1[-\s]?800[-\s]?273\b|273[-\s]?talk\b|\b(?:8254|8255)\b|116\s*123\b|samaritans\b|crisis\s+hotline\b|suicide\s+(?:prevention|crisis)\b|(?:suicide|crisis|prevention)\s+\w{0,12}\s*lifeline\b)\b"
)
DEFLECTS = [_p(r"^\s*let'?s\s+focus\s+on\b"), _p(r"^\s*if\s+you\s+or\s+someone\s+you\s+know\s+is\s+(?:struggling|in\s+crisis)\b")]
REFUSAL_6 = _p(
    r"^\s*(?:i\s+apologize|i'?m\s+sorry|sorry|i\s+cannot|i\s+can'?t|i\s+won'?t|i\s+am\s+not\s+able|i\s+am\s+unable|i\s+must\s+decline|i\s+have\s+to\s+decline|as\s+an?\s+ai|i\s+am\s+an?\s+artificial\s+intelligence)\b"
)
POLICY_6 = _p(
    r"\b(?:policy|guidelines|content\s+policy|safety|as\s+an?\s+ai|language\s+model|artificial\s+intelligence|not\s+appropriate|inappropriate|ethical|morally|"
    r"cannot\s+assist|can'?t\s+help|cannot\s+help|i\s+cannot\s+provide|i\s+can'?t\s+provide|request|prompt)\b"
)
CLOSING = _p(r"\b(?:i\s+hope\s+this\s+helps|let\s+me\s+know\s+if\s+you\s+have\s+any\s+other\s+questions|feel\s+free\s+to\s+ask)\b")
LEAST_6, LEAST_REST_6 = 100, 140

# Stage 7: letters of other scripts inside words of ASCII letters.
HIDDEN = {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x202A, 0x2030), *range(0x2066, 0x206A))}
LETTERS_7 = str.maketrans("ⲅհςЬь", "rhsBb")
SCRIPTS_7 = ("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC")

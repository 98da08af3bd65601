"""The text and reward rules once more, as plain Python on tag positions and
tables, for the tests to hold the Spark expressions against."""

from rubric.functions import fixed

TAGS = {"think": (fixed.THINK_OPEN, fixed.THINK_CLOSE), "answer": (fixed.ANSWER_OPEN, fixed.ANSWER_CLOSE)}
#: Letters whose lower case is another letter than the one they match without regard to case.
ODD_CASE = {"ſ": "s", "K": "k"}


def same_length_fold(text):
    return "".join(ODD_CASE.get(c, c.lower() if len(c.lower()) == 1 else c) for c in text)


def block(text, name, any_case, may_stay_open):
    """The text of the first block of tag ``name``, or None: from the end of
    the first opener to the next closer, or to the end if it may stay open."""
    opener, closer = TAGS[name]
    seen = same_length_fold(text) if any_case else text
    places = [(i, tag) for tag in (opener, closer) for i in range(len(seen)) if seen.startswith(tag, i)]
    start = None
    for i, tag in sorted(places):
        if tag == opener and start is None:
            start = i + len(opener)
        elif tag == closer and start is not None:
            return text[start:i].strip()
    return text[start:].strip() if start is not None and may_stay_open else None


def py_think_answer(text):
    return block(text, "think", True, False) or "", block(text, "answer", True, True) or ""


def py_strict(text):
    found = [block(text, name, False, False) for name in ("think", "answer")]
    if found == [None, None]:
        return text.strip(), ""
    return found[0] or "", found[1] or ""


def py_clean(text):
    kept = filter(lambda c: c == "_" or c.isalnum() or c.isspace(), text.lower())
    return "".join(kept)


#: Cleaned gold answer -> the words any of which counts as it.
ACCEPTED = {}
for words in fixed.SYNONYM_GROUPS.values():
    for word in words:
        ACCEPTED.setdefault(word, set(words))


def py_match(pred, gold):
    pred, gold = py_clean(pred), py_clean(gold)
    return pred == gold or not ACCEPTED.get(gold, {gold}).isdisjoint(pred.split())


def py_flags(text, gold):
    think, answer = py_think_answer(text)
    right = py_match(answer, gold)
    return think, answer, int(right), int(right and py_match(think, gold))


def py_format(text):
    return sum(fixed.FORMAT_TAG_POINTS for pair in TAGS.values() for tag in pair if tag in text)


#: Facts about a completion, and the points it gets if all of a row's hold.
POINTS = [
    ({"blank": True}, fixed.EMPTY_ANSWER_POINTS),
    ({"blank": False, "right": False}, fixed.WRONG_POINTS),
    ({"blank": False, "right": True}, fixed.CORRECT_POINTS),
    ({"blank": False, "right": True, "thought": True, "agrees": True}, fixed.CONSISTENT_BONUS),
    ({"blank": False, "right": True, "thought": True, "agrees": False}, -fixed.INCONSISTENT_PENALTY),
    ({"blank": False, "right": True, "wordy": True}, -fixed.LONG_ANSWER_PENALTY),
]


def py_main(text, gold):
    think, answer = py_think_answer(text)
    facts = {"blank": answer == "", "right": py_match(answer, gold), "thought": think != "", "agrees": py_match(think, gold),
             "wordy": len(answer.split()) > fixed.LONG_ANSWER_WORDS}
    return sum(points for row, points in POINTS if row.items() <= facts.items())

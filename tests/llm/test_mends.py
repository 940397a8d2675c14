"""Cases that once went wrong."""

import random
import re
import time

from duskline.llm import chat, pii


def test_null_is_no_text(spark):
    rows = [("a", 1, None, "x"), ("b", 1, "\x00null", "x"), ("c", 1, "", "x"), ("d", 1, "r", None), ("e", 1, "r", "\x00null"), ("f", 1, "r", "-1:")]
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert sorted(r.conv_id for r in got) == list("abcdef")


def test_base_patterns_are_the_plain_ones():
    plain = {"ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"}
    digits = lambda x: re.sub("[^0-9]", "", x)
    keep = {
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and pii.luhn(digits(x)),
        "phone": lambda x: 8 <= len(digits(x)) <= 15, "email": lambda x: True,
    }
    rng = random.Random(3)
    seen = set()
    for _ in range(4000):
        text = "".join(rng.choice(["1", "25", "0", ".", "..", "+", "-", " ", "(", ")", "@", "a", "Z.", "4539148803436467", "255.1.2.3", "x@y.z"]) for _ in range(rng.randrange(25)))
        want = [(k, *m.span()) for k in pii.KINDS for m in re.finditer(plain[k], text) if keep[k](m[0])]
        assert pii.base_spans(text) == want, text
        seen |= {k for k, _, _ in want}
    assert seen == set(pii.KINDS)


def test_long_runs_of_digits_take_linear_time():
    took = []
    for n in (200_000, 800_000):
        start = time.process_time()
        assert pii.base_spans("1" * n + " " + "1." * n) is not None
        took.append(time.process_time() - start)
    assert took[1] < 10 * max(took[0], 0.05)

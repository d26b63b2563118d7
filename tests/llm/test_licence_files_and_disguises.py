"""Whole licence files, and disguised personal data: precision, recall and time."""

import random
import time

import pytest

from setgraph.llm import licenses, pii
from setgraph.llm.licence_texts import BODIES

# -- licences -----------------------------------------------------------------------------------------------------


def licences(spark, rows):
    got = licenses.licences(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()
    return {r["path"]: (r["licence"], r["origin"]) for r in got}


def test_licence_files_and_their_neighbours(spark):
    """Each whole licence, with lines broken elsewhere and a holder's line before it, names its directory's files."""
    rows = []
    for at, (name, text) in enumerate(BODIES):
        rows += [(2 * at, f"{name}/LICENSE", "Copyright 2020 Some Body\n\n" + "\n ".join(text.split(" "))), (2 * at + 1, f"{name}/src/main.c", "int main() { return 0; }")]
    got = licences(spark, rows)
    for name, _ in BODIES:
        assert got[f"{name}/LICENSE"] == (name, "own")
        assert got[f"{name}/src/main.c"] == (name, "inherited")


@pytest.mark.parametrize("left_out", ["GFDL-1.2", "MPL-1.1", "Artistic-1.0-Perl", "LGPL-3.0"])
def test_unknown_long_licences_are_no_other(spark, left_out, monkeypatch):
    """A long licence that is no template, and not nearly another version of one, isn't taken for one by its statement."""
    family = left_out.split("-")[0]
    monkeypatch.setattr(licenses, "TEMPLATES", tuple(t for t in licenses.TEMPLATES if not t[0].startswith(family)))
    got = licences(spark, [(1, "a/LICENSE", dict(BODIES)[left_out]), (2, "a/b.c", "x"), (3, "b/LICENSE", dict(BODIES)["MIT"])])
    assert got == {"a/LICENSE": (None, "none"), "a/b.c": (None, "none"), "b/LICENSE": ("MIT", "own")}


# -- personal data ------------------------------------------------------------------------------------------------

WORDS = "we met her there on the last day of a long and quiet summer when nobody had much to say about it".split()
DIGITS = "zero one two three four five six seven eight nine".split()


def planted(rng):
    """A disguised identifier, its kind, and the disguise."""
    user, host, last = rng.choice(["anna.b", "j_doe", "max", "info-x"]), rng.choice(["mail", "acme-corp", "uni7"]), rng.choice(["com", "org", "de", "example"])
    phone = "".join(rng.choice("0123456789") for _ in range(rng.randint(10, 13)))
    spelled = lambda digits, gap: gap.join(DIGITS[int(d)] for d in digits)
    ip = [str(rng.randint(0, 255)) for _ in range(4)]
    return rng.choice([
        (f"{user} at {host} dot {last}", "email"), (f"{user} [at] {host} [dot] {last}", "email"), (f"{user}(at){host}.{last}", "email"),
        (f"{user}@{host} dot {last}", "email"), (f"{user}@{host}​.{last}", "email"), (f"{user}@{host}.{last}".replace("a", "а"), "email"),
        (" dot ".join(ip), "ip"), (" [.] ".join(ip), "ip"), (".".join(ip).translate({48 + k: 0xFF10 + k for k in range(10)}), "ip"),
        ("plus " + spelled(phone, " "), "phone"), ("+" + spelled(phone, "-"), "phone"), ("+" + phone[:6] + " " + spelled(phone[6:], " "), "phone"),
    ])


def test_planted_disguises():
    """Recall of what is planted, by its span and kind."""
    rng = random.Random(1)
    found = 0
    for _ in range(600):
        before, after = (" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(2))
        disguise, kind = planted(rng)
        text = f"{before}: {disguise}; {after}"
        start, end = len(before) + 2, len(before) + 2 + len(disguise)
        found += any(k == pii.KINDS.index(kind) and s <= start + 1 and e >= end - 1 for s, k, e in pii.find_all(text)[1])
    assert found >= 0.97 * 600


@pytest.mark.parametrize("text", [
    "meet at noon dot matrix", "one at two dot three", "look at this dot that way", "we met at eight, nine of us", "a dot at the end", "at dot com", "plus one more",
    "one two three four five", "arrive at seven dot then leave", "sit at table nine dot nobody minds", "the at sign (at) and the dot sign (dot)",
])
def test_plain_prose_holds_nothing(text):
    assert pii.find_all(text) == ([], [])


@pytest.mark.parametrize("text", ["7" * 1_000_000, "one " * 200_000, "1." * 300_000, "+1" + " (" * 300_000, "a@b.co " * 100_000 + "x (at) y (dot) org", "1 " * 400_000, "x at a dot " * 60_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    pii.find_all(text)
    assert time.process_time() - began < 6  # about a second or less on an idle machine


def test_addresses_by_the_plain_pattern():
    import re

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("0123.. a2", k=rng.randint(1, 40)))
        plain = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for s, k, e in pii.find_plain(text) if k == 1] == plain


def test_every_text_that_a_transducer_changes_is_read():
    """No signs are asked for before: an unbracketed "at" needs no spelled "dot" (F12)."""
    text = "write to john.doe at example.com today"
    assert pii.find_all(text) == ([], [(9, 0, 32)])

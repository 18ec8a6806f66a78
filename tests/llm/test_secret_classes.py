"""Each class of the entropy windows can fire, words do not, and long texts full of secrets stay linear."""

import random
import string
import time

import pytest

from marlstone.llm import secret_scan as S

ALPHABETS = {
    "digits": string.digits, "hex": "0123456789ABCDEF", "one case": string.ascii_lowercase, "one case, upper": string.ascii_uppercase, "letters": string.ascii_letters, "mixed": string.ascii_letters + string.digits,
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_each_class_fires(name):
    rng = random.Random(1)
    runs = ["".join(rng.choices(ALPHABETS[name], k=rng.randrange(24, 65))) for _ in range(400)]
    assert sum(S._class(r) == name.split(",")[0] for r in runs) > 380
    found = [S.find_secrets(f"is {r} here")[1] for r in runs]
    assert sum(bool(f) for f in found) >= 0.9 * len(runs)


@pytest.mark.parametrize("word", [
    "incomprehensibilities-and-electroencephalographically", "antidisestablishmentarianism", "MAX_CONNECTION_TIMEOUT_SECONDS", "donaudampfschifffahrtsgesellschaft", "src/main/resources/static/index", "get_user_by_name_and_password_or_raise",
    "rindfleischetikettierungsueberwachungsaufgabenuebertragungsgesetz", "-" * 40, "the-quick-brown-fox-jumps-over-the-lazy-dog",
])
def test_words_do_not(word):
    assert S.find_secrets(word)[1] == []


def test_spans_inside_base_spans_add_nothing():
    rng = random.Random(2)
    parts = []
    for _ in range(300):
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(24, 60)))
        parts.append(rng.choice(["token=" + key, key, "password: " + key + "+" + key, "AKIA" + key.upper(), "plain words"]))
    text = " ".join(parts)
    base, both = S.find_secrets(text)
    want = [s for s in S.entropy_spans(text) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
    assert both == sorted(base + want, key=lambda s: (s[0], S.KINDS.index(s[2]))) and want


def test_long_text_full_of_secrets():
    rng = random.Random(3)
    text = " ".join("token: " + "".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(46_000))
    assert len(text) > 2 << 20
    began = time.perf_counter()
    base, _ = S.find_secrets(text)
    assert len(base) == 46_000 and time.perf_counter() - began < 10

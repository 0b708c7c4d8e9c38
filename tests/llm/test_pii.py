import random
import re

import pytest

from ledgerloom.llm import pii


def plain(t):
    """The base patterns, tried as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }


@pytest.mark.parametrize("letters", ["ab@.-1 ", "0123456789.. -", "+12 ().-9a", "12.@+ -a٣"])
def test_base_spans(letters):
    random.seed(len(letters))
    for _ in range(3000):
        t = "".join(random.choices(letters, k=random.randint(0, 40)))
        assert pii.find(t) == plain(t)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("to john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("plus one five five five zero one two three four five six", "phone", "plus one five five five zero one two three four five six"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("double four one one one one one one one one one one one one one one", "card", None),
    ],
)
def test_disguises(text, kind, found):
    got = [text[s:e] for s, e in pii.extra(text, pii.find(text))[kind]]
    assert got == ([found] if found else [])


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("at 192.168.one.1 now", "ip", "192.168.one.1"),
        ("pay 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
        ("john\tat\texample\tdot\tcom", "email", "john\tat\texample\tdot\tcom"),
        ("john\t@\texample.com", "email", "john\t@\texample.com"),
    ],
)
def test_every_rule_is_tried_on_every_text(text, kind, found):
    assert [text[s:e] for s, e in pii.extra(text, pii.find(text))[kind]] == [found]


def test_plain_texts_gain_nothing():
    for t in ("He is at home. The dots are 10.5 and one two.", "a" * 5000, "1" * 5000, "+" * 3000):
        assert not any(pii.extra(t, pii.find(t)).values())


def test_redaction():
    t = "mail a@b.co or call +1 (377) 555-0271."
    assert pii.redact(t, pii.find(t)) == "mail <email> or call <phone>."


def test_rows(spark):
    rows = spark.createDataFrame([(1, "x 1.2.3.4", "s"), (1, "x 1.2.3.4", "s"), (2, None, "s"), (None, "", "s")], "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or 0, r["n_ip"], r["spans"]) for r in pii.scan(rows).collect())
    assert got == [(0, 0, ""), (1, 1, "ip:2:9"), (1, 1, "ip:2:9"), (2, 0, "")]
    assert pii.scan(rows, redacted=True).where("doc_id = 1").first()["redacted"] == "x <ip>"
    assert pii.scan(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("call plus 1 555 555 0199 now", "phone", "plus 1 555 555 0199"),
        ("ring plus 33 6 12 34 56 78.", "phone", "plus 33 6 12 34 56 78"),
        ("ring +1 five 55 555 0199 soon", "phone", "+1 five 55 555 0199"),
        ("llame más 34 612 345 678 ya", "phone", "más 34 612 345 678"),
        ("write jean arobase exemple point fr ou", "email", "jean arobase exemple point fr"),
        ("an max ät web punkt de bitte", "email", "max ät web punkt de"),
        ("a ana arroba correo punto example punto es y", "email", "ana arroba correo punto example punto es"),
        ("to jean point paul arobase exemple point fr ou", "email", "jean point paul arobase exemple point fr"),
        ("reach john at example.com today", "email", "john at example.com"),
        ("reach john (klammeraffe) example (punkt) com", "email", "john (klammeraffe) example (punkt) com"),
        ("uno nueve dos punto uno seis ocho punto uno punto uno", "ip", "uno nueve dos punto uno seis ocho punto uno punto uno"),
        ("host 10 point 0 point 0 point 7 down", "ip", "10 point 0 point 0 point 7"),
    ],
)
def test_spoken_forms_of_four_languages(text, kind, found):
    assert [text[s:e] for s, e in pii.extra(text, pii.find(text))[kind]] == [found]


@pytest.mark.parametrize("text", ["visit us at example.com", "write a@b.com point the way", "at this point we look at home. The end", "un point de vue", "zwei Punkt drei", "more than one dot is here", "found at www.example.org"])
def test_common_words_stay(text):
    assert not any(pii.extra(text, pii.find(text)).values())


#: Words for signs and digits, language by language, written out again.
LANGUAGES = {
    "en": ("at", "dot", "plus", "zero one two three four five six seven eight nine"),
    "fr": ("arobase", "point", "plus", "zéro un deux trois quatre cinq six sept huit neuf"),
    "de": ("ät", "punkt", "plus", "null eins zwei drei vier fünf sechs sieben acht neun"),
    "es": ("arroba", "punto", "más", "cero uno dos tres cuatro cinco seis siete ocho nueve"),
}


def disguised(plain, language, how):
    """An identifier rewritten sign by sign: the inverse of what the transducers do."""
    at, dot, plus, digits = LANGUAGES[language]
    digits = digits.split()
    if how == "spoken":
        return plain.replace("@", f" {at} ").replace(".", f" {dot} ")
    if how == "bracketed":
        return plain.replace("@", f" [{at}] ").replace(".", f" ({dot}) ")
    if how == "alike":
        return plain.translate(str.maketrans("aeopc0123456789", "аеорс０１２３４５６７８９"))
    out = [f" {digits[int(c)]} " if c.isdigit() else f" {plus} " if c == "+" else f" {dot} " if c == "." else c for c in plain]
    return " ".join("".join(out).split())


def test_planted_disguises_are_found_where_they_stand():
    random.seed(12)
    for _ in range(1500):
        language = random.choice(list(LANGUAGES))
        kind = random.choice(["email", "ip", "phone", "card"])
        if kind == "email":
            plain, hows = f"{random.choice(['jean', 'ana.perez', 'max_m', 'x9'])}@{random.choice(['exemple', 'web.example', 'correo-e'])}.{random.choice(['fr', 'de', 'com', 'org'])}", ["spoken", "bracketed", "alike"]
        elif kind == "ip":
            plain, hows = ".".join(str(random.randint(0, 255)) for _ in range(4)), ["spoken", "spelled", "alike", "bracketed"]
        elif kind == "phone":
            plain, hows = "+" + "".join(random.choices("123456789", k=random.randint(9, 13))), ["spelled", "alike"]
        else:
            body = "4" + "".join(random.choices("0123456789", k=14))
            plain, hows = next(body + c for c in "0123456789" if pii.luhn(body + c)), ["spelled", "alike"]
        told = disguised(plain, language, random.choice(hows))
        before, after = random.choice(["", "Zum Beispiel: ", "le texte. ", "« "]), random.choice(["", ", y más texto", "; end", "\nnext line"])
        text = before + told + after
        spans = pii.find(text)
        every = spans[kind] + pii.extra(text, spans)[kind]
        assert (len(before), len(before) + len(told)) in every, (text, kind, every)


def test_rules_passed_over_change_nothing(monkeypatch):
    random.seed(3)
    words = "at AT ät arobase dot point punto plus MÁS one deux vier null «one ſeven sİx sıx two’ (at) [.] < . > @ x@y .com 1 22 3.4 İ ı a b-c é_ _one ".split(" ")
    texts = ["".join(w + random.choice([" ", "", "\t", ".", "-", "é"]) for w in random.choices(words, k=12)) for _ in range(3000)]
    quick = [pii.normalise(t).text for t in texts]
    monkeypatch.setattr(pii, "_NO_PLAIN", re.compile(""))
    assert quick == [pii.normalise(t).text for t in texts]


def test_long_texts_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.process_time()
        for piece in ("a at b", "a dot ", "a point ", "x@y.z ", "one ", "+1 ", "4", "[ ", "a.b"):
            text = piece * n
            pii.extra(text, pii.find(text))
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 16 * max(seconds(5000), 0.05)

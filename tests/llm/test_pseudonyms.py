"""Against a plain form of the permutations, value by value."""

import hashlib
import random

from notewell.llm import pii, queries

KEY = "of tests"


def word(secret, round_, other, place):
    digest = hashlib.sha256(f"{secret}|{round_}|{other}".encode()).hexdigest()
    at = place * 3 % 60
    return int(digest[at : at + 4], 16)


def moved(c, by):
    for first, size in (("0", 10), ("a", 26), ("A", 26)):
        if first <= c < chr(ord(first) + size):
            return chr(ord(first) + (ord(c) - ord(first) + by) % size)
    return c


def permuted(text, secret):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(pii.ROUNDS):
        a, b = b, "".join(moved(c, word(secret, r, b, j)) for j, c in enumerate(a))
    return a + b


def luhn(digits):
    total = 0
    for j, c in enumerate(reversed(digits)):
        v = int(c) * (1 + j % 2)
        total += v - 9 if v > 9 else v
    return total % 10


def card(digits):
    body = permuted(digits[:-1], KEY + "card")
    return next(body + str(c) for c in range(10) if luhn(body + str(c)) == 0)


def address(text):
    n = 0
    for part in text.split("."):
        n = n * 256 + int(part)
    a, b = divmod(n, 65536)
    for r in range(pii.ROUNDS):
        a, b = b, (a + word(KEY + "address", r, b, 0) + 65536 * word(KEY + "address", r, b, 7)) % 65536
    n = a * 65536 + b
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def test_every_value_as_the_plain_form_has_it(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for d in range(120):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        good = next(digits + str(c) for c in range(10) if luhn(digits + str(c)) == 0)
        bad = good[:-1] + str((int(good[-1]) + 1) % 10)
        mail = "".join(rng.choice("abcXYZ019._") for _ in range(rng.randint(1, 12))) + "q"
        social = f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10000):04}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        text = "card {} not {} mail {}@mail.example.com social {} from {} far 300.1.2.3 end"
        rows.append((d, text.format(good, bad, mail, social, ip)))
        wanted[d] = text.format(card(good), bad, permuted(mail, KEY + "email"), permuted(social, KEY + "social"), address(ip))
    got = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert {d: r.text for d, r in got.items()} == wanted
    changed = {d: sum(x != y for x, y in zip(dict(rows)[d].split(), wanted[d].split(), strict=True)) for d in wanted}
    assert {d: r.n_found for d, r in got.items()} == changed and set(changed.values()) <= {3, 4}


def test_edge_cases(spark):
    same = "write to ann@x.example.com or +1 (212) 555-0199"
    rows = [(1, same, "a", 5), (1, same, "a", 5), (2, None, "b", 6), (3, "", "c", 7), (4, "not 4111111111111112", "d", 8), (None, same, "e", 9), (5, ("plain words 12 " * 40_000) + "ann@x.example.com", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_m` string, n_found int")
    out = pii.pseudonymised(docs, KEY)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == 7 and len({r.text for r in got if r._m in "ae"}) == 1
    assert [r.text for r in got if r._m in "bcd"] == [None, "", "not 4111111111111112"]
    name = next(r.text for r in got if r._m == "a").split()[2]
    assert next(r.text for r in got if r._m == "f").endswith(" " + name) and name != "ann@x.example.com"
    counts = {(r.doc_id, r.n_found) for r in pii.found(docs, KEY).collect()}
    assert counts == {(1, 2), (2, None), (3, 0), (4, 0), (None, 2), (5, 1)}
    assert pii.found(docs.limit(0), KEY).count() == 0


def test_another_key_gives_others(spark):
    docs = spark.createDataFrame([(1, "ann.smith@x.example.com")], "doc_id long, text string")
    assert len({pii.pseudonymised(docs, k).first().text for k in ("a", "b", queries.PII_KEY)}) == 3

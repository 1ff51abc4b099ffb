"""Classes of disguised personal data, and what looks like a secret and is none."""

import random
import string
import unicodedata

import pytest

from barlake.llm import pii, secrets


def told(text):
    base = pii.find(text)
    return {(kind, text[s:e]) for s, e, kind in base + pii.disguised(text, base)}


def styled(word, first_small, first_digit=None):
    """The word in another alphabet of the same order."""
    return "".join(chr(first_small + ord(c) - 97) if "a" <= c <= "z" else chr(first_digit + int(c)) if c.isdigit() and first_digit else c for c in word)


@pytest.mark.parametrize(
    "disguise",
    [
        lambda x: styled(x, 0x1D423 - 9),  # mathematical bold
        lambda x: styled(x, 0x24D0),  # circled
        lambda x: styled(x, 0xFF41).replace("@", "＠"),
        lambda x: x.replace("@", "&#64;").replace(".", "&#46;"),
        lambda x: x.replace("@", "&commat;").replace(".", "&period;"),
        lambda x: x.replace("@", "&#x40;"),
        lambda x: " ".join(x),
        lambda x: x.replace("@", "-at-").replace(".", "-dot-"),
        lambda x: x.replace("@", "_at_").replace(".", "_dot_"),
        lambda x: x.replace("@", " (at) ").replace(".", " (dot) "),
        lambda x: x.replace("@", "​@​"),
    ],
)
def test_disguised_addresses_are_found_whole(disguise):
    rng, found = random.Random(3), 0
    for _ in range(100):
        name, host = ("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(2))
        hidden = disguise(f"{name}@{host}.{rng.choice(['com', 'org', 'de', 'net'])}")
        found += ("email", hidden) in told(f"Please ask: {hidden} , any day.")
    assert found >= 90


def test_digits_of_all_scripts():
    zeros = [c for c in range(0x80, 0x1FFFF) if unicodedata.decimal(chr(c), None) == 0]
    assert len(zeros) > 50
    for z in zeros:
        hidden = "+" + "".join(chr(z + int(c)) for c in "49301234567")
        assert ("phone", hidden) in told(f"call {hidden} now"), hex(z)
    card = "".join(chr(0x966 + int(c)) for c in "4111111111111111")
    assert ("card", card) in told(card)


def test_spaced_letters_end_with_the_address():
    assert told("write to j a n e @ m a i l . c o m I am here") == {("email", "j a n e @ m a i l . c o m")}


@pytest.mark.parametrize("text", ["look-at-me-dot-dot-com", "a b c @ d e f", "as in note⁴ of x² at 3½ … &#8230; &#7;", "state-of-the-art", "at-at-at dot-dot-dot", "", "@", "&#64;"])
def test_what_is_no_identifier(text):
    assert told(text) == set()


@pytest.mark.parametrize("text", ["a " * 100_000 + "@ b c . d", "a-" * 100_000 + "at-x", "-at-x-dot-" * 20_000, "a @ b " * 20_000, "x-at-" * 30_000, "&#64;" * 20_000, "\U0001d423" * 50_000])
def test_long_disguises_end(text):
    pii.disguised(text, [])


def everyday():
    """200 paths, names and numbers that have digits and separators and are no secrets."""
    rng = random.Random(11)
    words = "world europe health release notes access report summer window market guide review history travel update images archive product season weather".split()
    plain = """uk/news/world-europe-56720589 org/2019/07/04/how-to-fix-it /var/log/nginx/access-2021-03-04 release-notes-2021-03-04-v2
        ISO-8859-1/UTF-8/ISO-8859-15 dp/B07XJ8C8F5/ref=sr_1_3 cp313-cp313-manylinux_2_17_x86_64 ENST00000380152_7 DE89370400440532013000
        x86_64-linux-gnu-gcc-12 en-us/articles/360001234567-Reset-password questions/11227809/why-is-processing-a-sorted-array
        IMG_20210304_123456 covid-19/by-country/2020-w12 GSE123456_series_matrix chr17_43044295_43125483 BRCA1_HUMAN/P38398-2
        2021-03-04T12-00-00Z_backup iPhone12ProMax256GB RTX4090-24GB-GDDR6X SM-G991B/DS-256GB win32-x64-105-node14 H1N1-H5N1-SARS-CoV-2
        wp-content/uploads/2019/03/IMG-20190312-WA0012 1280x720-800x600-640x480 utf8mb4_unicode_520_ci TLS_AES_256_GCM_SHA384
        TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256 arn/us-east-1/t2-micro-4 python3-pip-20-0-2-5ubuntu1 com/2021/3/4/22313936/apple-m1
        status/1367890123456789012 org/wiki/F-16_Fighting_Falcon a1-b2-c3-d4-e5-f6-g7 KB5000802-x64-21H1-20H2 MP3-320kbps-44100Hz r2d2-c3po-bb8-k2so""".split()
    shapes = [
        lambda w, n: f"{w[0]}/{n % 30 + 1990}/{n % 12 + 1}/{w[1]}-{w[2]}-{n}",
        lambda w, n: f"/var/{w[0]}/{w[1]}-{n % 30 + 1990}-{n % 12 + 1:02d}-{n % 28 + 1:02d}",
        lambda w, n: f"{w[0]}_{w[1]}_{n}_v{n % 9}",
        lambda w, n: f"{w[0].upper()}{n % 99}-{w[1].upper()}-{n}",
        lambda w, n: f"{w[0].title()}{w[1].title()}{n % 99}/{w[2]}{n % 9}",
    ]
    while len(plain) < 200:
        plain.append(rng.choice(shapes)(rng.sample(words, 3), rng.randrange(10**7)))
    return plain


def test_everyday_names_are_no_secrets():
    enc = secrets.encoding(secrets.vocabulary())
    assert [x for x in everyday() if secrets.token_spans(x, enc, 2.4, [])] == []


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters])
def test_random_keys_are_secrets(alphabet):
    enc, rng, found = secrets.encoding(secrets.vocabulary()), random.Random(7), 0
    for k in range(500):
        key = "".join(rng.choices(alphabet, k=16 + k % 25))
        found += bool(secrets.token_spans(key, enc, 2.4, []))
    assert found >= 475

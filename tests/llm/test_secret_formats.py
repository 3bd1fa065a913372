"""One case of each format of a secret, among values that are none."""

import random
import string

import pytest

from rankloom.llm.secret_scan import candidates, findings, redacted

SCHEMA = "doc_id long, text string"


def letters(seed, n, of=string.ascii_letters + string.digits):
    return "".join(random.Random(seed).choices(of, k=n))


HEX = letters(1, 32, "0123456789abcdef")
PEM = [letters(i, 64) for i in (5, 6)]
JWT = ("eyJhbGciOiJIUzI1NiJ9", "eyJ" + letters(7, 60) + "9x", letters(8, 43) + "7")
SECRETS = {
    "aws": ("AWS_SECRET_ACCESS_KEY={}", [letters(2, 39) + "7"]),
    "secret_key": ('secret_key = "{}"', [HEX]),
    "long name": ('aws_secret_access_key = "{}"', [HEX[::-1]]),
    "private_key": ("private_key: {}", [HEX[3:] + "abc"]),
    "github": ("see {} there", ["ghp_" + letters(3, 36)]),
    "stripe": ("see {} there", ["sk_live_" + letters(4, 24)]),
    "password": ("password={}", ["Tr0ub4dor3xy"]),
    "pem": ("-----BEGIN RSA PRIVATE KEY-----\n{}\n{}\n-----END RSA PRIVATE KEY-----", PEM),
    "jwt": ("Authorization {}.{}.{} sent", list(JWT)),
}
HARMLESS = ["commit " + HEX[::-1] + "01234567", "card 4111111111111111", "uuid 123e4567-e89b-42d3-a456-426614174000", "/usr/share/lib64/python3/site2"]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [f"some words before {form.format(*values)} and after" for form, values in SECRETS.values()]
    texts += [f"some words before {h} and after" for h in HARMLESS * 8]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return texts, {r.doc_id: r.text for r in redacted(docs, findings(docs)).collect()}


@pytest.mark.parametrize("name", list(SECRETS))
def test_each_format_is_found(scanned, name):
    clean = scanned[1][list(SECRETS).index(name)]
    assert not any(v in clean for v in SECRETS[name][1]) and clean.count("[secret]") == len(SECRETS[name][1])


def test_harmless_values_stay(scanned):
    assert all(scanned[1][i] == t for i, t in enumerate(scanned[0]) if i >= len(SECRETS))


def test_values_without_digits_are_candidates(spark):
    token = "qWeRtYuIopAsDfGhJk"
    texts = ["my password: CorrectHorseBatteryStaple yes", f"see {token} there", f"api_key = {token[::-1]}", "secret: correcthorsebatterystaple"]
    texts += ["a plain internationalisation of it", "Note: internationalisation", "the class StreamingQueryListener of it"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    seen = {r.doc_id: r.value for r in candidates(docs).collect()}
    assert {i: seen.get(i) for i in range(5)} == {0: "CorrectHorseBatteryStaple", 1: token, 2: token[::-1], 3: "correcthorsebatterystaple", 4: None}
    clean = {r.doc_id: r.text for r in redacted(docs, findings(docs)).collect()}
    assert clean[0] == "my password: [secret] yes" and clean[2] == "api_key = [secret]"
    assert all(clean[i] == t for i, t in enumerate(texts) if i >= 4)


SHORT = {
    "password=Tr0ub4dor3": "password=[secret]",
    "db_password: s3cr3t!pass#word9, then": "db_password: [secret], then",
    "postgres://user:Zk39xQpL77@db.host/x": "postgres://user:[secret]@db.host/x",
    "passwd = 'a.b@c:d9#' and more": "passwd = '[secret]' and more",
    "one pwd=q1w2e3 two PASSWORD=\"Z9!z8?y7\" end": "one pwd=[secret] two PASSWORD=\"[secret]\" end",
}
NO_VALUES = ["password: please", "password = get_password()", "pwd=${DB_PWD}", "http://host:8080/a@b", "password: <your-password>", "the password is short"]


def test_short_values_and_their_places(spark):
    texts = [f"é😀 {t}" for t in SHORT] + NO_VALUES * 3 + [""]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], SCHEMA)
    seen = findings(docs).collect()
    assert all(texts[r.doc_id][r.start : r.start + len(r.value)] == r.value for r in seen)
    assert len({(r.doc_id, r.start) for r in seen}) == len(seen)
    clean = {r.doc_id: r.text for r in redacted(docs, findings(docs)).collect()}
    assert [clean[i] for i in range(len(SHORT))] == [f"é😀 {t}" for t in SHORT.values()]
    assert all(clean[i] == t for i, t in enumerate(texts) if i >= len(SHORT))


def test_runs_inside_a_given_value_are_no_candidates_of_their_own(spark):
    token = "abcdefghijkl9" + "!xyzxyzxyzxyz7"
    docs = spark.createDataFrame([(1, f"password: {token} and token={HEX} end")] * 2, SCHEMA)
    assert sorted(r.value for r in candidates(docs).collect()) == sorted([token, HEX])

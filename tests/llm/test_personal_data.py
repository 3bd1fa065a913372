"""Personal data against the plain patterns and a plain count of the corpus."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from rankloom.llm.personal_data import PersonalData, _luhn, entities, personal_data, sanitised

SCHEMA = "doc_id long, text string, KEY_A string, spans int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_entities(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            value = m.group()
            digits = re.sub("[^0-9]", "", value)
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_luhn():
    assert _luhn("4111111111111111") and _luhn("79927398713") and not _luhn("4111111111111112")


@pytest.mark.parametrize("alphabet", ["a@.b- ", "01.2 5-", "+1 ()2.3-", "a1@.+ -4ü0", "4 1-"])
def test_entities_equal_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert entities(text) == plain_entities(text), text
    card = "".join(rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", " 1.2.3.255.4 ", "+1 (499) 555-6503", "x@y.zz@q.r"]) for _ in range(40))
    assert entities(card) == plain_entities(card)


def test_very_long_runs_take_linear_time():
    for run in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" + "(" * 500_000, "a@" * 300_000, "@" * 500_000):
        assert len(entities(run)) <= 130_000


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in for ünd on at by from data work text line page".split())
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [fill(rng.randint(0, 60)) for _ in range(120)]
    for _ in range(12):
        texts.append(f"{fill(20)} Zebrowski {word()} zeb@mail.example.com {word()} {fill(rng.randint(0, 9))}")
        texts.append(f"{fill(9)} call {word()} +1 (499) 555-6503 {fill(8)} Sometimes {fill(30)}")
    texts += [f"{fill(30)} Sometimes {fill(3)}" for _ in range(3)] + [f"{fill(40)} saw Zebrowski ü Zebrowskis {fill(4)}"]
    texts += [f"copied unique words near one@host.example.org {fill(0)}"] * 30
    return [(i, t) for i, t in enumerate(texts)] + [(7, None), (None, "q@w.e"), (7, "q@w.e"), (7, "q@w.e"), (1000, "")]


def plain_words(text):
    return [(m.start(), m.end(), m.group().lower() if m.group().isascii() else m.group()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def brute_terms(rows, how):
    texts = [t or "" for _, t in rows]
    near, contexts, n_entity, n_term = Counter(), defaultdict(set), Counter(), Counter()
    for text in texts:
        spans, seen, clean = entities(text), set(), text
        n_term.update(w for _, _, w in plain_words(text))
        for _, s, e in spans:
            clean = clean[:s] + " " * (e - s) + clean[e:]
        for kind, s, e in spans:
            value = text[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])
            n_entity[kind, value] += 1
            around = [(a, w) for a, b, w in plain_words(clean) if a >= s - how.reach and b <= e + how.reach]
            for a, w in around:
                if len(w.encode()) >= how.letters and (kind, value, a) not in seen:
                    seen.add((kind, value, a))
                    near[kind, value, w] += 1
                    contexts[kind, value, w].add(" ".join(x for _, x in around))
    shares = {}
    for (kind, value, w), n in near.items():
        own = math.log2(len(texts) / n_entity[kind, value])
        if len(contexts[kind, value, w]) >= how.support and own > 0:
            share = math.log2(n * len(texts) / (n_term[w] * n_entity[kind, value])) / own
            if share >= how.generalise:
                shares[w] = max(share, shares.get(w, 0))
    return shares


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_equal_a_plain_count(spark, seed):
    rows, how = corpus(seed), PersonalData()
    shares = brute_terms(rows, how)
    assert "zebrowski" in shares and "the" not in shares and "unique" not in shares
    wanted = []
    for i, text in rows:
        spans = plain_entities(text or "")
        terms = [("term", a, b) for a, b, w in plain_words(text or "") if w in shares and all(b <= s or a >= e for _, s, e in spans)]
        wanted.append((i, *(sum(s[0] == k for s in spans) for k in PATTERNS), ",".join(f"{k}:{s}:{e}" for k, s, e in spans + terms)))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = personal_data(docs)
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in found.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    clean = [r.text for r in sanitised(docs, found).collect()]
    assert len(clean) == len(rows) and clean.count(None) == 1
    assert not any(t and ("zeb@" in t or "Zebrowski " in t or "555-6503" in t) for t in clean)
    assert any(t and "[email]" in t for t in clean) and any(t and "Zebrowskis" in t for t in clean)


def test_no_documents_and_very_long_texts(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "word " * 100_000 + "me@x.yz " + "ü" * 50_000
    docs = spark.createDataFrame([(1, long, "x", 1), (2, "clean", "x", 1)], SCHEMA)
    assert sorted((r.doc_id, r.spans) for r in personal_data(docs).collect()) == [(1, "email:500000:500007"), (2, "")]

"""The mixture against its targets where cells or values cannot give what the targets ask for."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm.mixing import Mixing, calibrate, margins, mix

SCHEMA = "doc_id long, text string, lang string, source string"


def reached(cells, weights, share):
    whole = sum(t for _, t in cells)
    sums = [defaultdict(float) for _ in range(3)]
    for key, tokens in cells:
        for i, v in enumerate(key):
            sums[i][v] += tokens / whole * weights[key] * share
    return [{v: x / share for v, x in s.items()} for s in sums]


def test_others_give_what_a_full_cell_cannot():
    cells = [(("a", "x", "t"), 40.0), (("a", "y", "t"), 20.0), (("b", "x", "t"), 16.0), (("b", "y", "t"), 24.0)]
    how = Mixing(targets={"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"t": 1.0}}, rounds=200)
    weights, share = calibrate(cells, how)
    assert share == 0.5 and max(weights.values()) == pytest.approx(2.0)
    found = reached(cells, weights, share)
    for margin, got in zip(("source", "lang", "topic"), found, strict=True):
        assert got == pytest.approx(how.targets[margin], abs=1e-6)


def test_margins_that_cannot_be_had_together_lower_the_draw():
    cells = [(("a", "x", "t"), 1.0), (("a", "y", "t"), 59.0), (("b", "x", "t"), 39.0), (("b", "y", "t"), 1.0)]
    how = Mixing(targets={"source": {"a": 0.45, "b": 0.55}, "lang": {"x": 0.45, "y": 0.55}, "topic": {"t": 1.0}}, least_share=0.0, rounds=500)
    weights, share = calibrate(cells, how)
    assert 0 < share < 0.5 and max(weights.values()) * share <= 1 + 1e-9
    for margin, got in zip(("source", "lang", "topic"), reached(cells, weights, share), strict=True):
        assert got == pytest.approx(how.targets[margin], abs=1e-5)


def test_the_draw_is_lowered_to_what_a_target_needs(spark):
    rows = [(i, "ten words " * 5, "en" if i < 950 else "de", "s") for i in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    how = Mixing(targets={"lang": {"en": 0.75, "de": 0.25}})
    out = mix(docs, how)
    assert {r.lang: r.probability for r in out.select("lang", "probability").distinct().collect()} == {
        "de": pytest.approx(1.0), "en": pytest.approx(150 / 950)}
    got = {r.value: (r.target, r.achieved) for r in margins(out, how).filter("margin = 'lang'").collect()}
    assert got == {"en": pytest.approx((0.75, 0.75)), "de": pytest.approx((0.25, 0.25))}


def test_a_tiny_value_does_not_take_the_draw_away():
    cells = [(("a", "x", "t"), 1.0), (("b", "x", "t"), 999.0)]
    weights, share = calibrate(cells, Mixing(targets={"source": {"a": 0.5, "b": 0.5}}))
    assert share == 0.1 and weights[cells[0][0]] == pytest.approx(10.0)
    assert sum(t * weights[k] * share for k, t in cells) == pytest.approx(100.0)


def test_every_source_has_its_own_target(spark):
    rows = [(i, "two words " * (1 + i % 3), "en" if i // 100 % 3 else "de", f"s{i % 100}") for i in range(600)]
    rows += [(600 + i, "two words", "en" if i else "de", "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    how = Mixing(targets={"source": {"rare": 0.01, **{f"s{i}": 0.0099 for i in range(100)}}})
    out = mix(docs, how)
    got = {r.value: (r.target, r.achieved) for r in margins(out, how).filter("margin = 'source'").collect()}
    assert len(got) == 101 and all(reached == pytest.approx(target, abs=1e-6) for target, reached in got.values())
    assert all(r.probability > 0 for r in out.filter("source = 'rare'").collect())


@pytest.mark.parametrize("given", [{}, {"lang": {"en": 0.5, "de": 0.5}}, {"source": {"a": 0.7, "c": 0.3}}])
def test_tables_of_cells_are_raked_as_in_the_driver(spark, given):
    rows = [(i, "two words " * (1 + i % 5) + ("| a |" if i % 7 == 0 else ""), ["en", "de", "fr"][i % 11 % 3], "abc"[i * i % 3]) for i in range(120)]
    docs = spark.createDataFrame([*rows, (120, None, "en", "z"), (121, "x y", None, "a")], SCHEMA)
    seen = []
    for cells in (1 << 16, 0):
        out = mix(docs, Mixing(targets=given, rounds=4, cells=cells)).collect()
        seen.append({r.doc_id: (r.weight, r.probability, r.kept) for r in out})
    assert seen[0].keys() == seen[1].keys() and len(seen[0]) == 122
    for key, row in seen[0].items():
        assert seen[1][key] == pytest.approx(row, rel=1e-6, abs=1e-9)


def test_the_whole_draw_equals_a_second_writing(spark):
    signs = [("legal", r"licen[sc]ed? under|all rights reserved|general public license"), ("table", r"\|[^|\n]*\|"), ("contact", r"@[\w-]+\.")]
    tails = ["", " | a | b |", " ask me@there.org", " All rights reserved | x |"]
    rows = [(i if i % 17 else None, f"text {i}" + " of words" * (i * i % 23) + tails[i * 7 % 11 % 4], ["en", "de", None][i % 5 % 3], "abcd"[i * i % 7 % 4]) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "", "de", "b"), rows[3], rows[3]]
    how = Mixing(share=0.1, least_share=0.05, rounds=500)
    cells, seen = defaultdict(int), []
    for i, text, lang, source in rows:
        kind = next((k for k, sign in signs if re.search(sign, text or "", re.IGNORECASE)), "prose")
        cell, n = (source or "(none)", lang or "(none)", kind), len(re.findall("[^\\x20\\x09-\\x0D]+", text or ""))
        cells[cell] += n
        name = str(i) if i is not None else hashlib.md5(text.encode()).hexdigest()
        seen.append((i, cell, n, int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:12], 16) / 2**48))
    axes = [sorted({c[k] for c in cells}) for k in range(3)]
    now = np.zeros([len(a) for a in axes])
    for cell, n in cells.items():
        now[tuple(a.index(v) for a, v in zip(axes, cell, strict=True))] = n
    now /= now.sum()
    raked = now.copy()
    for _ in range(2000):
        for k in range(3):
            others = tuple(j for j in range(3) if j != k)
            wanted = np.sqrt(now.sum(axis=others))
            step = wanted / wanted.sum() / raked.sum(axis=others)
            raked *= np.expand_dims(step, others)
    weight = np.divide(raked, now, out=np.ones_like(now), where=now > 0)
    assert weight.max() * 0.1 < 1
    wanted = []
    for i, cell, n, draw in seen:
        w = weight[tuple(a.index(v) for a, v in zip(axes, cell, strict=True))]
        wanted.append((str(i), *cell, n, pytest.approx(w, rel=1e-6), pytest.approx(w * 0.1, rel=1e-6), bool(draw < w * 0.1)))
    out = mix(spark.createDataFrame(rows, SCHEMA), how).collect()
    got = [(str(r.doc_id), r.source, r.lang, r.topic, r.n_tokens, r.weight, r.probability, r.kept) for r in out]
    order = lambda r: (r[:5], r[7])
    assert len(got) == len(wanted) and sorted(got, key=order) == sorted(wanted, key=order)
    assert 5 < sum(r[7] for r in got) < 100


def test_margins_of_nothing(spark):
    assert margins(mix(spark.createDataFrame([], SCHEMA))).collect() == []
